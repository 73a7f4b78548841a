"""JSON lines that are read only if their bytes are what they should be."""

from __future__ import annotations

import hashlib
import itertools
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.operators import ordering
from loomwell.operators.audit import IntegrityError, expect_none
from loomwell.sources import files


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), value, size of the file: all lines as their bytes are, parted by line feeds alone.

    Files are read in blocks, as Spark splits them; lines are numbered by block and by
    their place in it with running sums, so a file of any size is spread.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    ranged = ordering.ranged(rows, ["file", "block", "nth"])
    return ordering.scan(ranged, ["file"], ["block", "nth"], {"line": ("sum", F.lit(1).cast("long"))}, before=True).drop("_range", "_at", "block", "nth")


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(file, size) of the files that Spark reads at ``path``; readers get no row of an empty one."""
    fs, Path = files._hadoop(spark, path)
    out = []
    for found in fs.globStatus(Path(path)) or []:
        for x in fs.listStatus(found.getPath()) if found.isDirectory() else [found]:
            if x.isFile() and not x.getPath().getName().startswith(("_", ".")):
                out.append((x.getPath().toString(), x.getLen()))
    return out


def faults(spark: SparkSession, path: str, numbered: DataFrame) -> DataFrame:
    """file, fault: what is wrong with the bytes of the files of ``path``, of which ``numbered`` has the ``lines``."""
    empty = spark.createDataFrame([(name, "the file is empty") for name, size in _listed(spark, path) if not size], "file string, fault string")
    # A line and its line feed; without the last one the sum is a byte more than the file.
    bytes_ = F.octet_length("value").cast("long") + 1
    by = numbered.groupBy("file").agg(F.sum(bytes_).alias("bytes"), F.first("size").alias("size"), F.min(F.when(F.octet_length("value") == 0, F.col("line"))).alias("blank"), F.min(F.when(~F.is_valid_utf8("value"), F.col("line"))).alias("broken"))
    told = F.array_compact(F.array(
        F.when(F.col("bytes") != F.col("size"), F.lit("there is no line feed at the end")), F.when(F.col("blank").isNotNull(), F.concat(F.lit("line "), F.col("blank").cast("string"), F.lit(" is empty"))),
        F.when(F.col("broken").isNotNull(), F.concat(F.lit("line "), F.col("broken").cast("string"), F.lit(" is no UTF-8")))))
    return by.select("file", F.explode(told).alias("fault")).unionByName(empty)


def digests(numbered: DataFrame) -> DataFrame:
    """file, sha256 of the files, over their lines in order; a task holds the state of one digest and no file."""

    def run(batches):
        import pyarrow as pa

        rows = (r for b in batches for r in zip(b.column("file").to_pylist(), b.column("value").to_pylist()))
        for file, group in itertools.groupby(rows, key=lambda r: r[0]):
            h = hashlib.sha256()
            for _, value in group:
                h.update(value)
                h.update(b"\n")
            yield pa.RecordBatch.from_pydict({"file": [file], "sha256": [h.hexdigest()]})

    rows = numbered.select("file", "line", F.col("value").cast("binary").alias("value"))
    return rows.repartition("file").sortWithinPartitions("file", "line").mapInArrow(run, "file string, sha256 string")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, sha256: dict[str, str] | None = None, position: str | None = None, first: int = 1) -> DataFrame:
    """The objects of JSON lines, after all of this holds, else an IntegrityError that names file and line.

    Every file ends with a line feed and has no empty line and no broken UTF-8; each line
    is an object with the keys of ``schema``, no more and no fewer. ``sha256`` gives the digest
    of every file by its name: nothing is parsed before they agree, and a file too many or
    too few is an error. ``position`` names a column that has to be the number of its line, from ``first``.
    """
    numbered = lines(spark, path)
    expect_none(faults(spark, path, numbered), "the lines can't be read")
    if sha256 is not None:
        have = {os.path.basename(r.file): r.sha256 for r in digests(numbered).collect()}  # a row for each file
        if have != sha256:
            raise IntegrityError(f"digests differ: {sorted(n for n in {*have, *sha256} if have.get(n) != sha256.get(n))}")
    want = F.array(*[F.lit(n) for n in sorted(schema.fieldNames())])
    where = F.concat(F.col("file"), F.lit(", line "), F.col("line").cast("string"))
    keys = F.array_sort(F.json_object_keys("value"))
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    wrong = F.raise_error(F.concat(F.lit("no object of these keys in "), where))
    rows = numbered.select("file", "line", F.when(F.coalesce(keys == want, F.lit(False)), parsed).otherwise(wrong).alias("row")).select("file", "line", "row.*")
    if position:
        off = F.raise_error(F.concat(F.lit(f"{position} is not the line's number in "), where))
        rows = rows.withColumn(position, F.when(F.col(position).eqNullSafe((F.col("line") + first).cast(schema[position].dataType)), F.col(position)).otherwise(off))
    return rows.drop("file", "line")

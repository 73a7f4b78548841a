"""Strict readers and deterministic writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.operators.audit import IntegrityError, expect_none, multiset_difference


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a closed schema: a line that is no object, or has a key too many or too few, fails the read.

    The raw line is kept beside the typed columns until its keys are compared.
    """
    raw = spark.read.text(path)
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    keys = F.array_sort(F.json_object_keys("value"))
    want = F.array(*[F.lit(n) for n in sorted(schema.fieldNames())])
    checked = raw.withColumn("row", F.when(keys == want, row).otherwise(F.raise_error(F.concat(F.lit("keys differ in: "), F.substring(F.coalesce("value", F.lit("")), 1, 200)))))
    return checked.select("row.*")


def read_config(path: str) -> dict:
    """A small control file: one JSON object."""
    with open(path, encoding="utf-8") as f:
        got = json.load(f)
    if not isinstance(got, dict):
        raise IntegrityError(f"{path} holds no JSON object")
    return got


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", "false").csv(path, header=True)


def read_vectors(spark: SparkSession, path: str, *, vector_col: str = "embedding", dims: int | None = None, unit: bool = False) -> DataFrame:
    """A vector table after checks of size, finiteness and, if asked, length 1."""
    from loomwell.functions import vectors as v

    df = spark.read.parquet(path)
    ok = v.is_usable(F.col(vector_col), dims)
    if unit:
        ok = ok & v.is_unit(F.col(vector_col))
    expect_none(df.filter(~ok).drop(vector_col), "vectors that can't be used")
    return df


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_documents(spark: SparkSession, path: str, parser, schema: str = "page int, text string") -> DataFrame:
    """Pages of binary documents by a pluggable parser: a function from bytes to rows of ``schema``.

    Several parsers can be compared by reading with each and joining the frames.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content):
                rows = list(parser(bytes(content)))
                if rows:
                    out = pd.DataFrame(rows)
                    out.insert(0, "path", p)
                    yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def pdf_words(content: bytes):
    """Words of a PDF with their boxes; needs the PyMuPDF package."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF") from e
    with fitz.open(stream=content, filetype="pdf") as doc:
        for page in doc:
            for x0, y0, x1, y1, word, block, line, _ in page.get_text("words"):
                yield {"page": page.number, "block": block, "line": line, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "word": word}


def canonical(df: DataFrame):
    """Each row as JSON with sorted keys and nulls written."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, order: list[str], *, overwrite: bool = False) -> None:
    """Canonical JSON lines in a total order: parts are ranges, so files in their order are the order."""
    rows = df.select(canonical(df).alias("value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = [f"_o{i}" for i in range(len(order))]
    rows.repartitionByRange(*by).sortWithinPartitions(*by).select("value").write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str], *, overwrite: bool = False) -> None:
    """A small published table as one CSV file with fixed columns and order."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\n").csv(path, header=True)


def write_object(values: dict, path: str) -> None:
    """A summary as canonical JSON, appearing when it is whole."""
    import os

    body = json.dumps(values, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":")) + "\n"
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(body)
    os.replace(f"{path}.tmp", path)


def verify_round_trip(df: DataFrame, again: DataFrame) -> None:
    """Fail unless both hold the same rows equally often."""
    expect_none(multiset_difference(df, again.select(*df.columns)), "rows differ after writing and reading")


def publish(spark: SparkSession, tables: dict[str, DataFrame], place: str, summary: dict, *, overwrite: bool = False, guard: DataFrame | None = None) -> None:
    """Write tables to a staging folder, verify them, move them into place, the summary last.

    Nothing is replaced unless ``overwrite`` is set, and never while ``guard``
    (human judgements, finished measures) has a row. A reader takes a place
    without ``summary.json`` for incomplete. What is replaced is moved aside until
    the new tables are in place; the next call puts it back if this one was cut
    off in between.
    """
    fs, Path = _hadoop(spark, place)
    aside = f"{place}.replaced"
    if fs.exists(Path(aside)):
        if fs.exists(Path(place)):
            fs.delete(Path(aside), True)
        else:
            _move(fs, Path, aside, place)
    if fs.exists(Path(place)):
        if guard is not None and guard.limit(1).count():
            raise IntegrityError(f"{place} holds finished work and is never overwritten")
        if not overwrite:
            raise FileExistsError(place)
    staging = f"{place}.staging"
    fs.delete(Path(staging), True)
    for name, df in tables.items():
        df.write.parquet(f"{staging}/{name}")
        verify_round_trip(df, spark.read.parquet(f"{staging}/{name}"))
    body = json.dumps(summary, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(f"{staging}/summary.json")
    replaced = fs.exists(Path(place))
    if replaced:
        _move(fs, Path, place, aside)
    try:
        _move(fs, Path, staging, place)
    except Exception:
        if replaced:
            _move(fs, Path, aside, place)
        raise
    fs.delete(Path(aside), True)


def publish_files(files: dict[str, bytes], folder: str) -> None:
    """Small files on the driver's disk: all of them appear whole, or none does; one that is there already is an error."""
    import os
    import tempfile

    if any(os.path.basename(name) != name or not name for name in files):
        raise IntegrityError(f"not plain names: {sorted(files)}")
    os.makedirs(folder, exist_ok=True)
    made = []
    try:
        with tempfile.TemporaryDirectory(dir=folder) as half:
            for name, body in files.items():
                with open(os.path.join(half, name), "wb") as f:
                    f.write(body)
            for name in files:
                os.link(os.path.join(half, name), os.path.join(folder, name))  # fails where the name is taken
                made.append(name)
    except BaseException:
        for name in made:
            os.unlink(os.path.join(folder, name))
        raise


def _move(fs, Path, a: str, b: str) -> None:
    if not fs.rename(Path(a), Path(b)):
        raise IntegrityError(f"{a} could not be moved to {b}")


def _hadoop(spark: SparkSession, place: str):
    jvm = spark.sparkContext._jvm
    Path = jvm.org.apache.hadoop.fs.Path
    return Path(place).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), Path

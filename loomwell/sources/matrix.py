"""Dense matrices of vectors as blocks of raw rows, with checks of type, shape and mapping."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.operators import ordering
from loomwell.operators.audit import IntegrityError, expect_equal, expect_none, multiset_difference

TYPES = {"float32": ("float", 4), "float64": ("double", 8)}
BLOCK_ROWS = 4096


def write(df: DataFrame, place: str, order: list[str], *, id_col: str, vector_col: str, dtype: str = "float32", dims: int | None = None, block_rows: int = BLOCK_ROWS) -> dict:
    """Write vectors in a total order as blocks of rows that follow one another, and where each id stands.

    A block holds the raw little-endian numbers of its rows. Spark commits both tables
    whole; the description, which says what they hold, comes last, and without it
    there is no matrix. Returns the description.
    """
    spark = df.sparkSession
    kind, size = TYPES[dtype]
    rows = ordering.with_position(df.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector")), [F.col(f"_o{i}") for i in range(len(order))], "place").drop(*[f"_o{i}" for i in range(len(order))])
    n, least, most, nulls = rows.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector")), F.count_if(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull()))).first()
    dims = dims if dims is not None else most or 0
    if n and (nulls or least != dims or most != dims):
        raise IntegrityError(f"vectors have from {least} to {most} components, {nulls} are null or hold nulls; {dims} are needed")
    numbers = "<f4" if size == 4 else "<f8"

    def pack(key, table):
        import pyarrow as pa

        t = table.sort_by("place")
        flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "first": pa.array([t.column("place")[0].as_py()], pa.int64()), "rows": pa.array([t.num_rows], pa.int64()), "data": pa.array([flat.astype(numbers).tobytes()], pa.binary())})

    blocks = rows.withColumn("block", F.floor(F.col("place") / block_rows)).groupBy("block").applyInArrow(pack, "block long, first long, rows long, data binary")
    blocks.write.option("compression", "zstd").parquet(f"{place}/blocks")
    rows.select("place", "id").write.parquet(f"{place}/mapping")
    about = {"dtype": dtype, "rows": n, "dims": dims, "block_rows": block_rows}
    spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.text(f"{place}/about")
    return about


def read(spark: SparkSession, place: str, *, dtype: str | None = None, dims: int | None = None, rows: int | None = None) -> DataFrame:
    """place, id, vector of a written matrix, after its shape, its type and its mapping are found to be as described and as asked."""
    about = json.loads(spark.read.text(f"{place}/about").first().value)
    asked = {"dtype": dtype, "dims": dims, "rows": rows}
    expect_equal({k: about[k] for k, v in asked.items() if v is not None}, {k: v for k, v in asked.items() if v is not None})
    blocks, mapping = spark.read.parquet(f"{place}/blocks"), spark.read.parquet(f"{place}/mapping")
    kind, size = TYPES[about["dtype"]]
    per, wide, total = about["block_rows"], about["dims"], about["rows"]
    shape = (F.octet_length("data") == F.col("rows") * wide * size) & (F.col("first") == F.col("block") * per) & (F.col("rows") == F.least(F.lit(per), F.lit(total) - F.col("first")))
    expect_none(blocks.filter(~shape).select("block", "first", "rows", F.octet_length("data").alias("bytes")), "blocks of another shape")
    held = blocks.agg(F.count_distinct("block").alias("blocks"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    expect_equal(held.asDict(), {"blocks": -(-total // per), "rows": total})
    mapped = mapping.agg(F.count("*").alias("rows"), F.count_distinct("place").alias("places"), F.coalesce(F.min("place"), F.lit(0)).alias("low"), F.coalesce(F.max("place") + 1, F.lit(0)).alias("high")).first()
    expect_equal(mapped.asDict(), {"rows": total, "places": total, "low": 0, "high": total})
    numbers = "<f4" if size == 4 else "<f8"

    def unpack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for first, n, data in zip(b.column("first").to_pylist(), b.column("rows").to_pylist(), b.column("data").to_pylist()):
                flat = pa.array(np.frombuffer(data, numbers))
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * wide)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.ListArray.from_arrays(offsets, flat)], ["place", "vector"])

    vectors = blocks.select("first", "rows", "data").mapInArrow(unpack, f"place long, vector array<{kind}>")
    return mapping.join(vectors, "place").select("place", "id", "vector")


def expect_same(df: DataFrame, again: DataFrame, *, id_col: str, vector_col: str, dtype: str = "float32") -> None:
    """Fail unless what was read is bit by bit what was written, each id as often."""
    kind = TYPES[dtype][0]
    own = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    expect_none(multiset_difference(own, again.select("id", "vector")).drop("vector"), "vectors differ after writing and reading")

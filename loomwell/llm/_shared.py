"""Places and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as a URI.

    ``spark.checkpoint.dir`` of the session is used as it is. Only where it is
    unset (tests, single-machine sessions) a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _FALLBACK:
        _FALLBACK[key] = tempfile.mkdtemp(prefix="loomwell-")
    return "file://" + _FALLBACK[key]


def new_place(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/loomwell/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage at a table that outlives executors: what was computed
    once is never computed again, and a later task that is lost only re-reads.
    """
    path = new_place(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, place: str) -> None:
    """Delete a table that nothing reads any more, wherever the shared folder is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(place)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


FEW_CELLS = 200_000  # totals of cells that are broadcast


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    Spark takes the size of a table from its compressed files and leaves out what ``explode`` multiplies, so
    a side that grows with the corpus can look small enough and then not fit the driver.
    """
    return df.hint("merge")


def if_few(df: DataFrame, rows: int = FEW_CELLS) -> DataFrame:
    """``df`` as a side of a join that is broadcast if it is found to have no more than ``rows`` rows, else shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def with_prefix(df: DataFrame, keys: list[str], order: list[Column], *, weight: Column | None = None,
                bucket: Column, name: str) -> DataFrame:
    """Add the running sum of ``weight`` (1 if none) before each row within ``keys``.

    Rows are ordered by ``bucket`` and then ``order``. Only the totals of the
    (keys, bucket) cells are ordered as a whole, so no task sees all rows of a
    key: the rows themselves are only sorted within a cell. The order inside a
    cell has to be total for the result to be reproducible. Cells are broadcast
    if they are few, else joined by shuffling.
    """
    cell, w = f"_{name}_cell", f"_{name}_w"
    rows = df.withColumn(cell, bucket).withColumn(w, (weight if weight is not None else F.lit(1)).cast("long"))
    cells = settle(rows.groupBy(*keys, cell).agg(F.sum(w).alias(f"_{name}_sum")), "cells")
    few = cells.count() <= FEW_CELLS
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    renamed = [F.col(k).alias(f"_{name}_key{i}") for i, k in enumerate([*keys, cell])]
    cells = cells.select(*renamed, (F.sum(f"_{name}_sum").over(before.orderBy(cell)) - F.col(f"_{name}_sum")).alias(f"_{name}_base"))
    local = Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(f"_{name}_run", F.sum(w).over(local) - F.col(w))
    cond = F.lit(True)
    for i, k in enumerate([*keys, cell]):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{name}_key{i}"))
    out = rows.join(F.broadcast(cells) if few else cells, cond)
    return out.select(*df.columns, (F.col(f"_{name}_run") + F.col(f"_{name}_base")).alias(name))


#: Spark's own bounds of what goes to a Python worker at once, and smaller ones that hold whole documents on both sides of the pipe.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with smaller batches: settings of the session that are still Spark's own are replaced, any other stays."""
    conf = df.sparkSession.conf
    for name, (usual, own) in BATCHES.items():
        if conf.get(name, usual) == usual:
            conf.set(name, own)
    return df.mapInArrow(run, schema)


def task_id() -> int:
    """Number of the running task's partition."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def in_memory_path(uri: str) -> str | None:
    """The plain path of a file URI; None for stores that cannot be memory-mapped."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def write_whole(uri: str, parts) -> None:
    """Write byte strings to one file that appears only when it is complete."""
    path = in_memory_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        half = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(half, "wb") as f:
            for p in parts:
                f.write(p)
        os.replace(half, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for p in parts:
            f.write(p)


def map_array(uri: str, dtype: str):
    """A numpy array over a file: memory-mapped where the store allows it."""
    import numpy as np

    path = in_memory_path(uri)
    if path:
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)

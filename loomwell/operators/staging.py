"""Tables that are written once to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def new_place(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Where the setting is missing, which only single-machine sessions may, a
    temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        key = spark.sparkContext.applicationId
        if key not in _OWN:
            _OWN[key] = "file://" + tempfile.mkdtemp(prefix="loomwell-")
        root = _OWN[key]
    return f"{root.rstrip('/')}/loomwell/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh place and read it back, so that all that follows sees the same rows."""
    path = new_place(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few short columns that may be sent to every task.
SMALL = 100_000


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcasting if it is found to have no more than ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

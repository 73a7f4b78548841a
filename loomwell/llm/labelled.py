"""A bounded sample of labelled documents for training on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _shared, pieces


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label_col: str, *, take: dict[int, int], keep: Column, id_col: str = "doc_id",
           text_col: str = "text", characters: int = 64_000_000) -> list[tuple[str, int]]:
    """(text, label) of at most ``take[label]`` documents of each label, of at most ``characters`` in all.

    The documents are those with the least hash of their id among the labelled
    ones for which ``keep`` (over ``doc_id``) holds; one that would exceed the
    characters is passed over. An id with several labels has the largest. First
    the ids are chosen from the labels, then one scan of the documents finds
    their lengths and one their texts: no more is broadcast or collected than the
    two bounds allow. Documents without a text teach nothing.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(keep).filter("doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    totals = {r.label: r.n for r in known.filter(F.col("label").isin(*take)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    ids = []
    for v, n in take.items():
        part = known.filter(F.col("label") == v)
        if totals.get(v, 0) > 4 * n and n >= 100:  # for speed only: twice as many as needed hold the least hashes, however many tasks there are
            part = part.filter(draw < (2 * n << 40) // totals[v])
        ids += [(r.doc_id, r.label) for r in part.orderBy(draw, "doc_id").limit(n).collect()]
    if not ids:
        return []
    spark = docs.sparkSession
    chosen = spark.createDataFrame(ids, "doc_id long, label int")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    lengths = {r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n")).collect()}
    held, fits = 0, []
    for i, _ in ids:
        if i in lengths and held + lengths[i] <= characters:
            held += lengths[i]
            fits.append((i,))
    if not fits:
        return []
    rows = texts.join(F.broadcast(spark.createDataFrame(fits, "doc_id long")), "doc_id", "left_semi").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: r.doc_id)]


def with_scores(docs: DataFrame, text_col: str, name: str, make) -> DataFrame:
    """The rows as they are and ``name``: what ``make()``, a function of a list of whole texts (null: empty), gives."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        pieces.release()
        own = make()
        for b in pieces.text_batches(batches, text_col):
            scores = pa.array(own([t or "" for t in b.column(text_col).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], [*b.schema.names, name])

    return _shared.map_batches(docs, run, schema)

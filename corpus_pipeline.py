"""A cleaning pipeline over ``documents``; each stage applies one operator of ``loomwell.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and all
but the last return the columns of ``documents``. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import _shared, byte_cnn, near_copies, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is 0.5 or more go.

    Null and empty texts have the score of no sentence, repeated rows and ties are judged each alone, texts of
    any length are read whole; an empty table gives no rows; extra columns pass, whatever they are called.
    """
    source, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(source, labels)
    score = _shared.fresh(docs, "_toxicity")
    return toxicity.flags(docs, model, name=score).filter(F.col(score) < 0.5).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is below 0.5 go.

    Null texts count as empty ones, repeated rows and ties are judged each alone, texts of any length are read
    whole; an empty table gives no rows; extra columns pass, whatever they are called.
    """
    source, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = byte_cnn.fit(source, labels)
    score = _shared.fresh(docs, "_quality")
    return byte_cnn.with_quality(docs, net, name=score).filter(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard similarity of 5-word shingles 0.8 or more) one document stays.

    It is one with the least id (null ids last); a row goes or stays by its own text, whatever other
    rows share its id. Repeated rows are one document, ties go to the least text hash and the
    least other columns; texts of any length are compared whole; an empty table gives no rows; extra columns pass.
    """
    return near_copies.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; ``n_chars`` follows.

    Every row stays, repeated ones too; null texts stay null; texts and secrets of any length are taken whole;
    an empty table gives no rows; extra columns pass, whatever they are called.
    """
    out = secrets.redact(docs, secrets.fit(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens.

    Null and empty texts are the end token alone, repeated rows are packed each, of equal lengths any may come
    first, longer texts are cut into pieces; an empty table gives no rows; other columns than id and text are left out.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", hide_secrets),
    ("best_fit_packing", pack),
]

#: The classifiers, the forest and the packing cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        place = _shared.new_place(spark, f"stage-{name}")
        out.write.parquet(place)
        docs = spark.read.schema(out.schema).parquet(place)
    return docs

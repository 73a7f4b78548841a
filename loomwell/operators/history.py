"""Versions of a judged pool: what each adds, chained by digests for each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a candidate may not change in once it has been judged.
PREFIX_FIELDS = [
    "candidate_schema_version", "chunk_character_count", "chunk_id", "chunk_text_sha256", "chunk_token_count", "index_position", "parent_record_id", "pdf_page_index",
    "pdf_page_number", "printed_page_number", "query_text_sha256", "question_id", "question_position", "rank", "similarity_score", "source_id",
]


def _links(rows: DataFrame, fields: list[str]) -> DataFrame:
    """question_id, version, n, own: the digest of the candidates that a version adds to a question."""
    body = F.to_json(F.struct(*[F.col(f) for f in sorted({*fields, "relevance_grade"})]), {"ignoreNullFields": "false"})
    added = rows.groupBy("question_id", "version").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", F.sha2(body, 256).alias("h")))).alias("hs"))  # a pool's depth bounds it
    return added.select("question_id", "version", "n", F.sha2(F.array_join(F.transform("hs", lambda x: x["h"]), "\n"), 256).alias("own"))


def chained(rows: DataFrame, fields: list[str] = PREFIX_FIELDS) -> DataFrame:
    """question_id, version, n, digest: each digest covers that of the version before, so no earlier judgement can change unseen."""
    links = _links(rows, fields)
    upto = F.array_sort(F.collect_list(F.struct("version", "own")).over(Window.partitionBy("question_id").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)))
    return links.select("question_id", "version", "n", F.aggregate(upto, F.lit(""), lambda s, x: F.sha2(F.concat(s, F.lit("\n"), x["own"]), 256)).alias("digest"))


def first_changes(rows: DataFrame, chain: DataFrame, fields: list[str] = PREFIX_FIELDS) -> DataFrame:
    """question_id, version: the first version of each question whose rows are not those that the kept chain was made of."""
    now = chained(rows, fields).select("question_id", "version", F.col("digest").alias("_now"))
    both = chain.select("question_id", "version", "digest").join(now, ["question_id", "version"], "full")
    return both.filter(~F.col("digest").eqNullSafe(F.col("_now"))).groupBy("question_id").agg(F.min("version").alias("version"))


def grow(judged: DataFrame, deeper: DataFrame, version: int, fields: list[str] = PREFIX_FIELDS) -> DataFrame:
    """The judged pool and, as ``version``, what a deeper search adds to it without a grade.

    Every judged candidate has to be in the deeper pool and agree in all
    ``fields``; a row that does not raises an error that names it and the fields.
    """
    keys = ["question_id", "chunk_id"]
    own = [f for f in fields if f not in keys]
    new = deeper.select(*keys, F.lit(True).alias("_found"), *[F.col(f).alias(f"_new_{f}") for f in own])
    both = judged.join(new, keys, "left")
    changed = F.array_join(F.array_compact(F.array(F.when(F.col("_found").isNull(), F.lit("gone")), *[F.when(F.col("_found") & ~F.col(f).eqNullSafe(F.col(f"_new_{f}")), F.lit(f)) for f in own])), ", ")
    wrong = F.raise_error(F.concat(F.lit("a judged candidate has changed: question "), F.col("question_id").cast("string"), F.lit(", rank "), F.col("rank").cast("string"), F.lit(": "), changed))
    same = both.withColumn("version", F.when(changed != "", wrong).otherwise(F.col("version"))).select(judged.columns)
    added = deeper.join(judged.select(*keys), keys, "left_anti").withColumn("version", F.lit(version)).withColumn("relevance_grade", F.lit(None).cast("int"))
    return same.unionByName(added.select(judged.columns))

"""One of each group of near copies: rows that share ids, null ids, and shingles that very many texts hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.llm import near_copies


def words(seed, n=60):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 10**6, n)]


def changed(ws, at):
    return " ".join([*ws[:at], "other", *ws[at + 1:]])


def test_rows_are_judged_by_their_own_text(spark):
    """An id that stays with one text doesn't keep the near copies that carry the same id."""
    a, b, c = words(1), words(2), words(3)
    rows = [(5, " ".join(a), "x", 1), (None, changed(a, 2), "x", 1), (None, " ".join(b), "x", 1), (9, changed(a, 57), "x", 1), (9, " ".join(c), "x", 1), (9, " ".join(c), "x", 1), (9, " ".join(c), "w", 2), (10, changed(c, 1), "x", 1),
            (11, None, "x", 1), (11, "", "x", 1), (12, " ", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string, h int")
    got = sorted(((r.doc_id, r.text, r.rest, r.h) for r in near_copies.one_of_each(df).collect()), key=repr)
    want = [(5, " ".join(a), "x", 1), (None, " ".join(b), "x", 1), (9, " ".join(c), "w", 2)]
    assert [r for r in got if r[0] != 11] == sorted(want, key=repr)
    assert [r[0] for r in got if r[0] == 11] == [11]
    assert near_copies.one_of_each(df.filter("false")).count() == 0
    assert near_copies.one_of_each(df).columns == df.columns


@pytest.mark.parametrize("n", [400, 1600])
def test_common_shingles_are_in_no_prefix(spark, n):
    """Texts made of passages that 40 texts share and one that all share: nobody meets in the last."""
    r = np.random.default_rng(7)
    passages = [" ".join(words(100 + i, 12)) for i in range(n // 4)]
    common = " ".join(words(99, 12))
    texts = [" ".join([common, *[passages[j] for j in r.choice(len(passages), 10, replace=False)]]) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = near_copies._rows(df, "doc_id", "text")
    found = near_copies.prefixes(rows, near_copies.grades(rows)).select("doc_id", F.explode("prefix").alias("token"))
    shared = near_copies.shingles(common)
    assert found.filter(F.col("token").isin([int(x) for x in shared])).count() == 0
    most = found.groupBy("token").count().agg(F.max("count")).first()[0]
    assert most <= 120  # whatever n

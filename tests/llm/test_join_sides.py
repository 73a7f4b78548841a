"""Sides of joins that grow with the corpus are shuffled, whatever Spark takes their size to be."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm import _shared, near_copies, simhash


def plans_of(monkeypatch, module) -> dict[str, list[str]]:
    """Physical plans, before they run, of what is written under each label."""
    seen: dict[str, list[str]] = {}
    settle = _shared.settle

    def noted(df: DataFrame, label: str) -> DataFrame:
        seen.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df, label)

    monkeypatch.setattr(module._shared, "settle", noted)
    return seen


def test_shingles_are_not_broadcast(spark, docs, monkeypatch):
    seen = plans_of(monkeypatch, near_copies)
    near_copies.one_of_each(docs)
    for label in ("entries", "pairs", "links", "edges"):
        assert seen[label]
    assert all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in seen["entries"] + seen["links"])


def test_probes_are_not_broadcast(spark, docs):
    fps = _shared.settle(simhash.fingerprints(docs).select("fp").distinct(), "fps")
    plan = simhash.choose(simhash.sampled(fps))
    met = simhash.linked(fps, plan)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in met


def test_few_rows_are_broadcast_and_more_are_not(spark):
    one, two = spark.range(100), spark.range(100).withColumn("x", F.lit(1))
    plan = lambda rows: one.join(_shared.if_few(two, rows), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(100)
    assert "SortMergeJoin" in plan(99)
    assert one.join(_shared.if_few(two, 99), "id").count() == 100

"""Exact medians and percentiles of groups of any size, without gathering a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.operators import staging

GATHERED = 50_000  # values of a group that are sorted together in the end
SKETCH, STEPS = 10_000, 200  # accuracy of the sketches that narrow a range down, and into how many steps they cut it


def nearest_rank(p: float, n: Column) -> list[Column]:
    """The rank, from 1, of the least value that has a share ``p`` of all at or below it."""
    return [F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * n))]


def middle(n: Column) -> list[Column]:
    """The two middle ranks, which are one if ``n`` is odd."""
    return [F.floor((n + 1) / 2), F.floor(n / 2) + 1]


def order_statistics(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, object]], *, gathered: int = GATHERED) -> DataFrame:
    """keys and a column for each of ``wanted``: names to (column, "median" or a share for the nearest rank); nulls don't count.

    For each group and rank a range of values is kept that holds the rank. A
    sketch of what lies in the range gives a narrower one around the rank, counting
    what is below and inside tells whether it holds, and so on until a range is one
    value or few values. Only those are sorted. Sketches and counts are made beside the
    data first, so a group that holds most rows is never in one task; each round divides a range by dozens.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    # One row for each value: (keys, what, v).
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("what"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("x")
    values = staging.settle(df.select(*keys, each).select(*keys, "x.what", "x.v").filter("v IS NOT NULL"), "values")
    group = [*keys, "what"]
    totals = values.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    asks = F.array(*[
        F.struct(F.lit(columns.index(c)).alias("what_"), F.lit(i).alias("out"), F.array(*(middle(F.col("n")) if kind == "median" else nearest_rank(kind, F.col("n")))).alias("ranks"))
        for i, (c, kind) in enumerate(wanted.values())])
    asked = totals.select(*group, "n", "low", "high", F.explode(F.filter(asks, lambda a: a["what_"] == F.col("what"))).alias("a"))
    asked = asked.select(*group, "low", "high", "n", F.col("a.out").alias("out"), F.explode(F.array_distinct("a.ranks")).alias("rank"), F.lit(0).cast("long").alias("below"))
    # (group, out, rank): of the values within [low, high] there are n, and `below` below low.
    state = staging.settle(asked, "ranks")
    same = [*group, "out", "rank"]
    while state.filter((F.col("n") > gathered) & (F.col("low") < F.col("high"))).limit(1).count():
        wide = state.filter((F.col("n") > gathered) & (F.col("low") < F.col("high")))
        marks = F.percentile_approx("v", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), SKETCH)
        sketch = _within(values, wide, group).groupBy(*same, "low", "high", "n", "below").agg(marks.alias("marks"))
        # The marks around the rank, a step further out on either side; the range itself where there is none.
        place = F.floor((F.col("rank") - F.col("below")) / F.col("n") * STEPS).cast("int")
        cut0 = F.when(place >= 2, F.element_at("marks", F.greatest(place - 1, F.lit(1)))).otherwise(F.col("low"))
        cut1 = F.when(place <= STEPS - 3, F.element_at("marks", F.least(place + 4, F.lit(STEPS + 1)))).otherwise(F.col("high"))
        narrow = sketch.select(*same, "low", "high", "below", cut0.alias("cut0"), cut1.alias("cut1"))
        # Below the first cut, at it, between, at the second, above: counts and ends of the five parts. The cuts go out of the range, so it shrinks.
        v, cut0, cut1 = F.col("v"), F.col("cut0"), F.col("cut1")
        parts = [v < cut0, v == cut0, (v > cut0) & (v < cut1), (v == cut1) & (cut0 < cut1), v > cut1]
        counts = [x for i, p in enumerate(parts) for x in (F.count_if(p).alias(f"n{i}"), F.min(F.when(p, v)).alias(f"low{i}"), F.max(F.when(p, v)).alias(f"high{i}"))]
        counted = _within(values, narrow, group).groupBy(*same, "below").agg(*counts)
        chosen, passed = None, F.lit(0).cast("long")
        for i in range(len(parts)):
            here = F.struct(F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), F.col(f"n{i}").alias("n"), (F.col("below") + passed).alias("below"))
            passed = passed + F.col(f"n{i}")
            inside = F.col("rank") - F.col("below") <= passed
            chosen = F.when(inside, here) if chosen is None else chosen.when(inside, here)
        moved = counted.select(*same, chosen.alias("x")).select(*group, "x.low", "x.high", "x.n", "out", "rank", "x.below")
        state = staging.settle(state.filter(~((F.col("n") > gathered) & (F.col("low") < F.col("high")))).unionByName(moved), "ranks")
    one = state.filter(F.col("low") >= F.col("high")).select(*same, F.col("low").alias("v"))
    few = _within(values, state.filter(F.col("low") < F.col("high")), group).groupBy(*same).agg(F.sort_array(F.collect_list("v")).alias("vs"), F.first("below").alias("b"))
    found = one.unionByName(few.select(*same, F.element_at("vs", (F.col("rank") - F.col("b")).cast("int")).alias("v")))
    found = found.groupBy(*keys).agg(*[F.avg(F.when(F.col("out") == i, F.col("v"))).alias(n) for i, n in enumerate(wanted)])
    return found if keys else found.select(*wanted)


def _within(values: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """Values with each range of their group that holds them."""
    renamed = state.select(*[F.col(g).alias(f"_{g}") for g in group], *[c for c in state.columns if c not in group])
    cond = F.col("v").between(F.col("low"), F.col("high"))
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return values.join(renamed, cond).drop(*[f"_{g}" for g in group])

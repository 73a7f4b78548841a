"""Paired comparison of conditions over the same blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import stats


def pairs(conds: DataFrame) -> DataFrame:
    """All pairs of conditions within a family, in their order: family, ord_l, left, ord_r, right."""
    l, r = conds.alias("l"), conds.alias("r")
    rows = l.join(r, (F.col("l.family") == F.col("r.family")) & (F.col("l.ord") < F.col("r.ord")))
    return rows.select(F.col("l.family").alias("family"), F.col("l.ord").alias("ord_l"), F.col("l.condition").alias("left"), F.col("r.ord").alias("ord_r"), F.col("r.condition").alias("right"))


def tables(scores: DataFrame, pair_rows: DataFrame) -> DataFrame:
    """The 2 x 2 table of each pair of conditions over shared blocks: both, only_left, only_right, neither.

    ``scores`` has condition, block, correct (0 or 1), one row for each condition and block.
    """
    l = scores.select(F.col("condition").alias("left"), "block", F.col("correct").alias("cl"))
    r = scores.select(F.col("condition").alias("right"), "block", F.col("correct").alias("cr"))
    rows = F.broadcast(pair_rows).join(l, "left").join(r, ["right", "block"])  # pairs of the few conditions
    return rows.groupBy("family", "ord_l", "left", "ord_r", "right").agg(
        F.count("*").alias("n"), F.count_if((F.col("cl") == 1) & (F.col("cr") == 1)).alias("both"), F.count_if((F.col("cl") == 1) & (F.col("cr") == 0)).alias("only_left"),
        F.count_if((F.col("cl") == 0) & (F.col("cr") == 1)).alias("only_right"), F.count_if((F.col("cl") == 0) & (F.col("cr") == 0)).alias("neither"))


def with_mcnemar(table_rows: DataFrame) -> DataFrame:
    return table_rows.withColumn("p_value", stats.mcnemar(F.col("only_left"), F.col("only_right")))


def with_holm(tests: DataFrame, family: str, p: str, order: list[str]) -> DataFrame:
    """Holm's step-down adjustment within each family; a family of one test keeps its p value."""
    w = Window.partitionBy(family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(family))
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    out = tests.withColumn("_scaled", scaled)
    return out.withColumn("p_holm", F.max("_scaled").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_scaled")


def cochran_q(scores: DataFrame, families: DataFrame) -> DataFrame:
    """Cochran's Q for each family: q, df, n, variation (false: nothing differs, Q is 0)."""
    rows = scores.join(F.broadcast(families.select("family", "condition")), "condition")
    block = rows.groupBy("family", "block").agg(F.sum("correct").alias("r"))
    rsum = block.groupBy("family").agg(F.sum(F.col("r") * F.col("r")).alias("r2"), F.count("*").alias("n"))
    col = rows.groupBy("family", "condition").agg(F.sum("correct").alias("c"))
    csum = col.groupBy("family").agg(F.sum(F.col("c") * F.col("c")).alias("c2"), F.sum("c").alias("t"), F.count("*").alias("k"))
    both = csum.join(rsum, "family")
    below = F.col("k") * F.col("t") - F.col("r2")
    above = (F.col("k") - 1) * (F.col("k") * F.col("c2") - F.col("t") * F.col("t"))
    return both.select("family", "n", "k", (F.col("k") - 1).alias("df"), F.when(below == 0, 0.0).otherwise(above / below).alias("q"), (below != 0).alias("variation"))


def average_ranks(df: DataFrame, block: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks within a block, ties sharing their mean."""
    ties = F.count("*").over(Window.partitionBy(*block, value))
    return df.withColumn(name, F.rank().over(Window.partitionBy(*block).orderBy(value)) + (ties - 1) / 2)


def friedman(scores: DataFrame, families: DataFrame, value: str) -> DataFrame:
    """Friedman's statistic with tie correction for each family with more than two conditions."""
    rows = average_ranks(scores.join(F.broadcast(families.select("family", "condition")), "condition"), ["family", "block"], value)
    sums = rows.groupBy("family", "condition").agg(F.sum("rank").alias("t"), F.count("*").alias("n"))
    sums = sums.groupBy("family").agg(F.sum(F.col("t") * F.col("t")).alias("t2"), F.count("*").alias("k"), F.max("n").alias("n"))
    ties = rows.groupBy("family", "block", value).agg(F.count("*").alias("c")).groupBy("family").agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    both = sums.join(ties, "family").filter("k > 2")
    k, n = F.col("k"), F.col("n")
    raw = F.lit(12.0) / (n * k * (k + 1)) * F.col("t2") - F.lit(3.0) * n * (k + 1)
    left = F.lit(1.0) - F.col("ties") / (n * k * (k * k - 1))
    return both.select("family", "n", "k", (k - 1).alias("df"), F.when(left > 0, raw / left).otherwise(0.0).alias("statistic"), (left > 0).alias("variation"))


def wilcoxon(scores: DataFrame, pair_rows: DataFrame, value: str) -> DataFrame:
    """Signed-rank test of each pair: n (differences that are not zero), rank sums, two-sided p value.

    A pair's ranks are gathered as counts of the different ones, of which there
    are no more than different sizes of a difference. The p value is exact up to
    the bound of ``stats.rank_tail``.
    """
    l = scores.select(F.col("condition").alias("left"), "block", F.col(value).alias("vl"))
    r = scores.select(F.col("condition").alias("right"), "block", F.col(value).alias("vr"))
    rows = F.broadcast(pair_rows).join(l, "left").join(r, ["right", "block"]).withColumn("d", F.col("vl") - F.col("vr"))
    keys = ["family", "ord_l", "left", "ord_r", "right"]
    sizes = rows.filter("d <> 0").groupBy(*keys, F.abs("d").alias("size")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("n_plus"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("size")) - F.col("n")
    twice = sizes.withColumn("rank", 2 * before + F.col("n") + 1)  # twice the mean of the ranks that share a size
    got = twice.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("ranks"), F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n_plus")).alias("plus"), F.sum(F.col("rank") * F.col("n")).alias("total"))
    zero = F.lit(0).cast("long")
    out = F.broadcast(pair_rows).join(got, keys, "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<struct<rank:bigint,n:bigint>>")))
    n, plus, total = (F.coalesce(c, zero) for c in ("n", "plus", "total"))
    return out.select(*keys, n.alias("n"), (plus / 2).alias("w_plus"), ((total - plus) / 2).alias("w_minus"), stats.signed_rank_tail(F.col("ranks"), plus).alias("p_value"))

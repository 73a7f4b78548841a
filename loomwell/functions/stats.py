"""Statistical expressions."""

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The two normal quantiles in use.
Z_ROUNDED = 1.96
Z_EXACT = 1.959963984540054

MOST_SUMS = 20_000_000  # sums of doubled ranks up to which the signed-rank test is exact


def wilson(successes: Column, n: Column, z: float = Z_EXACT) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]."""
    n = n.cast("double")
    p = successes / n
    scale = F.lit(1.0) + F.lit(z * z) / n
    centre = (p + F.lit(z * z) / (F.lit(2.0) * n)) / scale
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n)) / scale
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def gain(grade: Column, rank: Column) -> Column:
    """Discounted gain of a graded result."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + F.lit(1.0))


def binomial_tail(m: Column, n: Column) -> Column:
    """Sum of C(n, k) / 2^n for k = 0 .. m, for any n.

    The last term is kept as a logarithm and the sum in units of it, so nothing
    underflows; beyond the middle the other tail is summed.
    """
    n, m = n.cast("long"), m.cast("long")
    upper = 2 * m > n
    low = F.when(upper, n - m - 1).otherwise(m)
    steps = F.when(low >= 1, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>"))

    def step(s, k):
        ratio = (n - k + 1) / k
        return F.struct((s["log"] + F.log(ratio)).alias("log"), (F.lit(1.0) + s["sum"] / ratio).alias("sum"))

    state = F.struct((F.lit(-math.log(2)) * n).alias("log"), F.lit(1.0).alias("sum"))
    tail = F.aggregate(steps, state, step, lambda s: F.exp(s["log"] + F.log(s["sum"])))
    tail = F.when(low < 0, F.lit(0.0)).otherwise(tail)
    return F.when(upper, F.lit(1.0) - tail).otherwise(tail)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p value of the discordant counts."""
    n = (b + c).cast("long")
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * binomial_tail(F.least(b, c).cast("long"), n)))


def _erfc_root(v: pd.Series) -> pd.Series:
    return v.map(lambda t: math.erfc(math.sqrt(t / 2)) if t == t else None)


def chi_square_survival(x: Column, df: Column) -> Column:
    """Survival function for 1, 2 or 3 degrees of freedom.

    Two degrees are native. The others need the complementary error function,
    which comes from an Arrow-batched function.
    """
    erfc_root = F.pandas_udf(_erfc_root, "double")
    two = F.exp(-x / 2)
    one = erfc_root(x.cast("double"))
    three = one + F.sqrt(F.lit(2.0) * x / F.lit(math.pi)) * F.exp(-x / 2)
    return F.when(df == 2, two).when(df == 1, one).when(df == 3, three)


def rank_tail(ranks: list[tuple[int, int]], statistic: int, most: int = MOST_SUMS) -> float:
    """Two-sided p value of a signed-rank sum; ``ranks`` has each doubled rank with its count.

    The shares of sign patterns by their sum are built rank by rank up to the
    smaller of the two sums, of which the tail is doubled and clamped. Beyond
    ``most`` possible sums the normal approximation with its corrections for
    ties and continuity takes its place.
    """
    import numpy as np

    total = sum(r * c for r, c in ranks)
    low = min(statistic, total - statistic)
    if not total:
        return 1.0
    if total > most:
        spread = math.sqrt(sum(c * r * r for r, c in ranks) / 4)
        z = (abs(statistic - total / 2) - 0.5 * 2) / spread  # half a rank, doubled
        return min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2)))
    share = np.zeros(low + 1)
    share[0] = 1.0
    for r, c in ranks:
        for _ in range(c):
            new = share * 0.5
            if r <= low:
                new[r:] += share[:low + 1 - r] * 0.5
            share = new
    return min(1.0, 2 * float(share.sum()))


def _rank_tails(ranks: pd.Series, statistic: pd.Series) -> pd.Series:
    return pd.Series([rank_tail([(int(x["rank"]), int(x["n"])) for x in r], int(s)) for r, s in zip(ranks, statistic)], dtype="float64")


def signed_rank_tail(ranks: Column, statistic: Column) -> Column:
    """``rank_tail`` of an array of structs (rank, n), doubled ranks with their counts, and a doubled sum."""
    return F.pandas_udf(_rank_tails, "double")(ranks, statistic)

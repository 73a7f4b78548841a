"""Interval algebra per key: merge, complement, expansion over pages, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.operators import ordering

TOLERANCE = 1e-6


def merge(df: DataFrame, key: str, y0: str, y1: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Islands of each key: intervals that overlap or lie within ``tolerance`` of each other become one.

    How far the intervals before reach is a running maximum, and the number of an island a running sum, both scanned by ranges.
    """
    rows = ordering.ranged(df.select(key, y0, y1), [key, y0, y1])
    rows = ordering.scan(rows, [key], [y0, y1], {"_reach": ("max", F.col(y1))}, before=True)
    rows = rows.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(y0) > F.col("_reach") + tolerance), 1).otherwise(0))
    rows = ordering.scan(rows, [key], [y0, y1], {"island": ("sum", F.col("_new"))})
    return rows.groupBy(key, "island").agg(F.min(y0).alias(y0), F.max(y1).alias(y1), F.count("*").alias("merged"))


def complement(merged: DataFrame, key: str, y0: str, y1: str, height: float, tolerance: float = TOLERANCE) -> DataFrame:
    """What merged intervals leave of [0, height]; remainders up to ``tolerance`` are dropped."""
    clipped = merged.select(key, F.greatest(F.col(y0), F.lit(0.0)).alias(y0), F.least(F.col(y1), F.lit(height)).alias(y1)).filter(F.col(y1) > F.col(y0))
    rows = ordering.ranged(clipped, [key, y0])
    gaps = ordering.scan(rows, [key], [y0], {"_end": ("max", F.col(y1))}, before=True).select(key, F.coalesce("_end", F.lit(0.0)).alias("_g0"), F.col(y0).alias("_g1"))
    tails = rows.groupBy(key).agg(F.max(y1).alias("_g0")).select(key, "_g0", F.lit(height).alias("_g1"))
    return gaps.union(tails).select(key, F.col("_g0").alias(y0), F.col("_g1").alias(y1)).filter(F.col(y1) - F.col(y0) > tolerance)


def over_pages(sections: DataFrame, *, first: str, last: str, y0: str, y1: str, top: float, bottom: float) -> DataFrame:
    """A row for each page a section covers: clipped on its first and last page, whole in between."""
    rows = sections.withColumn("page", F.explode(F.sequence(F.col(first), F.col(last))))
    start = F.when(F.col("page") == F.col(first), F.col(y0)).otherwise(F.lit(top))
    end = F.when(F.col("page") == F.col(last), F.col(y1)).otherwise(F.lit(bottom))
    return rows.withColumn("page_y0", start).withColumn("page_y1", end)


def within(y0: Column, y1: Column, low: Column, high: Column, tolerance: float = TOLERANCE) -> Column:
    return (y0 >= low - tolerance) & (y1 <= high + tolerance)


def page_state(covered: Column, height: float, tolerance: float = TOLERANCE) -> Column:
    """State of a page by its covered height (null or 0: none)."""
    c = F.coalesce(covered, F.lit(0.0))
    return F.when(c <= tolerance, "fully_retained").when(c >= height - tolerance, "fully_excluded").otherwise("partially_retained")


def pair_forward(df: DataFrame, key: str, order: list[str], is_opening: Column, is_closing: Column) -> DataFrame:
    """Greedy forward pairing with consumption: each opening takes the next later closing that is still free.

    The i-th opening of a key can take closing number f_i at the earliest, and
    one after what the opening before it took; so it takes i + max(f_j - j) over
    all j <= i: a running maximum, and an equi-join on the number. Returns the
    openings with ``pair``, a struct of the order columns (null: none was left).
    """
    rows = ordering.ranged(df.select(key, *order, is_opening.alias("_open"), is_closing.alias("_close")), [key, *order])
    marked = ordering.scan(rows, [key], order, {"_closed": ("sum", F.col("_close").cast("int")), "_i": ("sum", F.col("_open").cast("int"))})
    ahead = F.when(F.col("_open"), F.col("_closed") + 1 - F.col("_i"))
    opens = ordering.scan(marked, [key], order, {"_ahead": ("max", ahead)}).filter("_open").withColumn("_take", F.col("_i") + F.col("_ahead"))
    closes = marked.filter("_close").select(F.col(key).alias("_key"), F.col("_closed").alias("_take"), F.struct(*order).alias("pair"))
    return opens.join(closes, (opens[key] == closes["_key"]) & (opens["_take"] == closes["_take"]), "left").select(opens[key], *[opens[o] for o in order], "pair")


#: Binary digits of a place that one level of the index takes up.
STEP = 4


def _nodes(first: Column, last: Column, levels: int) -> Column:
    """array<struct<level, node>>: the fewest blocks of 16 ** level places that make up [first, last]."""

    def blocks(level):  # the first and the last block that lie inside as a whole
        size = STEP * level
        return F.shiftright(first + F.lit((1 << size) - 1).cast("long"), size), F.shiftright(last + F.lit(1).cast("long"), size) - 1

    out = []
    for level in range(levels):
        low, high = blocks(level)
        between = lambda x, y, level=level: F.when(x <= y, F.transform(F.sequence(x, y), lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
        if level == levels - 1:
            out.append(between(low, high))
            continue
        up, down = blocks(level + 1)
        # What the next level holds as a whole is left to it.
        whole = up <= down
        out += [between(low, F.when(whole, F.shiftleft(up, STEP) - 1).otherwise(high)), between(F.when(whole, F.shiftleft(down + 1, STEP)).otherwise(high + 1), high)]
    return F.concat(*out)


def covering(points: DataFrame, spans: DataFrame, keys: list[str], at: str, first: str, last: str) -> DataFrame:
    """Each point joined with every span of its keys with first <= at <= last, all whole numbers, both ends included.

    A span becomes blocks of places, fewer than 32 a level, and a point the blocks
    it lies in, one a level; they meet in an equal join, once for each pair. A span
    over millions of pages costs some dozens of rows instead of a row a page, and a key
    that holds most rows is spread over its blocks. There are as many levels as the longest span needs.
    """
    span = F.col(last).cast("long") - F.col(first).cast("long")
    longest = spans.agg(F.max(span).alias("n")).first().n
    levels = 1
    while longest is not None and longest >> STEP * levels:
        levels += 1
    blocks = F.explode(_nodes(F.col(first).cast("long"), F.col(last).cast("long"), levels))
    left = spans.filter(F.col(first) <= F.col(last)).withColumn("_block", blocks)
    inside = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(F.col(at).cast("long"), STEP * i).alias("node")) for i in range(levels)]))
    right = points.filter(F.col(at).isNotNull()).withColumn("_block", inside)
    return right.join(left, [*keys, "_block"]).drop("_block")


def excluded(pages: DataFrame, sections: DataFrame, *, page: str, first: str, last: str, y0: str, y1: str, top: float, bottom: float) -> DataFrame:
    """Pages with the sections that cover them: clipped on a section's first and last page, whole in between."""
    rows = covering(pages, sections, [], page, first, last)
    start = F.when(F.col(page) == F.col(first), F.col(y0)).otherwise(F.lit(top))
    end = F.when(F.col(page) == F.col(last), F.col(y1)).otherwise(F.lit(bottom))
    return rows.withColumn("page_y0", start).withColumn("page_y1", end)

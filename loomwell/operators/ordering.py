"""Global positions and running sums, without sorting a table or a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators import staging


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Number the rows from 0 in the given order, which has to be total.

    Rows are dealt by ranges, sorted within them and written once with their
    range and their place in it; the counts of the ranges, one figure each, are
    taken from what was written, summed up and joined back. Were the ranges dealt
    twice, their sampled bounds could differ and so could the counts.
    """
    # The high bits of the generated id are the partition, the low 33 bits the row within it.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = staging.settle(ranged, "ranges")
    part = F.shiftright("_id", 33)
    counts = {r.part: r.n for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    bases, at = [], 0
    for k in range(max(counts, default=-1) + 1):
        bases.append(at)
        at += counts.get(k, 0)
    base = F.element_at(F.array(*[F.lit(b).cast("long") for b in bases or [0]]), part.cast("int") + 1)
    return ranged.withColumn(name, base + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums, each row's own value included, within ``keys`` in a total, ascending order.

    Rows are dealt by ranges of keys and order and written once with their range,
    so a key of any size is spread. Sums run within a range; what the ranges
    before it hold of a key, a row for each range and key, is added.
    """
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    marks = {f"_o{i}": c for i, c in enumerate(order)}
    rows = df.withColumns(values | marks).repartitionByRange(*keys, *marks).withColumn("_range", F.spark_partition_id())
    rows = staging.settle(rows, "ranges")
    totals = rows.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_b{v}") for v in values])
    inside = Window.partitionBy(*keys, "_range").orderBy(*marks).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_s{v}": F.sum(v).over(inside) for v in values})
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(bases, same)
    return joined.select(*df.columns, *[(F.col(f"_s{v}") + F.col(f"_b{v}")).alias(n) for n, v in zip(sums, values)])


def ranged(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows dealt by ranges of ``by`` and written once, with ``_range`` and with ``_at``, which makes any order total."""
    rows = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    return staging.settle(rows, "ranges")


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that lie in several ranges: only the first and the last key of a range can, so there are fewer than ranges."""
    whole = F.struct(*keys)
    ends = rows.groupBy("_range").agg(F.min(whole).alias("low"), F.max(whole).alias("high"))
    both = ends.select("_range", F.explode(F.array("low", "high")).alias("_several"))
    return both.groupBy("_several").agg((F.min("_range") < F.max("_range")).alias("_on")).filter("_on").select("_several")


def scan(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], *, before: bool = False) -> DataFrame:
    """Add running values within ``keys`` over what ``ranged`` has dealt by ``keys`` and ``order``.

    ``values`` maps names to an operation, ``sum``, ``max``, ``min`` or ``last``, and a column; all of
    them are associative, so each range is scanned alone, reduced to one row for
    each key that goes on, and what the ranges before hold is put in front. A key of any size
    is spread over its ranges. ``before`` leaves each row's own value out; without rows
    before it a sum is 0 and anything else null.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    frame = Window.partitionBy(*keys, "_range").orderBy(*order, "_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    whole = F.struct(*keys) if keys else F.lit(0)
    part = rows.withColumn("_k", whole)
    if keys:
        part = part.join(F.broadcast(_spread(rows, keys)), F.col("_k").eqNullSafe(F.col("_several")), "left_semi")  # fewer than ranges
    totals = part.groupBy("_k", "_range").agg(*[
        (F.max_by(F.struct(c.alias("v")), F.struct(*order, "_at")) if op == "last" else fold[op](c)).alias(f"_t{i}") for i, (op, c) in enumerate(values.values())])
    earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_k").alias("_bk"), F.col("_range").alias("_br"), *[(F.last(f"_t{i}", ignorenulls=True) if op == "last" else fold[op](f"_t{i}")).over(earlier).alias(f"_b{i}") for i, (op, _) in enumerate(values.values())])
    here = rows.withColumns({f"_h{i}": (F.last(F.struct(c.alias("v")), ignorenulls=True) if op == "last" else fold[op](c)).over(frame) for i, (op, c) in enumerate(values.values())})
    joined = here.join(F.broadcast(bases), whole.eqNullSafe(F.col("_bk")) & (F.col("_range") == F.col("_br")), "left")  # a row or two for each range

    def both(i, op):
        h, b = F.col(f"_h{i}"), F.col(f"_b{i}")
        if op == "sum":
            return F.coalesce(h, F.lit(0)) + F.coalesce(b, F.lit(0))
        return F.coalesce(h, b)["v"] if op == "last" else {"max": F.greatest, "min": F.least}[op](h, b)

    return joined.select(*rows.columns, *[both(i, op).alias(n) for i, (n, (op, _)) in enumerate(values.items())])

"""Operational audits and integrity expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators import ordering, staging


class IntegrityError(ValueError):
    """An expectation on the data does not hold."""


def expect_equal(actual: dict, expected: dict) -> None:
    """Fail with every difference between two audits."""
    found = [f"{k}: {actual.get(k)!r} is not {expected.get(k)!r}" for k in sorted({*actual, *expected}) if actual.get(k) != expected.get(k)]
    if found:
        raise IntegrityError("; ".join(found))


def expect_none(df: DataFrame, what: str) -> None:
    """Fail if there is any row, showing a few."""
    rows = df.limit(5).collect()
    if rows:
        raise IntegrityError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def expect_columns(df: DataFrame, allowed: list[str]) -> None:
    """Fail if a public or blinded table has any other column."""
    extra = set(df.columns) - set(allowed)
    if extra:
        raise IntegrityError(f"columns that may not be there: {sorted(extra)}")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with by how much each: one exchange for both directions."""
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*cols).withColumn("_n", F.lit(-1)))
    rows = both.groupBy(*cols).agg(F.sum("_n").alias("d")).filter("d <> 0")
    return rows.withColumn("side", F.when(F.col("d") > 0, "left").otherwise("right")).withColumn("n", F.abs("d")).drop("d")


def completeness(left: DataFrame, right: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Combinations of two domains that were not observed."""
    return left.crossJoin(staging.if_small(right)).join(observed.select(*keys).distinct(), keys, "left_anti")


def latency_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, both with or both without a time zone; negative if the end comes first."""
    span = end - start
    part = lambda field: F.extract(F.lit(field), span).cast("decimal(18,6)")
    return (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("double")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and a closed set of column values, zero-filled."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


HASHED_ROWS = 65_536


def projection_hash(df: DataFrame, order: list[str], fields: list[str], rows: int = HASHED_ROWS) -> DataFrame:
    """Digest of chosen fields of all rows in a total order, that doesn't depend on how rows are stored.

    Each row's canonical JSON is hashed, nulls written and keys sorted. The
    hashes of ``rows`` rows that follow one another are hashed together, and so
    are the digests of all these runs, so no task gathers more than a run's
    hashes or the runs' digests.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
    hashed = ordering.with_position(df.select(*order, row.alias("_hash")), [F.col(o) for o in order], "_place")
    together = lambda key, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, h))), lambda x: x[h]), "\n"), 256)
    runs = hashed.groupBy(F.floor(F.col("_place") / rows).alias("_run")).agg(F.count("*").alias("n"), together("_place", "_hash").alias("h"))
    return runs.agg(F.sum("n").alias("n"), together("_run", "h").alias("digest"))


def coverage(df: DataFrame, key: str) -> DataFrame:
    """Groups by size, with the share of all rows that the groups up to each of them hold."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    ranked = ordering.running(n, [], [-F.col("n"), F.col(key)], {"place": F.lit(1).cast("long"), "upto": F.col("n")})
    total = n.agg(F.sum("n").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select(F.col("place").cast("int").alias("place"), key, "n", (F.col("upto") * 100.0 / F.col("total")).alias("percent"))


def attempt_faults(attempts: DataFrame, responses: DataFrame, key: str, most: int) -> DataFrame:
    """Keys whose attempts are more than allowed or not retries + 1."""
    n = attempts.groupBy(key).agg(F.count("*").alias("attempts"))
    rows = responses.select(key, "retry_count").join(n, key, "full")
    return rows.filter(~F.coalesce((F.col("attempts") >= 1) & (F.col("attempts") <= most) & (F.col("attempts") == F.col("retry_count") + 1), F.lit(False)))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Places from 1 of the few rows of a report."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))

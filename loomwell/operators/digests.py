"""Digest trees: two tables are compared by descending where their digests differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 4  # binary digits of a leaf's number from one level to the next
LEAF_BITS = 12


def leaf(keys: list[str], bits: int = LEAF_BITS):
    """The leaf of a row, by its keys, so a row that comes or goes moves no other."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << bits)).cast("int")


def _hash(fields: list[str]):
    """Two halves of a row's digest as numbers, so that digests add up in any order."""
    body = F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(body, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]


def tree(df: DataFrame, keys: list[str], fields: list[str], bits: int = LEAF_BITS) -> DataFrame:
    """(level, node, n, digest): level 0 is the root, the last level the leaves.

    A leaf's digest is that of the sums of its rows' digests, which tasks add up
    before anything is shuffled; a repeated row counts each time. A node's digest
    is that of its children's in order. There are as many nodes whatever the table.
    """
    levels = -(-bits // STEP)
    rows = df.select(leaf(keys, bits).alias("node"), *[h.alias(f"h{i}") for i, h in enumerate(_hash(fields))])
    sums = rows.groupBy("node").agg(F.count("*").alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])
    level = sums.select(F.lit(levels).alias("level"), "node", "n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.col(f"h{i}").cast("string") for i in range(4)]), 256).alias("digest"))
    out = level
    for i in range(levels - 1, -1, -1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"])), "\n")
        level = level.groupBy(F.shiftright("node", STEP).alias("node")).agg(F.sum("n").alias("n"), F.sha2(children, 256).alias("digest")).select(F.lit(i).alias("level"), "node", "n", "digest")
        out = out.unionByName(level)
    return out


def differing_leaves(a: DataFrame, b: DataFrame) -> list[int]:
    """Numbers of the leaves in which two trees differ, found from the root down: of each level only children of nodes that differ are read."""
    levels = max(a.agg(F.max("level")).first()[0] or 0, b.agg(F.max("level")).first()[0] or 0)
    open_ = [0]
    for i in range(levels + 1):
        at = lambda t: t.filter((F.col("level") == i) & F.shiftright("node", STEP if i else 0).isin(open_)).select("node", "digest")  # noqa: B023, E731
        both = at(a).join(at(b).withColumnRenamed("digest", "other"), "node", "full").filter(~F.col("digest").eqNullSafe(F.col("other")))
        open_ = sorted(r.node for r in both.select("node").collect())  # 2 ** bits of them at most
        if not open_:
            break
    return open_


def difference(a: DataFrame, b: DataFrame, trees: tuple[DataFrame, DataFrame], keys: list[str], fields: list[str], bits: int = LEAF_BITS) -> DataFrame:
    """Rows that one table has more often, with side and n; only rows of leaves that differ are compared."""
    from loomwell.operators.audit import multiset_difference

    leaves = differing_leaves(*trees)
    some = lambda t: t.filter(leaf(keys, bits).isin(leaves) if leaves else F.lit(False)).select(*fields)
    return multiset_difference(some(a), some(b))

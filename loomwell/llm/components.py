"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def _clean(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (two long columns), root being the least reachable node.

    In turns every node links its larger and its smaller neighbours to the least
    one, until nothing changes, which a number of rounds by the square of the
    logarithm of the nodes suffices for, and far fewer in practice. The
    least neighbours are aggregated before they are joined back, so a node with
    very many neighbours is neither gathered in a task nor squared. Each round
    is written to the shared folder.
    """
    cols = edges.columns
    now = _shared.settle(_clean(edges.select(F.col(cols[0]).cast("long").alias("a"), F.col(cols[1]).cast("long").alias("b"))), "edges")
    before = None
    while True:
        # Large star: each node's larger neighbours go to its least neighbour (or itself).
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _clean(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: each node and its smaller neighbours go to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = _shared.settle(_clean(small), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

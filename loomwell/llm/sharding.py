"""Sharding by balanced label propagation, with row counts at most one apart.

Documents with equal texts are linked, each with every other. They start in shards by
rank, so that all shards are equally full. In every round the documents of a group look
where most of their neighbours are and ask to move there. How many may go from one
shard to another is decided for all pairs of shards at once: all ask, and where
more would come than the quota holds after others have left, the last are refused,
which keeps others where they are, until everything fits. Moves with the most neighbours at the
goal go first. Documents without links take whatever room is left, so they are never in the way.
A move always joins a smaller part of a group with one at least as large, so the
cut edges fall with every round that moves anything. When no round does, groups
that are still cut ask as a whole for any shard with room for all of them, and
propagation goes on from there, until that moves nothing either.

Equal texts are interchangeable, so the rounds only know how many documents of a group are
in each shard: a table of cells with at most a row for each linked document. Groups
that no shard can hold are cut beforehand into parts of a shard's size. In the end the
documents of a group are dealt to its cells by rank, and those without links fill the
quotas, so the law holds exactly.

Ranks are running sums in two levels (``_shared.with_prefix``), so no task sorts
a shard or a group as a whole. Only figures for pairs of shards reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def flows(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of ``asked[a][t]`` may go from shard a to t, so that no shard gets more than leave it and its room.

    All go at first. A shard that would be too full takes fewer from each, in
    proportion; what then stays elsewhere may make that too full, and so on. Every
    step takes some away, so it ends, at the latest with nothing.
    """
    n = len(room)
    out = [list(r) for r in asked]
    while True:
        over = [sum(out[a][t] for a in range(n)) - sum(out[t]) - room[t] for t in range(n)]
        t = max(range(n), key=lambda i: over[i])
        if over[t] <= 0:
            return out
        come = sum(out[a][t] for a in range(n))
        left = over[t]
        for a in sorted(range(n), key=lambda i: -out[i][t]):
            cut = min(left, out[a][t], -(-out[a][t] * over[t] // come))
            out[a][t] -= cut
            left -= cut


def _bucket(n: Column, key: list[str], turn: int) -> Column:
    """Cells of ranks: large counts first, and of about one size spread by hash."""
    return (F.lit(40) - F.least(F.lit(40), F.floor(F.log2(n))).cast("int")) * 16 + F.pmod(F.xxhash64(*key, F.lit(turn)), F.lit(16)).cast("int")


def _applied(cells: DataFrame, moves: DataFrame) -> DataFrame:
    """The cells after ``moves`` (g, part, n, shard, target, m)."""
    deltas = moves.select("g", "part", "n", F.explode(F.array(F.struct("shard", (-F.col("m")).alias("here")), F.struct(F.col("target").alias("shard"), F.col("m").alias("here")))).alias("d")).select("g", "part", "n", "d.*")
    found = cells.select("g", "part", "n", "shard", "here").union(deltas).groupBy("g", "part", "n", "shard").agg(F.sum("here").alias("here"))
    return _shared.settle(found.filter("here > 0"), "shard-cells")


def _state(cells: DataFrame, shards: int) -> tuple[list[int], int]:
    """Linked documents of each shard, and the pairs of a group that lie apart."""
    pairs = lambda c: c.cast("decimal(38,0)") * (c - 1)
    got = cells.groupBy("shard").agg(F.sum("here").alias("n"), F.sum(pairs(F.col("here"))).alias("near")).collect()  # a row for each shard
    whole = cells.select("g", "here").groupBy("g").agg(F.sum("here").alias("n")).agg(F.sum(pairs(F.col("n")))).first()[0] or 0
    load = {r.shard: r.n for r in got}
    return [load.get(s, 0) for s in range(shards)], int(whole - sum(r.near for r in got)) // 2


def propagate(cells: DataFrame, quota: list[int], log: list[dict] | None = None) -> DataFrame:
    """Cells (g, part, n, shard, here) after propagation within the quotas; ``log`` gets the cut edges of every round.

    Parts of one group that meet in a shard count as apart, so the edges in ``log`` are never too few.
    """
    shards = len(quota)
    load, cut = _state(cells, shards)
    turn = 0
    note = lambda moved, kind: log.append({"round": turn, "moved": moved, "cut_edges": cut, "kind": kind}) if log is not None else None
    note(0, "start")
    while cut:
        turn += 1
        room = [q - x for q, x in zip(quota, load)]
        best = cells.groupBy("g", "part").agg(F.max(F.struct("here", F.xxhash64("g", "part", "shard").alias("draw"), "shard")).alias("b"), F.count("*").alias("k")).filter("k > 1")
        asks = _shared.settle(cells.join(best, ["g", "part"]).filter("shard <> b.shard").select("g", "part", "n", "shard", "here", F.col("b.shard").alias("target"), F.col("b.here").alias("there")), "shard-asks")
        asked = [[0] * shards for _ in range(shards)]
        for r in asks.groupBy("shard", "target").agg(F.sum("here").alias("n")).collect():  # a row for each pair of shards
            asked[r.shard][r.target] = r.n
        allowed = flows(asked, room)
        kind = "neighbours"
        if any(map(any, allowed)):
            ranked = _shared.with_prefix(asks, ["shard", "target"], [F.desc("there"), F.col("g"), F.col("part")], weight=F.col("here"), bucket=_bucket(F.col("there"), ["g", "part"], turn), name="before")
            most = _pick([x for row in allowed for x in row], F.col("shard") * shards + F.col("target"))
            moves = ranked.withColumn("m", F.least(F.col("here"), most - F.col("before"))).filter("m > 0")
        else:
            # Groups as a whole, each to a shard that could hold it, the larger ones first.
            kind = "whole groups"
            able = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: _pick(room, s) >= F.col("n"))
            groups = asks.select("g", "part", "n").distinct().withColumn("target", F.try_element_at(able, (F.pmod(F.xxhash64("g", "part", F.lit(turn)), F.greatest(F.size(able), F.lit(1))) + 1).cast("int"))).filter("target IS NOT NULL")
            ranked = _shared.with_prefix(groups, ["target"], [F.desc("n"), F.col("g"), F.col("part")], weight=F.col("n"), bucket=_bucket(F.col("n"), ["g", "part"], turn), name="before")
            granted = ranked.filter(F.col("before") + F.col("n") <= _pick(room, F.col("target"))).select("g", "part", "target")
            moves = cells.join(granted, ["g", "part"]).filter("shard <> target").withColumn("m", F.col("here"))
        moves = _shared.settle(moves.select("g", "part", "n", "shard", "target", "m"), "shard-moves")
        moved = moves.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        if not moved:
            break
        cells = _applied(cells, moves)
        load, cut = _state(cells, shards)
        note(moved, kind)
    return cells


def shards(docs: DataFrame, *, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", log: list[dict] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``rows``: shards differ by one row at most; ``grown_shard`` is
    null. A null text has no bytes and is one group with the empty text. Null
    ids are rows as others; repeated rows are placed each; with fewer rows than
    shards some shards stay empty; an empty table gives no rows. Of a text of any
    length only its size and digests are moved; columns other than the two named
    take no part, whatever they are called. ``log`` gets a dict for each round: moved documents and cut edges.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("g"),
    )
    base = _shared.settle(base.withColumn("h", F.xxhash64("doc_id", "g")), "shard-rows")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(1, total // shards)
    buckets = max(64, total // (shards * 20_000))  # cells of about 20,000 rows, of a shard or of what is not granted
    spread = max(512, total // 20_000)
    spot = lambda salt, n: F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(n)).cast("int")

    sizes = _shared.settle(base.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "shard-groups")
    giants = F.broadcast(sizes.filter(F.col("n") > most).select(F.col("g").alias("giant"), F.col("n").alias("giant_n")))  # no more than `shards` + 1 rows
    split = base.join(giants, F.col("g") == F.col("giant"), "left")
    large = _shared.with_prefix(split.filter("giant IS NOT NULL"), ["g"], [F.col("h"), F.col("doc_id")], bucket=spot(1, max(256, most // 20_000)), name="rank")
    large = large.withColumn("part", F.floor(F.col("rank") / most).cast("int"))
    large = large.withColumn("n", F.least(F.lit(most).cast("long"), F.col("giant_n") - F.col("part").cast("long") * most))
    small = split.filter("giant IS NULL").drop("giant", "giant_n").join(sizes.filter(F.col("n") <= most), "g", "left")
    cols = ["doc_id", "size", "text_crc32", "g", "h", "part", "n"]
    small = small.withColumn("part", F.lit(0)).withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    linked = _shared.settle(small.filter("n > 1").select(*cols).union(large.select(*cols)), "shard-linked")
    start = _shared.with_prefix(linked, [], [F.col("h"), F.col("doc_id"), F.col("size")], bucket=spot(2, spread), name="rank")
    start = start.groupBy("g", "part", "n", F.pmod("rank", F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("here"))
    cells = propagate(_shared.settle(start, "shard-cells"), quota, log)
    load, _ = _state(cells, shards)

    # The documents of a group go to its cells by rank.
    upto = F.sum("here").over(Window.partitionBy("g", "part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    ends_ = cells.withColumn("upto", upto).groupBy("g", "part").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ends"))  # a struct for each shard at most
    inner = F.when(F.col("n") > 20_000, F.pmod(F.xxhash64("h", F.lit(5)), F.ceil(F.col("n") / 20_000))).otherwise(0).cast("int")
    linked = _shared.with_prefix(linked, ["g", "part"], [F.col("h"), F.col("doc_id"), F.col("size")], bucket=inner, name="rank")
    goal = F.filter("ends", lambda e: F.col("rank") < e["upto"])[0]["shard"]
    linked = linked.join(ends_, ["g", "part"]).select("doc_id", "size", "text_crc32", "h", goal.alias("shard"))
    # Documents without links fill what room is left.
    alone = _shared.with_prefix(small.filter("n = 1").select(*cols), [], [F.col("h"), F.col("doc_id"), F.col("size")], bucket=spot(3, spread), name="rank")
    ends, at = [], 0
    for q, x in zip(quota, load):
        at += q - x
        ends.append(at)
    goal = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("rank")))
    alone = alone.select("doc_id", "size", "text_crc32", "h", goal.cast("int").alias("shard"))
    final = _shared.settle(linked.union(alone), "shard-final")
    final = _shared.with_prefix(final, ["shard"], [F.col("h"), F.col("doc_id"), F.col("size")], bucket=spot(4, buckets), name="slot")
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

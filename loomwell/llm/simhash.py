"""SimHash near-duplicates by the generalised pigeonhole principle.

64 bits are grouped into partitions, correlated bits together, and partition i
gets its own threshold t_i so that sum(t_i + 1) = radius + 1: two fingerprints
within the radius are then within t_i of each other in some partition (a
threshold of -1 leaves a partition out). Dynamic programming picks thresholds,
and among numbers of partitions the best, by candidate counts estimated on a
sample; the sample decides the cost and never the result. Each fingerprint is
indexed by its bits in a partition and probes all values within the threshold;
what meets is verified. Equal fingerprints are one throughout.

A value that very many different fingerprints share would make candidates by the
square. Fingerprints that meet in such a value are linked another exact way:
two of them are within 2 bits if and only if flipping at most one bit of each
can make them equal, so they are grouped by what one flip makes of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared, pieces
from .components import components

BITS, RADIUS = 64, 2


def hashes(text: str, shingle: int):
    """Hashes of the shingles of a text in their order, repeats included; fewer words are one shingle, none has none."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z, and only space and U+0009 to U+000D
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) > shingle else [words]
    return np.fromiter([h(b" ".join(s), 42) for s in parts], np.uint64)


def majority(found) -> int:
    """The number whose bits are those that more than half of the hashes have; 0 without hashes."""
    import numpy as np

    total = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 1 << 14):
        part = found[i:i + (1 << 14)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned fingerprint of a whole text; 0 without words."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import numpy as np

        pieces.release()
        for b in pieces.text_batches(batches, "text"):
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return _shared.map_batches(rows, run, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Masks of the partitions, their thresholds, and the candidates expected."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    cost: float


def partitions(sample, parts: int) -> list[int]:
    """Masks of ``parts`` groups of bits: each group is grown by the bit most correlated with it."""
    import numpy as np

    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    x = bits.astype(float) - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    left, out = list(range(BITS)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            nxt = max(left, key=lambda b: corr[b, group].sum())
            group.append(nxt)
            left.remove(nxt)
        out.append(sum(1 << b for b in group))
    return out


def choose(sample, *, rows: int = 1_000_000, radius: int = RADIUS, most_parts: int = 4, probe_cost: float = 1.0) -> Plan:
    """Partition and allocate thresholds by dynamic programming over the candidates estimated for ``rows`` fingerprints."""
    import numpy as np

    best = None
    n = float(max(rows, 1))
    some = sample[:1500]
    for parts in range(1, min(most_parts, radius + 1) + 1):
        masks = partitions(sample, parts)
        costs = []
        for m in masks:
            width = m.bit_count()
            d = np.bitwise_count((some[:, None] ^ some[None, :]) & np.uint64(m))[np.triu_indices(len(some), 1)]
            row = {-1: 0.0}
            for t in range(radius + 1):
                ball = sum(comb(width, i) for i in range(t + 1))
                share = max((d <= t).mean() if len(d) else 0.0, ball / 2.0**width)
                row[t] = n * n / 2 * share + n * ball * probe_cost
            costs.append(row)
        # state: how much of radius + 1 has been handed out
        table = {0: (0.0, ())}
        for row in costs:
            nxt: dict[int, tuple[float, tuple]] = {}
            for used, (c, ts) in table.items():
                for t, extra in row.items():
                    u = used + t + 1
                    if u <= radius + 1 and (u not in nxt or nxt[u][0] > c + extra):
                        nxt[u] = (c + extra, (*ts, t))
            table = nxt
        c, ts = table[radius + 1]
        if best is None or c < best.cost:
            best = Plan(tuple(masks), ts, c)
    return best


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(mask: int, threshold: int) -> list[int]:
    """All changes of at most ``threshold`` bits within a mask, as signed longs, no change first."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    return [_signed(sum(c)) for t in range(threshold + 1) for c in combinations(bits, t)]


def linked(fps: DataFrame, plan: Plan, *, radius: int = RADIUS, crowd: int = 64) -> DataFrame:
    """(a, b): pairs of different fingerprints (column ``fp``, each once) whose links connect all within the radius.

    Values that more than ``crowd`` fingerprints share are not probed; who would
    meet there is linked by flips instead. That way is exact for a radius of 1
    or 2; with another radius every value is probed.
    """
    edges = []
    crowded = []
    for mask, t in zip(plan.masks, plan.thresholds):
        if t < 0:
            continue
        index = fps.select("fp", F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("v"))
        sizes = index.groupBy("v").agg(F.count("*").alias("n"))
        flips = variants(mask, t)
        probes = index if t == 0 else index.select("fp", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: x.bitwiseXOR(F.col("v")))).alias("v"))
        if radius in (1, 2):
            full = sizes.filter(F.col("n") > crowd).select("v")
            crowded.append(probes.join(full, "v", "left_semi").select("fp"))
            index = index.join(full, "v", "left_anti")
        met = index.withColumnRenamed("fp", "a").join(_shared.shuffled(probes.withColumnRenamed("fp", "b")), "v")
        if t == 0:
            met = met.filter("a < b")
        edges.append(met.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if crowded:
        dense = crowded[0]
        for c in crowded[1:]:
            dense = dense.union(c)
        flips = [0, *(_signed(1 << b) for b in range(BITS))] if radius == 2 else None
        dense = dense.distinct()
        if flips:
            ball = dense.select("fp", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: x.bitwiseXOR(F.col("fp")))).alias("v"))
            near = ball.withColumn("m", F.min("fp").over(Window.partitionBy("v")))  # at most 65 share a value
            edges.append(near.filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b")))
        else:  # radius 1: one is the other with a bit changed
            ball = dense.select("fp", F.explode(F.transform(F.array(*[F.lit(_signed(1 << b)) for b in range(BITS)]), lambda x: x.bitwiseXOR(F.col("fp")))).alias("v"))
            edges.append(ball.join(dense.withColumnRenamed("fp", "v"), "v", "left_semi").filter("v < fp").select(F.col("fp").alias("a"), F.col("v").alias("b")))
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def sampled(fps: DataFrame, rows: int = 4000):
    """At most ``rows`` different fingerprints, those with the least hashes, as unsigned integers."""
    import numpy as np

    got = fps.select("fp").distinct().orderBy(F.xxhash64(F.col("fp"), F.lit(1)), "fp").limit(rows).collect()
    return np.array([r.fp for r in got], np.int64).view(np.uint64)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS, crowd: int = 64) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document.

    ``component_id`` is the least id that links reach. A null or empty text has
    fingerprint zero and links with any other that is near; rows with the same
    text are one class; a row with a null id counts in its class, but no
    component is named after it unless it has only such rows (then null).
    Repeated rows are kept, an empty table gives no rows. Texts of any length are
    taken whole; columns other than the two named take no part, whatever they are
    called.
    """
    found = _shared.settle(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = _shared.settle(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    known = sampled(classes)
    if len(known) == 0:
        return found.select("doc_id", F.lit("").alias("fingerprint"), F.col("doc_id").alias("component_id"))
    plan = choose(known, rows=classes.count(), radius=radius)
    roots = components(linked(classes.select("fp"), plan, radius=radius, crowd=crowd))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

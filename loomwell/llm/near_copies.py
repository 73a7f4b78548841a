"""Near copies: all pairs of texts whose sets of word shingles have a Jaccard similarity of 4/5 or more.

Candidates come in two ways, and each is verified on the whole sets.

SimHash fingerprints of the shingles that are equal or differ by two bits, found
by the generalised pigeonhole of ``simhash``, bring most of what is nearly equal
together. At a similarity of 4/5 fingerprints differ by ten bits and more, which
no partition of 64 bits finds without comparing a fixed share of all pairs, so
the rest comes from the shingles themselves: they are put into one order for all
texts; two sets that are similar enough share one of their first
n - ceil(4n/5) + 1 shingles, their prefixes, and at the first one they share
enough must be left in either set. The order goes by how often a shingle is found
in a sample, in powers of two, the rarest first: a shingle that very many texts hold
is in a prefix only where four fifths of a text are as common, so few texts meet
in it. The sample decides the cost and never the result. The search is exact up to
collisions of 64-bit hashes.

Texts with the same set are one class. In a first pass the classes of a shingle
are compared with one of them only; who is linked then is not compared again, so a large group of near copies is not verified pair by pair. Before sets
are compared, bitmaps of the parities of their shingles are: two sets differ in
at least as many shingles as their bitmaps in bits, so no similar pair is lost.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, pieces, simhash
from .components import components

SHINGLE, LEAST = 5, (4, 5)
SHARE = 16  # one text of so many tells which shingles are frequent
GRADE_BITS = 24  # how frequent shingles are is kept for two to this power of residues, in four bits each
MARK_BITS = 2048


def distinct(hashes):
    """The different ones, ascending, as signed integers."""
    import numpy as np

    return np.unique(hashes.view(np.int64))


def shingles(text: str, shingle: int = SHINGLE):
    """The different hashes of a text's shingles, ascending; a text of fewer words is one shingle, none has none."""
    return distinct(simhash.hashes(text, shingle))


def marks(found):
    """A bit for each of MARK_BITS residues: whether an odd number of the hashes falls on it; as 64-bit integers."""
    import numpy as np

    odd = np.bincount((found & (MARK_BITS - 1)).astype(np.intp), minlength=MARK_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _key(found) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def _sets(rows: DataFrame) -> DataFrame:
    """(key, found) of every row."""

    def run(batches):
        for b in pieces.text_batches(batches, "text"):
            found = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(f) for f in found], pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["key", "found"])

    return _shared.map_batches(rows.select("text"), run, "key binary, found array<long>")


def grades(rows: DataFrame):
    """How frequent shingles are in the sample, as the logarithm of their count, for each residue: 16 in a 64-bit integer, 8 MB whatever the corpus."""
    import numpy as np

    some = rows.filter(F.pmod(F.xxhash64("h"), F.lit(SHARE)) == 0).dropDuplicates(["h"])
    counts = _sets(some).select(F.explode("found").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
    at = F.col("token").bitwiseAND(F.lit((1 << GRADE_BITS) - 1))
    by = counts.groupBy(at.alias("at")).agg(F.least(F.lit(15), F.floor(F.log2(F.max("n")))).cast("long").alias("g"))
    nibble = F.call_function("shiftleft", F.col("g"), (F.col("at").bitwiseAND(F.lit(15)) * 4).cast("int"))
    got = by.groupBy(F.shiftright("at", 4).alias("word")).agg(F.bit_or(nibble).alias("bits")).toArrow()
    out = np.zeros(1 << (GRADE_BITS - 4), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def in_order(found, graded):
    """Hashes in the order of all texts: by grade, then ascending."""
    import numpy as np

    at = found & ((1 << GRADE_BITS) - 1)
    return found[np.argsort(graded[at >> 4] >> (at & 15) * 4 & 15, kind="stable")]


def prefixes(rows: DataFrame, graded) -> DataFrame:
    """(doc_id, h, key, size, fp, mark, prefix): fingerprint, bitmap and the first shingles in the order."""
    import numpy as np

    num, den = LEAST
    shared = rows.sparkSession.sparkContext.broadcast(graded)  # of fixed size

    def run(batches):
        pieces.release()
        for b in pieces.text_batches(batches, "text"):
            keys, sizes, fps, bits, firsts = [], [], [], [], []
            for t in b.column("text").to_pylist():
                hashes = simhash.hashes(t, SHINGLE)
                f = distinct(hashes)
                keys.append(_key(f))
                sizes.append(len(f))
                fps.append(simhash.majority(hashes))
                bits.append(marks(f))
                firsts.append(in_order(f, shared.value)[:len(f) + (-num * len(f)) // den + 1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64()),
                 pa.array(bits, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                ["doc_id", "h", "key", "size", "fp", "mark", "prefix"])

    return _shared.map_batches(rows, run, "doc_id long, h long, key binary, size int, fp long, mark array<long>, prefix array<long>")


def _fits(a: str, b: str):
    """Whether sets that first meet here can be similar enough, by their sizes and by what is left of them."""
    num, den = LEAST
    sa, sb = F.col(f"{a}.size"), F.col(f"{b}.size")
    left = F.least(sa - F.col(f"{a}.pos"), sb - F.col(f"{b}.pos"))
    return (den * F.least(sa, sb) >= num * F.greatest(sa, sb)) & ((num + den) * left >= num * (sa + sb))


def _fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): classes whose fingerprints are equal or near, by the pigeonhole search of ``simhash``."""
    least = classes.groupBy("fp").agg(F.min("c").alias("b"))
    known = simhash.sampled(least)
    if not len(known):
        return classes.select(F.col("c").alias("a"), F.col("c").alias("b")).filter("false")
    same = classes.select("fp", F.col("c").alias("a")).join(least, "fp").filter("a <> b").select("a", "b")
    near = simhash.linked(least.select("fp"), simhash.choose(known, rows=least.count()))
    ends = least.select(F.col("fp").alias("f"), "b")
    near = near.select(F.col("a").alias("f"), F.col("b").alias("g")).join(ends.withColumnRenamed("b", "a"), "f").select("a", F.col("g").alias("f")).join(ends, "f").select("a", "b")
    return same.union(near)


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs that are similar enough; whole sets are made for the classes that their bitmaps leave only."""
    num, den = LEAST
    brief = classes.select("c", "size", "mark")
    left, right = (_shared.shuffled(brief.select(F.col("c").alias(c), F.col("size").alias(n), F.col("mark").alias(m))) for c, n, m in (("a", "s", "x"), ("b", "t", "y")))
    both = pairs.join(left, "a").join(right, "b")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    pairs = _shared.settle(both.filter((num + den) * apart <= (den - num) * (F.col("s") + F.col("t"))).select("a", "b").distinct(), "pairs")
    wanted = classes.select("c", "key", "rep").join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c", "left_semi")
    wanted = _shared.settle(wanted.select("c", "key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.h").alias("rep_h")), "wanted")
    some = rows.join(_shared.if_few(wanted.select("rep_id", "rep_h")), (rows.h == F.col("rep_h")) & rows.doc_id.eqNullSafe(F.col("rep_id")), "left_semi")
    sets = _sets(some).join(wanted.select("c", "key"), "key")
    sets = _shared.settle(sets.groupBy("c").agg(F.first("found").alias("found")), "sets")
    both = pairs.join(_shared.shuffled(sets.select(F.col("c").alias("a"), F.col("found").alias("x"))), "a").join(_shared.shuffled(sets.select(F.col("c").alias("b"), F.col("found").alias("y"))), "b")
    common = F.size(F.array_intersect("x", "y"))
    return _shared.settle(both.filter(den * common >= num * (F.size("x") + F.size("y") - common)).select("a", "b"), "links")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, key, ...) of the rows, and (key, root, least) of the classes: the component and the least id of each."""
    rows = _rows(docs, id_col, text_col)
    found = _shared.settle(prefixes(rows, grades(rows)), "prefixes")
    classes = found.groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"), *[F.first(x).alias(x) for x in ("size", "fp", "mark", "prefix")])
    classes = _shared.settle(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    entries = classes.select("c", "size", F.posexplode("prefix").alias("pos", "token"))
    # First one class of each shingle with all others, then whatever is still apart. The one has the shingle earliest in its order,
    # so it has the fewest shingles of its own: where texts are copies of one, it is that one or near it.
    first = entries.groupBy("token").agg(F.min(F.struct("pos", "c", "size")).alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    entries = _shared.settle(entries.join(_shared.shuffled(first), "token"), "entries")
    stars = entries.alias("a").filter("c <> b.c").filter(_fits("a", "b")).select(F.col("c").alias("a"), F.col("b.c").alias("b"))
    links = _verified(stars.union(_fingerprint_pairs(classes)).distinct(), classes, rows)
    roots = components(links)
    part = _shared.settle(entries.join(_shared.if_few(roots), entries.c == roots.node, "left").select("token", "c", "size", "pos", F.coalesce("root", "c").alias("part")), "parts")
    apart = part.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("token")
    part = part.join(_shared.shuffled(apart), "token", "left_semi")
    pairs = part.alias("a").join(_shared.shuffled(part.alias("b")), "token").filter("a.c > b.c AND a.part <> b.part").filter(_fits("a", "b")).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()
    roots = components(links.union(_verified(pairs, classes, rows)))
    named = classes.select("key", "least", "c").join(roots, F.col("c") == roots.node, "left").select("key", "least", F.coalesce("root", "c").alias("root"))
    return found, _shared.settle(named, "named")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id of every document.

    ``component_id`` is the least id that links reach. Null and empty texts and
    those without words are one class; a row with a null id counts in its class,
    but no component is named after it unless it has only such rows (then null).
    Texts of any length are taken whole. Repeated rows are kept, columns other
    than the two named take no part, whatever they are called, and an empty table
    gives no rows.
    """
    found, named = _rooted(docs, id_col, text_col)
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return found.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, with all columns.

    It is one with the least id (null ids come last), and of those with that id the text with the
    least hash: what else has the same id, in this group or another, is judged by its
    own text. Of rows that repeat id and text the one with the least other columns stays. Null
    and empty texts and those without words are one group; texts of any length are taken whole;
    extra columns may be called anything, and an empty table gives no rows.
    """
    found, named = _rooted(docs, id_col, text_col)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("m")
    chosen = found.select("doc_id", "h", "key").join(named.select("key", "root"), "key").groupBy("root").agg(least)
    key, none, h, text, null = (_shared.fresh(docs, f"_{n}") for n in ("id", "none", "h", "text", "null"))
    chosen = chosen.select(F.col("m.id").alias(key), F.col("m.none").alias(none), F.col("m.h").alias(h))
    whole = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), none: F.col(id_col).isNull(), h: F.xxhash64(whole), text: whole, null: F.col(text_col).isNull()})
    rest = F.min(F.struct(*[c for c in docs.columns if c != text_col], null)).alias("rest")
    kept = rows.drop(text_col).join(chosen, [key, none, h], "left_semi").groupBy(key, none, h, text).agg(rest).select("rest.*", text)
    return kept.withColumn(text_col, F.when(~F.col(null), F.col(text))).select(docs.columns)

"""Phrase collocations by level-wise passes (Apriori) over whole texts.

Level k reads all texts and counts phrases of k words, but only where both phrases
of k - 1 words that overlap in them are frequent; the others cannot be. What is
frequent at level k - 1 goes to the tasks as a bitmap of hashes of fixed size,
whatever the corpus. A hash that is taken by another phrase lets a phrase through
that is then counted and dropped like any other, so the bitmap decides the cost
and never the result: counts are by the phrases themselves.

Tasks count in numpy, within some millions of words, before Spark sums up by phrase, so
a phrase that fills a third of the corpus is one row a task. The frequent phrases
of all levels form one table, from which cuts are scored with joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared, pieces

#: Signs that end a piece, and what stands between words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
FILTER_BITS = 26
#: Words that a task holds before it hands its counts over, and different ones before it forgets them.
HELD, KNOWN = 1_000_000, 200_000
SLICE = 1 << 20

_TABLE = bytes.maketrans(ENDS + bytes(range(65, 91)), b"," * len(ENDS) + bytes(range(97, 123)))


class Words(dict):
    """Numbers of words, given as they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b",": 0})
        self.words = [b","]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


def numbers(text: bytes, known: Words):
    """Word numbers of a text with 0 between pieces and at its end; long texts are taken slice by slice, cut between words."""
    import numpy as np

    text = text.translate(_TABLE)
    out, at = [], 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):  # up to the next blank or end of a piece, whichever comes first
            stops = [x for x in (text.find(s, end) for s in (b" ", b"\t", b",")) if x >= 0]
            end = min(stops, default=len(text))
        found = text[at:end].replace(b",", b" , ").split()
        out.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
        at = end
    out.append(np.zeros(1, np.int32))
    return np.concatenate(out)


def mixed(before, word):
    """Hashes of phrases that end with a word, from the hashes of what stands before it and of the word."""
    import numpy as np

    x = (before ^ (word + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def hashed(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def runs(ids, hashes, k: int):
    """Hashes of the phrases of k words that begin at each place."""
    h = hashes[ids[:len(ids) - k + 1]]
    for j in range(1, k):
        h = mixed(h, hashes[ids[j:len(ids) - k + 1 + j]])
    return h


def holds(bits, h):
    """Which hashes the bitmap marks."""
    import numpy as np

    at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def counted(ids, hashes, k: int, bits):
    """(first place, count) of each different phrase of k words within pieces whose two parts ``bits`` marks."""
    import numpy as np

    m = len(ids) - k + 1
    if m <= 0:
        return (np.zeros(0, np.int64),) * 2
    ok = np.ones(m, bool)
    for j in range(k):
        ok &= ids[j:m + j] != 0
    if bits is not None:
        part = holds(bits, runs(ids, hashes, k - 1))
        ok &= part[:m] & part[1:m + 1]
    at = np.flatnonzero(ok)
    if not len(at):
        return (np.zeros(0, np.int64),) * 2
    # Exact codes of phrases: words, then pairs of codes made dense, never the hashes.
    code = ids[at].astype(np.int64)
    for j in range(1, k):
        code = np.unique(code, return_inverse=True)[1] if j > 1 else code
        code = code << 32 | ids[at + j]
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def _level(rows: DataFrame, k: int, bits, least: int) -> DataFrame:
    """(lang, phrase, f) of the phrases of k words found ``least`` times or more; level 1 adds the count of all words as phrase ''."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def batch(lang, phrases, n):
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "phrase", "f"])

    def run(batches):
        pieces.release()
        held: dict[str, list] = {}
        known, n_held = Words(), 0

        def counts():
            hashes = hashed(known.words)
            for lang, parts in held.items():
                ids = np.concatenate(parts)
                first, n = counted(ids, hashes, k, shared.value if shared else None)
                for i in range(0, len(first), 20_000):
                    at = first[i:i + 20_000]
                    words = [[known.words[x] for x in ids[at + j].tolist()] for j in range(k)]
                    yield batch(lang, words[0] if k == 1 else list(map(b" ".join, zip(*words))), n[i:i + 20_000])
                if k == 1:
                    yield batch(lang, [b""], [int((ids != 0).sum())])

        for b in pieces.text_batches(batches, "text"):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary())):
                ids = numbers(text.as_py(), known)
                held.setdefault(lang, []).append(ids)
                n_held += len(ids)
                if n_held >= HELD or len(known) >= KNOWN:
                    yield from counts()
                    held.clear()
                    known, n_held = Words(), 0
        yield from counts()

    found = _shared.map_batches(rows, run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def bitmap(level: DataFrame):
    """The hashes of a level as 2 ** FILTER_BITS bits: 8 MB for any number of phrases."""
    import numpy as np

    def run(batches):
        for b in batches:
            known = Words()
            ids = [[known[w] for w in p.encode().split(b" ")] for p in b.column("phrase").to_pylist()]
            hashes = hashed(known.words)
            places = np.array([int(runs(np.array(x), hashes, len(x))[0] >> np.uint64(64 - FILTER_BITS)) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    got = level.filter("phrase <> ''").select("phrase").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out


def levels(docs: DataFrame, *, longest: int = 4, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, k, phrase, f) of all frequent phrases up to ``longest`` words; k 0 and phrase '' hold the count of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    out, bits = None, None
    for k in range(1, longest + 1):
        level = _shared.settle(_level(rows, k, bits, least), f"phrases-{k}")
        part = level.select("lang", F.when(F.col("phrase") == "", 0).otherwise(k).alias("k"), "phrase", "f")
        out = part if out is None else out.union(part)
        if k < longest:
            bits = bitmap(level)
            if not bits.any():
                break
    return out


def _exact(c: Column, digits: int = 20) -> Column:
    return c.cast(f"decimal({digits},0)")


def scored(table: DataFrame, *, scale: int = 2_000_000, keep: tuple[int, int] = (80, 100)) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words and more that no longer one makes superfluous.

    A cut after k words scores floor(scale * a / (l + r)); the least score counts,
    then the least k. A phrase goes if a longer one that holds it occurs at least
    ``keep`` as often. As a phrase is at least as frequent as what it is part of,
    asking those that are one word longer is enough.
    """
    grams = table.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    longer = grams.filter("k >= 3").select("lang", F.explode(F.array(join(F.lit(1), F.col("k") - 1), join(F.lit(2), F.col("k") - 1))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    num, den = keep
    left = grams.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (_exact(F.col("most")) * den < _exact(F.col("a")) * num)).drop("most")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda c: F.struct(c.alias("cut"), F.array_join(F.slice("w", F.lit(1), c), " ").alias("first"), F.array_join(F.slice("w", c + 1, F.col("k") - c), " ").alias("rest"))))
    cuts = left.select("lang", "phrase", "a", cut.alias("x")).select("lang", "phrase", "a", "x.*")
    parts = table.filter("k >= 1").select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast(a AS decimal(20,0)) * cast({scale} AS decimal(7,0)) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each lang by score, a, phrase, with their rank.

    A histogram of scores, in steps of 1024 and so of less than a thousand rows a lang, tells
    from which step on rows are needed; those are ranked in parts of each lang, then together.
    """
    hist = found.groupBy("lang", F.shiftright("score", 10).alias("step")).agg(F.count("*").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    floor = hist.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).filter(F.col("above") < top).groupBy("lang").agg((F.min("step") * 1024).alias("floor"))
    some = found.join(floor, "lang").filter("score >= floor").drop("floor").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("part")


def mine(docs: DataFrame, *, longest: int = 4, least: int = 30, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language.

    Texts are lower-cased in A-Z only, split into pieces and those into words; phrases
    lie within pieces, overlaps count. A null lang is ``und``; null and empty texts
    have no words, and a lang without frequent phrases has no rows, nor has an empty table. Texts of
    any length are taken whole. Repeated rows count as often as they come; ties
    in score go by count, then by the phrase's bytes. Columns other than the two
    named take no part, whatever they are called.
    """
    table = _shared.settle(levels(docs, longest=longest, least=least, text_col=text_col, lang_col=lang_col), "phrases")
    found = _shared.settle(scored(table), "phrase-scores")
    totals = table.filter("k = 0").select("lang", F.col("f").alias("n"))
    return first_of_each(found, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

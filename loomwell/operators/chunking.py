"""Overlapping chunks of whole atoms (lines or words) with their provenance."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What str.split() and \s of the SQL engines have in common.
RULES = ["first_not_at_zero", "index_not_consecutive", "start_not_increasing", "gap", "atom_not_covered", "overlap_too_long", "length_differs"]
BATCH_BYTES = 1 << 20  # of text whose chunks are made at once
# Spark's own bounds of what goes to a Python worker at once, and smaller ones: a worker holds a batch as it comes, whatever is made of it.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}
_WORDS = re.compile(r"[^ \t\n\r\f\v]+")


def fold(lengths: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges [first, end) of atoms: each as many as fit ``size`` with one character between two.

    The next chunk starts with those atoms at the end of the last whose joined
    length is at most ``overlap`` and beside which the next atom still fits. An
    atom longer than ``size`` is a chunk by itself.
    """
    out = []
    first, used = 0, 0  # atoms of the open chunk, their joined length
    i = 0
    while i < len(lengths):
        n = lengths[i]
        if i > first and used + 1 + n > size:
            out.append((first, i))
            while i > first and (used > overlap or used + 1 + n > size):
                used -= lengths[first] + (1 if i - first > 1 else 0)
                first += 1
            used = max(used, 0)
        used = used + 1 + n if i > first else n
        i += 1
    if lengths:
        out.append((first, len(lengths)))
    return out


def _small_batches(df: DataFrame) -> DataFrame:
    """``df``, after settings of the session that are still Spark's own are replaced by smaller ones; any other stays."""
    conf = df.sparkSession.conf
    for name, (usual, own) in BATCHES.items():
        if conf.get(name, usual) == usual:
            conf.set(name, own)
    return df


def _slices(batch):
    """A batch in parts that don't hold much text, one row at least."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > BATCH_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def chunk(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 200, overlap: int = 10, atoms: str = "lines") -> DataFrame:
    """key, chunk_index, first_atom, end_atom, start, end, chunk, oversize.

    ``atoms`` is ``lines`` (joined by line feeds) or ``words`` (by one space, so
    places count in the text with white space collapsed). Texts are folded one by
    one in Arrow batches; a null text counts as empty and gives no chunk of
    words and one empty chunk of lines. What a worker holds is bounded by a batch of 4 MB
    and the chunks of 1 MB of text, or of one longer text, however large the table is.
    """
    joiner = "\n" if atoms == "lines" else " "

    def run(batches):
        import pyarrow as pa

        for b in (part for whole in batches for part in _slices(whole)):
            cols: list[list] = [[] for _ in range(8)]
            for k, whole in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts = whole.split("\n") if atoms == "lines" else _WORDS.findall(whole)
                lengths = [len(p) for p in parts]
                starts, at = [], 0
                for n in lengths:
                    starts.append(at)
                    at += n + 1
                for i, (a, e) in enumerate(fold(lengths, size, overlap)):
                    body = joiner.join(parts[a:e])
                    for c, v in zip(cols, (k, i, a, e, starts[a], starts[a] + len(body), body, len(body) > size)):
                        c.append(v)
            kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [key, "chunk_index", "first_atom", "end_atom", "start", "end", "chunk", "oversize"])

    kind = docs.schema[key].dataType.simpleString()
    return _small_batches(docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text))).mapInArrow(run, f"{key} {kind}, chunk_index int, first_atom int, end_atom int, start long, end long, chunk string, oversize boolean")


def violations(chunks: DataFrame, *, key: str = "doc_id", overlap: int = 10) -> DataFrame:
    """Chunks that break an invariant of the sequence, with its name; none if all is well."""
    w = Window.partitionBy(key).orderBy("chunk_index")
    before = chunks.withColumn("_s", F.lag("start").over(w)).withColumn("_e", F.lag("end").over(w)).withColumn("_i", F.lag("chunk_index").over(w)).withColumn("_a", F.lag("end_atom").over(w))
    rules = F.array(
        *[F.when(broken, name) for name, broken in zip(RULES, (
            F.col("_i").isNull() & (F.col("start") != 0), F.col("chunk_index") != F.coalesce(F.col("_i") + 1, F.lit(0)), F.col("start") <= F.col("_s"), F.col("start") - F.col("_e") > 1,
            F.col("first_atom") > F.col("_a"), F.col("_e") - F.col("start") > overlap, F.col("end") - F.col("start") != F.char_length("chunk")))])
    return before.select(key, "chunk_index", F.explode(F.array_compact(rules)).alias("violation"))

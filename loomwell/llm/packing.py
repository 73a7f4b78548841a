"""Best-two-fit packing of token sequences.

Which lengths share a sequence is decided on the histogram of lengths, which has
no more rows than a sequence has tokens, whatever the corpus. A bin is filled
greedily, the longest piece first and then the longest that still fits; then the
bin's smallest piece is replaced by two unpacked ones that fit the expanded gap
more tightly, as long as that gains room. The pattern found is used as often as
the counts allow. Each use exhausts the supply of one of its lengths or leaves
fewer than one bin holds, so there are at most sum(1 + size / length) patterns,
about 41,000 for 4096 tokens. Pieces are then dealt to the places of the
patterns by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _shared, pieces

#: What the table of pieces of a worker may take, for 800,000 of them.
TABLE_BYTES = 160 << 20


def plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in their order, times used) that pack all pieces.

    ``counts`` maps a length (1 to ``size``) to its number of pieces.
    """
    import numpy as np

    left = {n: c for n, c in counts.items() if c > 0}
    active = sorted(left)  # lengths with pieces left
    out = []
    while active:
        pick = [active[-1]]
        need = {active[-1]: 1}
        gap = size - active[-1]

        def fill(gap):
            i = bisect.bisect_right(active, gap) - 1
            while i >= 0:
                n = active[i]
                free = left[n] - need.get(n, 0)
                if free > 0 and n <= gap:
                    take = min(free, gap // n)
                    pick.extend([n] * take)
                    need[n] = need.get(n, 0) + take
                    gap -= take * n
                i = min(i - 1, bisect.bisect_right(active, gap) - 1)
            return gap

        gap = fill(gap)
        while gap and len(pick) > 1:
            small = min(pick)
            room = gap + small
            have = np.array([n for n in active[:bisect.bisect_right(active, room)] if left[n] > need.get(n, 0)], np.int64)
            if not len(have):
                break
            j = np.searchsorted(have, room - have, side="right") - 1  # the longest partner of each
            twice = np.array([left[n] - need.get(n, 0) > 1 for n in have.tolist()])
            j = np.where((j >= 0) & (have[j] == have) & ~twice, j - 1, j)
            total = np.where(j >= 0, have + have[j], -1)
            k = int(total.argmax())
            if total[k] <= small:
                break
            pick.remove(small)
            need[small] -= 1
            for n in (int(have[k]), int(have[j[k]])):
                pick.append(n)
                need[n] = need.get(n, 0) + 1
            gap = fill(room - int(total[k]))
        times = min(left[n] // c for n, c in need.items() if c)
        out.append((pick, times))
        for n, c in need.items():
            left[n] -= c * times
            if c and not left[n]:
                active.pop(bisect.bisect_left(active, n))
                del left[n]
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict:
    """Where pieces go, as arrays sorted by (length, first rank): key, sequence of the first, offset."""
    import numpy as np

    used: dict[int, int] = {}
    keys, firsts, offsets = [], [], []
    sequence = 0
    for pick, times in patterns:
        at = 0
        for n in pick:
            rank = used.get(n, 0)
            keys.append((n << 42) + rank)
            firsts.append(sequence)
            offsets.append(at)
            used[n] = rank + times
            at += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return {"key": np.array(keys, np.int64)[order], "first": np.array(firsts, np.int64)[order], "offset": np.array(offsets, np.int64)[order], "sequences": sequence}


def cut(docs: DataFrame, tokenizer: str, *, size: int, end_id: int | None, id_col: str, text_col: str, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Pieces of the encoded documents, with their rank among those of their length in their task."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        import numpy as np

        enc = pieces.encoder(tokenizer, 800_000 * table_bytes // TABLE_BYTES, table_bytes)
        end = np.array([] if end_id is None else [end_id], "<u4")
        task, ranks = _shared.task_id(), np.zeros(size + 1, np.int64)
        for b in pieces.text_batches(batches, "text"):
            cols: list[list] = [[] for _ in range(6)]
            for doc, x in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                ids = np.concatenate([np.frombuffer(x, enc.dtype).astype("<u4"), end])
                raw = ids.tobytes()
                for piece, at in enumerate(range(0, len(ids), size)):
                    n = min(size, len(ids) - at)
                    for c, v in zip(cols, (doc, piece, at, n, zlib.crc32(raw[4 * at:4 * (at + n)]), int(ranks[n]))):
                        c.append(v)
                    ranks[n] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array([task] * len(cols[0]), pa.int32())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "task"],
            )

    return _shared.map_batches(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, task int")


def pack(docs: DataFrame, tokenizer: str, *, size: int = 4096, end_id: int | None = 1, id_col: str = "doc_id",
         text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens.

    ``table_bytes`` bounds the table of encoded words that a worker keeps; it decides the cost only.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    text counts as empty; it still has its end token (without one, documents
    without ids have no piece). Repeated rows are packed as often as they come,
    null ids are kept, an empty table gives no rows. Only documents longer than
    ``size`` are cut.
    """
    spark = docs.sparkSession
    found = _shared.settle(cut(docs, tokenizer, size=size, end_id=end_id, id_col=id_col, text_col=text_col, table_bytes=table_bytes), "pieces")
    cells = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    cells = _shared.settle(cells, "piece-counts")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    where = spark.sparkContext.broadcast(places(plan(counts, size)))  # bounded: see the head of this module
    before = Window.partitionBy("length").orderBy("task")
    bases = cells.select("task", "length", (F.sum("n").over(before) - F.col("n")).alias("base"))
    ranked = found.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))

    def deal(batches):
        import numpy as np

        key, first, offset = (where.value[k] for k in ("key", "first", "offset"))
        for b in batches:
            own = (b.column("length").to_numpy() << 42) + b.column("rank").to_numpy()
            i = np.searchsorted(key, own, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[i] + own - key[i], pa.int64()), pa.array(offset[i], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""BPE encoding with content-defined chunk reuse, and exact decoding.

A rolling hash over the UTF-8 bytes cuts each text where the content says so, so
a passage that many documents share falls into the same chunks wherever it
stands. Documents are brought together by their least chunk hash; each task
encodes a chunk once and takes it from a table, by its bytes, when it comes again. A chunk's
first and last piece depend on its neighbours: around every join the text from
the last piece kept on the left to the first piece kept on the right is encoded
again by the library, and has to give exactly the ids kept on both sides. Where
it does not, the window grows piece by piece, up to the whole text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, pieces

WINDOW, MEAN_BITS, LEAST, MOST = 16, 10, 128, 16384

_CHUNKS: dict[tuple, dict] = {}
pieces._ALSO.append(_CHUNKS.clear)


def _gear():
    import numpy as np

    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_places(raw: bytes, gear=None) -> list[int]:
    """Ends of the chunks of ``raw``, the last being its length; none if empty.

    A cut follows a byte where the hash of the last 16 bytes has its ten highest
    bits clear. Chunks have 128 bytes at least and 16384 at most, the last one
    excepted, and never end inside a character.
    """
    import numpy as np

    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    g = (_gear() if gear is None else gear)[b]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint32(k)
    at = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, last = [], 0
    for p in [*at.tolist(), n]:
        while p - last > MOST + LEAST:
            last = _whole(raw, last + MOST)
            out.append(last)
        p = _whole(raw, p)
        if p - last >= LEAST and p < n:
            out.append(p)
            last = p
    return [*out, n]


def _whole(raw: bytes, p: int) -> int:
    while p < len(raw) and raw[p] & 0xC0 == 0x80:
        p += 1
    return p


class ChunkEncoder:
    """Encodes documents with a table of chunks of at most about ``size`` bytes and one of ``pieces_limit`` pieces.

    A chunk is known by its bytes. Of each the table keeps its pieces, the ids of
    all but the first and last, and where each piece's ids begin among them.
    """

    def __init__(self, tokenizer: str, size: int = 48 << 20, pieces_limit: int = 300_000):
        self.enc = pieces.encoder(tokenizer, pieces_limit)
        self.size = size
        self.kept = _CHUNKS.setdefault((tokenizer, size), {"table": {}, "held": 0})
        self.gear = _gear()
        self.met = self.fresh = self.widened = 0

    def _chunk_parts(self, chunks: list[bytes]) -> list[tuple]:
        """For each chunk: its pieces, and the ids of what lies between its first and last piece."""
        table = self.kept["table"]
        new = dict.fromkeys(c for c in chunks if c not in table)
        self.met, self.fresh = self.met + len(chunks), self.fresh + len(new)
        cost = sum(6 * len(c) + 300 for c in new)
        if self.kept["held"] + cost > self.size:
            held = {c: table[c] for c in chunks if c in table}
            table.clear()
            table.update(held)
            self.kept["held"] = sum(6 * len(c) + 300 for c in held)
        if new:
            self.kept["held"] += cost
            found = [self.enc.find(c.decode()) for c in new]
            cores = iter(self.enc.encode(["".join(p[1:-1]) for p in found if len(p) >= 3]))
            for c, p in zip(new, found):
                table[c] = (p, next(cores)) if len(p) >= 3 else (p, None)
        return [table[c] for c in chunks]

    def _joined(self, left: tuple | None, between: str, right: tuple | None, steps: int):
        """Ids of a window that reaches ``steps`` pieces into the cores beside it, without those of its ends, or None if they disagree.

        Returns also how many ids the window takes from the left core's end and
        the right core's beginning.
        """
        enc = self.enc
        a = "".join(left[0][1:-1][-steps:]) if left else ""
        b = "".join(right[0][1:-1][:steps]) if right else ""
        ids = enc.encode_whole(a + between + b)
        ends = [enc.encode([x])[0] if x else b"" for x in (a, b)]
        if left and not left[1].endswith(ends[0]) or right and not right[1].startswith(ends[1]):
            return None
        if len(ids) < len(ends[0]) + len(ends[1]) or not ids.startswith(ends[0]) or not ids.endswith(ends[1]):
            return None
        return ids[len(ends[0]):len(ids) - len(ends[1])]

    def encode(self, texts: list[str], cuts: list[list[int]] | None = None) -> list[bytes]:
        """Ids of each text, as the library gives them, as little-endian bytes.

        Between two kept cores the text from the last piece of the one to the
        first piece of the other is encoded again, and has to give the kept ids of
        both. Where it doesn't, the window grows by a piece on both sides, up to
        the ends of the cores; then the whole text is encoded.
        """
        enc = self.enc
        if enc.kind != "spaced":
            return enc.encode(texts)
        raws = [t.encode() for t in texts]
        cuts = cuts or [cut_places(r, self.gear) for r in raws]
        parts = iter(self._chunk_parts([r[a:b] for r, ends in zip(raws, cuts) for a, b in zip([0, *ends], ends)]))
        lines: list[list[tuple]] = []  # of each text: (core before or None, text between, core after or None)
        for ends in cuts:
            line, open_, left = [], [], None
            for _ in ends:
                own = next(parts)
                if own[1] is None:
                    open_ += own[0]
                    continue
                line.append((left, "".join([*open_, own[0][0]]), own))
                left, open_ = own, [own[0][-1]]
            line.append((left, "".join(open_), None))
            lines.append(line)
        # All windows of one piece at once; their ends are pieces met before.
        flat = [((l[0][-2] if l else ""), w, (r[0][1] if r else "")) for line in lines for l, w, r in ((x[0], x[1], x[2]) for x in line)]
        sides = list(dict.fromkeys(s for a, _, b in flat for s in (a, b)))
        side_ids = dict(zip(sides, enc.encode(sides)))
        again = iter(enc.encode_wholes([a + w + b for a, w, b in flat]))
        windows = iter(flat)
        out = []
        for text, line in zip(texts, lines):
            got: list[bytes] | None = []
            for left, between, right in line:
                (a, _, b), ids = next(windows), next(again)
                if got is None:
                    continue
                a, b = side_ids[a], side_ids[b]
                if len(ids) >= len(a) + len(b) and ids.startswith(a) and ids.endswith(b):
                    middle = ids[len(a):len(ids) - len(b)]
                else:
                    self.widened += 1
                    most = max(len(x[0]) - 2 for x in (left, right) if x) if left or right else 0
                    middle = next((m for n in range(2, most + 1) if (m := self._joined(left, between, right, n)) is not None), None)
                if middle is None:
                    got = None
                    continue
                got.append(middle)
                if right:
                    got.append(right[1])
            out.append(enc.encode_whole(text) if got is None else b"".join(got))
        return out


def token_bytes(tokenizer) -> list[bytes]:
    """The bytes each id of a byte-level vocabulary stands for."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    rest = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        t = tokenizer.id_to_token(i) or ""
        out.append(bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode())
    return out


def decode_ids(ids, table: list[bytes]) -> str:
    """Text of ids; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


_TABLES: dict[str, list[bytes]] = {}


def _table(tokenizer: str) -> list[bytes]:
    if tokenizer not in _TABLES:
        _TABLES[tokenizer] = token_bytes(pieces.encoder(tokenizer, 300_000).tokenizer)
    return _TABLES[tokenizer]


def gathered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with their cuts, those with the same least chunk hash side by side.

    The exchange is one that Spark may split where a key is hot, since nothing
    needs all documents of a key in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches):
        import numpy as np
        import xxhash

        gear, h = _gear(), xxhash.xxh3_64_intdigest
        for b in pieces.text_batches(batches, "text"):
            ends, route = [], []
            for t in b.column("text").to_pylist():
                raw = t.encode()
                c = cut_places(raw, gear)
                ends.append(np.array(c, "<i4").tobytes())
                route.append(min((h(raw[x:y]) for x, y in zip([0, *c], c)), default=0) - (1 << 63))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), pa.array(ends, pa.binary()), pa.array(route, pa.int64())], ["id", "text", "ends", "route"])

    return _shared.map_batches(rows, cut, "id long, text string, ends binary, route long").hint("rebalance", F.col("route"))


def _encoded(batches, tokenizer: str):
    import numpy as np

    enc = ChunkEncoder(tokenizer)
    for b in pieces.text_batches(batches, "text", size=4 << 20):
        cuts = [np.frombuffer(c, "<i4").tolist() for c in b.column("ends").to_pylist()]
        yield b.column("id"), enc.encode(b.column("text").to_pylist(), cuts), enc.enc.dtype


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids; null and repeated document ids
    are kept as they are; an empty table gives an empty result.
    """

    def run(batches):
        import numpy as np

        for ids, found, kind in _encoded(batches, tokenizer):
            yield pa.RecordBatch.from_arrays([ids, pa.array([np.frombuffer(x, kind).astype("<u4").tobytes() for x in found], pa.binary())], ["doc_id", "ids"])

    return _shared.map_batches(gathered(docs, id_col, text_col), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of what ``encode`` returned; special tokens are kept."""

    def run(batches):
        import numpy as np

        table = _table(tokenizer)
        for b in batches:
            texts = [decode_ids(np.frombuffer(x or b"", "<u4").tolist(), table) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode``, then ``decode``, in one pass, keeping digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        import numpy as np

        table = _table(tokenizer)
        sha = hashlib.sha256
        for ids, found, kind in _encoded(batches, tokenizer):
            wide = [np.frombuffer(x, kind) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(x) for x in wide], pa.int64()),
                    pa.array([sha(x.astype("<u4").tobytes()).hexdigest() for x in wide], pa.string()),
                    pa.array([sha(decode_ids(x.tolist(), table).encode()).hexdigest() for x in wide], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _shared.map_batches(gathered(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def reuse(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of what ``encode`` saves after its exchange: chunks met, chunks encoded, windows at joins that had to grow.

    Null and empty texts meet no chunk; an empty table gives zeros.
    """

    def run(batches):
        import numpy as np

        enc = ChunkEncoder(tokenizer)
        for b in pieces.text_batches(batches, "text", size=4 << 20):
            enc.encode(b.column("text").to_pylist(), [np.frombuffer(c, "<i4").tolist() for c in b.column("ends").to_pylist()])
        yield pa.RecordBatch.from_pydict({"chunks": [enc.met], "encoded": [enc.fresh], "widened": [enc.widened]})

    found = _shared.map_batches(gathered(docs, id_col, text_col), run, "chunks long, encoded long, widened long")
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "encoded", "widened")])

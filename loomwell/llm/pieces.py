"""Exact tokenization of whole texts, a piece at a time.

In both kinds of vocabulary that are recognised here no token reaches from a
character that is no white space into white space after it. A text may then be
cut before every run of white space: the ids of the pieces, joined, are the ids
of the text. Pieces that were met before are taken from a table; new ones go to
the tokenizers library together, parted by something with an id of its own.
Any other tokenizer gets each text as a whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

# The characters with the Unicode property White_Space.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_KEPT: dict[tuple, "PieceEncoder"] = {}
_ALSO: list = []  # what else to free with them


ENTRY = 150  # bytes of an entry of the table beyond its characters, about


class PieceEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes.

    ``limit`` bounds the number and ``size`` about the bytes of the table of
    pieces, which has two halves: when the new half is full it becomes the old
    one, and what is met there again moves over.
    """

    def __init__(self, path: str, limit: int = 800_000, size: int = 160 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.size, self.held = limit, size, 0
        self.table: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.width = int(self.dtype[2])
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind = self._kind(spec)
        if self.kind == "spaced":  # white space is kept, in front of its word
            self.find = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
            self.plain = re.compile(f" ?[^{SPACES}]+").fullmatch
            self.part = "\n"
        elif self.kind == "words":  # white space is dropped
            self.find = re.compile(f"[^{SPACES}]+").findall
            self.plain = re.compile(f"[^{SPACES}]+").fullmatch
            self.part = " \x00 "
        if self.kind:
            (self.part_id,) = self._ids([self.part])[0]

    @staticmethod
    def _kind(spec: dict) -> str | None:
        if spec["model"].get("type") != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
            return None
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "spaced"
        steps = pre.get("pretokenizers", [{}])
        if pre.get("type") == "Sequence" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and spec.get("added_tokens") and {n["type"] for n in (norm or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
            return "words"
        return None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        plain, table, width = self.plain, self.table, self.width
        easy = [p for p in pieces if plain(p)]
        other = [p for p in pieces if not plain(p)] if len(easy) < len(pieces) else []
        for i in range(0, len(easy), 20_000):
            groups = [easy[j:j + 100] for j in range(i, min(i + 20_000, len(easy)), 100)]
            joined = [self.part.join(g) for g in groups]
            for g, text, ids in zip(groups, joined, self._ids(joined)):
                ids = np.array(ids, self.dtype)
                at = np.flatnonzero(ids == self.part_id) * width
                if len(at) != len(g) - 1 or any(x in text for x in self.specials):
                    other += g  # one of them holds a special token
                    continue
                buf, at = ids.tobytes(), at.tolist()
                table.update(zip(g, [buf[x:y] for x, y in zip([0, *(x + width for x in at)], [*at, len(buf)])]))
        for i in range(0, len(other), 500):
            some = other[i:i + 500]
            table.update(zip(some, [np.array(x, self.dtype).tobytes() for x in self._ids(some)]))

    def encode_wholes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text by the library alone, without the table."""
        return [np.array(x, self.dtype).tobytes() for x in self._ids(texts)] if texts else []

    def encode_whole(self, text: str) -> bytes:
        return self.encode_wholes([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as the library gives them without special tokens."""
        if self.kind is None:
            return [np.array(x, self.dtype).tobytes() for x in self._ids(texts)]
        out: list[bytes] = []
        find, table, get = self.find, self.table, self.table.get
        waiting: list[tuple] = []
        new: set[str] = set()
        for k, text in enumerate(texts):
            ps = find(text)
            got = list(map(get, ps))
            missing = [i for i, g in enumerate(got) if g is None] if None in got else []
            new.update([ps[i] for i in missing])
            waiting.append((ps, got, missing))
            if len(new) < 20_000 and len(waiting) < 256 and k < len(texts) - 1:
                continue
            if new:
                cost = sum(map(len, new)) + ENTRY * len(new)
                if len(table) + len(new) > self.limit // 2 or self.held + cost > self.size // 2:
                    self.old = dict(table)
                    table.clear()
                    self.held = 0
                self.held += cost
                old = self.old
                table.update((p, old[p]) for p in new if p in old)
                self._learn([p for p in new if p not in old])
                new = set()
            for ps, got, missing in waiting:
                for i in missing:
                    got[i] = table[ps[i]]
                out.append(b"".join(got))
            waiting = []
        return out


def encoder(path: str, limit: int = 800_000, size: int = 160 << 20) -> PieceEncoder:
    """The encoder of this worker process, kept from task to task."""
    key = (path, limit, size)
    if key not in _KEPT:
        _KEPT[key] = PieceEncoder(path, limit, size)
    return _KEPT[key]


def release() -> None:
    """Free the tables of this worker process, which lives on: tasks that encode nothing begin with it."""
    _KEPT.clear()
    for free in _ALSO:
        free()


def text_batches(batches, text: str, *, rows: int = 512, size: int = 8 << 20):
    """Cut Arrow batches so that each has few rows and not much text."""
    import pyarrow.compute as pc

    for b in batches:
        lengths = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and (i - start >= rows or held + n > size):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)

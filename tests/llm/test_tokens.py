"""Packing, token files and chunk BPE against the tokenizers library."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomwell.llm import _shared, chunk_bpe, packing, pieces, token_files


def ids_of(path, texts):
    t = Tokenizer.from_file(path)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("limit", [300, 100_000])
def test_pieces_are_exact(path, texts, name, limit):
    enc = pieces.PieceEncoder(path(name), limit)
    assert enc.kind
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == ids_of(path(name), texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t'sé1.\x00\x85　<|endoftext|>Σ"), max_size=40), max_size=5))
def test_pieces_are_exact_for_any_text(path, some):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = pieces.encoder(path(name), 5_000)
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(some)] == ids_of(path(name), some)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=25))
def test_plan_packs_everything(counts):
    patterns = packing.plan(counts, 100)
    used = Counter()
    for pick, times in patterns:
        assert sum(pick) <= 100 and times > 0
        for n in pick:
            used[n] += times
    assert used == Counter(counts)
    total, bins = sum(n * c for n, c in counts.items()), sum(t for _, t in patterns)
    assert bins <= 2 * total / 100 + 1
    assert len(patterns) <= sum(1 + 100 // n for n in counts)


def test_plan_replaces_the_smallest_by_two():
    # Greedy gives 60 + 30; the 30 goes for 25 + 15, which fill the bin.
    pick, times = packing.plan({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0]
    assert (sorted(pick), times) == ([15, 25, 60], 1)


def test_packing(spark, path, docs, plain, empty):
    got = packing.pack(docs, path("word_bpe_49k.json")).collect()
    want = Counter()
    for (doc, _), ids in zip(plain, ids_of(path("word_bpe_49k.json"), [t for _, t in plain])):
        ids = [*ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[doc, p, at, len(part), crc(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(k[3] * c for k, c in want.items()) // 4096) + 1
    assert packing.pack(empty, path("word_bpe_49k.json")).count() == 0


def test_token_files(spark, path, docs, plain, empty):
    place = _shared.new_place(spark, "test")
    token_files.write(docs, place, path("byte_bpe_50k.json"), end_id=2)
    rows = sorted(token_files.read(spark, place, with_ids=True).collect(), key=lambda r: r.doc_index)
    own = Counter((d, tuple([*ids, 2])) for (d, _), ids in zip(plain, ids_of(path("byte_bpe_50k.json"), [t for _, t in plain])))
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == own
    assert [r.doc_index for r in rows] == list(range(len(rows)))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += r.n_tokens
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert rows[0].doc_id is None and known == sorted(known)
    place = _shared.new_place(spark, "test")
    token_files.write(empty, place, path("byte_bpe_50k.json"))
    assert token_files.read(spark, place).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 400))
def test_cuts_cover(part, times):
    raw = (part * times).decode("utf-8", "ignore").encode()
    ends = chunk_bpe.cut_places(raw)
    assert (ends[-1] if ends else 0) == len(raw) and ends == sorted(set(ends))
    assert all(b - a <= chunk_bpe.MOST + chunk_bpe.LEAST + 4 for a, b in zip([0, *ends], ends))
    b"".join(raw[a:b].decode().encode() for a, b in zip([0, *ends], ends))


def test_cuts_follow_content():
    passage = bytes(np.random.default_rng(1).integers(97, 123, 20000, np.uint8))
    a = {passage[x:y] for x, y in zip(chunk_bpe.cut_places(passage), chunk_bpe.cut_places(passage)[1:])}
    moved = b"something else " * 20 + passage
    b = {moved[x:y] for x, y in zip(chunk_bpe.cut_places(moved), chunk_bpe.cut_places(moved)[1:])}
    assert len(a & b) >= len(a) - 2


def test_chunks_are_reused(path):
    enc = chunk_bpe.ChunkEncoder(path("byte_bpe_50k.json"), size=8 << 20)
    text = " ".join(f"word{i * i}" for i in range(3000))
    enc.encode([text])
    fresh = enc.fresh
    enc.encode(["in front " + text, text])
    assert enc.fresh - fresh <= 3 and enc.met > 2 * fresh


def test_chunk_bpe(spark, path, docs, plain, empty):
    name = path("byte_bpe_50k.json")
    got = chunk_bpe.digests(docs, name).collect()
    t = Tokenizer.from_file(name)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())) for (d, _), ids in zip(plain, ids_of(name, [x for _, x in plain])))
    assert Counter(tuple(r) for r in got) == want
    back = chunk_bpe.decode(chunk_bpe.encode(docs, name), name).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(plain)
    assert chunk_bpe.digests(empty, name).count() == 0


def test_reuse_after_the_exchange(spark, path, empty):
    r = np.random.default_rng(5)
    passage = " ".join(f"word{x}" for x in r.integers(0, 10**6, 4000))
    texts = [f"{i} in front " + passage + f" behind {i}" for i in range(60)]
    name = path("byte_bpe_50k.json")
    got = chunk_bpe.reuse(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12), name).first()
    assert got.chunks > 60 * 20 and got.encoded < 0.2 * got.chunks
    assert tuple(chunk_bpe.reuse(empty, name).first()) == (0, 0, 0)


def test_decoding_of_broken_bytes(path):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    table = chunk_bpe.token_bytes(t)
    r = np.random.default_rng(3)
    for _ in range(200):
        ids = r.integers(0, 50257, 20).tolist()
        assert chunk_bpe.decode_ids(ids, table) == t.decode(ids, skip_special_tokens=False)

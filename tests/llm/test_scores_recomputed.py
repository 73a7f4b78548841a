"""Scores of the registered classifiers, recomputed from the fitted weights without the library's code."""

import math

import numpy as np
import pytest

from loomwell.llm import byte_cnn, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def words(sentence):
    out, now = set(), ""
    for c in sentence.lower() + " ":
        if c.isalnum() or c == "_":
            now += c
        elif now:
            out.add(now)
            now = ""
    return out


def split(text):
    """A sentence is what stands before signs, with them; signs without text before them are one of their own."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] not in ".!?\n":
            j += 1
        while j < len(text) and text[j] in ".!?\n":
            j += 1
        out.append(text[i:j])
        i = j
    return out


def test_toxicity(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels, held_out=(5, 0))
    want = {}
    for d in docs.collect():
        clean, bad = 1.0, 0
        for s in split(d.text or ""):
            z = model.bias + sum(model.weights.get(f, 0.0) for w in words(s) for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)])
            clean *= 1 - 1 / (1 + math.exp(-z)) if z < 500 else 0.0
            bad += z >= 0
        want[d.doc_id] = (1 - clean, bad)
    got = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i, (p, bad) in want.items():
        assert got[i].score == pytest.approx(p, abs=1e-9) and got[i].n_offending == bad and got[i].predicted == int(got[i].score >= 0.5)
    assert any(p >= 0.5 for p, _ in want.values()) and any(p < 0.5 for p, _ in want.values())


def test_quality_network(spark, tables):
    docs, labels = tables
    net = byte_cnn.fit(docs, labels, held_out=(3, 1))
    got = {r.doc_id: r for r in queries.QUERIES["op9_quality_cnn"](spark, SF).collect()}
    rows = docs.orderBy("doc_id").collect()
    assert got.keys() == {d.doc_id for d in rows}
    table = net.tables.astype(np.float64)
    for d in sorted(rows, key=lambda d: -len(d.text or ""))[:3] + rows[:40]:
        raw = (d.text or "").encode()
        total = weight = 0.0
        start = 0
        while start == 0 or start + 64 < len(raw):
            part = raw[start:start + 512]
            full = part + bytes(512 - len(part))
            best = np.full(table.shape[2], -np.inf)
            for p in range(0, 505, 2):
                best = np.maximum(best, sum(table[k, full[p + k]] for k in range(8)))
            z = float(np.maximum(best + net.bias, 0) @ net.out + net.base)
            total, weight, start = total + z * max(1, len(part)), weight + max(1, len(part)), start + 448
        want = 1 / (1 + math.exp(-max(-60.0, min(60.0, total / weight))))
        assert got[d.doc_id].score == pytest.approx(want, abs=1e-4)
        assert got[d.doc_id].predicted == int(got[d.doc_id].score >= 0.5)

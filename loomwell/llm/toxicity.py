"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag has a label. Each sentence
gets a probability from a logistic model over its words and the beginnings of
its words; noisy-or combines them: the document is toxic unless every sentence
is not. The model is trained through the noisy-or from document labels alone,
and afterwards its sentence probabilities say where the toxic sentences are.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, labelled, pieces

SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)


def _features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Weights of words and of beginnings of words (marked by a star)."""

    bias: float
    weights: dict[str, float]

    def __post_init__(self):
        self._words: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self._words.get(word)
        if got is None:
            if len(self._words) > 300_000:
                self._words.clear()
            w = self.weights
            got = self._words[word] = sum(w.get(f, 0.0) for f in _features(word))
        return got

    def margin(self, sentence: str) -> float:
        words = set(WORD.findall(sentence.lower()))
        known = self._words
        return self.bias + sum([known[w] if w in known else self.word(w) for w in words])

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of each sentence of the text."""
        out = []
        for m in SENTENCE.finditer(text):
            z = self.margin(m.group())
            out.append((m.start(), m.end(), 1 / (1 + math.exp(-z)) if z > -500 else 0.0))
        return out

    def score(self, text: str) -> float:
        """Probability of the whole document: noisy-or over its sentences; 0 without a sentence."""
        total = sum(_softplus(self.margin(s)) for s in SENTENCE.findall(text))
        return 0.0 - math.expm1(-total)


def _softplus(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z)) if z > -700 else 0.0


def train(rows: list[tuple[str, int]], *, rounds: int = 160, least: int = 4, rate: float = 0.15, decay: float = 5e-5) -> Model:
    """Fit the model to (text, label) rows with Adam on the noisy-or likelihood.

    A feature has to be in ``least`` documents. The weights are made sparse by a
    proximal step. With rows of one label only, the model always says that label.
    """
    import numpy as np

    if len({y for _, y in rows}) < 2:
        return Model(20.0 if rows and rows[0][1] else -40.0, {})
    def bag(sentence: str) -> set[str]:
        return {f for w in set(WORD.findall(sentence.lower())) for f in _features(w)}

    # What is rare is dropped by hashed counts first, so that only frequent features are ever held as strings.
    mask = (1 << 21) - 1
    often = np.zeros(mask + 1, np.int32)
    for text, _ in rows:
        often[np.unique(np.array([zlib.crc32(f.encode()) & mask for s in SENTENCE.findall(text) for f in bag(s)], np.int64))] += 1
    index: dict[str, int] = {}
    cols, sent, owner = array("i"), array("i"), array("i")
    documents: list[int] = []
    n = 0
    for d, (text, _) in enumerate(rows):
        met = set()
        for s in SENTENCE.findall(text):
            for f in bag(s):
                if often[zlib.crc32(f.encode()) & mask] >= least:
                    k = index.setdefault(f, len(index))
                    cols.append(k)
                    sent.append(n)
                    met.add(k)
            owner.append(d)
            n += 1
        documents += [0] * (len(index) - len(documents))
        for k in met:
            documents[k] += 1
    cols, sent, owner = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (cols, sent, owner))
    kept = np.array(documents, np.int64) >= least
    new = np.cumsum(kept) - 1
    size = int(kept.sum())
    own = kept[cols]
    cols, sent = new[cols[own]], sent[own]
    y = np.array([v for _, v in rows], float)
    names = [f for f, k in index.items() if kept[k]]
    w, bias = np.zeros(size), -5.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    weight = 1 / len(y)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(sent, w[cols], n)
        sp = np.logaddexp(0, z)
        total = np.bincount(owner, sp, len(y))
        slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-3), 1.0) * weight
        dz = slope[owner] / (1 + np.exp(-z))
        g, gb = np.bincount(cols, dz[sent], size), dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + t / rounds)
        scale = np.sqrt(v / (1 - 0.99**t)) + 1e-6
        w -= step * (m / (1 - 0.9**t)) / scale
        w = np.sign(w) * np.maximum(np.abs(w) - step * decay / scale, 0)
        bias -= step * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return Model(float(bias), {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", positives: int = 1200, negatives: int = 2000,
        held_out: tuple[int, int] = (5, 0), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of labelled documents outside the held-out fold.

    ``positives`` and ``negatives`` bound the sample; ``held_out`` is (folds,
    fold) of crc32 of the id as text. Without labels nothing is toxic.
    """
    keep = labelled.fold(F.col("doc_id"), held_out[0]) != held_out[1]
    return train(labelled.sample(docs, labels, label_col, take={1: positives, 0: negatives}, keep=keep, id_col=id_col, text_col=text_col))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_sentences, n_offending, worst_start, worst_end of every whole text.

    A null or empty text has score 0 and no worst sentence (nulls). Sentences
    with a probability of 0.5 or more are offending; places count characters.
    Repeated rows are scored each; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # features of a bounded sample
    kept = {}

    def run(batches):
        own = kept.get("model") or kept.setdefault("model", Model(*shared.value))
        for b in pieces.text_batches(batches, "text"):
            out: list[list] = [[] for _ in range(5)]
            for text in b.column("text").to_pylist():
                total, n, bad, worst, where = 0.0, 0, 0, -1.0, (None, None)
                for m in SENTENCE.finditer(text):
                    z = own.margin(m.group())
                    s = _softplus(z)
                    total += s
                    n += 1
                    bad += z >= 0
                    if s > worst:
                        worst, where = s, m.span()
                for c, v in zip(out, (0.0 - math.expm1(-total), n, bad, *where)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.float64()), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "score", "n_sentences", "n_offending", "worst_start", "worst_end"])

    return _shared.map_batches(rows, run, "doc_id long, score double, n_sentences long, n_offending long, worst_start long, worst_end long")


def offending(docs: DataFrame, model: Model, *, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, probability, sentence of each offending sentence; null texts have none."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def run(batches):
        own = Model(*shared.value)
        for b in pieces.text_batches(batches, "text"):
            found = [(d, s, e, p, t[s:e]) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for s, e, p in own.sentences(t) if p >= least]
            cols = list(zip(*found)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "end", "probability", "sentence"])

    return _shared.map_batches(rows, run, "doc_id long, start long, end long, probability double, sentence string")


def flags(docs: DataFrame, model: Model, *, text_col: str = "text", name: str = "_toxicity") -> DataFrame:
    """The rows as they are, with the document's score as ``name``: for filtering in place."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def make():
        own = Model(*shared.value)
        return lambda texts: [own.score(t) for t in texts]

    return labelled.with_scores(docs, text_col, name, make)

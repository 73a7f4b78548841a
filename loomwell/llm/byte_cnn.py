"""Text quality by a byte-level convolutional network in numpy.

The whole text, as UTF-8, is cut into chunks of 512 bytes that overlap by 64.
Learned filters slide over each chunk two bytes at a time and see eight bytes;
a filter is a table with a weight for each byte at each of its places, so a
convolution is a sum of rows. The maximum over each chunk goes through a ReLU
and an output layer to the chunk's logit, and the mean of the logits over all
chunks, by their bytes, gives the document's probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled

CHUNK, OVERLAP, WIDTH, STRIDE = 512, 64, 8, 2


def chunks(raw: bytes) -> np.ndarray:
    """The chunks of a text as rows of bytes, the last filled up with zeros; an empty text is one row of zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    flat = np.zeros(OVERLAP + n * step, np.uint8)
    flat[:len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


def sizes(raw: bytes) -> np.ndarray:
    """How many bytes of the text each chunk holds (1 if it is empty)."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    return np.maximum(1, np.minimum(CHUNK, len(raw) - step * np.arange(n)))


@dataclass
class Net:
    """tables: (WIDTH, 256, filters); bias: (filters,); out: (filters,); base: float."""

    tables: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float

    def maxima(self, rows: np.ndarray, where: bool = False):
        """The largest response of each filter in each row, and with ``where`` its place."""
        places = (CHUNK - WIDTH) // STRIDE + 1
        best, at = [], []
        for i in range(0, len(rows), 128):
            part = rows[i:i + 128]
            sums = None
            for k in range(WIDTH):
                got = self.tables[k].take(part[:, k:k + STRIDE * places:STRIDE], axis=0)
                sums = got if sums is None else np.add(sums, got, out=sums)
            if where:
                a = sums.argmax(axis=1)
                at.append(a)
                best.append(np.take_along_axis(sums, a[:, None, :], axis=1)[:, 0])
            else:
                best.append(sums.max(axis=1))
        top = np.concatenate(best)
        return (top, np.concatenate(at)) if where else top

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.maxima(rows) + self.bias, 0) @ self.out + self.base

    def scores(self, raws: list[bytes]) -> list[float]:
        """Probabilities of whole texts."""
        out = []
        some: list[bytes] = []
        held = 0
        for i, r in enumerate(raws):
            some.append(r)
            held += len(r)
            if held < 1 << 20 and i < len(raws) - 1:
                continue
            logits = self.logits(np.concatenate([chunks(x) for x in some]))
            at = 0
            for x in some:
                w = sizes(x)
                z = float(np.average(logits[at:at + len(w)], weights=w))
                at += len(w)
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            some, held = [], 0
        return out


def train(rows: list[tuple[str, int]], *, filters: int = 24, rounds: int = 60, per_text: int = 3, rate: float = 0.01, seed: int = 11) -> Net:
    """Fit the network to (text, label) rows: Adam on the logistic loss of random chunks.

    In each round every text gives ``per_text`` of its chunks at most. With rows
    of one label only, the network always says that label.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    tables = rng.normal(0, 0.25, (WIDTH, 256, filters)).astype(np.float32)
    tables[:, 0] = 0  # what fills up
    net = Net(tables, np.zeros(filters, np.float32), rng.normal(0, 0.5, filters).astype(np.float32), 0.0)
    if len({y for _, y in rows}) < 2:
        net.out[:] = 0
        net.base = 20.0 if not rows or rows[0][1] else -20.0
        return net
    held = [chunks(t.encode()) for t, _ in rows]
    y = np.array([v for _, v in rows], np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    params = [net.tables, net.bias, net.out, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, batch = 0, 256
    for _ in range(rounds):
        order = rng.permutation(len(held))
        for i in range(0, len(order), batch):
            own = order[i:i + batch]
            picks = [(d, j) for d in own for j in rng.choice(len(held[d]), min(per_text, len(held[d])), replace=False)]
            part = np.stack([held[d][j] for d, j in picks])
            doc = np.array([d for d, _ in picks])
            short = rng.integers(24, CHUNK, len(part))  # a quarter of the chunks end early, as those of short texts do
            part[(np.arange(CHUNK) >= short[:, None]) & (rng.random(len(part)) < 0.25)[:, None]] = 0
            top, at = net.maxima(part, where=True)
            pre = top + net.bias
            act = np.maximum(pre, 0)
            z = act @ net.out + params[3][0]
            dz = ((1 / (1 + np.exp(-z)) - y[doc]) * weight[doc] / len(picks)).astype(np.float32)
            dact = dz[:, None] * net.out * (pre > 0)
            grads = [np.zeros_like(net.tables), dact.sum(0), act.T @ dz, dz.sum(keepdims=True)]
            r, f = np.arange(len(part))[:, None], np.arange(filters)
            for k in range(WIDTH):
                np.add.at(grads[0][k], (part[r, at * STRIDE + k], f), dact)
            grads[0][:, 0] = 0
            t += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    net.base = float(params[3][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", each: int = 1200, held_out: tuple[int, int] = (3, 1),
        id_col: str = "doc_id", text_col: str = "text") -> Net:
    """Train on at most ``each`` labelled documents of either label outside the held-out fold.

    ``held_out`` is (folds, fold) of crc32 of the id as text. Without labels
    every document is of good quality.
    """
    keep = labelled.fold(F.col("doc_id"), held_out[0]) != held_out[1]
    net = train(labelled.sample(docs, labels, label_col, take={1: each, 0: each}, keep=keep, id_col=id_col, text_col=text_col))
    known = labels.withColumn("doc_id", F.col(id_col)).filter(keep)
    good, bad = known.agg(F.count_if(F.col(label_col) == 1), F.count_if(F.col(label_col) == 0)).first()
    if good and bad:  # training weighs both labels alike
        net.base += math.log(good / bad)
    return net


def with_quality(docs: DataFrame, net: Net, *, text_col: str = "text", name: str = "_quality") -> DataFrame:
    """The rows as they are and ``name``, the probability that the whole text is of good quality.

    A null text counts as empty and gets the empty text's probability; repeated
    rows are scored each; an empty table gives no rows. Other columns pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    return labelled.with_scores(docs, text_col, name, lambda: lambda texts: shared.value.scores([t.encode() for t in texts]))


def score(docs: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text; see ``with_quality``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_quality(rows, net, name="score").select("doc_id", "score")

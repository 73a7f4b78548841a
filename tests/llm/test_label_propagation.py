"""Balanced label propagation: cut edges fall with every round and come near the least cut."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwell.llm import sharding


def cut(rows, where):
    by = defaultdict(Counter)
    for i, t in rows:
        by[t][where[i]] += 1
    pairs = lambda n: n * (n - 1) // 2
    return sum(pairs(sum(c.values())) - sum(map(pairs, c.values())) for c in by.values())


def placed(spark, rows, shards):
    log = []
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), shards=shards, log=log).collect()
    where = {r.doc_id: r.shard for r in got}
    sizes = Counter(where.values())
    assert len(got) == len(rows) and max(sizes.get(s, 0) for s in range(shards)) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    steps = [x["cut_edges"] for x in log]
    assert all(a > b for a, b in zip(steps, steps[1:])), steps
    return cut(rows, where), steps


def texts(sizes, alone=0):
    rows, i = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append((i, f"group {g}"))
            i += 1
    return rows + [(i + j, f"alone {j}") for j in range(alone)]


@pytest.mark.parametrize(("sizes", "alone", "shards", "least"), [
    ([5] * 12, 60, 4, 0),  # room for every group
    ([2] * 40 + [9] * 6, 200, 8, 0),
    ([30], 90, 4, 0),  # as large as a shard
    ([60], 60, 4, 900),  # two shards at the least: 30 x 30 pairs
    ([], 50, 4, 0),
    ([7] * 10 + [1] * 10, 100, 6, 0),
])
def test_the_least_cut(spark, sizes, alone, shards, least):
    rows = texts(sizes, alone)
    got, steps = placed(spark, rows, shards)
    assert got == least
    assert steps[0] >= got and steps[-1] >= got


@pytest.mark.parametrize("seed", [1, 2])
def test_without_any_room(spark, seed):
    """Every document is linked, so groups can only change places with one another."""
    r = random.Random(seed)
    sizes = [r.randint(2, 9) for _ in range(60)]
    rows = texts(sizes)
    got, steps = placed(spark, rows, 5)
    assert got <= 0.5 * steps[0] and len(steps) > 1


@given(st.integers(1, 6).flatmap(lambda n: st.tuples(st.lists(st.lists(st.integers(0, 50), min_size=n, max_size=n), min_size=n, max_size=n), st.lists(st.integers(0, 30), min_size=n, max_size=n))))
@settings(max_examples=200, deadline=None)
def test_flows_fit(case):
    asked, room = case
    n = len(room)
    for i in range(n):
        asked[i][i] = 0
    got = sharding.flows(asked, room)
    assert all(0 <= got[a][t] <= asked[a][t] for a in range(n) for t in range(n))
    assert all(sum(got[a][t] for a in range(n)) - sum(got[t]) <= room[t] for t in range(n))
    if all(sum(asked[a][t] for a in range(n)) - sum(asked[t]) <= room[t] for t in range(n)):
        assert got == asked

"""Operators that spread a hot key: range scans, selection, block joins, the grid search."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.operators import intervals, ordering, retrieval, selection


@pytest.fixture
def many_ranges(spark):
    """Ranges stay as many as they are dealt."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


@pytest.mark.parametrize("before", [False, True])
def test_scans(spark, many_ranges, before):
    r = np.random.default_rng(3)
    rows = [(k, int(t), float(v) if v > -1.5 else None) for k, t, v in zip(r.choice(["hot"] * 9 + ["a", "b", None], 900), r.permutation(900), r.normal(size=900))]
    ranged = ordering.ranged(spark.createDataFrame(rows, "k string, t long, v double"), ["k", "t"])
    per = {x._range: x.n for x in ranged.filter("k = 'hot'").groupBy("_range").agg(F.count("*").alias("n")).collect()}
    assert len(per) > 4 and max(per.values()) < 500  # no task has the hot key as a whole
    got = ordering.scan(ranged, ["k"], ["t"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v")), "low": ("min", F.col("v"))}, before=before).collect()
    by = defaultdict(list)
    for x in rows:
        by[x[0]].append(x)
    want = {}
    for k, xs in by.items():
        xs.sort(key=lambda x: x[1])
        for i, x in enumerate(xs):
            seen = xs[:i + (not before)]
            vs = [y[2] for y in seen if y[2] is not None]
            want[k, x[1]] = (sum(vs), max(vs, default=None), seen[-1][2] if seen else None, min(vs, default=None))
    assert len(got) == len(rows)
    for x in got:
        s, m, last, low = want[x.k, x.t]
        assert abs(x.s - s) < 1e-9 and x.m == m and x.l == last and x.low == low


def test_scan_of_all_rows(spark, many_ranges):
    rows = ordering.ranged(spark.range(1000).withColumnRenamed("id", "t"), ["t"])
    got = {x.t: (x.s, x.p) for x in ordering.scan(rows, [], ["t"], {"s": ("sum", F.col("t")), "p": ("last", F.col("t"))}, before=True).collect()}
    assert got == {t: (t * (t - 1) // 2, t - 1 if t else None) for t in range(1000)}
    assert ordering.scan(ordering.ranged(spark.range(0).withColumnRenamed("id", "t"), ["t"]), [], ["t"], {"s": ("sum", F.col("t"))}).count() == 0


def test_merge_and_complement_of_one_hot_key(spark, many_ranges):
    r = np.random.default_rng(5)
    starts = np.round(r.uniform(0, 4000, 3000), 1)
    rows = [("hot", float(a), float(a + n)) for a, n in zip(starts, r.choice([0.0, 0.3, 0.6, 2.5], 3000))] + [("cold", 1.0, 2.0), ("cold", 2.0, 3.0), ("cold", 9.0, 9.0), ("long", 0.0, 5000.0)] + [("long", float(i), i + 0.5) for i in range(0, 4000, 40)]
    rows += [rows[0]] * 5
    want = []
    for key in ("hot", "cold", "long"):
        out = []
        for _, a, b in sorted(x for x in rows if x[0] == key):
            if not out or a > out[-1][1] + 1e-6:
                out.append([a, b, 0])
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += 1
        want += [(key, i + 1, *x) for i, x in enumerate(out)]
    merged = intervals.merge(spark.createDataFrame(rows, "k string, y0 double, y1 double").repartition(5), "k", "y0", "y1")
    assert sorted(tuple(x) for x in merged.collect()) == sorted(want)
    gaps = defaultdict(list)
    for key in ("hot", "cold", "long"):
        end = 0.0
        for _, _, a, b, _ in (x for x in want if x[0] == key):
            a, b = max(a, 0.0), min(b, 3000.0)
            if b > a:
                gaps[key].append((end, a))
                end = b
        gaps[key].append((end, 3000.0))
    expected = sorted((k, a, b) for k, v in gaps.items() for a, b in v if b - a > 1e-6)
    assert sorted(tuple(x) for x in intervals.complement(merged, "k", "y0", "y1", 3000.0).collect()) == expected


def test_pairing_within_one_hot_key(spark, many_ranges):
    r = np.random.default_rng(6)
    marks = [("hot", i, x == "o", x == "c") for i, x in enumerate(r.choice(["o", "c", "-"], 1500, p=[0.4, 0.35, 0.25]))]
    df = spark.createDataFrame(marks, "k string, t int, o boolean, c boolean").repartition(6)
    got = {x.t: x.pair.t if x.pair else None for x in intervals.pair_forward(df, "k", ["t"], F.col("o"), F.col("c")).collect()}
    want, used = {}, set()
    for _, t, o, _ in marks:
        if o:
            want[t] = next((u for _, u, _, c in marks[t + 1:] if c and u not in used), None)
            used.add(want[t])
    assert got == want


def test_covering(spark):
    r = np.random.default_rng(9)
    spans = [(["a", "b"][i % 2], int(f), int(f + n)) for i, (f, n) in enumerate(zip(r.integers(-500, 5000, 300), r.choice([0, 1, 15, 16, 17, 255, 256, 4000, -3], 300)))] + [("a", -(10**9), 10**9), ("c", 5, 5), (None, 0, 9), ("a", None, 5)]
    points = [(["a", "b", "c"][i % 3], int(x)) for i, x in enumerate(r.integers(-600, 9500, 400))] + [("c", 5), ("a", None), ("a", 10**9), ("a", 10**9 + 1), ("b", 0), ("b", 0)]
    p, s = spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, first long, last long")
    got = Counter((x.k, x["at"], x["first"], x["last"]) for x in intervals.covering(p, s, ["k"], "at", "first", "last").collect())
    want = Counter((k, at, f, n) for k, at in points for k2, f, n in spans if k == k2 and at is not None and f is not None and f <= at <= n)
    assert got == want and len(want) > 500
    blocks = s.filter("first = -1000000000").select(F.size(intervals._nodes(F.col("first"), F.col("last"), 8)).alias("n")).first().n
    assert blocks < 32 * 8  # of two thousand million places
    assert intervals.covering(p, s.filter("false"), ["k"], "at", "first", "last").count() == 0


@pytest.mark.parametrize("gathered", [50_000, 20])
def test_selection(spark, gathered):
    r = np.random.default_rng(2)
    groups = {"normal": r.normal(size=2001), "ties": r.choice([0.0, 1.0], 1000), "one": np.full(700, 3.25), "two": np.array([0.0] * 500 + [1.0] * 500), "steep": 2.0 ** r.integers(-1000, 1000, 900), "few": np.array([4.0, 1.0]), "mixed": np.concatenate([np.full(900, 5.0), r.normal(size=300)]), None: r.integers(0, 9, 600).astype(float)}
    rows = [(k, float(x), float(-x) if i % 7 else None) for k, v in groups.items() for i, x in enumerate(v)] + [("nulls", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    got = {x.k: x for x in selection.order_statistics(df, ["k"], {"mid": ("v", "median"), "p95": ("v", 0.95), "low": ("v", 0.0), "wmid": ("w", "median"), "top": ("v", 1.0)}, gathered=gathered).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v, w = sorted(v), sorted(-x for i, x in enumerate(v) if i % 7)
        assert math.isclose(got[k].mid, float(np.median(v)), rel_tol=1e-12, abs_tol=1e-300), k
        assert got[k].p95 == v[max(1, math.ceil(0.95 * len(v))) - 1] and got[k].low == v[0] and got[k].top == v[-1]
        assert math.isclose(got[k].wmid, float(np.median(w)), rel_tol=1e-12, abs_tol=1e-300), k
    whole = selection.order_statistics(df, [], {"mid": ("v", "median")}, gathered=gathered).first().mid
    assert whole == float(np.median([x[1] for x in rows if x[1] is not None]))
    assert selection.order_statistics(df.filter("false"), ["k"], {"mid": ("v", "median")}).count() == 0


@pytest.mark.parametrize("exclude_self", [False, True])
def test_grid_search_is_the_same(spark, exclude_self):
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=5).round(1).tolist()) for i in range(400)] + [(7, [1.0, 0.0, 0.0, 0.0, 0.0])] * 90 + [(500 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(900, [0.0] * 5), (901, None)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = corpus.filter("vec_id % 2 = 1 AND vec_id <> 7")
    found = lambda **how: sorted((x.query_id, x["rank"], x.id, round(x.score, 9)) for x in retrieval.top_k(corpus, queries, 12, exclude_self=exclude_self, **how).collect())
    want = found()
    assert len(want) == 12 * queries.filter("vec_id <> 901").count()
    for block in (400, 40 * 60, 1 << 20):  # cells of ten rows a side, of sixty, and one cell
        assert found(query_bytes=0, block_bytes=block) == want
    with pytest.raises(Exception, match="differ in length"):
        retrieval.top_k(corpus.union(spark.createDataFrame([(1, [1.0])], corpus.schema)), queries, 3, query_bytes=0).collect()

"""Golden cases and properties of the operators."""

import datetime
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwell.functions import money, stats, text, vectors
from loomwell.operators import audit, chunking, cleaning, integrity, intervals, ordering, paired, requests, retrieval, review
from loomwell.sources import files
from loomwell.streaming import resumable


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("lines", "size", "overlap", "ranges", "places"), [
    (["aaa", "bbb", "ccc"], 10, 4, [(0, 2), (1, 3)], [(0, 7), (4, 11)]),
    (["A" * 198, "\x0b=1"], 200, 10, [(0, 1), (1, 2)], [(0, 198), (199, 202)]),
])
def test_chunk_goldens(spark, lines, size, overlap, ranges, places):
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = sorted(chunking.chunk(df, size=size, overlap=overlap).collect(), key=lambda r: r.chunk_index)
    assert [(r.first_atom, r.end_atom) for r in got] == ranges
    assert [(r.start, r.end) for r in got] == places


def test_chunk_line_with_line_feed_inside():
    assert chunking.fold([7, 6], 10, 0) == [(0, 1), (1, 2)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=40), st.integers(1, 40), st.integers(0, 12))
def test_chunk_properties(lengths, size, overlap):
    got = chunking.fold(lengths, size, overlap)
    covered = [i for a, e in got for i in range(a, e)]
    assert set(covered) == set(range(len(lengths)))
    for a, e in got:
        assert e > a and (e - a == 1 or sum(lengths[a:e]) + e - a - 1 <= size)
    for (a, e), (b, f) in zip(got, got[1:]):
        assert a < b <= e < f
        assert b == e or sum(lengths[b:e]) + e - b - 1 <= overlap


def test_chunk_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")
    assert [(r.doc_id, r.chunk) for r in chunking.chunk(df, atoms="words").collect()] == [(None, "a b")]
    assert chunking.violations(chunking.chunk(df, atoms="words")).count() == 0


def test_statistics_goldens(spark):
    assert one(spark, stats.mcnemar(F.lit(10), F.lit(0))) == pytest.approx(2 / 2**10)
    assert one(spark, stats.mcnemar(F.lit(0), F.lit(0))) == 1
    assert one(spark, stats.mcnemar(F.lit(300), F.lit(310))) == pytest.approx(min(1, 2 * sum(math.comb(610, k) for k in range(301)) / 2**610))
    low, high = stats.wilson(F.lit(3), F.lit(20), stats.Z_ROUNDED)
    assert (one(spark, low), one(spark, high)) == pytest.approx((0.05236779195949584, 0.36042329588695743), abs=1e-12)
    low, high = stats.wilson(F.lit(3), F.lit(20))
    assert (one(spark, low), one(spark, high)) == pytest.approx((0.052368745896216595, 0.3604188647407569), abs=1e-12)
    assert one(spark, stats.chi_square_survival(F.lit(40.0), F.lit(2))) == pytest.approx(math.exp(-20))
    assert one(spark, stats.chi_square_survival(F.lit(3.841458820694124), F.lit(1))) == pytest.approx(0.05)
    assert one(spark, stats.chi_square_survival(F.lit(7.814727903251179), F.lit(3))) == pytest.approx(0.05)


def test_tails_of_large_counts(spark):
    assert one(spark, stats.mcnemar(F.lit(600), F.lit(600))) == 1
    want = sum(math.comb(2000, k) for k in range(901)) * 2 / 2**2000
    assert one(spark, stats.mcnemar(F.lit(900), F.lit(1100))) == pytest.approx(want, rel=1e-9)
    assert one(spark, stats.binomial_tail(F.lit(7), F.lit(10))) == pytest.approx(sum(math.comb(10, k) for k in range(8)) / 2**10)
    assert stats.rank_tail([(2 * i, 1) for i in range(1, 5)], 0) == pytest.approx(2 / 16)
    exact = stats.rank_tail([(1201, 600), (3001, 300)], 900_000)
    assert stats.rank_tail([(1201, 600), (3001, 300)], 900_000, most=1) == pytest.approx(exact, abs=2e-3) and 0 < exact < 1


def test_latency_of_both_kinds_of_timestamps(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        at = lambda x: F.lit(x).cast(kind)
        assert one(spark, audit.latency_seconds(at("2024-02-28 23:59:58.5"), at("2024-03-01 00:00:01.25"))) == 86402.75
        assert one(spark, audit.latency_seconds(at("2024-01-01 00:00:02"), at("2024-01-01 00:00:01"))) == -1


def test_positions_of_many_rows(spark):
    df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_000).alias("v"), F.concat(F.lit("payload "), F.col("id").cast("string")).alias("p"))
    got = ordering.with_position(df, [F.col("v")])
    assert got.filter("v <> position").count() == 0 and got.count() == 2_000_000


def test_running_sums(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    rows = ordering.running(df, ["k"], [F.col("o")], {"n": F.lit(1).cast("long"), "s": F.col("o")}).collect()
    assert len(rows) == 5000 and all(r.n == r.o // 3 + 1 and r.s == sum(range(r.k, r.o + 1, 3)) for r in rows)


def test_mixed_vectors_fail(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        retrieval.top_k(df, df.filter("vec_id = 0"), 2).collect()
    with pytest.raises(ValueError):
        retrieval.top_k(df, df, 2)


def test_search_in_parts(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(i, [float(r.randint(0, 3)), float(r.randint(1, 3))]) for i in range(300)], "vec_id long, embedding array<double>")
    whole = {(x.query_id, x["rank"]): x.id for x in retrieval.top_k(df, df, 9).collect()}
    assert whole == {(x.query_id, x["rank"]): x.id for x in retrieval.top_k(df, df, 9, query_bytes=1000).collect()}


def test_integrity_joins(spark):
    judged = spark.createDataFrame([("a", 2), ("b", 0)], "judgement_id string, grade int")
    cands = spark.createDataFrame([("a",), ("b",)], "judgement_id string")
    assert {r.grade for r in integrity.with_grades(cands, judged).collect()} == {0, 2}
    for bad in (judged.limit(1), judged.union(judged)):
        with pytest.raises(Exception, match="judgement"):
            integrity.with_grades(cands, bad).collect()
    asked = spark.createDataFrame([("base", 1, 1), ("other", 1, 1)], "model string, input_token_count int, output_token_count int")
    with pytest.raises(Exception, match="no rates"):
        requests.known_cost(asked, requests.pricing(spark)).collect()
    chunks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "at int, name string")
    found = integrity.verify_mapping(chunks, spark.createDataFrame([(0, "a"), (1, "x"), (3, "d")], "at int, name string"), "at", ["name"])
    assert {(r["at"], r.status, r.field) for r in found.collect()} == {(0, "equal", None), (1, "differs", "name"), (2, "no_mapping", None), (3, "no_chunk", None)}
    sheet = spark.createDataFrame([(0, "A", 1)], "g int, label string, score int")
    with pytest.raises(Exception, match="stands for nothing"):
        integrity.by_label(sheet, spark.createDataFrame([(0, "B", "x")], "g int, label string, condition string"), "g").collect()
    rows = spark.createDataFrame([("r", 1, "P0", "m", "completed")], "blinded_response_id string, question_id int, condition string, model string, status string")
    judgement = spark.createDataFrame([("r", 2, 1)], "blinded_response_id string, question_id int, correct int")
    with pytest.raises(Exception, match="another question"):
        integrity.unblind(judgement, rows, spark.createDataFrame([(1, "x"), (2, "y")], "question_id int, reference string")).collect()


def test_paired_goldens(spark):
    conds = [("a", 0), ("b", 1), ("c", 2)]
    fam = spark.createDataFrame([("f", c, i) for c, i in conds], "family string, condition string, ord int")
    rows = [(c, b, int(c == "a"), {"a": 0, "b": 1, "c": 2}[c]) for c, _ in conds for b in range(20)]
    scores = spark.createDataFrame(rows, "condition string, block int, correct int, v int")
    q = paired.cochran_q(scores, fam).first()
    assert q.q == 40 and q.df == 2 and q.variation
    assert paired.cochran_q(scores.withColumn("correct", F.lit(0)), fam).first().q == 0
    assert paired.friedman(scores, fam, "v").first().statistic == pytest.approx(40)
    assert not paired.friedman(scores.withColumn("v", F.lit(1)), fam, "v").first().variation
    w = {(r.left, r.right): r for r in paired.wilcoxon(scores, paired.pairs(fam), "v").collect()}
    assert w["a", "c"].p_value == pytest.approx(2 / 2**20) and w["a", "c"].n == 20
    assert {r.p_value for r in paired.wilcoxon(scores.withColumn("v", F.lit(1)), paired.pairs(fam), "v").collect()} == {1.0}
    tests = spark.createDataFrame([("f", 0, 0.01), ("f", 1, 0.02), ("f", 2, 0.2), ("g", 0, 0.3)], "family string, o int, p double")
    got = {(r.family, r.o): r.p_holm for r in paired.with_holm(tests, "family", "p", ["o"]).collect()}
    assert [got["f", i] for i in range(3)] == pytest.approx([0.03, 0.04, 0.2]) and got["g", 0] == 0.3


def test_money(spark):
    got = [one(spark, money.retry_delay(F.lit(n))) for n in (1, 2, 3, 4)]
    assert got == [2, 4, 8, 8] and one(spark, money.retry_delay(F.lit(1), hint=F.lit(9))) == 9
    assert str(one(spark, money.report(F.lit("17.9526795").cast("decimal(20,7)")))) == "17.952680"
    df = spark.createDataFrame([(1, 1, "0.4"), (1, 2, "0.6"), (1, 3, "0.000001")], "k int, i int, c string").withColumn("max_cost", F.col("c").cast(money.MONEY))
    assert [r.granted for r in requests.reserve(df, "1.0", key="k", order=["i"]).orderBy("i").collect()] == [True, True, False]


def test_text(spark):
    assert one(spark, text.edge_trim(F.lit(" \t\x0bab \r\n"))) == "\x0bab"
    assert one(spark, text.word_count(F.lit("   "))) == 0
    assert not one(spark, text.full_match(F.lit("src1\n"), "src[0-9]+"))
    assert one(spark, text.restore_newlines(text.protect_newlines(F.lit("a\nb")))) == "a\nb"
    assert one(spark, text.table_count(F.lit("x\n| hits (all) | 3 / 20 |\n"), "hits (all)", 2)) == 20
    assert one(spark, text.collapse(F.lit(" a \xa0\x1c b\n"))) == "a b"


def test_retrieval_goldens(spark):
    def graded(marks):
        return spark.createDataFrame([(q, r, 0 + marks.get((q, r), 0), 100 + r, 20 + r) for q in (0, 1) for r in range(1, 5)], "query_id int, rank int, grade int, character_count int, token_count int")

    rows = graded({(0, 2): 2, (1, 1): 2})
    m = {r.depth_k: r for r in retrieval.metrics_at(rows, [1, 2]).collect()}
    assert [m[k].direct_hits for k in (1, 2)] == [1, 2] and m[2].direct_mrr == 0.75
    s = retrieval.select_depth(retrieval.metrics_at(rows, [1, 2]), retrieval.late_hits(rows, 2)).first()
    assert not s.gate_fires and s.selected_depth == 2
    rows = graded({(0, 1): 2})
    assert retrieval.select_depth(retrieval.metrics_at(rows, [1, 2]), retrieval.late_hits(rows, 2)).first().selected_depth == 1
    rows = graded({(0, 1): 2, (1, 3): 2})
    s = retrieval.select_depth(retrieval.metrics_at(rows, [1, 2]), retrieval.late_hits(rows, 2)).first()
    assert s.gate_fires and s.selected_depth is None


def test_search_is_exact_and_nested(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for x in retrieval.top_k(df, df.filter("vec_id < 5"), 7, exclude_self=True).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.id
    small = {}
    for x in retrieval.top_k(df, df.filter("vec_id < 5"), 3, exclude_self=True).collect():
        small.setdefault(x.query_id, {})[x.rank] = x.id
    unit = {i: [a / math.sqrt(sum(b * b for b in v)) for a in v] for i, v in rows[:60]}
    for q in range(5):
        want = sorted((i for i in unit if i != q), key=lambda i: (-sum(a * b for a, b in zip(unit[q], unit[i])), i))[:7]
        assert [got[q][k] for k in range(1, 8)] == want and [small[q][k] for k in range(1, 4)] == want[:3]
    one_ = retrieval.top_k_one(df, rows[3][1], 4, exclude=3).collect()
    assert [x.id for x in one_] == [got[3][k] for k in range(1, 5)]
    dims = lambda texts: [[float(len(x) % 5 + i) for i in range(8)] for x in texts]
    assert retrieval.Retriever(df, 2, embed=dims).interactive("hello").count() == 2
    with pytest.raises(ValueError):
        retrieval.Retriever(df, 2, embed=dims).interactive(" ")


def test_prompt_with_placeholder_in_value_is_reported(spark):
    prompt, sound = requests.render("{context} {question}", {"context": F.lit("x {question}"), "question": F.lit("q")})
    assert one(spark, prompt) == "x {question} q" and one(spark, sound) is False
    with pytest.raises(ValueError):
        requests.render("{context} {context}", {"context": F.lit("")})


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(1, 20)), min_size=1, max_size=8))
def test_merge_and_complement_partition(spark, spans):
    df = spark.createDataFrame([(1, float(a), float(a + n)) for a, n in spans], "page int, y0 double, y1 double")
    merged = intervals.merge(df, "page", "y0", "y1")
    rest = intervals.complement(merged, "page", "y0", "y1", 60.0)
    covered = set().union(*[set(range(a, a + n)) for a, n in spans])
    free = [(r.y0, r.y1) for r in rest.collect()]
    assert sorted(i for a, b in free for i in range(int(a), int(b))) == [i for i in range(60) if i not in covered]


def test_greedy_pairing(spark):
    r = random.Random(2)
    rows = [(k, i, r.choice("orx")) for k in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    got = {(x.k, x.i): x.pair.i if x.pair else None for x in intervals.pair_forward(df, "k", ["i"], F.col("t") == "o", F.col("t") == "r").collect()}
    for k in range(6):
        free = [i for a, i, t in rows if a == k and t == "r"]
        for i in [i for a, i, t in rows if a == k and t == "o"]:
            later = [j for j in free if j > i]
            want = later[0] if later else None
            if later:
                free.remove(want)
            assert got[k, i] == want


def test_positions_and_hash(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    assert {(r.v, r.position) for r in ordering.with_position(df, [F.col("v")]).collect()} == {(i, i) for i in range(1000)}
    a = audit.projection_hash(df, ["v"], ["v"]).first()
    assert a == audit.projection_hash(df.repartition(7), ["v"], ["v"]).first() and a.n == 1000
    assert a != audit.projection_hash(df.filter("v < 999"), ["v"], ["v"]).first()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\n"), (1, None)], "id int, t string")
    files.write_jsonl(df, str(tmp_path / "j"), ["id"])
    again = files.read_jsonl(spark, str(tmp_path / "j"), df.schema)
    files.verify_round_trip(df, again)
    text_ = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert text_ == '{"id":1,"t":null}\n{"id":2,"t":"b\\n"}\n'
    (tmp_path / "bad.jsonl").write_text('{"id":1}\n')
    with pytest.raises(Exception, match="keys differ"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), df.schema).collect()
    files.write_csv(df.filter("id = 2").withColumn("t", F.lit("x")), str(tmp_path / "c"), ["t", "id"], ["id"])
    assert files.read_csv(spark, str(tmp_path / "c"), "t string, id int").first() == ("x", 2)
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_jsonl(df, str(tmp_path / "j"), ["id"])
    place = f"file://{tmp_path}/pub"
    files.publish(spark, {"t": df}, place, {"n": 2})
    with pytest.raises(FileExistsError):
        files.publish(spark, {"t": df}, place, {"n": 2})
    with pytest.raises(audit.IntegrityError):
        files.publish(spark, {"t": df}, place, {"n": 2}, overwrite=True, guard=df)
    files.publish(spark, {"t": df.filter("id = 1")}, place, {"n": 1}, overwrite=True)
    assert spark.read.parquet(f"{place}/t").count() == 1
    assert files.file_digests(spark, str(tmp_path / "bad.jsonl")).first().length == 9


def test_expectations(spark):
    df = spark.range(3)
    with pytest.raises(audit.IntegrityError):
        audit.expect_none(df, "rows")
    with pytest.raises(audit.IntegrityError, match="a: 1 is not 2"):
        audit.expect_equal({"a": 1}, {"a": 2})
    with pytest.raises(audit.IntegrityError):
        audit.expect_columns(df, ["x"])
    assert audit.duplicates(df.union(df.limit(1)), ["id"]).count() == 1


def test_resumable_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(5).coalesce(1).write.parquet(src)
    work = lambda d: d.withColumn("twice", F.col("id") * 2)
    resumable.run_batches(spark, src, spark.range(1).schema, out, work)
    resumable.run_batches(spark, src, spark.range(1).schema, out, work)
    assert spark.read.parquet(out + "/out").count() == 5
    b = spark.createDataFrame([(0, "a"), (1, "b")], "batch_index int, content_sha256 string")
    assert [r.batch_index for r in resumable.pending(b, b.filter("batch_index = 0")).collect()] == [1]
    with pytest.raises(Exception, match="other content"):
        resumable.pending(b, spark.createDataFrame([(0, "z")], b.schema)).collect()


def test_stream_windows(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(base + datetime.timedelta(minutes=m), "a", 1.0) for m in (1, 2, 70, 400)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = resumable.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == sorted(r.n for r in resumable.windowed(df).collect()) == [1, 1, 2]


def test_blinded_order_and_rules(spark):
    df = spark.createDataFrame([(g, c) for g in range(3) for c in "abcdefg"], "g int, c string")
    a = {(r.g, r.c): r.label for r in review.labelled_order(df, "g", "c", "s").collect()}
    assert a == {(r.g, r.c): r.label for r in review.labelled_order(df.repartition(5), "g", "c", "s").collect()}
    assert all(sorted(a[g, c] for c in "abcdefg") == list("ABCDEFG") for g in range(3))


def test_vectors_and_boxes(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.norm(v)) == 5 and one(spark, vectors.is_unit(vectors.normalise(v)))
    box = lambda *x: F.struct(*[F.lit(float(a)).alias(n) for a, n in zip(x, ("x0", "y0", "x1", "y1"))])
    u = one(spark, vectors.box_union(F.array(box(1, 2, 3, 4), box(0, 3, 2, 9))))
    assert tuple(u) == (0, 2, 3, 9)
    assert one(spark, vectors.boundary_excess(box(-1, 2, 3, 4), F.lit(10.0), F.lit(0.0), F.lit(10.0))) == 1
    assert one(spark, cleaning.heading_class(F.lit(" The  End"), F.lit(9), F.lit(50.0), targets=["The End"], contents_pages=(1, 3))) == "body"

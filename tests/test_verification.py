"""Strict files, matrices, digest trees, histories, lineage, contiguity: what holds passes, each breach is named."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomwell.operators import digests, history, integrity, lineage, retrieval
from loomwell.operators.audit import IntegrityError
from loomwell.sources import matrix, strict

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])


def put(folder, name, body: bytes):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(body)


def good(rows, first=1):
    return b"".join(f'{{"n":{i + first},"s":"x{i} é"}}\n'.encode() for i in range(rows))


def test_strict_lines(spark, tmp_path):
    a, b = good(3000), good(7) + b'{"s":"a\\r\\n","n":8}\n'
    put(tmp_path, "a.jsonl", a)
    put(tmp_path, "b.jsonl", b)
    known = {"a.jsonl": hashlib.sha256(a).hexdigest(), "b.jsonl": hashlib.sha256(b).hexdigest()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # many blocks a file
    try:
        got = strict.read_jsonl(spark, str(tmp_path), SCHEMA, sha256=known, position="n").collect()
        assert sorted(r.n for r in got) == sorted([*range(1, 3001), *range(1, 9)])
        numbered = strict.lines(spark, str(tmp_path)).collect()
        assert {(os.path.basename(r.file), r.line, r.value) for r in numbered} == {("a.jsonl", i, x) for i, x in enumerate(a.decode().split("\n")[:-1])} | {("b.jsonl", i, x) for i, x in enumerate(b.decode().split("\n")[:-1])}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("body", "said"), [
    (good(3)[:-1], "no line feed at the end"), (good(2) + b"\n" + good(1), "line 2 is empty"), (b"", "the file is empty"), (good(1) + b'{"n":2,"s":"\xff"}\n', "line 1 is no UTF-8"), (good(1) + b"[1]\n", "line 1"), (good(1) + b'{"n":2}\n', "line 1"),
    (good(1) + b'{"n":2,"s":"a","t":1}\n', "line 1"), (good(1) + b'{"n":3,"s":"a"}\n', "n is not the line's number"), (good(1) + b'{"n":"x","s":"a"}\n', "MALFORMED|Malformed|parse"), (good(1) + b"\r\n", "line 1"), (good(4), "digests differ"),
])
def test_strict_breaches(spark, tmp_path, body, said):
    put(tmp_path, "a.jsonl", body)
    known = {"a.jsonl": hashlib.sha256(body if said != "digests differ" else b"other").hexdigest()}
    with pytest.raises(Exception, match=said):
        strict.read_jsonl(spark, str(tmp_path), SCHEMA, sha256=known, position="n").collect()


def test_strict_names_files(spark, tmp_path):
    put(tmp_path, "a.jsonl", good(2))
    with pytest.raises(IntegrityError, match="b.jsonl"):
        strict.read_jsonl(spark, str(tmp_path), SCHEMA, sha256={"a.jsonl": hashlib.sha256(good(2)).hexdigest(), "b.jsonl": "0" * 64})


@pytest.mark.parametrize("dtype", ["float32", "float64"])
def test_matrix(spark, tmp_path, dtype):
    r = np.random.default_rng(1)
    rows = [(int(i), r.normal(size=7).tolist()) for i in r.permutation(1000)] + [(5, [0.1] * 7), (None, [float("nan"), float("inf"), -0.0, 0.0, 1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").repartition(6)
    place = str(tmp_path / "m")
    about = matrix.write(df, place, ["vec_id", "e"], id_col="vec_id", vector_col="e", dtype=dtype, block_rows=64)
    assert about == {"dtype": dtype, "rows": 1002, "dims": 7, "block_rows": 64}
    again = matrix.read(spark, place, dtype=dtype, dims=7, rows=1002)
    matrix.expect_same(df, again, id_col="vec_id", vector_col="e", dtype=dtype)
    assert [x.id for x in again.orderBy("place").collect()] == [None, *sorted(x[0] for x in rows[:-1])]
    for wrong in ({"dtype": "float16"}, {"dims": 8}, {"rows": 1001}):
        with pytest.raises(IntegrityError):
            matrix.read(spark, place, **wrong)
    with pytest.raises(IntegrityError, match="differ"):
        matrix.expect_same(df.filter("vec_id <> 9"), again, id_col="vec_id", vector_col="e", dtype=dtype)


def test_matrix_breaches(spark, tmp_path):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "vec_id long, e array<double>")
    write = lambda d, name: matrix.write(d, str(tmp_path / name), ["vec_id"], id_col="vec_id", vector_col="e", block_rows=4)
    for name, bad in (("long", [1.0]), ("null", None), ("hole", [1.0, None])):
        with pytest.raises(IntegrityError):
            write(df.union(spark.createDataFrame([(99, bad)], df.schema)), name)
    write(df, "m")
    place = str(tmp_path / "m")
    blocks, mapping = spark.read.parquet(f"{place}/blocks"), spark.read.parquet(f"{place}/mapping")
    for part, name, table in ((blocks.filter("block <> 1"), "blocks", "lost"), (blocks.withColumn("data", F.substring("data", 1, 8)), "blocks", "short"), (blocks.union(blocks.filter("block = 0")), "blocks", "twice"), (mapping.filter("place <> 3"), "mapping", "unmapped"), (mapping.withColumn("place", F.greatest("place", F.lit(1))), "mapping", "same")):
        other = str(tmp_path / table)
        (part if name == "blocks" else blocks).write.parquet(f"{other}/blocks")
        (part if name == "mapping" else mapping).write.parquet(f"{other}/mapping")
        spark.read.text(f"{place}/about").write.text(f"{other}/about")
        with pytest.raises(IntegrityError):
            matrix.read(spark, other)
    assert write(df.filter("false"), "none")["rows"] == 0 and matrix.read(spark, str(tmp_path / "none")).count() == 0


def test_digest_tree(spark):
    rows = [(i, f"v{i % 7}", None if i % 5 else 1.5) for i in range(3000)] + [(7, "v0", None)] * 3
    a = spark.createDataFrame(rows, "k long, v string, w double")
    tree = lambda df: digests.tree(df, ["k"], ["k", "v", "w"])
    first, shuffled = tree(a).collect(), tree(a.repartition(9, "v")).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, shuffled))
    assert {r.n for r in first if r.level == 0} == {len(rows)} and digests.differing_leaves(tree(a), tree(a.repartition(3))) == []
    b = a.withColumn("v", F.when(F.col("k") == 1234, "changed").otherwise(F.col("v"))).filter("k <> 99").union(spark.createDataFrame([(50_000, "new", None), (7, "v0", None)], a.schema))
    assert len(digests.differing_leaves(tree(a), tree(b))) <= 4
    got = {(r.k, r.v, r.side, r.n) for r in digests.difference(a, b, (tree(a), tree(b)), ["k"], ["k", "v", "w"]).collect()}
    assert got == {(1234, "v2", "left", 1), (1234, "changed", "right", 1), (99, "v1", "left", 1), (50_000, "new", "right", 1), (7, "v0", "right", 1)}
    assert digests.difference(a, a, (tree(a), tree(a)), ["k"], ["k", "v", "w"]).count() == 0
    assert len(digests.differing_leaves(tree(a), tree(a.filter("false")))) > 1000


def candidates(spark, depth):
    rows = [{f: f"{f}-{q}-{r}" for f in history.PREFIX_FIELDS} | {"question_id": q, "rank": r, "chunk_id": f"c{r}"} for q in range(4) for r in range(1, depth + 1)]
    kind = lambda f: "int" if f in ("question_id", "rank") else "string"
    return spark.createDataFrame([tuple(x[f] for f in history.PREFIX_FIELDS) for x in rows], ", ".join(f"{f} {kind(f)}" for f in history.PREFIX_FIELDS))


def test_pool_history(spark):
    one = candidates(spark, 20).withColumn("version", F.lit(1)).withColumn("relevance_grade", F.col("rank") % 3)
    two = history.grow(one, candidates(spark, 30), 2)
    three = history.grow(two.withColumn("relevance_grade", F.coalesce("relevance_grade", F.lit(1))), candidates(spark, 40), 3)
    assert {(r.version, r.n) for r in three.groupBy("version").agg(F.count("*").alias("n")).collect()} == {(1, 80), (2, 40), (3, 40)}
    assert three.filter("version = 3 AND relevance_grade IS NOT NULL").count() == 0 and three.filter("version < 3 AND relevance_grade IS NULL").count() == 0
    chain = history.chained(three)
    assert history.first_changes(three, chain).count() == 0
    for column in [f for f in history.PREFIX_FIELDS if f not in ("question_id", "rank")] + ["relevance_grade"]:
        value = F.lit(7) if column == "relevance_grade" else F.lit("other")
        changed = three.withColumn(column, F.when((F.col("question_id") == 2) & (F.col("rank") == 33 - 10 * F.col("question_id") % 3), value).otherwise(F.col(column)))
        (found,) = history.first_changes(changed, chain).collect()
        assert (found.question_id, found.version) == (2, 3), column
    assert {tuple(r) for r in history.first_changes(three.filter("NOT (question_id = 1 AND rank = 25)"), chain).collect()} == {(1, 2)}


@pytest.mark.parametrize("field", [f for f in history.PREFIX_FIELDS if f not in ("question_id", "rank", "chunk_id")])
def test_grown_pools_keep_every_field(spark, field):
    one = candidates(spark, 3).withColumn("version", F.lit(1)).withColumn("relevance_grade", F.lit(1))
    deeper = candidates(spark, 4).withColumn(field, F.when((F.col("question_id") == 1) & (F.col("rank") == 2), "other").otherwise(F.col(field)))
    with pytest.raises(Exception, match=f"question 1, rank 2: {field}"):
        history.grow(one, deeper, 2).collect()


def test_grown_pools_lose_nothing(spark):
    one = candidates(spark, 3).withColumn("version", F.lit(1)).withColumn("relevance_grade", F.lit(1))
    with pytest.raises(Exception, match="question 0, rank 3: gone"):
        history.grow(one, candidates(spark, 4).filter("NOT (question_id = 0 AND rank = 3)"), 2).collect()


def test_lineage(spark):
    df = spark.createDataFrame([(1, 0.5, "a", "x")], "id int, score double, text string, condition string")
    blind = df.filter("score > 0").select("id", F.sha2("text", 256).alias("h"))
    assert lineage.expect_independent(blind, {"score", "condition"}) is blind
    told = df.select("id", (F.col("score") * 2).alias("weight")).groupBy("id").agg(F.max("weight").alias("quality")).withColumn("shown", F.concat(F.lit("q"), F.col("quality").cast("string")))
    assert "score" in lineage.lineage(told)["shown"]
    leaks = {
        "renamed": df.select("id", F.col("score").alias("s")), "computed": told, "window": df.select("id", F.row_number().over(Window.orderBy("score")).alias("place"), F.sum("score").over(Window.partitionBy("id")).alias("t")),
        "joined": df.select("id").join(df.select("id", F.col("condition").alias("c")), "id"), "union": df.select("id", "text").union(df.select("id", "condition")), "exploded": df.select("id", F.explode(F.array("condition", "text")).alias("x")),
        "struct": df.select(F.struct("id", "score").alias("s")).select(F.to_json("s").alias("j")), "mapped": df.mapInArrow(lambda b: b, "id int, a double, b string, c string").select("id", "a"), "sql": df.selectExpr("id", "case when score > 0.5 then 1 else 0 end AS good"),
    }
    for name, leak in leaks.items():
        with pytest.raises(IntegrityError, match="is made of"):
            lineage.expect_independent(leak, {"score", "condition"})
            pytest.fail(name)


def test_blinded_rows_hold_no_rank(spark):
    rows = spark.createDataFrame([("j", "q", "t", 1, 0.5)], "judgement_id string, query_text string, chunk_text string, rank int, score double")
    assert retrieval.blinded(rows, "c").count() == 1
    with pytest.raises(IntegrityError, match="chunk_text is made of rank"):
        retrieval.blinded(rows.withColumn("chunk_text", F.concat("chunk_text", F.col("rank").cast("string"))), "c")


def test_aggregates_only(spark):
    df = spark.createDataFrame([(1, "a")], "id int, condition string")
    lineage.expect_aggregate(df.groupBy("condition").count().orderBy("condition"), {"condition"})
    for bad in (df, df.groupBy("condition", "id").count()):
        with pytest.raises(IntegrityError):
            lineage.expect_aggregate(bad, {"condition"})


def test_contiguity(spark):
    parents = ["a", "a", "b", "b", "b", "a", "c", "d", "d"]
    index = [0, 1, 0, 1, 3, 2, 5, 0, 0]
    rows = spark.createDataFrame([(i, p, x, i if i != 7 else 70) for i, (p, x) in enumerate(zip(parents, index))], "t int, p string, x int, at long").repartition(4)
    got = {r.p: (r.rows, r.runs, r.index_breaks, r["first"], r["last"], r.misplaced) for r in integrity.contiguity(rows, ["t"], "p", "x", "at").collect()}
    assert got == {"a": (3, 2, 0, 0, 5, 0), "b": (3, 1, 1, 2, 4, 0), "c": (1, 1, 0, 6, 6, 0), "d": (2, 1, 1, 7, 8, 1)}


@pytest.mark.parametrize(("found", "want"), [("abcde", (5, None, None)), ("abxde", (2, 2, "other")), ("abc", (3, 3, "missing")), ("abcdef", (5, 5, "extra")), ("", (0, 0, "missing")), ("xbcde", (0, 0, "other"))])
def test_common_prefix(spark, found, want):
    make = lambda s: spark.createDataFrame(list(enumerate(s)), "place long, key string")
    assert tuple(integrity.common_prefix(make("abcde"), make(found), "place", "key").first()) == want


def test_accounting(spark):
    make = lambda s: spark.createDataFrame([(k, v) for k, vs in s.items() for v in vs], "k string, v string")
    raw, kept, gone = make({"a": "xxy", "b": "pq", "c": "z"}), make({"a": "xy", "b": "pp"}), make({"a": "x", "b": "q", "d": "w"})
    got = {r.k: tuple(r)[1:] for r in integrity.accounting(raw, {"kept": kept, "gone": gone}, "k", "v").collect()}
    assert got == {"a": (3, 2, 1, 0, 0), "b": (2, 2, 1, 0, 1), "c": (1, 0, 0, 1, 0), "d": (0, 0, 1, 0, 1)}


def test_other_orders(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 6), ("b", 0, 5), ("b", 1, 7), ("c", 0, 5), ("d", 0, 9), ("d", 1, 6)], "condition string, position int, question int")
    got = {tuple(r) for r in integrity.other_orders(rows, "condition", "position", "question").collect()}
    assert got == {("b", 1, 7, 6), ("c", 1, None, 6), ("d", 0, 9, 5)}


def test_score_rules(spark):
    from loomwell.operators import review

    base = {"id": "ok", "correct": 1, "unsupported": False, "confirmed": False, "is_empty": False, "category": "none", "confidence": "high", "note": None, "on": True, "depth": 2, "clarity": 2}
    empty = base | {"correct": 0, "confirmed": True, "is_empty": True, "category": "no_visible_answer", "note": "n", "depth": 0, "clarity": 0}
    cases = {
        "ok": base, "ok empty": empty, "ok not applicable": base | {"on": False, "depth": None}, "ok empty, not applicable": empty | {"on": False, "depth": None}, "ok wrong": base | {"correct": 0, "category": "grounding", "note": "why"},
        "correct_in_range": base | {"correct": 2, "category": "other", "note": "n"}, "category_known": base | {"correct": 0, "category": "bad", "note": "n"}, "confidence_known": base | {"confidence": "sure"}, "unsupported_given": base | {"unsupported": None}, "depth_in_range": base | {"depth": 3}, "depth_in_range ": base | {"on": False},
        "depth_in_range  ": base | {"depth": None}, "clarity_in_range": base | {"clarity": -1}, "category_agrees": base | {"category": "conceptual"}, "category_agrees ": base | {"correct": 0, "note": "n"}, "note_given": base | {"confidence": "low"}, "note_given ": base | {"depth": 1, "note": " "}, "note_given  ": base | {"clarity": 1},
        "empty_is_confirmed": base | {"confirmed": True}, "empty_is_confirmed ": base | {"confirmed": None}, "empty_policy": empty | {"clarity": 2}, "empty_policy ": empty | {"unsupported": True}, "empty_policy  ": empty | {"category": "grounding"}, "empty_policy   ": empty | {"depth": 2}, "answer_is_visible": base | {"correct": 0, "category": "no_visible_answer", "note": "n"},
    }
    rows = [tuple((x | {"id": name}).values()) for name, x in cases.items()]
    df = spark.createDataFrame(rows, "id string, correct int, unsupported boolean, confirmed boolean, is_empty boolean, category string, confidence string, note string, on boolean, depth int, clarity int")
    got = sorted((r.id, r.rule) for r in review.violations(df, "id", review.score_rules({"depth": "on"}, ["clarity"])).collect())
    assert got == sorted((n, n.strip()) for n in cases if not n.startswith("ok"))


def test_small_sides_only_are_broadcast(spark):
    from loomwell.operators import staging

    plan = lambda df: spark.range(10).crossJoin(df)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(staging.if_small(spark.range(5), 5)) and "broadcast" not in plan(staging.if_small(spark.range(6), 5))


def test_estimates_take_the_largest_count(spark):
    from loomwell.operators import requests

    df = spark.createDataFrame([("x" * 30,), ("",), (None,)], "prompt string")
    got = [r[0] for r in df.select(requests.estimated(lambda ts: [len(t) // 3 for t in ts], lambda ts: [min(len(t), 15) for t in ts])(F.col("prompt"))).collect()]
    assert got == [15, 0, 0]

"""Contracts and the resumable executor."""

import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loomwell import __main__ as cli
from loomwell import contracts
from loomwell.operators import execution
from loomwell.operators.audit import IntegrityError
from loomwell.sources import files

ASKED = [{"id": f"r{i}", "max_cost": "0.4"} for i in range(4)]


def test_run_resumes_and_keeps_to_the_limit(tmp_path):
    calls = []

    def call(q):
        calls.append(q["id"])
        if len(calls) == 2:
            raise execution.CallFailed(429, 9)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return {"content": "x", "cost": "0.1"}

    waits = []
    with pytest.raises(KeyboardInterrupt):
        execution.run(ASKED, call, str(tmp_path), limit=Decimal("9"), sleep=waits.append)
    assert waits == [9] and calls == ["r0", "r1", "r1", "r2"]
    got = execution.run(ASKED, call, str(tmp_path), limit=Decimal("9"), sleep=waits.append)
    assert [r["id"] for r in got] == [q["id"] for q in ASKED] and [r["retry_count"] for r in got] == [0, 1, 1, 0]
    n = len(calls)
    assert execution.run(ASKED, call, str(tmp_path), limit=Decimal("9")) == got and len(calls) == n


def test_limit_is_exact(tmp_path):
    call = lambda q: {"content": "", "cost": "0.4"}
    with pytest.raises(execution.CostLimit):
        execution.run(ASKED, call, str(tmp_path / "a"), limit=Decimal("1.5"))
    assert execution.run(ASKED, call, str(tmp_path / "b"), limit=Decimal("1.6"))[3]["status"] == "empty"
    with pytest.raises(execution.CostLimit):  # a restart knows what was spent
        execution.run(ASKED, call, str(tmp_path / "a"), limit=Decimal("1.5"))


def test_terminal_failure_stays(tmp_path):
    def call(q):
        raise execution.CallFailed(400)

    with pytest.raises(execution.CallFailed):
        execution.run(ASKED, call, str(tmp_path), limit=Decimal("9"))
    with pytest.raises(IntegrityError, match="for good"):
        execution.run(ASKED, call, str(tmp_path), limit=Decimal("9"))


def test_torn_line(tmp_path):
    j = execution.Journal(str(tmp_path / "j"))
    j.add({"a": 1})
    with open(j.path, "a") as f:
        f.write('{"a": ')
    assert j.rows() == [{"a": 1}]
    j.add({"a": 2})
    assert j.rows() == [{"a": 1}, {"a": 2}]


def test_schema_and_manifest(spark, tmp_path):
    df = spark.range(1)
    assert contracts.require_schema(df, df.schema).columns == ["id"]
    with pytest.raises(IntegrityError, match="unknown x"):
        contracts.require_schema(df.withColumn("x", F.lit(1)), df.schema)
    (tmp_path / "s").write_bytes(b"abc")
    good = {"sources": [{"source_id": "s", "path": "s", "bytes": 3, "sha256": hashlib.sha256(b"abc").hexdigest()}]}
    assert contracts.verify_manifest(good, str(tmp_path)) == {"s": good["sources"][0]["sha256"]}
    for change in ({"bytes": 4}, {"sha256": "0" * 64}, {"path": "../s"}, {"extra": 1}):
        with pytest.raises(IntegrityError):
            contracts.verify_manifest({"sources": [good["sources"][0] | change]}, str(tmp_path))


def test_questions(spark):
    sha = hashlib.sha256(b"why?").hexdigest()
    rows = [("1.2a", "1.2", "a", "why?", sha, False), ("1.3", "1.2", None, "why?", sha, False), ("x", "x", None, " ", sha, True)]
    df = spark.createDataFrame(rows, "question_id string, problem string, part string, query_text string, query_text_sha256 string, ground_truth_available boolean")
    got = {(r.question_id, r.rule) for r in contracts.question_violations(df).collect()}
    assert got == {("1.3", "id_is_problem_and_part"), ("x", "id_has_form"), ("x", "text_not_blank"), ("x", "digest_is_of_text"), ("x", "ground_truth_hidden")}


def test_score_cell():
    assert contracts.score_cell("scores = {'A': {'correct': 1}}") == {"A": {"correct": 1}}
    for bad in ("import os", "scores = f()", "scores = {}\nscores = {}", "scores = [1]"):
        with pytest.raises((IntegrityError, ValueError)):
            contracts.score_cell(bad)


def test_review_states(tmp_path):
    p = tmp_path / "ref.json"
    p.write_bytes(b"1")
    s = contracts.ReviewState(str(p), str(tmp_path / "ledger.json"))
    assert s.state() == "pre_approval" and s.advance(b"2") == "approved" and s.advance(b"3") == "frozen" and s.state() == "frozen"
    with pytest.raises(IntegrityError, match="frozen"):
        s.advance(b"4")
    p.write_bytes(b"other")
    with pytest.raises(IntegrityError, match="no recorded state"):
        s.state()


def test_publish_replaces_whole_tables(spark, tmp_path):
    place, one, two = str(tmp_path / "out"), spark.range(3), spark.range(5)
    files.publish(spark, {"t": one}, place, {"n": 3})
    with pytest.raises(FileExistsError):
        files.publish(spark, {"t": two}, place, {"n": 5})
    files.publish(spark, {"t": two}, place, {"n": 5}, overwrite=True)
    assert spark.read.parquet(f"{place}/t").count() == 5
    (tmp_path / "out").rename(tmp_path / "out.replaced")  # as if a call had been cut off between its two moves
    with pytest.raises(FileExistsError):
        files.publish(spark, {"t": one}, place, {"n": 3})
    assert spark.read.parquet(f"{place}/t").count() == 5 and not (tmp_path / "out.replaced").exists()
    with pytest.raises(IntegrityError, match="never overwritten"):
        files.publish(spark, {"t": one}, place, {"n": 3}, overwrite=True, guard=one)


def test_files_appear_together_or_not_at_all(tmp_path):
    files.publish_files({"a": b"1", "b": b"2"}, str(tmp_path))
    with pytest.raises(FileExistsError):
        files.publish_files({"c": b"3", "b": b"9"}, str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a": b"1", "b": b"2"}
    with pytest.raises(IntegrityError):
        files.publish_files({"../x": b""}, str(tmp_path))


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "vector_topk" in capsys.readouterr().out
    assert cli.main(["run", "uniqueness", "/root/testdata/sf0.001", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1

"""How much of the encoded pieces a worker of op2 keeps decides the cost and nothing else."""

from loomwell.llm import _shared, queries, token_files


def test_table_size_changes_no_file(spark, docs, path):
    got = []
    for table_bytes in (1 << 10, 320 << 20):
        place = _shared.new_place(spark, "tokens")
        token_files.write(docs, place, path("byte_bpe_50k.json"), end_id=2, table_bytes=table_bytes)
        got.append(sorted(map(tuple, token_files.read(spark, place).collect()), key=repr))
    assert got[0] == got[1] and got[0]


def test_query_keeps_more_than_the_usual_table(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(token_files, "write", lambda *a, **k: seen.update(k))
    monkeypatch.setattr(token_files, "read", lambda spark, place: spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long"))
    queries.op2_token_files(spark, "/root/testdata/sf0.001")
    assert seen["table_bytes"] > token_files.TABLE_BYTES

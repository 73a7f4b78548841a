"""Chunks are made from small batches, so that a worker holds little however large the table is."""

import pyarrow as pa

from loomwell.operators import chunking


def test_workers_get_and_give_small_batches(spark):
    for name in chunking.BATCHES:
        spark.conf.unset(name)
    texts = [" ".join(f"w{(i * k) % 997}" for k in range(900)) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    sizes = lambda: docs.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in bs), "n long, size long").collect()
    before = sizes()
    chunks = chunking.chunk(docs, size=200, overlap=10, atoms="words").collect()
    after = sizes()
    assert sum(r.n for r in before) == sum(r.n for r in after) == 3000
    assert max(r.size for r in after) <= 5 << 20 < max(r.size for r in before)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(3000)), "text": texts})
    parts = list(chunking._slices(batch))
    assert sum(p.num_rows for p in parts) == 3000 and max(p.nbytes for p in parts) <= 2 << 20
    want = [(i, k, a, e) for i, t in enumerate(texts) for k, (a, e) in enumerate(chunking.fold([len(w) for w in t.split()], 200, 10))]
    assert sorted((r.doc_id, r.chunk_index, r.first_atom, r.end_atom) for r in chunks) == want


def test_other_settings_stay(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "123")
    chunking.chunk(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), atoms="words").collect()
    assert spark.conf.get(name) == "123"
    spark.conf.unset(name)

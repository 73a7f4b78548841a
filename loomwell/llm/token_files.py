"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A dataset is a folder of shards. ``NNNNNN.bin`` holds the ids of a shard's
documents one after the other as little-endian unsigned integers (16 bits if
the vocabulary fits, else 32), ``NNNNNN.off`` the places of its documents, from
0, as n + 1 little-endian 64-bit integers, ``NNNNNN.doc`` their document ids and
``NNNNNN.set`` a bit for each that says whether it has one. ``index.json`` lists the shards in order with the documents and ids before
each: prefix sums over the shards' counts, the only figures the driver sees.
"""

from __future__ import annotations

import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, pieces

#: What the table of pieces of a worker may take, for 800,000 of them.
TABLE_BYTES = 160 << 20


def write(docs: DataFrame, place: str, tokenizer: str, *, end_id: int | None = None, id_col: str = "doc_id",
          text_col: str = "text", table_bytes: int = TABLE_BYTES) -> dict:
    """Encode ``docs`` in ascending order of ``id_col`` and write them to ``place``.

    A null text counts as empty; null ids come first; rows that share an id are
    ordered by their text. Rows are dealt by ranges of (id, hash of the text),
    so even one id with very many rows is spread. A shard is written under
    another name and renamed when whole, so a task that is run again replaces
    its shard by an equal one. Texts of any length are encoded whole; columns
    other than the two named take no part. An empty table gives an index without
    shards. ``table_bytes`` bounds the table of encoded pieces that a worker keeps;
    it decides the cost only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def shard(batches):
        import numpy as np

        enc = pieces.encoder(tokenizer, 800_000 * table_bytes // TABLE_BYTES, table_bytes)
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        ids, known, lengths = [], [], []

        def run():
            for b in pieces.text_batches(batches, "text"):
                ids.append(b.column("id").fill_null(0).to_numpy())
                known.append(b.column("id").is_valid().to_numpy(zero_copy_only=False))
                for x in enc.encode(b.column("text").to_pylist()):
                    lengths.append((len(x) + len(end)) // enc.width)
                    yield x
                    yield end

        first = next(batches, None)
        if first is None:
            return
        from itertools import chain

        batches = chain([first], batches)
        k = _shared.task_id()
        name = f"{place}/{k:06d}"
        _shared.write_whole(f"{name}.bin", run())
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype="<i8")]).astype("<i8")
        _shared.write_whole(f"{name}.off", [offsets.tobytes()])
        _shared.write_whole(f"{name}.doc", [np.concatenate(ids).astype("<i8").tobytes()])
        _shared.write_whole(f"{name}.set", [np.packbits(np.concatenate(known)).tobytes()])
        yield pa.RecordBatch.from_pydict({"shard": [k], "docs": [len(lengths)], "ids": [int(offsets[-1])], "kind": [enc.dtype]})

    found = _shared.map_batches(rows, shard, "shard long, docs long, ids long, kind string").collect()  # a row for each shard
    index = {"format": 2, "dtype": found[0].kind if found else "<u2", "end_id": end_id, "shards": []}
    docs_before = ids_before = 0
    for r in sorted(found, key=lambda r: r.shard):
        index["shards"].append({"name": f"{r.shard:06d}", "docs": r.docs, "ids": r.ids, "docs_before": docs_before, "ids_before": ids_before})
        docs_before, ids_before = docs_before + r.docs, ids_before + r.ids
    _shared.write_whole(f"{place}/index.json", [json.dumps(index).encode()])
    return index


def load_index(place: str) -> dict:
    return json.loads(bytes(_shared.map_array(f"{place}/index.json", "u1")))


def read(spark: SparkSession, place: str, *, with_ids: bool = False) -> DataFrame:
    """A row for each document, from the files: doc_id, doc_index, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is over the
    ids as little-endian unsigned 32-bit integers. ``with_ids`` adds ``ids``.
    """
    index = load_index(place)
    kind = index["dtype"]
    schema = "doc_id long, doc_index long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not index["shards"]:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(s["name"], s["docs_before"], s["ids_before"]) for s in index["shards"]], "name string, docs_before long, ids_before long")
    shards = shards.repartition(len(index["shards"]))

    def documents(batches):
        import numpy as np

        for b in batches:
            for name, docs_before, ids_before in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = _shared.map_array(f"{place}/{name}.bin", kind)
                off = _shared.map_array(f"{place}/{name}.off", "<i8")
                doc = np.asarray(_shared.map_array(f"{place}/{name}.doc", "<i8"))
                none = np.unpackbits(np.asarray(_shared.map_array(f"{place}/{name}.set", "u1")), count=len(doc)) == 0
                for i in range(0, len(doc), 2000):
                    j = min(i + 2000, len(doc))
                    own = [np.asarray(ids[off[k]:off[k + 1]]).astype("<u4") for k in range(i, j)]
                    cols = [
                        pa.array(doc[i:j], pa.int64(), mask=none[i:j]),
                        pa.array(np.arange(i, j) + docs_before, pa.int64()),
                        pa.array(np.asarray(off[i:j]) + ids_before, pa.int64()),
                        pa.array(np.diff(off[i:j + 1]), pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "doc_index", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols.append(pa.array([x.astype("i4") for x in own], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(cols, names)

    return shards.mapInArrow(documents, schema)

"""Centroid clustering by Lloyd's rounds in whole numbers, where a round does only what changed.

Vectors become integers, so sums, means and distances are exact and don't depend
on how Spark deals rows to tasks. What is kept between rounds is a table of the
vectors with their owner and their distance to it, and the sums and counts of the
clusters, k rows that the driver holds. A round goes over the table once:

* a vector whose owner stayed, or came nearer, can only be won by centroids that
  changed, for the others were behind before and still are: it meets those only;
* a vector whose owner moved away meets all centroids.

Vectors that change hands are then summed as signed transfers, out of the old
cluster and into the new one, within each task first; the clusters' sums take
them up. There is no shuffle of vectors. A round in which no centroid changes ends
the work, as all later ones would repeat it.

The state of a round is written whole before that of the round before is dropped,
so a lost executor costs the tasks it ran and no more.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: Components from here on have no exact distance in 64 bits.
TOO_LARGE = 1 << 27
#: Up to here products of doubles are exact: all terms of a distance stay below 2 ** 53.
EXACT_IN_DOUBLES = 1 << 22


@dataclass
class Clusters:
    """The vectors with ``cluster`` and ``distance``, the centroids as rows of integers, and what each round did."""

    rows: DataFrame
    centroids: list[list[int]]
    log: list[dict] = field(default_factory=list)


def whole(vectors: DataFrame, *, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors of ``dims`` finite components as integers floor(scale * x)."""
    x = F.col(vector_col)
    # Asked one after the other: sizes and nulls before values.
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    scaled = lambda c: c.cast("double") * F.lit(float(scale))
    fits = lambda c: F.floor(F.when(F.abs(scaled(c)) < TOO_LARGE, scaled(c)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")))).cast("int")
    return vectors.filter((F.size(x) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, fits).alias("v"))


def distances(v, c):
    """Squared distances of the rows of ``v`` and ``c``, exact integers."""
    import numpy as np

    if max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0))) <= EXACT_IN_DOUBLES:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for k in range(len(c)):
        out[:, k] = ((v - c[k]) ** 2).sum(1)
    return out


def reassign(v, owner, dist, centroids, changed):
    """(owner, dist, work) after the centroids marked in ``changed`` moved; work counts the distances computed.

    ``owner`` is -1 where there is none yet. Of equal distances the smaller number wins.
    """
    import numpy as np

    owner, dist, work = owner.copy(), dist.copy(), np.zeros(len(v), np.int64)
    left = owner < 0
    mine = np.flatnonzero(~left & changed[np.maximum(owner, 0)])
    if len(mine):
        now = ((v[mine] - centroids[owner[mine]]) ** 2).sum(1)
        left[mine] = now > dist[mine]
        dist[mine] = now
        work[mine] += 1
    full, some, moved = np.flatnonzero(left), np.flatnonzero(~left), np.flatnonzero(changed)
    if len(full):
        d = distances(v[full], centroids)
        best = d.argmin(1)
        owner[full], dist[full] = best, d[np.arange(len(full)), best]
        work[full] += len(centroids)
    if len(some) and len(moved):
        d = distances(v[some], centroids[moved])
        at = d.argmin(1)
        best, near = moved[at], d[np.arange(len(some)), at]
        wins = (near < dist[some]) | ((near == dist[some]) & (best < owner[some]))
        owner[some], dist[some] = np.where(wins, best, owner[some]), np.where(wins, near, dist[some])
        work[some] += len(moved)
    return owner, dist, work


def _matrix(column, dims: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _round(state: DataFrame, centroids, changed, dims: int) -> DataFrame:
    import numpy as np

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            before = b.column("owner").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, dist, work = reassign(_matrix(b.column("v"), dims), before, b.column("dist").to_numpy(zero_copy_only=False).astype(np.int64), centroids, changed)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("v"), pa.array(owner, pa.int32()), pa.array(before, pa.int32()), pa.array(dist, pa.int64()), pa.array(work, pa.int32())],
                ["vec_id", "v", "owner", "before", "dist", "work"])

    return state.mapInArrow(run, "vec_id long, v array<int>, owner int, before int, dist long, work int")


def _transfers(state: DataFrame, k: int, dims: int) -> DataFrame:
    """(cluster, j, s): signed sums of component j of the vectors that came to or left a cluster; j = dims counts them."""
    import numpy as np

    def run(batches):
        total, touched = np.zeros((k, dims + 1), np.int64), np.zeros(k, bool)
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column("v"), dims)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], axis=1)
            for name, sign in (("owner", 1), ("before", -1)):
                c = b.column(name).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(total, c[c >= 0], sign * v[c >= 0])
                touched[c[c >= 0]] = True
        at = np.repeat(np.flatnonzero(touched), dims + 1)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.tile(np.arange(dims + 1), touched.sum()), pa.int32()), pa.array(total[touched].ravel(), pa.int64())], ["cluster", "j", "s"])

    sums = state.filter("owner <> before").select("v", "owner", "before").mapInArrow(run, "cluster int, j int, s long")
    return sums.groupBy("cluster", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Lloyd's rounds over all vectors of ``dims`` finite components, each taken as floor(scale * x), then one more assignment.

    Centroids start as the ``k`` vectors whose ids have the smallest sha256 of
    ``<salt>:<id>``; of repeated ids the smaller vector comes first, null ids last. Every
    round assigns each vector to the nearest centroid, ties to the smaller number,
    and moves each centroid that has vectors to the floor of their mean.

    Vectors that are null, of another length or hold null or non-finite components
    take no part. Repeated rows and rows with a null id are vectors like others;
    with fewer than ``k`` vectors there are as many centroids; an empty table
    gives no rows. A component of 2 ** 27 or more after scaling raises an error, as
    its distances have no exact value in 64 bits. Columns other than the two named
    take no part, whatever they are called; embeddings hold no texts.
    """
    import numpy as np

    spark = vectors.sparkSession
    base = whole(vectors, dims=dims, scale=scale, id_col=id_col, vector_col=vector_col)
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = base.withColumn("h", draw).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    blank = base.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("dist"))
    if not first:
        return Clusters(blank.select("vec_id", F.col("owner").alias("cluster"), F.col("dist").alias("distance")), [])
    centroids = np.array([r.v for r in first], np.int64)
    k = len(centroids)
    changed, sums, counts = np.ones(k, bool), [[0] * dims for _ in range(k)], [0] * k
    state, place, log = blank, None, []
    for turn in range(rounds + 1):
        old, place = place, _shared.new_place(spark, f"lloyd-{turn}")
        out = _round(state, centroids, changed, dims)
        out.write.option("compression", "zstd").parquet(place)
        state = spark.read.schema(out.schema).parquet(place)
        if old:
            _shared.drop(spark, old)
        did = state.agg(F.sum("work").alias("work"), F.count_if(F.col("owner") != F.col("before")).alias("moved")).first()
        log.append({"round": turn, "changed_centroids": int(changed.sum()), "distances": int(did.work), "moved": did.moved})
        if turn == rounds:
            break
        for r in _transfers(state, k, dims).collect() if did.moved else []:  # dims + 1 rows for each cluster
            if r.j == dims:
                counts[r.cluster] += int(r.s)
            else:
                sums[r.cluster][r.j] += int(r.s)
        moved = np.array([[s // n for s in total] if n else list(map(int, c)) for total, n, c in zip(sums, counts, centroids)], np.int64)
        changed, centroids = (moved != centroids).any(1), moved
        if not changed.any():
            break
    return Clusters(state.select("vec_id", F.col("owner").alias("cluster"), F.col("dist").alias("distance")), centroids.tolist(), log)


def digests(found: Clusters) -> DataFrame:
    """The vectors with the inertia of their cluster and of all, and the sha256 of its centroid."""
    if not found.centroids:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return found.rows.select("*", *none)
    by = {r.cluster: int(r.s) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each cluster
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    at = F.col("cluster") + 1
    return found.rows.select(
        "vec_id", "cluster", "distance", F.element_at(F.array(*[F.lit(by.get(i, 0)).cast("long") for i in range(len(marks))]), at).alias("cluster_inertia"),
        F.lit(sum(by.values())).cast("long").alias("inertia"), F.element_at(F.array(*[F.lit(m) for m in marks]), at).alias("centroid_sha256"))

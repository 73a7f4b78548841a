"""Near-duplicates among embeddings: spherical k-means cells, blocked cosine products.

Equal vectors of a label are one class. Centroids are fitted on a bounded sample
of classes, and every class is assigned to its nearest centroid, its home, and as
a visitor to each other cell where something within reach of it may have its
home: x with home c can only be within distance r of y, whose home is h, if
y.(h - c) <= r |h - c|. r is the chord that belongs to the least cosine, whatever
the number of dimensions. A home is compared with all members of its cell, so each pair is seen
from either side once. Cells of any size are compared in blocks; a block gives a
row for each vector, its links counted and one edge to the least vector of its
part, never the pairs.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared
from .components import components

FEW_CELLS = 200_000  # rows of cell sizes that are broadcast; beyond, they are joined by shuffling


def kmeans(x, k: int, rounds: int = 12, seed: int = 3):
    """Centroids of unit length for unit rows ``x``."""
    import numpy as np

    k = max(1, min(k, len(x)))
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i:i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], c)
    return c


def _unit(vectors):
    import numpy as np

    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def reach(least: float) -> float:
    """The distance of unit vectors of this cosine: no difference within it points further in any direction."""
    return math.sqrt(max(0.0, 2 - 2 * least))


def _assign(classes: DataFrame, centroids: dict, least: float) -> DataFrame:
    """(label, dims, cell, home, id, copies, vector as bytes of doubles)."""
    shared = classes.sparkSession.sparkContext.broadcast(centroids)  # at most `most_cells` vectors of each dimension

    def run(batches):
        import numpy as np

        apart_of: dict = {}
        for b in batches:
            dims = b.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                part = b.take(pa.array(own))
                x = _unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                c = shared.value.get(d)
                if c is None:  # a dimension the sample didn't have: one cell
                    c = np.zeros((1, d))
                    c[0, 0] = 1
                sims = x @ c.T
                home = sims.argmax(1)
                if d not in apart_of:
                    apart_of[d] = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                apart = apart_of[d]
                inside = sims[np.arange(len(x)), home][:, None] - sims <= reach(least) * apart[home] + 1e-9
                r, cell = np.nonzero(inside)
                raw = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label").take(pa.array(r)), pa.array(np.full(len(r), d), pa.int32()), pa.array(cell, pa.int32()), pa.array(home[r] == cell),
                        part.column("id").take(pa.array(r)), part.column("copies").take(pa.array(r)), pa.array([raw[i] for i in r.tolist()], pa.binary()),
                    ],
                    ["label", "dims", "cell", "home", "id", "copies", "raw"],
                )

    return _shared.map_batches(classes.select("label", "id", "copies", "vector"), run, "label long, dims int, cell int, home boolean, id long, copies long, raw binary")


def _compare(least: float):
    def run(table):
        import numpy as np

        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        copies = table.column("copies").to_numpy()
        x = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.float64).reshape(len(ids), -1)
        names, at = np.unique(ids, return_inverse=True)
        h, m = np.flatnonzero(side), np.flatnonzero(~side)
        hi, mi = at[h], at[m]
        near = x[h] @ x[m].T >= least
        near &= hi[:, None] != mi[None, :]
        links = near @ copies[m]
        low = np.arange(len(names))
        far = len(names)
        if near.any():
            rows, cols = near.any(1), near.any(0)
            part, hp, mp = near[rows][:, cols], hi[rows], mi[cols]
            while True:
                old = low.copy()
                np.minimum.at(low, hp, np.where(part, low[mp][None, :], far).min(1))
                np.minimum.at(low, mp, np.where(part, low[hp][:, None], far).min(0))
                low = low[low]
                if (low == old).all():
                    break
        found = np.zeros(len(names), np.int64)
        np.add.at(found, hi, links)
        own = np.flatnonzero((low != np.arange(len(names))) | (found > 0))
        return pa.table({"id": names[own], "links": found[own], "least": names[low[own]]})

    return run


def dedup(vectors: DataFrame, *, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
          cell_rows: int = 600, most_cells: int = 4096, sample_rows: int = 50_000, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link if their labels are equal and not null and their cosine, in double
    precision, is ``least`` or more. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing and are kept, as are rows
    without a label; vectors of different lengths don't link. Rows with the same
    id are one vector each and share what the links of any of them reach. A row
    with a null id gets null. An empty table gives no rows. Columns other than the
    three named take no part, whatever they are called.
    """
    import numpy as np

    spark = vectors.sparkSession
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.col("label").isNotNull() & F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h", F.when(F.col("fine"), F.xxhash64("vector"))).withColumn("g", F.when(F.col("fine"), F.hash("vector")))
    key = ["label", "h", "g"]
    classes = rows.filter("fine").groupBy(*key).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = _shared.settle(classes, "vector-classes")
    n, labels = classes.agg(F.count("*"), F.count_distinct("label")).first()
    if not n:
        return rows.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), (F.col("id") == F.col("id")).alias("kept"))
    k = max(1, min(most_cells, round(n / (labels * cell_rows))))
    some = classes.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(min(sample_rows, max(2000, 40 * k))).toArrow()
    held = some.column("vector").combine_chunks()
    dims = held.value_lengths().to_numpy(zero_copy_only=False)
    centroids = {int(d): kmeans(_unit(held.filter(pa.array(dims == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)), k) for d in np.unique(dims)}
    cells = _shared.settle(_assign(classes, centroids, least), "cells")
    sizes = cells.groupBy("label", "dims", "cell").agg(F.count_if("home").alias("homes"), F.count("*").alias("members"))
    sizes = _shared.settle(sizes.select("label", "dims", "cell", F.ceil(F.col("homes") / block).cast("int").alias("hb"), F.ceil(F.col("members") / block).cast("int").alias("mb")).filter("hb > 0"), "cell-sizes")
    if sizes.count() <= FEW_CELLS:
        sizes = F.broadcast(sizes)
    placed = cells.join(sizes, ["label", "dims", "cell"])
    spot = lambda n: F.pmod(F.xxhash64("id", F.lit(5)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["label", "dims", "cell", "id", "copies", "raw"]
    as_home = placed.filter("home").select(*cols, spot(F.col("hb")).alias("i"), every(F.col("mb")).alias("j"), F.lit(True).alias("side"))
    as_member = placed.select(*cols, every(F.col("hb")).alias("i"), spot(F.col("mb")).alias("j"), F.lit(False).alias("side"))
    blocks = as_home.select(*cols, "i", "j", "side").union(as_member.select(*cols, "i", "j", "side"))
    met = _shared.settle(blocks.groupBy("label", "dims", "cell", "i", "j").applyInArrow(_compare(least), "id long, links long, least long"), "links")
    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.select("id", "least").filter("id <> least"))
    named = classes.select(*key, F.col("id").alias("class"), "copies")
    named = named.join(links.withColumnRenamed("id", "class"), "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.select(*[F.col(c).alias(f"c_{c}") for c in key], (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("component"))
    same = (rows.label == named.c_label) & (rows.h == named.c_h) & (rows.g == named.c_g)
    out = rows.select("id", *key).join(named, same, "left")
    root = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("id") == root).alias("kept"))

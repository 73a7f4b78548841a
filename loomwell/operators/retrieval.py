"""Exact vector search, judged pools and graded retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import stats
from loomwell.functions import text as t
from loomwell.functions import vectors as v
from loomwell.operators import lineage

QUERY_BYTES, QUERY_BLOCK = 64 << 20, 2048  # of query vectors that are shipped to every task or make a block, and rows of a product


def _best(s, i, k: int):
    """The k best columns of each row of scores ``s`` with ids ``i``, best first, ties by id."""
    import numpy as np

    n = s.shape[1]
    if n > 4 * k:
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(s, part, 1)
        own = np.take_along_axis(i, part, 1)
        least = top.min(1)
        for r in np.flatnonzero((s >= least[:, None]).sum(1) > k):  # a tie at the end: the least ids stay
            order = np.lexsort((i[r], -s[r]))[:k]
            top[r], own[r] = s[r, order], i[r, order]
        s, i = top, own
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


SEARCHED = "query_id long, id long, score double"


class _Found:
    """The k best of what some queries have met so far."""

    def __init__(self, ids, vectors, k: int, exclude_self: bool):
        import numpy as np

        self.ids, self.q, self.k, self.exclude_self = ids, vectors / np.linalg.norm(vectors, axis=1, keepdims=True), k, exclude_self
        self.s, self.i = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)

    def meet(self, own, x) -> None:
        """Products with the rows of ``x``, in blocks."""
        import numpy as np

        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        new_s, new_i = [], []
        for j in range(0, len(self.ids), QUERY_BLOCK):
            part = slice(j, j + QUERY_BLOCK)
            s = self.q[part] @ x.T
            if self.exclude_self:
                s[self.ids[part, None] == own[None, :]] = -np.inf
            s, i = _best(np.concatenate([self.s[part], s], axis=1), np.concatenate([self.i[part], np.broadcast_to(own, s.shape)], axis=1), self.k)
            new_s.append(s)
            new_i.append(i)
        self.s, self.i = np.concatenate(new_s), np.concatenate(new_i)

    def rows(self) -> dict:
        import numpy as np

        fine = np.isfinite(self.s.ravel())
        return {"query_id": np.repeat(self.ids, self.s.shape[1])[fine], "id": self.i.ravel()[fine], "score": self.s.ravel()[fine]}


def _vectors(column, dims: int):
    """A matrix of the vectors of an Arrow column, all of which have to have ``dims`` components."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dims or len(column) and column.value_lengths().to_numpy(zero_copy_only=False).min() != dims:
        raise ValueError(f"vectors and queries differ in length; the queries have {dims}")
    return flat.reshape(len(column), dims)


def _beside(rows: DataFrame, asked: DataFrame, k: int, dims: int, exclude_self: bool) -> DataFrame:
    """Few queries go to every task, which keeps k rows for each of them."""
    got = asked.toArrow()
    ids, vectors = got.column("id").to_numpy(), _vectors(got.column("vector").combine_chunks(), dims)
    shared = rows.sparkSession.sparkContext.broadcast((ids, vectors))  # at most query_bytes

    def run(batches):
        import pyarrow as pa

        found = _Found(*shared.value, k, exclude_self)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_BLOCK):
                b = whole.slice(at, QUERY_BLOCK)
                found.meet(b.column("id").to_numpy(), _vectors(b.column("vector"), dims))
        yield pa.RecordBatch.from_pydict(found.rows())

    return rows.mapInArrow(run, SEARCHED)


def _grid(rows: DataFrame, asked: DataFrame, k: int, dims: int, exclude_self: bool, query_rows: int, corpus_rows: int, counts: tuple[int, int]) -> DataFrame:
    """Blocks of queries meet blocks of the corpus, each pair of blocks in a cell of its own.

    Either side is scanned once and dealt to blocks by the place of its rows, not
    by their ids, so repeated ids don't crowd a block; a row goes to as many cells as the other
    side has blocks. A cell gives k rows for each of its queries; before they meet, Spark keeps
    the best k a task, so what is shuffled then is queries x k for each task.
    """
    across, down = max(1, -(-counts[0] // query_rows)), max(1, -(-counts[1] // corpus_rows))
    block = lambda df, n, other, own, all_: df.withColumn(own, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))).withColumn(all_, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))))
    left, right = block(asked, across, down, "_q", "_c"), block(rows, down, across, "_c", "_q")

    def cell(queries, corpus):
        import pyarrow as pa

        one = lambda t, c: t.column(c).combine_chunks()
        found = _Found(one(queries, "id").to_numpy(), _vectors(one(queries, "vector"), dims), k, exclude_self)
        ids, vectors = one(corpus, "id").to_numpy(), one(corpus, "vector")
        for at in range(0, len(ids), QUERY_BLOCK):
            found.meet(ids[at:at + QUERY_BLOCK], _vectors(vectors.slice(at, QUERY_BLOCK), dims))
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(found.rows().items(), (pa.int64(), pa.int64(), pa.float64()))})

    return left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(cell, SEARCHED)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", exclude_self: bool = False, query_bytes: int = QUERY_BYTES, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest by cosine for every query, ties by id.

    Both sides are normalised; unusable vectors take no part, and vectors of
    different lengths are an error. Queries of up to ``query_bytes`` in all are shipped to the
    tasks, which keep k rows for each. More of them meet the corpus in a grid of cells, of
    at most ``block_bytes`` a side. The partial results meet in one window over few rows.
    """
    spark = corpus.sparkSession
    usable = lambda df: df.filter(v.is_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    asked, rows = usable(queries), usable(corpus)
    total, dims, least = asked.agg(F.count("*"), F.max(F.size("vector")), F.min(F.size("vector"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if dims != least:
        raise ValueError(f"queries have from {least} to {dims} components")
    if total * dims * 8 <= query_bytes:
        out = _beside(rows, asked, k, dims, exclude_self)
    else:
        block = max(1, block_bytes // (dims * 8))
        out = _grid(rows, asked, k, dims, exclude_self, block, block, (total, corpus.count()))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def top_k_one(corpus: DataFrame, query: list[float], k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", exclude: int | None = None) -> DataFrame:
    """The same for one query vector, as one expression and a bounded heap in each task."""
    size = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / size) for x in query])
    rows = corpus.filter(v.is_usable(F.col(vector_col)))
    if exclude is not None:
        rows = rows.filter(F.col(id_col) != exclude)
    score = v.dot(v.normalise(F.col(vector_col)), q)
    return rows.select(F.col(id_col).cast("long").alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def candidates(found: DataFrame, texts: DataFrame, config_id: str, *, text_id: str = "doc_id") -> DataFrame:
    """Search results with the identity and size of what they point to; a result without a text is an error."""
    body = texts.select(F.col(text_id).alias("id"), "text")
    missing = F.raise_error(F.concat(F.lit("a result has no text: "), F.col("id").cast("string")))
    rows = found.join(body, "id", "left").withColumn("text", F.when(F.col("text").isNull(), missing).otherwise(F.col("text")))
    return rows.select(
        "query_id", "rank", "id", "score", t.pair_id(F.lit(config_id), F.col("query_id").cast("string"), F.col("id").cast("string")).alias("judgement_id"),
        t.fingerprint(F.col("text")).alias("text_sha256"), t.char_count(F.col("text")).cast("long").alias("character_count"), t.word_count(F.col("text")).cast("long").alias("token_count"),
    )


def blinded(rows: DataFrame, config_id: str) -> DataFrame:
    """What a judge may see, in the order of the hashed identity: nothing that is made of a rank or a score, under whatever name."""
    seen = rows.select(F.lit(config_id).alias("configuration_id"), "judgement_id", "query_text", "chunk_text", F.lit(None).cast("int").alias("relevance_grade"))
    return lineage.expect_independent(seen, {"rank", "score", "condition", "grade"}).orderBy("judgement_id")


def metrics_at(graded: DataFrame, depths: list[int], z: float = stats.Z_ROUNDED) -> DataFrame:
    """Measures of the first k results for every k, from one judged pool.

    ``graded`` has query_id, rank, grade (0, 1, 2), character_count and
    token_count. The ideal order for nDCG is that of the whole pool. Direct is
    grade 2, useful is 1 or more; precision divides by k.
    """
    spark = graded.sparkSession
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    pool = graded.withColumn("ideal_rank", ideal_rank)
    k = F.broadcast(spark.createDataFrame([(d,) for d in depths], "depth_k int"))
    rows = pool.crossJoin(k)  # times the few depths
    inside = F.col("rank") <= F.col("depth_k")
    ideal = F.col("ideal_rank") <= F.col("depth_k")
    one = rows.groupBy("depth_k", "query_id").agg(
        F.min(F.when(inside & (F.col("grade") == 2), F.col("rank"))).alias("first_direct"),
        F.count_if(inside & (F.col("grade") >= 1)).alias("useful"),
        F.sum(F.when(inside, stats.gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(ideal, stats.gain(F.col("grade"), F.col("ideal_rank"))).otherwise(0.0)).alias("idcg"),
        F.sum(F.when(inside, F.col("token_count")).otherwise(0)).alias("tokens"),
        F.sum(F.when(inside, F.col("character_count")).otherwise(0)).alias("characters"),
    )
    all_ = one.groupBy("depth_k").agg(
        F.count("*").alias("questions"),
        F.count("first_direct").alias("direct_hits"),
        F.count_if(F.col("useful") > 0).alias("useful_hits"),
        F.avg(F.coalesce(F.lit(1.0) / F.col("first_direct"), F.lit(0.0))).alias("direct_mrr"),
        F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
        F.avg(F.col("useful") / F.col("depth_k")).alias("useful_precision"),
        F.avg("tokens").alias("mean_tokens"),
        F.avg("characters").alias("mean_characters"),
    )
    low, high = stats.wilson(F.col("direct_hits"), F.col("questions"), z)
    return all_.withColumn("direct_rate", F.col("direct_hits") / F.col("questions")).withColumn("direct_low", low).withColumn("direct_high", high).withColumn("useful_rate", F.col("useful_hits") / F.col("questions"))


def diagnostics(graded: DataFrame) -> DataFrame:
    """For each query the rank of the first direct and the first useful result (null: none in the pool)."""
    return graded.groupBy("query_id").agg(F.min(F.when(F.col("grade") == 2, F.col("rank"))).alias("first_direct_rank"), F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first_useful_rank"))


def late_hits(graded: DataFrame, deepest: int) -> DataFrame:
    """Queries whose first direct result lies beyond the deepest depth: the pool was judged deep enough to tell, the depths were not."""
    return diagnostics(graded).filter(F.col("first_direct_rank") > deepest)


def select_depth(metrics: DataFrame, late: DataFrame) -> DataFrame:
    """One row: the depth with most direct hits, then most useful hits, then the least; null where the gate fires."""
    best = metrics.orderBy(F.desc("direct_hits"), F.desc("useful_hits"), "depth_k").limit(1).select("depth_k", "direct_hits", "useful_hits")
    gate = late.agg(F.count("*").alias("late_questions"))
    row = best.crossJoin(F.broadcast(gate))  # one row each
    fires = F.col("late_questions") > 0
    return row.select(fires.alias("gate_fires"), "late_questions", F.when(~fires, F.col("depth_k")).alias("selected_depth"), F.col("direct_hits").alias("best_direct_hits"), F.col("useful_hits").alias("best_useful_hits"))


def carry_over(pool: DataFrame, prior: DataFrame, prior_depth: int, fields: list[str]) -> DataFrame:
    """Grades of a shallower pool on a deeper one.

    status is ``carried`` where the prior row is the same in all ``fields``,
    ``mismatch`` where it differs, ``missing`` where a row within the prior depth
    has no judgement, and ``new`` beyond. Only carried rows have a grade.
    """
    old = prior.select("query_id", "id", "grade", F.lit(True).alias("_known"), *[F.col(f).alias(f"_old_{f}") for f in fields])
    rows = pool.join(old, ["query_id", "id"], "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_old_{f}"))
    known = F.coalesce("_known", F.lit(False))
    status = F.when(known & same, "carried").when(known, "mismatch").when(F.col("rank") <= prior_depth, "missing").otherwise("new")
    return rows.select(*pool.columns, status.alias("status"), F.when(known & same, F.col("grade")).alias("grade"))


def expand_pool(corpus: DataFrame, queries: DataFrame, prior: DataFrame, prior_depth: int, depth: int, **columns) -> DataFrame:
    """query_id, rank, id, score, grade: the pool of a search at a greater depth, with the grades of the judged one.

    ``prior`` has query_id, rank, id, score, grade of the first ``prior_depth``
    results. A row of it that the deeper search does not give at the same rank
    with the same score, or lacks, is an error.
    """
    deep = top_k(corpus, queries, depth, exclude_self=True, **columns).withColumn("score", F.round("score", 9))
    rows = carry_over(deep, prior.withColumn("score", F.round("score", 9)), prior_depth, ["rank", "score"])
    changed = F.raise_error(F.concat(F.lit("the judged pool has changed at query "), F.col("query_id").cast("string"), F.lit(", rank "), F.col("rank").cast("string")))
    return rows.withColumn("grade", F.when(F.col("status").isin("mismatch", "missing"), changed).otherwise(F.col("grade"))).drop("status")


def next_ungraded(judgements: DataFrame) -> DataFrame:
    """Where an annotator goes on: the first ungraded identity, and how far the work is."""
    return judgements.agg(F.count("*").alias("total"), F.count("relevance_grade").alias("graded"), F.min(F.when(F.col("relevance_grade").isNull(), F.col("judgement_id"))).alias("next_judgement_id"))


class Retriever:
    """Production retrieval at a fixed depth over a validated corpus.

    ``embed`` turns texts into vectors (a function of a list of texts) and is
    only needed for queries that are given as text.
    """

    def __init__(self, corpus: DataFrame, depth: int, *, id_col: str = "vec_id", vector_col: str = "embedding", embed=None):
        self.corpus, self.depth, self.id_col, self.vector_col, self.embed = corpus, depth, id_col, vector_col, embed

    def benchmark(self, queries: DataFrame) -> DataFrame:
        return top_k(self.corpus, queries, self.depth, id_col=self.id_col, vector_col=self.vector_col)

    def interactive(self, text: str) -> DataFrame:
        if not text or not text.strip():
            raise ValueError("the query is empty")
        if self.embed is None:
            raise ValueError("no embedding client was given")
        (vector,) = self.embed([text])
        return top_k_one(self.corpus, list(vector), self.depth, id_col=self.id_col, vector_col=self.vector_col)

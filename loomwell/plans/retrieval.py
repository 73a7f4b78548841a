"""Vector search and graded evaluation over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import text as t
from loomwell.operators import integrity, staging
from loomwell.operators import retrieval as r
from loomwell.plans.catalog import query, table

POOL, PRIOR, EVERY = 30, 20, 100  # queries are the vectors whose id is divisible by EVERY; a query's question is its id over EVERY
DEPTHS = [1, 3, 5, 10, 15, 20, 25, 30]
CONFIG = "retrieval-v1"

_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings"
_FOUND = """s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl, list_inner_product(q.e, c.e) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""
_NORM = f"n AS ({_UNIT}),\n{_FOUND}"
_INDEXED = f"n AS ({_UNIT} WHERE vec_id IN (SELECT doc_id FROM documents)),\n{_FOUND}"


def _pool(depth: int) -> str:
    return _NORM + f""",
p AS (SELECT f.query_id, f.rank, f.id, f.score, CASE WHEN ql = cl THEN CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS grade,
coalesce(length(d.text), 0) AS character_count, coalesce(len(regexp_extract_all(d.text, '\\S+')), 0) AS token_count, d.text AS text
FROM f LEFT JOIN documents d ON d.doc_id = f.id WHERE f.rank <= {depth})"""


def _search(rows: DataFrame, depth: int) -> DataFrame:
    return r.top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0), depth, exclude_self=True)


def search(spark, sf_dir, depth: int = POOL) -> DataFrame:
    return _search(table(spark, sf_dir, "embeddings"), depth)


def indexed_search(spark, sf_dir, depth: int = POOL) -> DataFrame:
    """The same over the vectors that have a document."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    return _search(table(spark, sf_dir, "embeddings").join(texts, "vec_id", "left_semi"), depth)


def candidates(spark, sf_dir) -> DataFrame:
    return r.candidates(indexed_search(spark, sf_dir), table(spark, sf_dir, "documents"), CONFIG)


def derived_grade():
    """Same label: relevant, and every third vector a direct answer."""
    return F.when(F.col("ql") == F.col("cl"), F.when(F.col("id") % 3 == 0, 2).otherwise(1)).otherwise(0)


def graded(spark, sf_dir) -> DataFrame:
    """Results of one search at the depth of the pool, with a derived grade."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cl"))
    own = labels.select(F.col("id").alias("query_id"), F.col("cl").alias("ql"))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = search(spark, sf_dir).join(labels, "id").join(own, "query_id").join(texts, "id", "left")
    return rows.select("query_id", "rank", "id", "score", derived_grade().alias("grade"), F.coalesce(t.char_count(F.col("text")), F.lit(0)).alias("character_count"), F.coalesce(t.word_count(F.col("text")), F.lit(0)).alias("token_count"))


@query(f"WITH {_NORM} SELECT query_id, rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS score FROM f WHERE rank <= 30")
def vector_topk(spark, sf_dir):
    return search(spark, sf_dir).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_NORM} SELECT query_id, rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS score FROM f WHERE rank <= 10")
def vector_topk_grid(spark, sf_dir):
    """The same search as one of more queries than can be shipped: blocks of both sides meet in a grid."""
    rows = table(spark, sf_dir, "embeddings")
    found = r.top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0), 10, exclude_self=True, query_bytes=0, block_bytes=1 << 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(f"WITH {_NORM} SELECT rank::INTEGER AS rank, id AS vec_id, round(score, 6) AS score FROM f WHERE query_id = 100 AND rank <= 10")
def topk_single_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    (one,) = rows.filter("vec_id = 100").select("embedding").collect()
    found = r.top_k_one(rows, list(one.embedding), 10, exclude=100)
    return found.groupBy().agg(F.collect_list(F.struct("score", "id")).alias("l")).select(F.posexplode(F.array_sort("l", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(F.when(a["id"] < b["id"], -1).otherwise(1)))).alias("i", "x")).select((F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.round("x.score", 6).alias("score"))


@query(f"""WITH {_INDEXED} SELECT query_id, rank::INTEGER AS rank, id, sha256(concat('{CONFIG}', chr(0), query_id, chr(0), id)) AS judgement_id, sha256(d.text) AS text_sha256,
length(d.text)::BIGINT AS character_count, len(regexp_extract_all(d.text, '\\S+'))::BIGINT AS token_count FROM f JOIN documents d ON d.doc_id = f.id WHERE rank <= 30""")
def ranked_candidates_join(spark, sf_dir):
    return candidates(spark, sf_dir).drop("score")


@query(f"""WITH {_INDEXED}, b AS (SELECT sha256(concat('{CONFIG}', chr(0), query_id, chr(0), id)) AS judgement_id, q.text AS query_text, d.text AS chunk_text
FROM f JOIN documents d ON d.doc_id = f.id JOIN benchmark q ON q.item_id = f.query_id // 100 WHERE rank <= 30)
SELECT '{CONFIG}' AS configuration_id, judgement_id, query_text, chunk_text, NULL::INTEGER AS relevance_grade FROM b""")
def blinded_judgements(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"))
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * EVERY).alias("query_id"), F.col("text").alias("query_text"))
    return r.blinded(rows.join(texts, "id").join(asked, "query_id"), CONFIG)


_METRICS = """,
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal_rank FROM p),
o AS (SELECT k AS depth_k, query_id, min(CASE WHEN rank <= k AND grade = 2 THEN rank END) AS fd, count(*) FILTER (rank <= k AND grade >= 1) AS useful,
sum(CASE WHEN rank <= k THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal_rank <= k THEN (pow(2, grade) - 1) / log2(ideal_rank + 1) ELSE 0 END) AS idcg,
sum(CASE WHEN rank <= k THEN token_count ELSE 0 END) AS tokens, sum(CASE WHEN rank <= k THEN character_count ELSE 0 END) AS chars
FROM r CROSS JOIN (SELECT unnest([1, 3, 5, 10, 15, 20, 25, 30])::INTEGER AS k) GROUP BY ALL),
m AS (SELECT depth_k, count(*) AS questions, count(fd) AS direct_hits, count(*) FILTER (useful > 0) AS useful_hits, avg(coalesce(1.0::DOUBLE / fd, 0)) AS direct_mrr,
avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) AS ndcg, avg(useful::DOUBLE / depth_k) AS useful_precision, avg(tokens) AS mean_tokens, avg(chars) AS mean_characters FROM o GROUP BY depth_k)"""
_WILSON = """greatest(0, ({a}::DOUBLE / {n} + {z} * {z} / (2.0 * {n})) / (1 + {z} * {z} / {n}) - {z}::DOUBLE * sqrt({a}::DOUBLE / {n} * (1 - {a}::DOUBLE / {n}) / {n} + {z}::DOUBLE * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n}))::DOUBLE AS low,
least(1, ({a}::DOUBLE / {n} + {z} * {z} / (2.0 * {n})) / (1 + {z} * {z} / {n}) + {z}::DOUBLE * sqrt({a}::DOUBLE / {n} * (1 - {a}::DOUBLE / {n}) / {n} + {z}::DOUBLE * {z} / (4.0 * {n} * {n})) / (1 + {z} * {z} / {n}))::DOUBLE AS high"""


@query(f"""WITH {_pool(30)}{_METRICS}, w AS (SELECT *, {_WILSON.format(a="direct_hits", n="questions", z="1.96::DOUBLE")} FROM m)
SELECT depth_k, questions, direct_hits, useful_hits, round(direct_hits::DOUBLE / questions, 9) AS direct_rate, round(low, 9) AS direct_low, round(high, 9) AS direct_high, round(useful_hits::DOUBLE / questions, 9) AS useful_rate,
round(direct_mrr, 9) AS direct_mrr, round(ndcg, 9) AS ndcg, round(useful_precision, 9) AS useful_precision, round(mean_tokens, 6) AS mean_tokens, round(mean_characters, 6) AS mean_characters FROM w""")
def retrieval_metrics_at_k(spark, sf_dir):
    m = r.metrics_at(graded(spark, sf_dir), DEPTHS)
    nine = ["direct_rate", "direct_low", "direct_high", "useful_rate", "direct_mrr", "ndcg", "useful_precision"]
    return m.select("depth_k", "questions", "direct_hits", "useful_hits", *[F.round(c, 9).alias(c) for c in nine], F.round("mean_tokens", 6).alias("mean_tokens"), F.round("mean_characters", 6).alias("mean_characters"))


@query(f"WITH {_pool(30)} SELECT query_id, min(CASE WHEN grade = 2 THEN rank END)::INTEGER AS first_direct_rank, min(CASE WHEN grade >= 1 THEN rank END)::INTEGER AS first_useful_rank FROM p GROUP BY query_id")
def retrieval_diagnostics(spark, sf_dir):
    return r.diagnostics(graded(spark, sf_dir))


@query(f"WITH {_pool(30)}, d AS (SELECT query_id, min(CASE WHEN grade = 2 THEN rank END)::INTEGER AS first_direct_rank FROM p GROUP BY query_id) SELECT query_id, first_direct_rank FROM d WHERE first_direct_rank > 20")
def adequacy_gate(spark, sf_dir):
    return r.late_hits(graded(spark, sf_dir), 20).select("query_id", "first_direct_rank")


def _selection(deepest: int) -> str:
    return f"""WITH {_pool(30)}{_METRICS}, l AS (SELECT count(*) AS late_questions FROM (SELECT query_id, min(CASE WHEN grade = 2 THEN rank END) AS fd FROM p GROUP BY query_id) WHERE fd > {deepest}),
b AS (SELECT depth_k, direct_hits, useful_hits FROM m WHERE depth_k <= {deepest} ORDER BY direct_hits DESC, useful_hits DESC, depth_k LIMIT 1)
SELECT late_questions > 0 AS gate_fires, late_questions, CASE WHEN late_questions = 0 THEN depth_k END AS selected_depth, direct_hits AS best_direct_hits, useful_hits AS best_useful_hits FROM b, l"""


def _select(spark, sf_dir, deepest: int) -> DataFrame:
    rows = staging.settle(graded(spark, sf_dir), "pool")
    return r.select_depth(r.metrics_at(rows, [d for d in DEPTHS if d <= deepest]), r.late_hits(rows, deepest))


@query(_selection(10))
def depth_selection(spark, sf_dir):
    return _select(spark, sf_dir, 10)


@query(_selection(30))
def depth_selection_whole_pool(spark, sf_dir):
    return _select(spark, sf_dir, 30)


_FIELDS = ["rank", "score", "character_count", "token_count"]


def pools(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The pool of one search and what a shallower judged pool has of it: a prefix of every query."""
    deep = staging.settle(graded(spark, sf_dir), "pool")
    return deep, deep.filter(F.col("rank") <= PRIOR)


@query(f"""WITH {_pool(30)} SELECT query_id, rank::INTEGER AS rank, id, CASE WHEN rank <= 20 THEN 'carried' ELSE 'new' END AS status, CASE WHEN rank <= 20 THEN grade END::INTEGER AS grade FROM p""")
def judgement_carryover(spark, sf_dir):
    deep, prior = pools(spark, sf_dir)
    return r.carry_over(deep.drop("grade"), prior, PRIOR, _FIELDS).select("query_id", "rank", "id", "status", "grade")


@query(f"""WITH {_pool(30)} SELECT query_id, rank::INTEGER AS rank, id, CASE WHEN rank <= 20 THEN grade END::INTEGER AS grade FROM p""")
def pool_expansion(spark, sf_dir):
    """A judged pool of 20 grown to 30 by a deeper search of the same queries, after its rows were found unchanged."""
    _, prior = pools(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings")
    got = r.expand_pool(rows, rows.filter(F.col("vec_id") % EVERY == 0), prior, PRIOR, POOL)
    return got.select("query_id", "rank", "id", "grade")


@query(f"""WITH {_pool(30)} SELECT query_id, rank::INTEGER AS rank, id, CASE WHEN rank = 4 THEN 'mismatch' ELSE 'missing' END AS status FROM p WHERE rank IN (4, 6)""")
def prefix_mismatch(spark, sf_dir):
    """A prior pool in which the fourth row of every query has changed and the sixth is lost: all have to be found."""
    deep, prior = pools(spark, sf_dir)
    prior = prior.filter("rank <> 6").withColumn("token_count", F.when(F.col("rank") == 4, F.col("token_count") + 1).otherwise(F.col("token_count")))
    return r.carry_over(deep.drop("grade"), prior, PRIOR, _FIELDS).filter("status IN ('mismatch', 'missing')").select("query_id", "rank", "id", "status")


@query(f"""WITH {_INDEXED}, x AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) < score AS rises FROM f WHERE rank <= 30)
SELECT query_id, count(*) AS results, count(DISTINCT id) = 30 AND count(*) = 30 AS exactly_k, min(rank) = 1 AND max(rank) = count(*) AS contiguous, count(*) FILTER (rises) = 0 AS never_rises FROM x GROUP BY query_id""")
def search_contract(spark, sf_dir):
    """Exactly k results, ranks without a gap, scores that never rise."""
    return integrity.search_contract(indexed_search(spark, sf_dir), POOL)


@query(f"""WITH {_INDEXED} SELECT sha256(concat('{CONFIG}', chr(0), query_id, chr(0), id)) AS judgement_id, query_id, rank::INTEGER AS rank, CASE WHEN ql = cl THEN CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END::INTEGER AS grade FROM f WHERE rank <= 30""")
def graded_candidates(spark, sf_dir):
    """Candidates joined with a table of judgements by their identity, one to one."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cl"))
    own = labels.select(F.col("id").alias("query_id"), F.col("cl").alias("ql"))
    found = staging.settle(candidates(spark, sf_dir), "candidates")
    judged = found.select("judgement_id", "query_id", "id").join(labels, "id").join(own, "query_id").select("judgement_id", derived_grade().alias("grade"))
    return integrity.with_grades(found, judged).select("judgement_id", "query_id", "rank", "grade")


@query(f"""WITH {_NORM}, d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS apart FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY apart, id) AS near FROM d)
SELECT query_id, count(*) AS results, count(*) FILTER (near = rank) AS same_place FROM f JOIN g USING (query_id, id) WHERE rank <= 30 GROUP BY query_id""")
def distance_ranking(spark, sf_dir):
    """Vectors of length 1 have the same order by inner product and by Euclidean distance."""
    from loomwell.functions import vectors as v

    rows = table(spark, sf_dir, "embeddings").filter(v.is_usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), v.normalise(F.col("embedding")).alias("e"))
    found = staging.settle(search(spark, sf_dir), "found")
    asked = rows.select(F.col("id").alias("query_id"), F.col("e").alias("q"))
    apart = F.sqrt(F.aggregate(F.zip_with("e", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = found.join(rows, "id").join(asked, "query_id").withColumn("apart", apart)
    near = near.withColumn("near", F.row_number().over(Window.partitionBy("query_id").orderBy("apart", "id")))
    return near.groupBy("query_id").agg(F.count("*").alias("results"), F.count_if(F.col("near") == F.col("rank")).alias("same_place"))


_MAPPED = ["chunk_id", "parent_record_id", "pdf_page_index", "pdf_page_number", "printed_page_number", "source_id"]
_PAGES = "'page:' || {i} % 700 AS parent_record_id, {i} % 700 AS pdf_page_index, {i} % 700 + 1 AS pdf_page_number, ({i} % 700 - 23)::VARCHAR AS printed_page_number"
_MAPPING = f"""c AS (SELECT doc_id AS index_position, 'doc:' || doc_id AS chunk_id, {_PAGES.format(i="doc_id")}, source AS source_id FROM documents),
m AS (SELECT vec_id AS index_position, 'doc:' || vec_id AS chunk_id, {_PAGES.format(i="vec_id")} , 'src' || (vec_id % 20) AS source_id FROM embeddings),
w AS (SELECT * REPLACE (CASE WHEN index_position % 61 = 3 THEN NULL ELSE printed_page_number END AS printed_page_number, CASE WHEN index_position % 53 = 9 THEN pdf_page_number + 1 ELSE pdf_page_number END AS pdf_page_number) FROM m)"""
_FIRST_OFF = "CASE " + " ".join(f"WHEN c.{f} IS DISTINCT FROM w.{f} THEN '{f}'" for f in _MAPPED) + " END"


@query(f"""WITH {_MAPPING}, j AS (SELECT coalesce(c.index_position, w.index_position) AS index_position, CASE WHEN c.chunk_id IS NULL THEN 'no_chunk' WHEN w.chunk_id IS NULL THEN 'no_mapping' WHEN {_FIRST_OFF} IS NOT NULL THEN 'differs' ELSE 'equal' END AS status,
CASE WHEN c.chunk_id IS NOT NULL AND w.chunk_id IS NOT NULL THEN {_FIRST_OFF} END AS field FROM c FULL JOIN w USING (index_position))
SELECT status, field, count(*) AS n, min(index_position) AS first, max(index_position) AS last FROM j GROUP BY ALL""")
def mapping_verification(spark, sf_dir):
    """The index, a vector at each place, against the documents that belong there, in six fields, two of which were changed here and there."""
    def mapped(df, i, source):
        page = F.col(i) % 700
        return df.select(F.col(i).alias("index_position"), F.concat(F.lit("doc:"), i).alias("chunk_id"), F.concat(F.lit("page:"), page.cast("string")).alias("parent_record_id"), page.alias("pdf_page_index"), (page + 1).alias("pdf_page_number"), (page - 23).cast("string").alias("printed_page_number"), source.alias("source_id"))

    chunks = mapped(table(spark, sf_dir, "documents"), "doc_id", F.col("source"))
    mapping = mapped(table(spark, sf_dir, "embeddings"), "vec_id", F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")))
    off = lambda n, r: F.col("index_position") % n == r
    mapping = mapping.withColumn("printed_page_number", F.when(~off(61, 3), F.col("printed_page_number"))).withColumn("pdf_page_number", F.when(off(53, 9), F.col("pdf_page_number") + 1).otherwise(F.col("pdf_page_number")))
    found = integrity.verify_mapping(chunks, mapping, "index_position", _MAPPED)
    return found.groupBy("status", "field").agg(F.count("*").alias("n"), F.min("index_position").alias("first"), F.max("index_position").alias("last"))


@query(f"""WITH {_pool(30)}, j AS (SELECT sha256(concat('{CONFIG}', chr(0), query_id, chr(0), id)) AS judgement_id, CASE WHEN rank <= 20 THEN grade END AS g FROM p)
SELECT count(*) AS total, count(g) AS graded, min(CASE WHEN g IS NULL THEN judgement_id END) AS next_judgement_id FROM j""")
def annotation_progress(spark, sf_dir):
    rows = graded(spark, sf_dir).select(t.pair_id(F.lit(CONFIG), F.col("query_id").cast("string"), F.col("id").cast("string")).alias("judgement_id"), F.when(F.col("rank") <= 20, F.col("grade")).alias("relevance_grade"))
    return r.next_ungraded(rows)


@query("""SELECT count(*) AS vectors, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 1e-6) AS unit, min(len(embedding))::INTEGER AS min_dims, max(len(embedding))::INTEGER AS max_dims,
round(avg(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings""")
def vector_audit(spark, sf_dir):
    from loomwell.functions import vectors as v

    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.count_if(v.is_usable(e) & v.is_unit(e)).alias("unit"), F.min(F.size(e)).alias("min_dims"), F.max(F.size(e)).alias("max_dims"), F.round(F.avg(v.norm(e)), 6).alias("mean_norm"))

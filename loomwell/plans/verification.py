"""Integrity over whole tables: contiguity, strict files, matrices, digest trees, histories and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions import text as t
from loomwell.operators import digests, history, integrity, ordering, requests, staging
from loomwell.plans import corpus, generation, retrieval
from loomwell.plans.catalog import query, table
from loomwell.sources import files, matrix, strict

_MOVED = """l AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_linenumber = 2 AND l_orderkey % 50 = 7 THEN -1 ELSE l_orderkey END AS parent, CASE WHEN l_linenumber = 3 AND l_orderkey % 70 = 9 THEN 9 ELSE l_linenumber END AS idx FROM lineitem)"""


@query(f"""WITH {_MOVED}, o AS (SELECT *, row_number() OVER w - 1 AS place, lag(parent) OVER w AS p, lag(idx) OVER w AS j FROM l WINDOW w AS (ORDER BY k, i)),
g AS (SELECT parent, count(*) AS rows, count(*) FILTER (p IS DISTINCT FROM parent) AS runs, count(*) FILTER (p IS NOT DISTINCT FROM parent AND idx <> j + 1) AS index_breaks, min(place) AS first, max(place) AS last FROM o GROUP BY parent)
SELECT * FROM g WHERE runs > 1 OR index_breaks > 0""")
def parent_contiguity(spark, sf_dir):
    """Parents whose rows don't follow one another, or whose indexes have gaps: some lines were given to another parent or another index."""
    odd = lambda line, n, r: (F.col("l_linenumber") == line) & (F.col("l_orderkey") % n == r)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.when(odd(2, 50, 7), -1).otherwise(F.col("l_orderkey")).alias("parent"), F.when(odd(3, 70, 9), 9).otherwise(F.col("l_linenumber")).alias("idx"))
    return integrity.contiguity(rows, ["k", "i"], "parent", "idx").filter("runs > 1 OR index_breaks > 0")


@query("""SELECT row_number() OVER (ORDER BY item_id) AS position, item_id, sha256(text) AS text_sha256 FROM benchmark""")
def strict_jsonl(spark, sf_dir):
    """Questions written as canonical JSON lines with their numbers and read back strictly: bytes, digests, keys and line numbers."""
    rows = ordering.with_position(table(spark, sf_dir, "benchmark"), [F.col("item_id")], "position").withColumn("position", F.col("position") + 1)
    place = staging.new_place(spark, "questions")
    files.write_jsonl(rows.coalesce(1), place, ["item_id"])
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("text", T.StringType())])
    numbered = strict.lines(spark, place)
    known = {r.file.rsplit("/", 1)[1]: r.sha256 for r in strict.digests(numbered).collect()}  # a row for each file
    got = strict.read_jsonl(spark, place, schema, sha256=known, position="position" if len(known) == 1 else None)
    return got.select("position", "item_id", t.fingerprint(F.col("text")).alias("text_sha256"))


@query("""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id AS id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square FROM embeddings""")
def matrix_round_trip(spark, sf_dir):
    """Vectors as a dense matrix and its mapping, read back after all checks and compared bit by bit."""
    rows = table(spark, sf_dir, "embeddings")
    place = staging.new_place(spark, "matrix")
    about = matrix.write(rows, place, ["vec_id"], id_col="vec_id", vector_col="embedding", block_rows=256)
    again = matrix.read(spark, place, dtype="float32", dims=about["dims"], rows=rows.count())
    matrix.expect_same(rows, again, id_col="vec_id", vector_col="embedding")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    wide = F.transform("vector", lambda x: x.cast("double"))
    return again.select("place", "id", F.size("vector").cast("long").alias("dims"), F.round(add(wide), 6).alias("total"), F.round(add(F.transform(wide, lambda x: x * x)), 6).alias("square"))


_LINES = "l_orderkey, l_linenumber, l_quantity, l_discount"


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1000 = 7 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_discount FROM lineitem WHERE l_orderkey % 997 <> 5),
d AS (SELECT {_LINES}, sum(s) AS d FROM (SELECT {_LINES}, 1 AS s FROM lineitem UNION ALL SELECT {_LINES}, -1 FROM b) GROUP BY ALL)
SELECT {_LINES}, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d)::BIGINT AS n FROM d WHERE d <> 0""")
def digest_tree_difference(spark, sf_dir):
    """A table and a changed copy, compared by descending their digest trees; rows are compared in leaves that differ only."""
    keys, fields = ["l_orderkey"], ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]
    a = table(spark, sf_dir, "lineitem").select(*fields)
    b = a.filter("l_orderkey % 997 <> 5").withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    trees = tuple(staging.settle(digests.tree(x, keys, fields), "tree") for x in (a, b))
    return digests.difference(a, b, trees, keys, fields).select(*fields, "side", F.col("n").cast("long").alias("n"))


_VERSIONS = [20, 30, 40]


def _candidates(spark, sf_dir, depth: int):
    """Candidates of a search with all fields that judgements are held to."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("source_id"))
    asked = table(spark, sf_dir, "benchmark").select((F.col("item_id") * retrieval.EVERY).alias("query_id"), F.col("item_id").alias("question_id"), t.fingerprint(F.col("text")).alias("query_text_sha256"))
    rows = retrieval.indexed_search(spark, sf_dir, depth).join(docs, "id").join(asked, "query_id")
    page = (F.col("id") % 700).cast("int")
    return rows.select(
        F.lit("candidate-1").alias("candidate_schema_version"), t.char_count(F.col("text")).alias("chunk_character_count"), F.concat(F.lit("doc:"), F.col("id")).alias("chunk_id"), t.fingerprint(F.col("text")).alias("chunk_text_sha256"), t.word_count(F.col("text")).alias("chunk_token_count"),
        F.col("id").alias("index_position"), F.concat(F.lit("page:"), page).alias("parent_record_id"), page.alias("pdf_page_index"), (page + 1).alias("pdf_page_number"), (page - 23).cast("string").alias("printed_page_number"), "query_text_sha256", "question_id",
        F.col("question_id").alias("question_position"), "rank", F.round("score", 6).alias("similarity_score"), "source_id")


def pool_versions(spark, sf_dir):
    """A pool of 20, grown to 30 and 40 by deeper searches; what is new has no grade, the rest keeps its own."""
    deep = staging.settle(_candidates(spark, sf_dir, _VERSIONS[-1]), "candidates")
    rows = deep.filter(F.col("rank") <= _VERSIONS[0]).withColumn("version", F.lit(1)).withColumn("relevance_grade", (F.col("index_position") % 3).cast("int"))
    for i, depth in enumerate(_VERSIONS[1:]):
        rows = history.grow(rows, deep.filter(F.col("rank") <= depth), i + 2)
    return staging.settle(rows, "pool-versions")


_FOUND = f"""WITH {retrieval._INDEXED}, p AS (SELECT query_id // 100 AS question_id, rank, id FROM f JOIN benchmark b ON b.item_id = f.query_id // 100 WHERE rank <= 40),
v AS (SELECT *, CASE WHEN rank <= 20 THEN 1 WHEN rank <= 30 THEN 2 ELSE 3 END AS version FROM p)"""


@query(_FOUND + " SELECT question_id, version, count(*) AS n, count(*) FILTER (rank <= 20) AS graded, min(rank)::INTEGER AS first_rank, max(rank)::INTEGER AS last_rank FROM v GROUP BY ALL")
def pool_history(spark, sf_dir):
    """What each version of a judged pool adds to each question."""
    return pool_versions(spark, sf_dir).groupBy("question_id", "version").agg(F.count("*").alias("n"), F.count("relevance_grade").alias("graded"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


@query(_FOUND + " SELECT question_id, min(version) AS version FROM v WHERE (question_id % 2 = 0 AND rank = 25) OR (question_id % 3 = 0 AND rank = 4) GROUP BY question_id")
def pool_changes(spark, sf_dir):
    """The kept chain of digests names the first version that no longer holds, after a page number and a grade were changed."""
    rows = pool_versions(spark, sf_dir)
    chain = staging.settle(history.chained(rows), "chain")
    page = F.when((F.col("question_id") % 2 == 0) & (F.col("rank") == 25), F.lit("0")).otherwise(F.col("printed_page_number"))
    grade = F.when((F.col("question_id") % 3 == 0) & (F.col("rank") == 4), F.lit(9)).otherwise(F.col("relevance_grade"))
    return history.first_changes(rows.withColumn("printed_page_number", page).withColumn("relevance_grade", grade), chain)


@query(generation._MANIFEST + """, placed AS (SELECT row_number() OVER (ORDER BY ord, position, question_id) - 1 AS place, cost_units FROM h), made AS (SELECT (count(*) * 3) // 5 AS done FROM placed)
SELECT done - 2 AS matched, done - 2 AS first_difference, 'other' AS kind, done AS recorded, (SELECT sum(cost_units) FROM placed WHERE place < done - 2)::BIGINT AS cost_units, true AS repaired FROM made""")
def checkpoint_reconciliation(spark, sf_dir):
    """Where the responses of a checkpoint stop matching its requests, and what its metadata should say: responses that hold, and their cost."""
    asked = ordering.with_position(generation.costed(spark, sf_dir).select("ord", "position", "question_id", "blinded_response_id", "max_cost"), [F.col(c) for c in ("ord", "position", "question_id")], "place")
    asked = staging.settle(asked, "requests")
    done = asked.agg(F.floor(F.count("*") * 3 / 5).alias("done"))
    answered = asked.crossJoin(F.broadcast(done)).filter(F.col("place") < F.col("done"))  # one row
    # The last two responses changed places.
    other = F.when(F.col("place") == F.col("done") - 1, F.col("place") - 1).when(F.col("place") == F.col("done") - 2, F.col("place") + 1).otherwise(F.col("place"))
    held = answered.select(other.alias("place"), "blinded_response_id")
    known = integrity.common_prefix(asked.join(held.select("place"), "place", "left_semi"), held, "place", "blinded_response_id")
    spent = ordering.scan(ordering.ranged(asked, ["place"]), [], ["place"], {"spent": ("sum", F.col("max_cost"))}).select((F.col("place") + 1).alias("matched"), "spent")
    units = (F.coalesce("spent", F.lit(0)) * F.lit("100000000").cast("decimal(10,0)")).cast("long")
    return known.join(spent, "matched", "left").crossJoin(F.broadcast(done)).select("matched", "first_difference", "kind", F.col("done").alias("recorded"), units.alias("cost_units"), (F.col("matched") != F.col("done")).alias("repaired"))


_INV = """c AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(text, '[^\x20-\x7E]')) AS c FROM documents)"""


@query(f"""WITH {_INV} SELECT CASE WHEN grouping(source) = 1 THEN 'character' WHEN grouping(lang) = 1 THEN 'source' ELSE 'source_lang' END AS level, source, lang, unicode(c)::INTEGER AS code_point, count(*) AS n, count(DISTINCT doc_id) AS texts FROM c
GROUP BY GROUPING SETS ((c), (source, c), (source, lang, c))""")
def character_inventory(spark, sf_dir):
    """Characters outside printable ASCII by character, by source, and by source and language, in one aggregate with its levels marked."""
    found = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20-\x7E])"), F.lit(1))).alias("c"))
    # A text's repeats are added up before the levels multiply rows.
    per = found.groupBy("doc_id", "source", "lang", F.ascii("c").alias("code_point")).agg(F.count("*").alias("n"))
    c, s, l = (F.col(x) for x in ("code_point", "source", "lang"))
    got = per.groupingSets([[c], [s, c], [s, l, c]], s, l, c).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    # The marks of the columns that a level leaves out: source 4, lang 2.
    level = F.when(F.col("level") == 6, "character").when(F.col("level") == 2, "source").otherwise("source_lang")
    return got.select(level.alias("level"), "source", "lang", "code_point", "n", "texts")


@query("""WITH s AS (SELECT c_nationkey AS condition, c_custkey // 25 AS block, c_acctbal > 4000 AS correct FROM customer), d AS (SELECT condition, block, bool_or(correct) AS correct FROM s GROUP BY ALL), m AS (SELECT block, sum(CASE WHEN correct THEN 1::BIGINT << condition ELSE 0 END)::BIGINT AS pattern FROM d GROUP BY block)
SELECT pattern, count(*) AS blocks, bit_count(pattern)::INTEGER AS conditions FROM m GROUP BY pattern""")
def overlap_masks(spark, sf_dir):
    """Which of 25 conditions are right together: a bit for each, however many there are, instead of a pivot."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("condition"), F.floor(F.col("c_custkey") / 25).alias("block"), (F.col("c_acctbal") > 4000).alias("correct"))
    bit = F.when(F.col("correct"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("condition").cast("int"))).otherwise(F.lit(0).cast("long"))
    masks = rows.groupBy("block").agg(F.bit_or(bit).alias("pattern"))
    return masks.groupBy("pattern").agg(F.count("*").alias("blocks"), F.bit_count("pattern").alias("conditions"))


@query(generation._MANIFEST + """, o AS (SELECT condition, position, CASE WHEN condition = (SELECT max(condition) FROM h) AND position IN (3, 4) THEN 7 - question_id ELSE question_id END AS question_id FROM h WHERE NOT (condition = (SELECT min(condition) FROM h) AND position = 9))
SELECT max(condition) AS condition, 3 AS position, 4 AS question_id, 3 AS expected FROM o UNION ALL SELECT max(condition), 4, 3, 4 FROM o UNION ALL SELECT min(condition), 9, NULL, 9 FROM o""")
def question_order(spark, sf_dir):
    """Where conditions don't ask the shared questions in the shared order: two were exchanged, one was lost."""
    rows = generation.manifest(spark, sf_dir).select("condition", "position", "question_id")
    ends = rows.agg(F.min("condition").alias("low"), F.max("condition").alias("high"))
    rows = rows.crossJoin(F.broadcast(ends))  # one row
    rows = rows.filter(~((F.col("condition") == F.col("low")) & (F.col("position") == 9)))
    swapped = F.when((F.col("condition") == F.col("high")) & F.col("position").isin(3, 4), 7 - F.col("question_id")).otherwise(F.col("question_id"))
    return integrity.other_orders(rows.withColumn("question_id", swapped), "condition", "position", "question_id")


@query(generation._RESPONSES + " SELECT condition, model, effort, count(*) AS responses, count(*) FILTER (status = 'empty') AS empty, count(DISTINCT question_id) FILTER (status = 'empty') AS questions FROM r GROUP BY ALL HAVING count(*) FILTER (status = 'empty') > 0")
def empty_responses(spark, sf_dir):
    """Empty responses by condition, model and effort."""
    empty = F.col("status") == "empty"
    got = generation.responses(spark, sf_dir).groupBy("condition", "model", "effort").agg(F.count("*").alias("responses"), F.count_if(empty).alias("empty"), F.count_distinct(F.when(empty, F.col("question_id"))).alias("questions"))
    return got.filter("empty > 0")


@query(f"""WITH {corpus._LINES}, a AS (SELECT doc_id, line, reason, i FROM c),
x AS (SELECT doc_id, line, 1 AS raw, CASE WHEN reason IS NULL AND i % 97 <> 11 THEN 1 ELSE 0 END AS retained, CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN i % 89 = 7 THEN 1 ELSE 0 END AS removed FROM a),
g AS (SELECT doc_id, line, sum(raw) AS raw, sum(retained) AS retained, sum(removed) AS removed FROM x GROUP BY ALL)
SELECT doc_id, sum(raw)::BIGINT AS raw, sum(retained)::BIGINT AS retained, sum(removed)::BIGINT AS removed, sum(greatest(raw - retained - removed, 0))::BIGINT AS lacking, sum(greatest(retained + removed - raw, 0))::BIGINT AS too_many FROM g GROUP BY doc_id HAVING sum(abs(raw - retained - removed)) > 0""")
def line_accounting(spark, sf_dir):
    """Lines as multisets: each raw line is retained or removed, as often as it comes; some were lost and some were counted twice."""
    lines = corpus.classified(spark, sf_dir).select("doc_id", "line", "reason", "line_index")
    removed = lines.filter("reason IS NOT NULL").unionByName(lines.filter("line_index % 89 = 7"))
    got = integrity.accounting(lines, {"retained": lines.filter("reason IS NULL AND line_index % 97 <> 11"), "removed": removed}, "doc_id", "line")
    return got.filter("lacking > 0 OR too_many > 0")


@query(generation._MANIFEST + """SELECT condition, count(*) AS requests, max(greatest(len(regexp_extract_all(prompt, '[^ \t\n\r\f\v]+')), (length(prompt) + 3) // 4))::BIGINT + 24 AS most_tokens, sum(greatest(len(regexp_extract_all(prompt, '[^ \t\n\r\f\v]+')), (length(prompt) + 3) // 4) + 24)::BIGINT AS tokens FROM h GROUP BY condition""")
def token_estimates(spark, sf_dir):
    """Tokens of requests by the larger of two estimates, words and a quarter of the characters, through the hook for encoders."""
    import re

    word = re.compile(r"[^ \t\n\r\f\v]+")
    largest = requests.estimated(lambda texts: [len(word.findall(x)) for x in texts], lambda texts: [(len(x) + 3) // 4 for x in texts])
    rows = generation.manifest(spark, sf_dir, tokens=largest)
    return rows.groupBy("condition").agg(F.count("*").alias("requests"), F.max("input_tokens").alias("most_tokens"), F.sum("input_tokens").alias("tokens"))

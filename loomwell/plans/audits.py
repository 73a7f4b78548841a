"""Operational audits and integrity queries over ``events``, ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import money
from loomwell.functions import text as t
from loomwell.operators import audit, review, selection, staging
from loomwell.plans.catalog import query, table
from loomwell.streaming import resumable

_TURNS = """c AS (SELECT role, conv_id, turn, text, length(text) AS characters, len(regexp_extract_all(text, '\\S+')) AS words, CASE WHEN regexp_matches(text, '(?i)^(sorry|i cannot|i can''t)') THEN 'refused' WHEN length(text) > 0 THEN 'completed' ELSE 'empty' END AS status FROM conversations)"""


def turns(spark, sf_dir) -> DataFrame:
    """Turns with their sizes and completion; the text goes once it is measured."""
    text = F.col("text")
    refusal = F.when(text.rlike("(?i)^(sorry|i cannot|i can't)"), text)  # these logs have no field of its own for it
    status = review.completion(F.when(refusal.isNull(), text), refusal)
    return table(spark, sf_dir, "conversations").select("role", "conv_id", "turn", F.char_length(text).alias("characters"), t.word_count(text).alias("words"), status.alias("status"))


@query(f"WITH {_TURNS} SELECT status, count(*) AS n, sum(characters)::BIGINT AS characters FROM c GROUP BY status")
def response_status(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("characters").alias("characters"))


@query(f"WITH {_TURNS} SELECT role, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'refused') AS refused, count(*) FILTER (status = 'empty') AS empty FROM c GROUP BY role")
def status_crosstab(spark, sf_dir):
    return audit.crosstab(turns(spark, sf_dir), "role", "status", ["completed", "refused", "empty"])


@query("""WITH e AS (SELECT event_type, value, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS us FROM events)
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(avg(us / 1e6), 4) AS mean_latency, round(median(us / 1e6), 4) AS median_latency, count(*) FILTER (us < 0) AS negative FROM e GROUP BY event_type""")
def operational_summary(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("latency", audit.latency_seconds(F.lag("ts").over(w), F.col("ts")))
    rows = staging.settle(rows.select("event_type", "value", "latency"), "latencies")
    middles = selection.order_statistics(rows, ["event_type"], {"median": ("value", "median"), "median_latency": ("latency", "median")})
    got = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.count_if(F.col("latency") < 0).alias("negative"))
    return got.join(middles, "event_type").withColumns({"median": F.round("median", 6), "median_latency": F.round("median_latency", 4)})


@query(f"WITH {_TURNS} SELECT role, turn, count(*) AS n, count(*) FILTER (words < 12) AS short, count(*) FILTER (status = 'empty') AS empty FROM c GROUP BY ALL HAVING count(*) FILTER (words < 12) > 0")
def empty_summary(spark, sf_dir):
    got = turns(spark, sf_dir).groupBy("role", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("words") < 12).alias("short"), F.count_if(F.col("status") == "empty").alias("empty"))
    return got.filter("short > 0")


@query("SELECT CASE WHEN value > 50 THEN event_type END AS kind, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.when(F.col("value") > 50, F.col("event_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT event_id) AS ids, count(DISTINCT event_id) = count(*) AS ids_unique, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def uniqueness(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("event_id").alias("ids"), (F.count_distinct("event_id") == F.count("*")).alias("ids_unique"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT row_number() OVER w::INTEGER AS place, source, n, round(sum(n) OVER w * 100.0 / (SELECT count(*) FROM documents), 6)::DOUBLE AS percent FROM n WINDOW w AS (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING)""")
def coverage_topn(spark, sf_dir):
    return audit.coverage(table(spark, sf_dir, "documents"), "source").withColumn("percent", F.round("percent", 6))


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, sha256('{{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}}') AS h FROM documents),
b AS (SELECT place // {audit.HASHED_ROWS} AS run, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY place)) AS h FROM r GROUP BY 1) SELECT sum(n)::BIGINT AS n, sha256(string_agg(h, chr(10) ORDER BY run)) AS digest FROM b""")
def projection_hash(spark, sf_dir):
    return audit.projection_hash(table(spark, sf_dir, "documents"), ["doc_id"], ["doc_id", "lang", "n_chars"])


@query("""WITH a AS (SELECT source, lang FROM documents SEMI JOIN labels USING (doc_id)), b AS (SELECT source, lang FROM documents ANTI JOIN labels USING (doc_id)),
d AS (SELECT source, lang, sum(k)::BIGINT AS d FROM (SELECT *, 1 AS k FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY ALL) SELECT source, lang, CASE WHEN d > 0 THEN 'left' ELSE 'right' END AS side, abs(d) AS n FROM d WHERE d <> 0""")
def set_equality_audit(spark, sf_dir):
    """Whether documents with and without a label are alike in source and language, each as often."""
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    return audit.multiset_difference(docs.join(known, "doc_id", "left_semi").select("source", "lang"), docs.join(known, "doc_id", "left_anti").select("source", "lang"))


@query("SELECT conv_id, count(*) AS turns, max(turn) AS last, max(turn) + 1 = count(*) AND min(turn) = 0 AS contiguous FROM conversations GROUP BY conv_id")
def turn_contiguity(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"), ((F.max("turn") + 1 == F.count("*")) & (F.min("turn") == 0)).alias("contiguous"))


@query("SELECT lang, source, doc_id FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL)) WHERE k <= 3")
def distinct_contexts(spark, sf_dir):
    """The first three different sources of each language, the way a context inventory shows a few of each kind."""
    first = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).filter("k <= 3").drop("k")


@query("""WITH c AS (SELECT doc_id, source, text FROM documents) SELECT count(*) AS records, count(DISTINCT doc_id) AS ids, count(*) FILTER (NOT regexp_full_match(source, 'src[0-9]+')) AS bad_source, count(*) FILTER (n_chars <> length(text)) AS bad_length, min(doc_id) AS first, max(doc_id) AS last FROM documents""")
def record_audit(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("records"), F.count_distinct("doc_id").alias("ids"), F.count_if(~t.full_match(F.col("source"), "src[0-9]+")).alias("bad_source"), F.count_if(F.col("n_chars") != t.char_count(F.col("text"))).alias("bad_length"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("""SELECT item_id, sha256(text) AS text_sha256, len(regexp_extract_all(text, '\\S+')) AS words, length(text)::INTEGER AS characters, text <> '' AS has_text FROM benchmark""")
def question_audit(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", t.fingerprint(text).alias("text_sha256"), t.word_count(text).cast("long").alias("words"), t.char_count(text).alias("characters"), (text != "").alias("has_text"))


@query("""WITH q AS (SELECT item_id // 10 AS chapter, regexp_matches(text, '[0-9]') AS has_figures, contains(text, chr(10)) AS has_lines, len(regexp_extract_all(text, '\\S+')) AS words FROM benchmark)
SELECT 'chapter' AS kind, chapter::VARCHAR AS value, count(*) AS n FROM q GROUP BY ALL UNION ALL SELECT 'has_figures', has_figures::VARCHAR, count(*) FROM q GROUP BY ALL UNION ALL SELECT 'has_lines', has_lines::VARCHAR, count(*) FROM q GROUP BY ALL
UNION ALL SELECT 'shorter_than_20_words', (words < 20)::VARCHAR, count(*) FROM q GROUP BY ALL""")
def question_histogram(spark, sf_dir):
    """Questions by chapter (ten ids each), by two yes-no marks, and those that differ from the usual length."""
    text = F.col("text")
    marks = {"chapter": F.floor(F.col("item_id") / 10).cast("string"), "has_figures": text.rlike("[0-9]").cast("string"), "has_lines": F.contains(text, F.lit("\n")).cast("string"), "shorter_than_20_words": (t.word_count(text) < 20).cast("string")}
    long = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in marks.items()])).alias("x"))
    return long.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


@query("""SELECT l_discount, l_tax, l_linestatus AS mode, count(*) AS n FROM lineitem GROUP BY ALL""")
def orientation_counts(spark, sf_dir):
    """Counts by a structured key of two floating-point numbers, compared exactly, and a mode."""
    key = F.struct("l_discount", "l_tax", F.col("l_linestatus").alias("mode"))
    return table(spark, sf_dir, "lineitem").groupBy(key.alias("key")).agg(F.count("*").alias("n")).select("key.l_discount", "key.l_tax", "key.mode", "n")


_PRICES = [("small", "0.02"), ("large", "0.13")]  # fixed values: rates of embedding per million tokens


@query("""WITH w AS (SELECT sum(length(text))::BIGINT AS characters, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS tokens FROM documents) SELECT model, characters, tokens, round(characters::DOUBLE / tokens, 6) AS characters_per_token, tokens * units AS cost_units FROM w, (VALUES ('small', 2), ('large', 13)) p(model, units)""")
def embedding_cost(spark, sf_dir):
    """Characters of a token on average, and what the corpus costs at each price, in hundred-millionths."""
    sums = table(spark, sf_dir, "documents").agg(F.sum(t.char_count(F.col("text"))).alias("characters"), F.sum(t.word_count(F.col("text"))).alias("tokens"))
    prices = spark.createDataFrame(_PRICES, "model string, rate string")
    rows = sums.crossJoin(F.broadcast(prices))  # one row times the price list
    cost = money.cost(F.col("tokens"), F.lit(0), F.col("rate"), F.lit("0"))
    return rows.select("model", "characters", "tokens", F.round(F.col("characters") / F.col("tokens"), 6).alias("characters_per_token"), (cost * F.lit("100000000").cast("decimal(10,0)")).cast("long").alias("cost_units"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, (date_trunc('hour', ts) + INTERVAL 1 HOUR)::TIMESTAMP AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """An extension: the same function serves a stream."""
    return resumable.windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", user_id, count(*) AS n FROM i GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """An extension: sessions that a gap of half an hour ends."""
    return resumable.sessions(table(spark, sf_dir, "events"))

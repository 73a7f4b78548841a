"""Scores by condition and their paired comparison, over ``labels`` and ``documents``.

Sources of documents stand for conditions; four of them are compared in three
families. A condition's labelled documents are numbered by their id, and blocks
are the numbers that all conditions have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions import stats
from loomwell.operators import audit, integrity, ordering, paired, review, staging
from loomwell.plans.catalog import query, table
from loomwell.plans.retrieval import _WILSON

#: family, condition, order
FAMILIES = [("a", "src1", 0), ("a", "src2", 1), ("b", "src1", 0), ("b", "src2", 1), ("b", "src3", 2), ("c", "src1", 0), ("c", "src2", 1), ("c", "src3", 2), ("c", "src4", 3)]
CATEGORIES = ["none", "toxic", "poor", "other"]

_SCORES = """s0 AS (SELECT d.source AS condition, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id)::INTEGER AS block, l.quality AS correct, l.toxic AS unsupported, d.doc_id, d.lang, d.n_chars,
least(2, d.n_chars // 1500)::INTEGER AS depth, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE (d.doc_id % 3)::INTEGER END AS clarity, d.n_chars < 80 AS is_empty,
CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'none' WHEN l.toxic = 1 THEN 'toxic' ELSE 'poor' END AS category FROM documents d JOIN labels l USING (doc_id)),
n0 AS (SELECT min(m) AS m FROM (SELECT condition, max(block) AS m FROM s0 GROUP BY condition)),
s AS (SELECT s0.* FROM s0, n0 WHERE block <= m)"""
_ALL = _SCORES.rsplit(",\n", 2)[0] + ",\ns AS (SELECT * FROM s0)"
_FAM = "fam(family, condition, ord) AS (VALUES " + ", ".join(f"('{f}', '{c}', {o})" for f, c, o in FAMILIES) + ")"
_PAIRS = "prs AS (SELECT l.family, l.ord AS ord_l, l.condition AS \"left\", r.ord AS ord_r, r.condition AS \"right\" FROM fam l JOIN fam r ON l.family = r.family AND l.ord < r.ord)"
_TABLES = """tab AS (SELECT p.*, count(*) AS n, count(*) FILTER (a.correct = 1 AND b.correct = 1) AS "both", count(*) FILTER (a.correct = 1 AND b.correct = 0) AS only_left, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS only_right, count(*) FILTER (a.correct = 0 AND b.correct = 0) AS neither
FROM prs p JOIN s a ON a.condition = p."left" JOIN s b ON b.condition = p."right" AND b.block = a.block GROUP BY ALL)"""
_MCN = """mc AS (SELECT *, CASE WHEN only_left + only_right = 0 THEN 1.0::DOUBLE ELSE least(1, 2 * list_sum(list_transform(range(0, least(only_left, only_right) + 1), lambda k: exp(lgamma(only_left + only_right + 1) - lgamma(k + 1) - lgamma(only_left + only_right - k + 1) - (only_left + only_right) * ln(2))))) END AS p_value FROM tab)"""


def families(spark) -> DataFrame:
    return spark.createDataFrame(FAMILIES, "family string, condition string, ord int")


def all_scores(spark, sf_dir) -> DataFrame:
    """Labelled documents of every source, numbered within it."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    category = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "none").when(F.col("toxic") == 1, "toxic").otherwise("poor")
    rows = rows.select(
        F.col("source").alias("condition"), F.col("quality").alias("correct"), F.col("toxic").alias("unsupported"), "doc_id", "lang", "n_chars",
        F.least(F.lit(2), F.floor(F.col("n_chars") / 1500)).cast("int").alias("depth"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 3).cast("int")).alias("clarity"), (F.col("n_chars") < 80).alias("is_empty"), category.alias("category"))
    return ordering.running(rows, ["condition"], [F.col("doc_id")], {"block": F.lit(1).cast("long")}).withColumn("block", F.col("block").cast("int"))


def scores(spark, sf_dir) -> DataFrame:
    """The blocks that every source has."""
    rows = all_scores(spark, sf_dir)
    least = rows.groupBy("condition").agg(F.max("block").alias("m")).agg(F.min("m").alias("m"))
    return rows.join(F.broadcast(least), F.col("block") <= F.col("m")).drop("m")  # one row


@query(f"""WITH {_ALL}, c AS (SELECT condition, count(*) AS n, count(*) FILTER (correct = 1) AS n_correct, count(*) FILTER (NOT is_empty) AS n_completed, count(*) FILTER (unsupported = 1) AS n_unsupported FROM s GROUP BY condition),
w AS (SELECT *, {_WILSON.format(a="n_correct", n="n", z="1.959963984540054::DOUBLE")} FROM c)
SELECT condition, n, n_correct, n_completed, n_unsupported, round(n_correct::DOUBLE / n, 9) AS accuracy, round(low, 9) AS low, round(high, 9) AS high FROM w""")
def condition_summary(spark, sf_dir):
    got = review.condition_summary(all_scores(spark, sf_dir))
    return got.select("condition", "n", "n_correct", "n_completed", "n_unsupported", *[F.round(c, 9).alias(c) for c in ("accuracy", "low", "high")])


@query(f"""WITH {_ALL}, u AS (SELECT condition, 'depth' AS field, depth AS value FROM s UNION ALL SELECT condition, 'clarity', clarity FROM s)
SELECT field, condition, count(*) AS n, round(avg(value), 9) AS mean, round(median(value), 9)::DOUBLE AS median, count(*) FILTER (value = 0) AS n_0, count(*) FILTER (value = 1) AS n_1, count(*) FILTER (value = 2) AS n_2 FROM u WHERE value IS NOT NULL GROUP BY ALL""")
def secondary_summary(spark, sf_dir):
    got = review.secondary_summary(all_scores(spark, sf_dir), ["depth", "clarity"])
    return got.withColumn("mean", F.round("mean", 9)).withColumn("median", F.round("median", 9))


@query(f"""WITH {_ALL} SELECT k.category, c.condition, count(s.doc_id) AS n FROM (SELECT unnest(['none', 'toxic', 'poor', 'other']) AS category) k CROSS JOIN (SELECT DISTINCT condition FROM s) c LEFT JOIN s ON s.category = k.category AND s.condition = c.condition GROUP BY ALL""")
def error_distribution(spark, sf_dir):
    rows = all_scores(spark, sf_dir)
    domain = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return review.error_counts(rows, domain, rows.select("condition").distinct())


@query(f"""WITH {_ALL}, u AS (SELECT condition, block, correct, 'lang' AS field, lang AS value FROM s UNION ALL SELECT condition, block, correct, 'clarity', clarity::VARCHAR FROM s UNION ALL SELECT condition, block, correct, 'depth', depth::VARCHAR FROM s),
z AS (SELECT field, min(n) < 6 AS pool FROM (SELECT field, value, count(DISTINCT block) AS n FROM u WHERE value IS NOT NULL GROUP BY ALL) GROUP BY field)
SELECT u.field, CASE WHEN value IS NULL THEN 'not_recorded' WHEN pool THEN 'pooled' ELSE value END AS stratum, condition, count(*) AS n, count(*) FILTER (correct = 1) AS n_correct, round(count(*) FILTER (correct = 1)::DOUBLE / count(*), 9) AS accuracy FROM u LEFT JOIN z USING (field) GROUP BY ALL""")
def strata_pooled(spark, sf_dir):
    got = review.pooled_strata(all_scores(spark, sf_dir), ["lang", "clarity", "depth"], least=6)
    return got.withColumn("accuracy", F.round("accuracy", 9))


_SCORED = """v AS (SELECT doc_id, correct, unsupported = 1 AS unsupported, is_empty, is_empty <> (doc_id % 23 = 0) AS confirmed, CASE WHEN doc_id % 17 = 0 THEN 'other' WHEN doc_id % 41 = 0 THEN 'unknown' WHEN correct = 1 THEN 'none' WHEN is_empty THEN 'no_visible_answer' WHEN unsupported = 1 THEN 'grounding' ELSE 'conceptual' END AS category,
CASE WHEN doc_id % 37 = 0 THEN 'sure' WHEN doc_id % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'seen' ELSE ' ' END AS note, doc_id % 4 <> 0 AS applies, CASE WHEN doc_id % 29 = 0 THEN 3 WHEN doc_id % 4 <> 0 THEN depth WHEN doc_id % 31 = 0 THEN 0 END AS depth, (doc_id % 3)::INTEGER AS clarity FROM s)"""


@query(f"""WITH {_ALL}, {_SCORED},
r AS (SELECT doc_id, unnest([CASE WHEN category NOT IN ('none', 'grounding', 'conceptual', 'calculation', 'deficiency', 'no_visible_answer', 'other') THEN 'category_known' END, CASE WHEN confidence NOT IN ('low', 'medium', 'high') THEN 'confidence_known' END,
CASE WHEN CASE WHEN applies THEN depth NOT IN (0, 1, 2) ELSE depth IS NOT NULL END THEN 'depth_in_range' END, CASE WHEN (correct = 1) <> (category = 'none') THEN 'category_agrees' END,
CASE WHEN (correct = 0 OR coalesce(depth, 0) = 1 OR clarity = 1 OR category = 'other' OR confidence = 'low') AND trim(note) = '' THEN 'note_given' END, CASE WHEN confirmed <> is_empty THEN 'empty_is_confirmed' END,
CASE WHEN is_empty AND NOT (correct = 0 AND NOT unsupported AND category = 'no_visible_answer' AND clarity = 0 AND depth IS NOT DISTINCT FROM CASE WHEN applies THEN 0 END) THEN 'empty_policy' END, CASE WHEN NOT is_empty AND category = 'no_visible_answer' THEN 'answer_is_visible' END]) AS rule FROM v)
SELECT doc_id, rule FROM r WHERE rule IS NOT NULL""")
def score_rule_violations(spark, sf_dir):
    """Scores against all their rules; some categories, confidences, notes, confirmations and values were made wrong."""
    odd = lambda n: F.col("doc_id") % n == 0
    empty, applies = F.col("is_empty"), F.col("doc_id") % 4 != 0
    category = F.when(odd(17), "other").when(odd(41), "unknown").when(F.col("correct") == 1, "none").when(empty, "no_visible_answer").when(F.col("unsupported") == 1, "grounding").otherwise("conceptual")
    rows = all_scores(spark, sf_dir).select(
        "doc_id", "correct", (F.col("unsupported") == 1).alias("unsupported"), "is_empty", (empty != odd(23)).alias("confirmed"), category.alias("category"), F.when(odd(37), "sure").when(odd(5), "low").otherwise("high").alias("confidence"),
        F.when(odd(3), "seen").otherwise(" ").alias("note"), applies.alias("applies"), F.when(odd(29), 3).when(applies, F.col("depth")).when(odd(31), 0).alias("depth"), (F.col("doc_id") % 3).cast("int").alias("clarity"))
    return review.violations(rows, "doc_id", review.score_rules({"depth": "applies"}, ["clarity"]))


_KEYS = 'family, ord_l, "left", ord_r, "right"'


def chosen(spark, sf_dir) -> DataFrame:
    """Scores of the conditions that are compared."""
    return scores(spark, sf_dir).join(F.broadcast(families(spark).select("condition").distinct()), "condition", "left_semi")


@query(f"WITH {_SCORES}, {_FAM}, {_PAIRS}, {_TABLES} SELECT {_KEYS}, n, \"both\", only_left, only_right, neither FROM tab")
def paired_table(spark, sf_dir):
    return paired.tables(chosen(spark, sf_dir), paired.pairs(families(spark)))


@query(f"WITH {_SCORES}, {_FAM}, {_PAIRS}, {_TABLES}, {_MCN} SELECT {_KEYS}, only_left, only_right, round(p_value, 9) AS p_value FROM mc")
def mcnemar(spark, sf_dir):
    got = paired.with_mcnemar(paired_table(spark, sf_dir))
    return got.select("family", "ord_l", "left", "ord_r", "right", "only_left", "only_right", F.round("p_value", 9).alias("p_value"))


@query(f"""WITH {_SCORES}, {_FAM}, {_PAIRS}, {_TABLES}, {_MCN}, h AS (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, ord_l, ord_r) + 1) * p_value) AS scaled FROM (SELECT * REPLACE (round(p_value, 12) AS p_value) FROM mc))
SELECT {_KEYS}, round(p_value, 9) AS p_value, round(max(scaled) OVER (PARTITION BY family ORDER BY p_value, ord_l, ord_r ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM h""")
def holm(spark, sf_dir):
    tests = paired.with_mcnemar(paired_table(spark, sf_dir)).withColumn("p_value", F.round("p_value", 12))
    got = paired.with_holm(tests, "family", "p_value", ["ord_l", "ord_r"])
    return got.select("family", "ord_l", "left", "ord_r", "right", F.round("p_value", 9).alias("p_value"), F.round("p_holm", 9).alias("p_holm"))


_Q = """g AS (SELECT f.family, s.block, s.condition, s.correct FROM s JOIN fam f USING (condition)), rs AS (SELECT family, sum(r * r) AS r2, count(*) AS n FROM (SELECT family, block, sum(correct) AS r FROM g GROUP BY ALL) GROUP BY family),
cs AS (SELECT family, sum(c * c) AS c2, sum(c) AS t, count(*) AS k FROM (SELECT family, condition, sum(correct) AS c FROM g GROUP BY ALL) GROUP BY family),
q AS (SELECT family, n, k, k - 1 AS df, CASE WHEN k * t - r2 = 0 THEN 0 ELSE ((k - 1) * (k * c2 - t * t))::DOUBLE / (k * t - r2)::DOUBLE END AS q, k * t - r2 <> 0 AS variation FROM rs JOIN cs USING (family))"""


@query(f"WITH {_SCORES}, {_FAM}, {_Q} SELECT family, n, k, df, round(q, 9) AS q, variation FROM q")
def cochran_q(spark, sf_dir):
    return paired.cochran_q(scores(spark, sf_dir), families(spark)).withColumn("q", F.round("q", 9))


@query(f"WITH {_SCORES}, {_FAM}, {_Q} SELECT family, round(q, 9) AS q, round(exp(-q / 2), 9) AS p_value FROM q WHERE df = 2")
def cochran_p_two(spark, sf_dir):
    got = paired.cochran_q(scores(spark, sf_dir), families(spark)).filter("df = 2")
    return got.select("family", F.round("q", 9).alias("q"), F.round(F.exp(-F.col("q") / 2), 9).alias("p_value"))


#: The error function by Simpson's rule over 4,000 steps, as no SQL engine here has it.
_ERFC = "(1 - 2 / sqrt(pi()) * sqrt(q / 2) / 12000 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-q / 2 * pow(i / 4000.0::DOUBLE, 2)))))"


@query(f"WITH {_SCORES}, {_FAM}, {_Q} SELECT family, df, round(q, 9) AS q, round(CASE WHEN NOT variation THEN 1 WHEN df = 2 THEN exp(-q / 2) WHEN df = 1 THEN {_ERFC} ELSE {_ERFC} + sqrt(2 * q / pi()) * exp(-q / 2) END, 9)::DOUBLE AS p_value FROM q")
def cochran_p(spark, sf_dir):
    """p values for 1 to 3 degrees of freedom."""
    got = paired.cochran_q(scores(spark, sf_dir), families(spark))
    return got.select("family", "df", F.round("q", 9).alias("q"), F.round(F.when(~F.col("variation"), 1.0).otherwise(stats.chi_square_survival(F.col("q"), F.col("df"))), 9).alias("p_value"))


@query(f"""WITH {_SCORES}, {_FAM}, g AS (SELECT f.family, s.block, s.condition, s.depth FROM s JOIN fam f USING (condition)),
r AS (SELECT *, rank() OVER (PARTITION BY family, block ORDER BY depth) + (count(*) OVER (PARTITION BY family, block, depth) - 1) / 2.0::DOUBLE AS rk FROM g),
t AS (SELECT family, sum(t * t) AS t2, count(*) AS k, max(n) AS n FROM (SELECT family, condition, sum(rk) AS t, count(*) AS n FROM r GROUP BY ALL) GROUP BY family),
e AS (SELECT family, sum(c * c * c - c) AS ties FROM (SELECT family, block, depth, count(*) AS c FROM r GROUP BY ALL) GROUP BY family),
x AS (SELECT family, n, k, k - 1 AS df, 12.0::DOUBLE / (n * k * (k + 1)) * t2 - 3.0::DOUBLE * n * (k + 1) AS raw, 1 - ties::DOUBLE / (n * k * (k * k - 1)) AS rest FROM t JOIN e USING (family) WHERE k > 2)
SELECT family, n, k, df, round(CASE WHEN rest > 0 THEN raw / rest ELSE 0 END, 6) AS statistic, rest > 0 AS variation FROM x""")
def friedman(spark, sf_dir):
    return paired.friedman(scores(spark, sf_dir), families(spark), "depth").withColumn("statistic", F.round("statistic", 6))


_WSR = """d AS (SELECT p.*, a.depth - b.depth AS d FROM prs p JOIN s a ON a.condition = p."left" JOIN s b ON b.condition = p."right" AND b.block = a.block),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY family, ord_l, ord_r, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY family, ord_l, ord_r ORDER BY abs(d))),
x AS (SELECT family, ord_l, ord_r, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus FROM r GROUP BY ALL)"""


@query(f"WITH {_SCORES}, {_FAM}, {_PAIRS}, {_WSR} SELECT p.family, p.ord_l, p.\"left\", p.ord_r, p.\"right\", coalesce(n, 0) AS n, coalesce(w_plus, 0)::DOUBLE AS w_plus, coalesce(w_minus, 0)::DOUBLE AS w_minus FROM prs p LEFT JOIN x USING (family, ord_l, ord_r)")
def wilcoxon(spark, sf_dir):
    return paired.wilcoxon(scores(spark, sf_dir), paired.pairs(families(spark)), "depth").drop("p_value")


@query(f"""WITH RECURSIVE {_SCORES}, {_FAM}, {_PAIRS}, {_WSR},
i AS (SELECT family, ord_l, ord_r, (2 * rk)::BIGINT AS t, row_number() OVER (PARTITION BY family, ord_l, ord_r ORDER BY rk, d) AS j FROM r),
ways AS (SELECT family, ord_l, ord_r, 0::BIGINT AS j, 0::BIGINT AS total, 1::DOUBLE AS ways FROM prs UNION ALL
SELECT family, ord_l, ord_r, j, total, sum(ways) AS ways FROM (SELECT w.family, w.ord_l, w.ord_r, i.j, w.total + i.t * c.c AS total, w.ways FROM ways w JOIN i ON i.family = w.family AND i.ord_l = w.ord_l AND i.ord_r = w.ord_r AND i.j = w.j + 1 CROSS JOIN (VALUES (0), (1)) c(c)) GROUP BY ALL),
y AS (SELECT w.*, coalesce(x.n, 0) AS n, 2 * least(coalesce(w_plus, 0), coalesce(w_minus, 0)) AS low FROM ways w LEFT JOIN x USING (family, ord_l, ord_r) WHERE w.j = coalesce(x.n, 0))
SELECT family, ord_l, ord_r, round(CASE WHEN max(n) = 0 THEN 1 ELSE least(1, 2 * sum(ways) FILTER (total <= low) / pow(2, max(n))) END, 9)::DOUBLE AS p_value FROM y GROUP BY ALL""")
def wilcoxon_p(spark, sf_dir):
    got = paired.wilcoxon(scores(spark, sf_dir), paired.pairs(families(spark)), "depth")
    return got.select("family", "ord_l", "ord_r", F.round("p_value", 9).alias("p_value"))


@query(f"""WITH {_SCORES}, p AS (SELECT block, max(correct) FILTER (condition = 'src1') AS src1, max(correct) FILTER (condition = 'src2') AS src2, max(correct) FILTER (condition = 'src3') AS src3 FROM s GROUP BY block) SELECT src1, src2, src3, count(*) AS n FROM p GROUP BY ALL""")
def overlap_patterns(spark, sf_dir):
    wide = scores(spark, sf_dir).groupBy("block").pivot("condition", ["src1", "src2", "src3"]).agg(F.max("correct"))
    return wide.groupBy("src1", "src2", "src3").agg(F.count("*").alias("n"))


@query(f"WITH {_ALL} SELECT 'depth' AS field, round(avg(depth) FILTER (condition = 'src1'), 9) AS src1, round(avg(depth) FILTER (condition = 'src2'), 9) AS src2, round(avg(depth) FILTER (condition = 'src3'), 9) AS src3, round(avg(depth) FILTER (condition = 'src4'), 9) AS src4 FROM s UNION ALL SELECT 'clarity', round(avg(clarity) FILTER (condition = 'src1'), 9), round(avg(clarity) FILTER (condition = 'src2'), 9), round(avg(clarity) FILTER (condition = 'src3'), 9), round(avg(clarity) FILTER (condition = 'src4'), 9) FROM s")
def mean_score_pivot(spark, sf_dir):
    long = all_scores(spark, sf_dir).select("condition", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("depth", "clarity")])).alias("x")).select("condition", "x.*")
    return long.groupBy("field").pivot("condition", ["src1", "src2", "src3", "src4"]).agg(F.round(F.avg("value"), 9))


@query(f"""WITH {_ALL}, c AS (SELECT condition, count(*) AS n, count(*) FILTER (correct = 1) AS n_correct, count(*) FILTER (NOT is_empty) AS n_completed, count(*) FILTER (category <> 'none') AS errors FROM s GROUP BY condition), e AS (SELECT condition, sum(k)::BIGINT AS listed FROM (SELECT condition, category, count(*) AS k FROM s WHERE category <> 'none' GROUP BY ALL) GROUP BY condition)
SELECT condition, n, errors, coalesce(listed, 0) AS listed, errors = coalesce(listed, 0) AS agrees, n_correct <= n_completed AND n_completed <= n AS in_bounds, round(n_correct::DOUBLE / n, 9) AS accuracy, round(n_completed::DOUBLE / n, 9) AS completion_rate FROM c LEFT JOIN e USING (condition)""")
def publication_reconciliation(spark, sf_dir):
    """Published counts and rates against one another: errors that are listed, correct within completed within all."""
    rows = all_scores(spark, sf_dir)
    totals = rows.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("correct") == 1).alias("n_correct"), F.count_if(~F.col("is_empty")).alias("n_completed"), F.count_if(F.col("category") != "none").alias("errors"))
    listed = error_distribution(spark, sf_dir).filter("category <> 'none'").groupBy("condition").agg(F.sum("n").alias("listed"))
    both = totals.join(listed, "condition", "left").withColumn("listed", F.coalesce("listed", F.lit(0).cast("long")))
    rate = lambda c: F.round(F.col(c) / F.col("n"), 9)
    return both.select("condition", "n", "errors", "listed", (F.col("errors") == F.col("listed")).alias("agrees"), ((F.col("n_correct") <= F.col("n_completed")) & (F.col("n_completed") <= F.col("n"))).alias("in_bounds"), rate("n_correct").alias("accuracy"), rate("n_completed").alias("completion_rate"))


@query(f"""WITH {_SCORES} SELECT b.block, c.condition FROM (SELECT DISTINCT block FROM s0) b CROSS JOIN (SELECT DISTINCT condition FROM s0) c WHERE NOT EXISTS (SELECT 1 FROM s0 WHERE s0.block = b.block AND s0.condition = c.condition)""")
def matrix_completeness(spark, sf_dir):
    """Cells of the design without a row: numbers that some sources have and others don't."""
    rows = all_scores(spark, sf_dir)
    return audit.completeness(rows.select("block").distinct(), rows.select("condition").distinct(), rows, ["block", "condition"])


@query(f"""WITH {_SCORES}, o AS (SELECT s.*, row_number() OVER (PARTITION BY block ORDER BY sha256(concat('seed-1', chr(31), block, chr(31), condition)), condition) AS place FROM s WHERE condition IN ('src1', 'src2', 'src3', 'src4'))
SELECT block, substr('ABCDEFG', place, 1) AS label, condition, correct FROM o""")
def label_mapping(spark, sf_dir):
    """A scoring sheet knows groups and labels only; the mapping says which condition a label stands for."""
    order = review.labelled_order(chosen(spark, sf_dir), "block", "condition", "seed-1")
    order = staging.settle(order.select("block", "condition", "label", "correct"), "labels")
    return integrity.by_label(order.select("block", "label", "correct"), order.select("block", "label", "condition"), "block").select("block", "label", "condition", "correct")


@query(f"""WITH {_ALL}, u AS (SELECT condition, 'depth' AS field, depth AS value FROM s UNION ALL SELECT condition, 'clarity', clarity FROM s),
c AS (SELECT field, condition, count(*) AS n, avg(value) AS mean, count(*) FILTER (value = 0) AS n_0, count(*) FILTER (value = 1) AS n_1, count(*) FILTER (value = 2) AS n_2 FROM u WHERE value IS NOT NULL GROUP BY ALL)
SELECT field, condition, n, n_0 + n_1 + n_2 = n AS adds_up, abs(mean - (n_1 + 2 * n_2)::DOUBLE / n) < 1e-9 AS mean_agrees FROM c""")
def score_counts_reconciled(spark, sf_dir):
    """Counts of the scores 0, 1, 2 have to add up to n and give the mean."""
    got = review.secondary_summary(all_scores(spark, sf_dir), ["depth", "clarity"])
    adds = F.col("n_0") + F.col("n_1") + F.col("n_2") == F.col("n")
    return got.select("field", "condition", "n", adds.alias("adds_up"), (F.abs(F.col("mean") - (F.col("n_1") + 2 * F.col("n_2")) / F.col("n")) < 1e-9).alias("mean_agrees"))


@query(f"""WITH {_SCORES}, o AS (SELECT block, condition, row_number() OVER (PARTITION BY block ORDER BY sha256(concat('seed-1', chr(31), block, chr(31), condition)), condition) AS place FROM s WHERE condition IN ('src1', 'src2', 'src3', 'src4')) SELECT block, condition, place::INTEGER AS place, substr('ABCDEFG', place, 1) AS label FROM o""")
def grouped_shuffle(spark, sf_dir):
    return review.labelled_order(chosen(spark, sf_dir).select("block", "condition"), "block", "condition", "seed-1")

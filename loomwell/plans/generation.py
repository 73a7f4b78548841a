"""Requests, costs, reservations and retries over ``benchmark`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.functions import money
from loomwell.functions import text as t
from loomwell.operators import audit, integrity, ordering, requests, review, staging
from loomwell.plans import retrieval as ret
from loomwell.plans.catalog import query, table

CONFIG = "generation-v1"
TEMPLATE = "Use the excerpts to answer.\n\n{context}\n\nQuestion: {question}"
BARE = "Question: {question}"

_VALUES = ", ".join("('{}', {}, '{}', {}, {}, {}, {})".format(c, o, m, k, "NULL" if x is None else x, "NULL" if e is None else f"'{e}'", w) for c, o, m, k, x, e, w in requests.CONDITIONS)
_CONDS = f"k(condition, ord, model, results, temperature, effort, win) AS (VALUES {_VALUES})"
_RATES = "rates(model, rate_in, rate_out) AS (VALUES " + ", ".join(f"('{m}', '{i}', '{o}')" for m, i, o in requests.PRICING) + ")"
_CONTEXT = ret._INDEXED + """,
x0 AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS i, count(*) OVER () AS n, count(*)::INTEGER AS excerpts, max(rank) = count(*) AS in_order, string_agg('[Retrieved excerpt ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
FROM f JOIN documents d ON d.doc_id = f.id WHERE rank <= 30 GROUP BY query_id),
x AS (SELECT item_id AS question_id, excerpts, in_order, context FROM benchmark JOIN x0 ON i = item_id % n)"""
_MANIFEST = f"""WITH {_CONTEXT}, {_CONDS}, {_RATES},
p AS (SELECT k.*, b.item_id AS question_id, b.item_id AS position, CASE WHEN k.results > 0 THEN sha256(x.context) END AS context_sha256, CASE WHEN k.results > 0 THEN 'Use the excerpts to answer.' || chr(10) || chr(10) || x.context || chr(10) || chr(10) || 'Question: ' || b.text ELSE 'Question: ' || b.text END AS prompt
FROM benchmark b CROSS JOIN k JOIN x ON x.question_id = b.item_id),
m AS (SELECT sha256(concat('{CONFIG}', chr(31), condition, chr(31), question_id)) AS blinded_response_id, condition, ord::INTEGER AS ord, question_id, position, model, CASE WHEN effort IS NULL THEN 'max_tokens' ELSE 'max_completion_tokens' END AS limit_field,
temperature::DOUBLE AS temperature, effort, prompt, context_sha256, sha256(prompt) AS prompt_sha256, len(regexp_extract_all(prompt, '\\S+')) + 24 AS input_tokens, 2000::BIGINT AS reserved_tokens, win::BIGINT AS "window", true AS sound FROM p),
h AS (SELECT m.*, rate_in, rate_out, "window" - input_tokens - reserved_tokens AS headroom, (input_tokens * (rate_in::DECIMAL(12,2) * 100)::BIGINT + reserved_tokens * (rate_out::DECIMAL(12,2) * 100)::BIGINT)::BIGINT AS cost_units FROM m JOIN rates USING (model))"""


def contexts(spark, sf_dir) -> DataFrame:
    """All retrieved texts of each question, as many as the conditions give.

    There are fewer query vectors than questions, so question i takes that of query i modulo their number.
    """
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = staging.settle(ret.indexed_search(spark, sf_dir, requests.DEPTH), "found")
    asked = ordering.with_position(found.select("query_id").distinct(), [F.col("query_id")], "place")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id")).crossJoin(F.broadcast(asked.agg(F.count("*").alias("n"))))  # one row
    own = questions.withColumn("place", F.col("question_id") % F.col("n")).join(asked, "place").select("question_id", "query_id")
    whole = requests.assemble(found.join(texts, "id").select("query_id", "rank", "text"), "query_id")
    return own.join(whole, "query_id").drop("query_id")


def manifest(spark, sf_dir, *, keep_prompt: bool = False, tokens=None) -> DataFrame:
    """Requests for every question; one without a context fails where a condition gives results."""
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("item_id").alias("position"), F.col("text").alias("query_text"))
    found = contexts(spark, sf_dir).select("question_id", "context")
    return requests.manifest(questions, requests.conditions(spark), found, CONFIG, template=TEMPLATE, bare=BARE, tokens=tokens, keep_prompt=keep_prompt)


def costed(spark, sf_dir) -> DataFrame:
    return requests.with_cost(manifest(spark, sf_dir), requests.pricing(spark))


def _units(c) -> F:
    """Exact cost in hundred-millionths, as a whole number."""
    return (c * F.lit("100000000").cast("decimal(10,0)")).cast("long")


@query(f"WITH {_CONTEXT} SELECT question_id, excerpts, in_order, sha256(context) AS context_sha256, length(context)::INTEGER AS characters FROM x")
def context_assembly(spark, sf_dir):
    return contexts(spark, sf_dir).select("question_id", "excerpts", "in_order", t.fingerprint(F.col("context")).alias("context_sha256"), t.char_count(F.col("context")).alias("characters"))


@query(_MANIFEST + 'SELECT blinded_response_id, condition, ord, question_id, position, model, limit_field, temperature, effort, prompt_sha256, input_tokens, reserved_tokens, "window", headroom, sound FROM h')
def request_manifest(spark, sf_dir):
    return manifest(spark, sf_dir).drop("context_sha256", "configuration_id", "top_p")


@query(_MANIFEST + "SELECT condition, count(*) AS requests, min(input_tokens) AS least_input, max(input_tokens) AS most_input, min(headroom) AS least_headroom, count(*) FILTER (headroom < 0) AS over_window FROM h GROUP BY condition")
def context_window_check(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("condition").agg(F.count("*").alias("requests"), F.min("input_tokens").alias("least_input"), F.max("input_tokens").alias("most_input"), F.min("headroom").alias("least_headroom"), F.count_if(F.col("headroom") < 0).alias("over_window"))


@query(_MANIFEST + "SELECT condition, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(cost_units)::BIGINT AS cost_units FROM h GROUP BY condition")
def cost_by_condition(spark, sf_dir):
    rows = costed(spark, sf_dir)
    return rows.groupBy("condition").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), _units(F.sum("max_cost")).alias("cost_units"))


@query(_MANIFEST + ", r AS (SELECT condition, question_id, cost_units, sum(cost_units) OVER (PARTITION BY condition ORDER BY position, question_id ROWS UNBOUNDED PRECEDING) AS c FROM h) SELECT condition, question_id, c::BIGINT AS reserved_units, c <= 100000000 AS granted FROM r")
def cost_running_cap(spark, sf_dir):
    rows = requests.reserve(costed(spark, sf_dir), "1.0", key="condition", order=["position", "question_id"])
    return rows.select("condition", "question_id", _units(F.col("reserved_cost")).alias("reserved_units"), "granted")


@query(_MANIFEST + "SELECT condition, min(question_id) AS first_question, count(*) AS n, count(DISTINCT position) AS positions, count(DISTINCT blinded_response_id) AS ids FROM h GROUP BY condition")
def manifest_counts(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("condition").agg(F.min("question_id").alias("first_question"), F.count("*").alias("n"), F.count_distinct("position").alias("positions"), F.count_distinct("blinded_response_id").alias("ids"))


_TEXT = """'"' || replace(replace(replace(prompt, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""


@query(_MANIFEST + f"""SELECT blinded_response_id, sha256(CASE WHEN effort IS NULL THEN '{{"model":"' || model || '","messages":[{{"role":"user","content":' || {_TEXT} || '}}],"temperature":' || temperature || ',"max_tokens":2000}}'
ELSE '{{"model":"' || model || '","messages":[{{"role":"user","content":' || {_TEXT} || '}}],"reasoning_effort":"' || effort || '","max_completion_tokens":2000}}' END) AS payload_sha256 FROM h""")
def request_payload(spark, sf_dir):
    return requests.payload(manifest(spark, sf_dir, keep_prompt=True)).select("blinded_response_id", t.fingerprint(F.col("payload")).alias("payload_sha256"))


@query(_MANIFEST + """SELECT model, rate_in, rate_out, count(*) AS requests, sum(cost_units)::BIGINT AS cost_units, round_even(sum(cost_units) / 100000000.0::DOUBLE, 2) AS cost_even FROM h GROUP BY ALL""")
def priced_requests(spark, sf_dir):
    """Requests joined with the price list by their model; a model without rates fails."""
    total = F.sum("max_cost")
    return costed(spark, sf_dir).groupBy("model", "rate_in", "rate_out").agg(F.count("*").alias("requests"), _units(total).alias("cost_units"), money.report_even(total).alias("cost_even"))


_RESPONSES = _MANIFEST + f""",
a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant'),
r0 AS (SELECT h.*, coalesce(a.text, '') AS response_text, least(2000, len(regexp_extract_all(coalesce(a.text, ''), '\\S+'))) AS output_token_count FROM h LEFT JOIN a ON a.conv_id = h.question_id AND a.k = 1),
r AS (SELECT * REPLACE (CASE WHEN output_token_count % 13 = 0 THEN sha256('') ELSE prompt_sha256 END AS prompt_sha256), CASE WHEN length(response_text) > 0 THEN 'completed' ELSE 'empty' END AS status, input_tokens AS input_token_count,
input_tokens + output_token_count + CASE WHEN output_token_count % 11 = 0 THEN 1 ELSE 0 END AS total_token_count, (question_id % 4)::INTEGER AS retry_count, prompt_sha256 AS asked_sha256 FROM r0)"""


def responses(spark, sf_dir) -> DataFrame:
    """Derived responses: the first answer of the conversation with the question's number.

    So that there is something to find, some give a total of tokens that does
    not add up, another prompt, or a retry too many.
    """
    asked = manifest(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("text"))
    rows = asked.join(turns, "question_id", "left").withColumn("response_text", F.coalesce("text", F.lit("")))
    out = F.least(F.lit(2000), t.word_count(F.col("response_text"))).cast("long")
    rows = rows.withColumn("output_token_count", out).withColumn("input_token_count", F.col("input_tokens"))
    odd = lambda n: F.col("output_token_count") % n == 0
    return rows.select(
        *integrity.REPEATED[:5], F.when(odd(13), t.fingerprint(F.lit(""))).otherwise(F.col("prompt_sha256")).alias("prompt_sha256"), *integrity.REPEATED[6:], "response_text", review.completion(F.col("response_text"), F.lit(None)).alias("status"),
        "input_token_count", "output_token_count", (F.col("input_token_count") + F.col("output_token_count") + F.when(odd(11), 1).otherwise(0)).alias("total_token_count"), (F.col("question_id") % 4).cast("int").alias("retry_count"))


@query(_RESPONSES + """ SELECT blinded_response_id, rule FROM (SELECT blinded_response_id, unnest([CASE WHEN prompt_sha256 <> asked_sha256 THEN 'prompt_sha256_changed' END, CASE WHEN total_token_count <> input_token_count + output_token_count THEN 'tokens_do_not_add_up' END,
CASE WHEN retry_count >= 3 THEN 'retries_impossible' END]) AS rule FROM r) WHERE rule IS NOT NULL""")
def response_integrity(spark, sf_dir):
    """Responses against their requests: ten fields that may not change, tokens that add up, possible retries."""
    return integrity.response_faults(responses(spark, sf_dir), manifest(spark, sf_dir))


@query(_RESPONSES + """ SELECT status, count(*) AS responses, count(*) FILTER (total_token_count = input_token_count + output_token_count) AS reconciled, sum(total_token_count - input_token_count - output_token_count)::BIGINT AS difference FROM r GROUP BY status""")
def token_reconciliation(spark, sf_dir):
    parts = F.col("input_token_count") + F.col("output_token_count")
    return responses(spark, sf_dir).groupBy("status").agg(F.count("*").alias("responses"), F.count_if(F.col("total_token_count") == parts).alias("reconciled"), F.sum(F.col("total_token_count") - parts).alias("difference"))


@query(_RESPONSES + """ SELECT model, count(*) AS responses, sum(input_token_count)::BIGINT AS input_tokens, sum(output_token_count)::BIGINT AS output_tokens, sum(input_token_count * (rate_in::DECIMAL(12,2) * 100)::BIGINT + output_token_count * (rate_out::DECIMAL(12,2) * 100)::BIGINT)::BIGINT AS cost_units FROM r GROUP BY model""")
def known_usage_cost(spark, sf_dir):
    """What the tokens that responses report have cost at the listed rates."""
    rows = requests.known_cost(responses(spark, sf_dir), requests.pricing(spark))
    return rows.groupBy("model").agg(F.count("*").alias("responses"), F.sum("input_token_count").alias("input_tokens"), F.sum("output_token_count").alias("output_tokens"), _units(F.sum("known_cost")).alias("cost_units"))


@query(_RESPONSES + """, j AS (SELECT blinded_response_id, question_id, (output_token_count % 2)::INTEGER AS correct FROM r) SELECT j.blinded_response_id, j.question_id, r.condition, r.model, r.status, j.correct, sha256(b.text) AS reference_sha256 FROM j JOIN r USING (blinded_response_id) JOIN benchmark b ON b.item_id = j.question_id""")
def unblinded_scores(spark, sf_dir):
    """Blinded judgements joined with their responses and the references of their questions, one to one to one."""
    rows = staging.settle(responses(spark, sf_dir), "responses")
    judged = rows.select("blinded_response_id", "question_id", (F.col("output_token_count") % 2).cast("int").alias("correct"))
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), t.fingerprint(F.col("text")).alias("reference_sha256"))
    return integrity.unblind(judged, rows, known).select("blinded_response_id", "question_id", "condition", "model", "status", "correct", "reference_sha256")


_LOG = """e AS (SELECT event_id, user_id, ts, value, (CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 400 WHEN 4 THEN 503 WHEN 5 THEN 408 ELSE 404 END)::INTEGER AS status, (event_id % 4 + 1)::INTEGER AS attempt, CASE WHEN event_id % 3 = 0 THEN (event_id % 20)::INTEGER END AS hint FROM events)"""


def op_log(spark, sf_dir) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 429, 500, 400, 503, 408, 404)]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").withColumn("status", status).withColumn("attempt", (F.col("event_id") % 4 + 1).cast("int")).withColumn("hint", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 20).cast("int")))


@query(f"WITH {_LOG} SELECT status, attempt, status IN (408, 409, 429, 500, 502, 503, 504) AS retryable, round(greatest(least(2.0 * pow(2, attempt - 1), 8.0), coalesce(hint, 0)), 6)::DOUBLE AS delay, count(*) AS n FROM e GROUP BY ALL")
def retry_schedule(spark, sf_dir):
    delay = F.round(money.retry_delay(F.col("attempt"), hint=F.col("hint")), 6)
    return op_log(spark, sf_dir).groupBy("status", "attempt", money.retryable(F.col("status")).alias("retryable"), delay.alias("delay")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT user_id, count(*) AS attempts FROM events GROUP BY user_id), r AS (SELECT c_custkey AS user_id, (c_custkey % 9)::INTEGER AS retry_count FROM customer)
SELECT user_id, retry_count, attempts FROM r FULL JOIN a USING (user_id) WHERE NOT coalesce(attempts BETWEEN 1 AND 12 AND attempts = retry_count + 1, false)""")
def attempt_accounting(spark, sf_dir):
    responses = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 9).cast("int").alias("retry_count"))
    return audit.attempt_faults(table(spark, sf_dir, "events"), responses, "user_id", 12)

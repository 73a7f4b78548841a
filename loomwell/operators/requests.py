"""Context and prompt assembly, request manifests, limits and costs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import money
from loomwell.functions import text as t
from loomwell.operators import integrity, ordering

# Tokens a request has besides its texts, and what stands before an excerpt.
ALLOWANCE = 24
EXCERPT = ("[Retrieved excerpt ", "]\n")

# Conditions of the comparison in their order: model, results given, temperature, effort, window.
CONDITIONS = [
    ("P0", 0, "base", 0, 0.0, None, 8192), ("P1", 1, "base", 30, 0.0, None, 8192), ("P2", 2, "base", 30, 0.5, None, 8192), ("P3", 3, "base", 30, 1.0, None, 8192),
    ("M1", 4, "second", 30, 0.0, None, 1047576), ("M2", 5, "third", 30, None, "high", 400000), ("M3", 6, "fourth", 30, None, "high", 1000000),
]
CONDITION_SCHEMA = "condition string, ord int, model string, results int, temperature double, effort string, window long"
DEPTH = max(c[3] for c in CONDITIONS)
# Rates per million tokens, in and out.
PRICING = [("base", "30", "60"), ("second", "2", "8"), ("third", "1.25", "10"), ("fourth", "10", "50")]


def conditions(spark) -> DataFrame:
    return spark.createDataFrame(CONDITIONS, CONDITION_SCHEMA)


def pricing(spark) -> DataFrame:
    return spark.createDataFrame(PRICING, "model string, rate_in string, rate_out string")


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """The rows with the rates of their ``model``; a model without rates is an error. The price list is small."""
    missing = F.raise_error(F.concat(F.lit("no rates for the model "), F.coalesce("model", F.lit("null"))))
    priced = rows.join(F.broadcast(rates), "model", "left")
    return priced.withColumn("rate_in", F.when(F.col("rate_in").isNull() | F.col("rate_out").isNull(), missing).otherwise(F.col("rate_in")))


def assemble(ranked: DataFrame, key: str, *, rank: str = "rank", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """One context for each key: its texts in the order of rank, each with its number, parted by blank lines.

    A key has to have as many texts as the search depth, any other number is an
    error. ``in_order`` says whether ranks run from 1 without a gap.
    """
    rows = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t")))).alias("xs"))
    wrong = F.raise_error(F.concat(F.lit(f"a context needs {depth} texts and has "), F.size("xs").cast("string")))
    rows = rows.withColumn("xs", F.when(F.size("xs") != depth, wrong).otherwise(F.col("xs")))
    body = F.array_join(F.transform("xs", lambda x: F.concat(F.lit(EXCERPT[0]), x["r"].cast("string"), F.lit(EXCERPT[1]), x["t"])), "\n\n")
    return rows.select(key, F.size("xs").alias("excerpts"), (F.col("xs")[F.size("xs") - 1]["r"] == F.size("xs")).alias("in_order"), body.alias("context"))


def render(template: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """The prompt, and whether it is sound: each placeholder once in the template, none in the values.

    Values are put in at the template's own places, so a value that holds a
    placeholder is never filled in; it is reported instead.
    """
    import re

    names = re.findall(r"\{(\w+)\}", template)
    if sorted(names) != sorted(values):
        raise ValueError("each value needs its placeholder in the template exactly once")
    parts = re.split(r"\{\w+\}", template)
    pieces = [F.lit(parts[0])]
    for n, p in zip(names, parts[1:]):
        pieces += [values[n], F.lit(p)]
    sound = F.lit(True)
    for c in values.values():
        for n in names:
            sound = sound & ~F.contains(c, F.lit("{" + n + "}"))
    return F.concat(*pieces), sound


def manifest(questions: DataFrame, conds: DataFrame, contexts: DataFrame, config_id: str, *, template: str, bare: str, reserved: int = 2000, tokens=None, keep_prompt: bool = False) -> DataFrame:
    """A request for each condition and question, in the order of conditions, then questions.

    ``questions`` has question_id, position, query_text; ``contexts`` has
    question_id, context and is joined where a condition gives results; a question without one is an error then.
    ``tokens`` estimates a prompt's tokens from its column (see ``estimated``);
    by default it counts words.
    """
    rows = questions.crossJoin(F.broadcast(conds)).join(contexts, "question_id", "left")  # the conditions are few
    with_context, ok = render(template, {"context": integrity.present(F.col("context"), "no context for the question", F.col("question_id")), "question": F.col("query_text")})
    without, ok2 = render(bare, {"question": F.col("query_text")})
    gives = F.col("results") > 0
    prompt = F.when(gives, with_context).otherwise(without)
    rows = rows.withColumn("prompt", prompt).withColumn("sound", F.when(gives, ok).otherwise(ok2))
    tokens = ((tokens or t.word_count)(F.col("prompt")) + ALLOWANCE).cast("long")
    return rows.select(
        F.lit(config_id).alias("configuration_id"), F.when(gives, t.fingerprint(F.col("context"))).alias("context_sha256"), F.lit(None).cast("double").alias("top_p"), t.response_id(F.lit(config_id), F.col("condition"), F.col("question_id").cast("string")).alias("blinded_response_id"), "condition", "ord", "question_id", "position", "model",
        F.when(F.col("effort").isNull(), "max_tokens").otherwise("max_completion_tokens").alias("limit_field"), "temperature", "effort", t.fingerprint(F.col("prompt")).alias("prompt_sha256"),
        tokens.alias("input_tokens"), F.lit(reserved).cast("long").alias("reserved_tokens"), "window", (F.col("window") - tokens - reserved).alias("headroom"), "sound", *["prompt"] * keep_prompt,
    )


def estimated(*encoders):
    """An estimate for ``manifest`` from tokenizers: the largest of their counts.

    Each encoder is a function from a list of texts to a list of numbers of
    tokens; they run in Arrow batches.
    """
    def largest(texts: pd.Series) -> pd.Series:
        some = texts.fillna("").tolist()
        return pd.Series([max(x) for x in zip(*(e(some) for e in encoders))], dtype="int64")

    return F.pandas_udf(largest, "long")


def payload(requests: DataFrame) -> DataFrame:
    """The body of each request as JSON: one message of the user, and sampling parameters or reasoning effort, never both; what is null is left out.

    ``requests`` come from ``manifest`` with ``keep_prompt``.
    """
    sampled = F.col("effort").isNull()
    most = lambda field: F.when(F.col("limit_field") == field, F.col("reserved_tokens")).alias(field)
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.to_json(F.struct("model", F.array(message).alias("messages"), F.when(sampled, F.col("temperature")).alias("temperature"), F.col("effort").alias("reasoning_effort"), most("max_tokens"), most("max_completion_tokens")))
    return requests.withColumn("payload", body)


def with_cost(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """The most a request can cost, in exact decimals."""
    return with_rates(requests, rates).withColumn("max_cost", money.cost(F.col("input_tokens"), F.col("reserved_tokens"), F.col("rate_in"), F.col("rate_out")))


def known_cost(responses: DataFrame, rates: DataFrame) -> DataFrame:
    """What responses (model, input_token_count, output_token_count) have cost, in exact decimals."""
    return with_rates(responses, rates).withColumn("known_cost", money.cost(F.col("input_token_count"), F.col("output_token_count"), F.col("rate_in"), F.col("rate_out")))


def reserve(requests: DataFrame, cap: str, *, key: str, order: list[str]) -> DataFrame:
    """Reserve costs in order until the cap: exactly the cap is still granted, and what follows a refusal is refused.

    The sum runs within ``key`` (a run or an account); the order has to be total.
    """
    rows = ordering.running(requests, [key], [F.col(o) for o in order], {"reserved_cost": F.col("max_cost")})
    return rows.withColumn("granted", F.col("reserved_cost") <= F.lit(cap).cast(money.MONEY))

"""Joins that have to come out one to one, and what they find when they don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.operators import ordering, staging
from loomwell.operators.review import violations

# What a response repeats of its request, how it may have ended, and the attempts a request has.
REPEATED = ["configuration_id", "condition", "blinded_response_id", "question_id", "context_sha256", "prompt_sha256", "model", "temperature", "top_p", "effort"]
ENDINGS = ["completed", "refused", "empty"]
ATTEMPTS = 3


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows as they are; a key that comes twice is an error."""
    n = F.count("*").over(Window.partitionBy(*keys))
    twice = F.raise_error(F.concat(F.lit(f"{what} comes twice: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return df.withColumn("_n", n).withColumn(keys[0], F.when(F.col("_n") > 1, twice).otherwise(F.col(keys[0]))).drop("_n")


def present(c: Column, what: str, key: Column) -> Column:
    """A column whose nulls are an error that names the key."""
    return F.when(c.isNull(), F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(key.cast("string"), F.lit("null"))))).otherwise(c)


def verify_mapping(chunks: DataFrame, mapping: DataFrame, position: str, fields: list[str]) -> DataFrame:
    """position, status, field: how each place of an index agrees with the chunk that belongs there.

    status is ``equal``, ``no_chunk``, ``no_mapping`` or ``differs``; ``field`` is
    the first of ``fields`` that differs.
    """
    l = chunks.select(position, F.lit(True).alias("_chunk"), *[F.col(f).alias(f"_c_{f}") for f in fields])
    r = mapping.select(position, F.lit(True).alias("_mapping"), *[F.col(f).alias(f"_m_{f}") for f in fields])
    rows = l.join(r, position, "full")
    first = F.coalesce(*[F.when(~F.col(f"_c_{f}").eqNullSafe(F.col(f"_m_{f}")), F.lit(f)) for f in fields])
    known = F.col("_chunk").isNotNull() & F.col("_mapping").isNotNull()
    status = F.when(F.col("_chunk").isNull(), "no_chunk").when(F.col("_mapping").isNull(), "no_mapping").when(first.isNotNull(), "differs").otherwise("equal")
    return rows.select(position, status.alias("status"), F.when(known, first).alias("field"))


def search_contract(found: DataFrame, k: int) -> DataFrame:
    """For each query: results, whether there are exactly ``k``, whether ranks run from 1 without a gap, and whether scores never rise along them."""
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = found.select("query_id", "rank", "id", (before < F.col("score")).alias("rises"))
    return rows.groupBy("query_id").agg(
        F.count("*").alias("results"), ((F.count("*") == k) & (F.count_distinct("id") == k)).alias("exactly_k"),
        ((F.min("rank") == 1) & (F.max("rank") == F.count("*")) & (F.count_distinct("rank") == F.count("*"))).alias("contiguous"),
        (F.count_if("rises") == 0).alias("never_rises"))


def with_grades(candidates: DataFrame, judgements: DataFrame) -> DataFrame:
    """Candidates with the grade of their ``judgement_id``; one that is missing or comes twice is an error."""
    grades = unique(judgements.select("judgement_id", "grade"), ["judgement_id"], "a judgement")
    rows = candidates.join(grades, "judgement_id", "left")
    return rows.withColumn("grade", present(F.col("grade"), "no grade for the judgement", F.col("judgement_id")))


def response_faults(responses: DataFrame, requests: DataFrame, *, attempts: int = ATTEMPTS) -> DataFrame:
    """blinded_response_id, rule: the rules that a response breaks against its request.

    Responses without a request are ``no_request``, requests without a response
    ``no_response``. Token counts have to add up, retries have to be possible,
    and what a request fixes may not have changed.
    """
    key = "blinded_response_id"
    own = [f for f in REPEATED if f != key]
    asked = requests.select(key, F.lit(True).alias("_asked"), *[F.col(f).alias(f"_q_{f}") for f in own])
    rows = responses.withColumn("_answered", F.lit(True)).join(asked, key, "full")
    known = F.col("_asked").isNotNull() & F.col("_answered").isNotNull()
    tokens = [F.col(c) for c in ("input_token_count", "output_token_count", "total_token_count")]
    rules = {f"{f}_changed": ~known | F.col(f).eqNullSafe(F.col(f"_q_{f}")) for f in own}
    rules |= {
        "no_request": F.col("_asked").isNotNull(),
        "no_response": F.col("_answered").isNotNull(),
        "tokens_negative": ~known | ((tokens[0] >= 0) & (tokens[1] >= 0) & (tokens[2] >= 0)),
        "tokens_do_not_add_up": ~known | (tokens[0] + tokens[1] == tokens[2]),
        "retries_impossible": ~known | ((F.col("retry_count") >= 0) & (F.col("retry_count") < attempts)),
        "ending_unknown": ~known | F.col("status").isin(*ENDINGS),
        "text_missing": ~known | F.col("response_text").isNotNull(),
    }
    return violations(rows, key, rules)


def unblind(judgements: DataFrame, responses: DataFrame, references: DataFrame) -> DataFrame:
    """Judgements with the condition of their response and the reference of their question.

    Judgements may hold no condition; a judgement without its response, of
    another question, or an identity or a pair of question and condition that
    comes twice is an error.
    """
    extra = {"condition", "model", "response_text"} & set(judgements.columns)
    if extra:
        raise ValueError(f"a blinded judgement holds {sorted(extra)}")
    told = unique(responses, ["blinded_response_id"], "a response").select("blinded_response_id", F.col("question_id").alias("_question"), "condition", "model", "status")
    rows = unique(judgements, ["blinded_response_id"], "a judgement").join(told, "blinded_response_id", "left")
    rows = rows.withColumn("condition", present(F.col("condition"), "a judgement of no response", F.col("blinded_response_id")))
    other = F.raise_error(F.concat(F.lit("a judgement of another question: "), F.col("blinded_response_id")))
    rows = rows.withColumn("question_id", F.when(F.col("question_id") == F.col("_question"), F.col("question_id")).otherwise(other)).drop("_question")
    known = unique(references, ["question_id"], "a reference").withColumn("_known", F.lit(True))
    rows = rows.join(known, "question_id", "left").withColumn("_known", present(F.col("_known"), "no reference for the question", F.col("question_id")))
    return unique(rows.filter("_known").drop("_known"), ["question_id", "condition"], "a question and condition")


def by_label(sheet: DataFrame, mapping: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Rows of a scoring sheet with what their label stands for in their group; a label that stands for nothing is an error."""
    known = unique(mapping, [group, label], "a label").withColumn("_known", F.lit(True))
    rows = unique(sheet, [group, label], "a scored label").join(known, [group, label], "left")
    return rows.withColumn("_known", present(F.col("_known"), "a label stands for nothing in group", F.col(group))).filter("_known").drop("_known")


def compare_counts(counts: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, expected, agrees: counts beside those that were expected; what one side lacks counts 0."""
    zero = F.lit(0).cast("long")
    rows = counts.select(*keys, F.col("n").alias("_n")).join(expected.select(*keys, F.col("n").alias("_e")), keys, "full")
    n, e = F.coalesce("_n", zero), F.coalesce("_e", zero)
    return rows.select(*keys, n.alias("n"), e.alias("expected"), (n == e).alias("agrees"))


def other_orders(rows: DataFrame, condition: str, position: str, question: str) -> DataFrame:
    """condition, position, question, expected: where a condition asks another question than most do at a position, or none.

    Of questions that are asked equally often the least counts as the shared one.
    """
    votes = rows.groupBy(position, question).agg(F.count("*").alias("_n"))
    shared = votes.groupBy(position).agg(F.min(F.struct(-F.col("_n"), F.col(question))).alias("x")).select(position, F.col(f"x.{question}").alias("expected"))
    every = shared.crossJoin(staging.if_small(rows.select(condition).distinct()))
    both = every.join(rows.select(condition, position, question), [condition, position], "left")
    return both.filter(~F.col(question).eqNullSafe(F.col("expected"))).select(condition, position, question, "expected")


def accounting(raw: DataFrame, parts: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """For each key: raw values, those in each part, and how many the parts lack or have too many, as multisets.

    All tables have key and value; each raw value has to be in exactly one part, as
    often as it comes. One exchange adds them up.
    """
    one = lambda df, names: df.select(key, value, *[(F.lit(1) if n in names else F.lit(0)).cast("long").alias(n) for n in ("raw", *parts)])
    rows = one(raw, ["raw"])
    for n, df in parts.items():
        rows = rows.unionByName(one(df, [n]))
    sums = rows.groupBy(key, value).agg(*[F.sum(n).alias(n) for n in ("raw", *parts)])
    held = F.lit(0).cast("long")
    for n in parts:
        held = held + F.col(n)
    zero = F.lit(0).cast("long")
    return sums.groupBy(key).agg(*[F.sum(n).alias(n) for n in ("raw", *parts)], F.sum(F.greatest(F.col("raw") - held, zero)).alias("lacking"), F.sum(F.greatest(held - F.col("raw"), zero)).alias("too_many"))


def contiguity(df: DataFrame, order: list[str], parent: str, index: str, position: str | None = None) -> DataFrame:
    """For each parent of rows in a total order: rows, runs, index_breaks, first, last, and misplaced if positions are stored.

    A parent is together if it has one run. Within a run the index has to go up
    by one, and a run that begins a parent has to begin with the parent's least
    index. Each row sees the one before it, across ranges too, which are joined by
    one row each; no task sorts all rows.
    """
    rows = ordering.ranged(df.select(*dict.fromkeys([*order, parent, index, *([position] if position else [])])), order)
    own = F.struct(F.col(parent).alias("p"), F.col(index).alias("i"))
    rows = ordering.scan(rows, [], order, {"_before": ("last", own), "_place": ("sum", F.lit(1).cast("long"))}, before=True)
    starts = F.col("_before").isNull() | ~F.col("_before.p").eqNullSafe(F.col(parent))
    rows = rows.withColumn("_starts", starts).withColumn("_breaks", ~F.col("_starts") & (F.col(index) != F.col("_before.i") + 1))
    misplaced = [F.count_if(~F.col(position).eqNullSafe(F.col("_place"))).alias("misplaced")] if position else []
    got = rows.groupBy(parent).agg(F.count("*").alias("rows"), F.count_if("_starts").alias("runs"), F.count_if("_breaks").alias("index_breaks"), F.min("_place").alias("first"), F.max("_place").alias("last"), *misplaced)
    return got


def common_prefix(expected: DataFrame, found: DataFrame, position: str, key: str) -> DataFrame:
    """One row: matched, the number of places from the first on at which both tables hold the same key, and of what kind the first difference is.

    ``kind`` is ``other``, ``missing`` (nothing is found there), ``extra`` (nothing was
    expected) or null if all agree. Places are compared where they are; only
    the least place that differs is looked for.
    """
    a = expected.select(F.col(position).alias("_p"), F.col(key).alias("_a"), F.lit(True).alias("_in_a"))
    b = found.select(F.col(position).alias("_p"), F.col(key).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, "_p", "full")
    kind = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when(~F.col("_a").eqNullSafe(F.col("_b")), "other")
    odd = both.select("_p", kind.alias("kind"))
    least = odd.agg(F.min(F.when(F.col("kind").isNotNull(), F.struct("_p", "kind"))).alias("x"), F.min("_p").alias("start"), F.max("_p").alias("end"))
    return least.select(F.coalesce(F.col("x._p") - F.col("start"), F.col("end") - F.col("start") + 1, F.lit(0)).cast("long").alias("matched"), F.col("x._p").alias("first_difference"), F.col("x.kind").alias("kind"))

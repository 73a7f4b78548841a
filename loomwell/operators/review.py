"""Scores of blinded responses: consistency rules, summaries, error counts, pooled strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions import stats
from loomwell.operators import staging


def violations(scores: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a score breaks; a rule is an expression that has to hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    return scores.select(key, F.explode(broken).alias("rule"))


# What a score may say.
CATEGORIES = ("none", "grounding", "conceptual", "calculation", "deficiency", "no_visible_answer", "other")
CONFIDENCES = ("low", "medium", "high")


def score_rules(secondary: dict[str, str], always: list[str]) -> dict[str, Column]:
    """The rules of a score.

    It has correct (0, 1), unsupported, confirmed and is_empty (booleans), category,
    confidence and note. ``secondary`` names ordinal values (0, 1, 2) with the
    column that says whether they apply; where they don't they are null.
    ``always`` names those that apply to every score.
    """
    correct, note, empty = F.col("correct"), F.trim(F.coalesce("note", F.lit(""))), F.col("is_empty")
    both = lambda cs: F.forall(F.array(*cs), lambda c: F.coalesce(c, F.lit(False)))
    any_ = lambda cs: F.exists(F.array(*cs), lambda c: F.coalesce(c, F.lit(False)))
    rules = {"correct_in_range": correct.isin(0, 1), "category_known": F.col("category").isin(*CATEGORIES), "confidence_known": F.col("confidence").isin(*CONFIDENCES), "unsupported_given": F.col("unsupported").isNotNull()}
    rules |= {f"{n}_in_range": F.when(F.col(on), F.col(n).isin(0, 1, 2)).otherwise(F.col(n).isNull()) for n, on in secondary.items()}
    rules |= {f"{n}_in_range": F.col(n).isin(0, 1, 2) for n in always}
    partial = [F.col(n) == 1 for n in (*secondary, *always)]
    policy = [correct == 0, ~F.col("unsupported"), F.col("category") == "no_visible_answer", *[F.col(n) == 0 for n in always], *[F.col(n).eqNullSafe(F.when(F.col(on), 0)) for n, on in secondary.items()]]
    return rules | {
        "category_agrees": (correct == 1) == (F.col("category") == "none"),
        "note_given": ~any_([correct == 0, *partial, F.col("category") == "other", F.col("confidence") == "low"]) | (note != ""),
        "empty_is_confirmed": F.col("confirmed").isNotNull() & (F.col("confirmed") == empty),
        "empty_policy": ~empty | both(policy),
        "answer_is_visible": empty | (F.col("category") != "no_visible_answer"),
    }


def completion(content: Column, refusal: Column) -> Column:
    """How a response has ended: with an answer, with a refusal instead of one, or with neither."""
    return F.when(F.char_length(F.coalesce(content, F.lit(""))) > 0, "completed").when(F.char_length(F.coalesce(refusal.cast("string"), F.lit(""))) > 0, "refused").otherwise("empty")


def condition_summary(scores: DataFrame, z: float = stats.Z_EXACT) -> DataFrame:
    """For each condition: n, correct, accuracy with its interval, completed, unsupported. Empty responses count as incorrect."""
    rows = scores.groupBy("condition").agg(F.count("*").alias("n"), F.count_if(F.col("correct") == 1).alias("n_correct"), F.count_if(~F.col("is_empty")).alias("n_completed"), F.count_if(F.col("unsupported") == 1).alias("n_unsupported"))
    low, high = stats.wilson(F.col("n_correct"), F.col("n"), z)
    return rows.withColumn("accuracy", F.col("n_correct") / F.col("n")).withColumn("low", low).withColumn("high", high)


def secondary_summary(scores: DataFrame, fields: list[str]) -> DataFrame:
    """n, mean, median and counts of 0, 1, 2 of each ordinal field and condition, over rows where it applies (not null)."""
    long = scores.select("condition", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("value")) for f in fields])).alias("x")).select("condition", "x.field", "x.value")
    return long.filter("value IS NOT NULL").groupBy("field", "condition").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), *[F.count_if(F.col("value") == i).alias(f"n_{i}") for i in range(3)])


def error_counts(scores: DataFrame, categories: DataFrame, conds: DataFrame) -> DataFrame:
    """Category by condition, zero where nothing was found; there are as many rows as pairs, whatever the scores."""
    domain = categories.select("category").crossJoin(staging.if_small(conds.select("condition")))
    found = scores.groupBy("category", "condition").agg(F.count("*").alias("n"))
    return domain.join(found, ["category", "condition"], "left").select("category", "condition", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def pooled_strata(scores: DataFrame, fields: list[str], least: int = 3) -> DataFrame:
    """Accuracy by stratum and condition; a field with any value of fewer than ``least`` rows pools all recorded values, nulls stay apart."""
    long = scores.select("condition", "block", "correct", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("condition", "block", "correct", "x.field", "x.value")
    sizes = long.filter("value IS NOT NULL").groupBy("field", "value").agg(F.count_distinct("block").alias("n")).groupBy("field").agg((F.min("n") < least).alias("pool"))
    rows = long.join(F.broadcast(sizes), "field", "left")  # a row for each field
    label = F.when(F.col("value").isNull(), "not_recorded").when(F.col("pool"), "pooled").otherwise(F.col("value"))
    return rows.withColumn("stratum", label).groupBy("field", "stratum", "condition").agg(F.count("*").alias("n"), F.count_if(F.col("correct") == 1).alias("n_correct")).withColumn("accuracy", F.col("n_correct") / F.col("n"))


def labelled_order(responses: DataFrame, group: str, key: str, seed: str, labels: str = "ABCDEFG") -> DataFrame:
    """A shuffle within each group that only the seed decides, with a letter for each place."""
    draw = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(group).cast("string"), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(group).orderBy(draw, key))
    return responses.withColumn("place", place).withColumn("label", F.substring(F.lit(labels), F.col("place"), F.lit(1)))

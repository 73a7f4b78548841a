"""Quality rules with risk-controlled thresholds.

The base counts and the base rule are fixed. Beyond them each rule compares one
measure with a cutoff, and labelled good documents that pass the base rule decide
the cutoff: for every stratum, rule and candidate cutoff the rejected ones are
counted, an exact (Clopper-Pearson) upper bound of the rate of false rejection
is taken at confidence 1 - error / (strata * rules), and the strictest cutoff
whose bound is within the rule's share of the allowed rate is used: a rule's
cutoffs are nested and tested in fixed sequence, so they share no error. With
probability 1 - error all chosen cutoffs hold together, and in no stratum more
than ``max_false_rejection`` of the good documents are rejected. Where no cutoff
can be certified the rule stays off in that stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _shared, pieces

FEW_STRATA = 100_000  # rows of cutoffs that are broadcast; beyond, they are joined by shuffling

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_lines"]


def count(text: str) -> tuple[int, ...]:
    """MEASURES and EXTRA of one text."""
    raw = text.encode()
    words = raw.split()  # on exactly space and U+0009 to U+000D
    n = len(words)
    if not n:
        return (0,) * 7
    letters = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat = 0
    threes = list(zip(words, words[1:], words[2:]))
    if len(set(threes)) < len(threes):
        seen: dict = {}
        for t in threes:
            seen[t] = seen.get(t, 0) + 1
        end = 0  # of what is counted so far
        for i, t in enumerate(threes):
            if seen[t] > 1:
                repeat += i + 3 - max(end, i)
                end = i + 3
    return n, letters, symbols, len(lines) - len(set(lines)), repeat, upper, len(lines)


@dataclass(frozen=True)
class Rule:
    """Rejects where ``numerator / denominator`` lies beyond a cutoff: above it, or below it."""

    name: str
    numerator: str
    denominator: str
    above: bool
    cutoffs: tuple[float, ...]  # strictest first

    def rejects(self, cutoff: Column | float) -> Column:
        a, b = F.col(self.numerator).cast("double"), F.col(self.denominator).cast("double") * cutoff
        return (a > b) if self.above else (a < b)


def _steps(start: float, ratio: float, n: int) -> tuple[float, ...]:
    return tuple(round(start * ratio**i, 6) for i in range(n))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", True, _steps(0.01, 1.25, 20)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", True, _steps(0.05, 1.17, 18)),
    Rule("repeated_words", "n_repeat_words", "n_words", True, _steps(0.05, 1.17, 15)),
    Rule("capitals", "n_upper", "word_chars", True, _steps(0.05, 1.2, 16)),
    Rule("long_words", "word_chars", "n_words", True, _steps(6.0, 1.1, 15)),
    Rule("short_words", "word_chars", "n_words", False, tuple(round(4.0 - 0.2 * i, 1) for i in range(16))),
)


def upper_bound(failures: int, trials: int, error: float) -> float:
    """Exact upper confidence bound of a binomial rate: P(X <= failures) = error at the bound."""
    if failures >= trials:
        return 1.0

    def below(p: float) -> float:
        lp, lq, total, term = math.log(p), math.log1p(-p), 0.0, None
        for k in range(failures, -1, -1):  # from the largest term down
            term = math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * lp + (trials - k) * lq
            add = math.exp(term)
            total += add
            if add < 1e-18 * total:
                break
        return total

    lo, hi = failures / trials, 1.0 - 1e-15
    lo = max(lo, 1e-15)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) > error else (lo, mid)
    return hi


@dataclass
class Calibration:
    """Cutoffs by (stratum, rule name); a rule that isn't there is off."""

    cutoffs: dict[tuple[str, str], float] = field(default_factory=dict)
    report: list[tuple] = field(default_factory=list)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum, MEASURES, EXTRA and base_failed of every whole text (null: no words)."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [*MEASURES, *EXTRA]

    def run(batches):
        for b in pieces.text_batches(batches, "text"):
            found = [count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("stratum"), *(pa.array([x[i] for x in found], pa.int64()) for i in range(len(names)))], ["doc_id", "stratum", *names])

    out = _shared.map_batches(rows, run, "doc_id long, stratum string, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bounds(good: DataFrame, *, max_false_rejection: float = 0.02, error: float = 0.05, rules=RULES) -> DataFrame:
    """(stratum, rule, cutoff, failures, n, bound) of every rule that is on, in every stratum of ``good``.

    ``good`` are measured documents that are labelled good and pass the base rule.
    What a rule rejects at a cutoff it also rejects at each stricter one, so its
    cutoffs are tested in fixed sequence, the loosest first until one fails, each
    at the same error: only strata and rules share the error. The bounds rise
    along the sequence, so the last that holds is the strictest that holds.
    """
    tests = [F.count_if(r.rejects(c)).alias(f"{r.name}|{i}") for r in rules for i, c in enumerate(r.cutoffs)]
    counts = _shared.settle(good.groupBy("stratum").agg(F.count("*").alias("n"), *tests), "strata")
    each, most = error / max(1, counts.count() * len(rules)), max_false_rejection / len(rules)

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                for r in rules:
                    for i, c in enumerate(r.cutoffs):
                        failures = row[f"{r.name}|{i}"]
                        if failures <= most * row["n"] and (bound := upper_bound(failures, row["n"], each)) <= most:
                            out.append((row["stratum"], r.name, c, failures, row["n"], bound))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate([pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()])], ["stratum", "rule", "cutoff", "failures", "n", "bound"])

    return _shared.settle(counts.mapInArrow(run, "stratum string, rule string, cutoff double, failures long, n long, bound double"), "bounds")


def calibrate(good: DataFrame, *, max_false_rejection: float = 0.02, error: float = 0.05, rules=RULES) -> Calibration:
    """What ``bounds`` finds, on the driver: a row for each rule that is on."""
    rows = bounds(good, max_false_rejection=max_false_rejection, error=error, rules=rules).orderBy(F.desc("n"), "stratum", "rule").collect()
    return Calibration({(r.stratum, r.rule): r.cutoff for r in rows}, [tuple(r) for r in rows])


def verdict(calibration: Calibration, rules=RULES) -> Column:
    """True where no rule that is on in the row's stratum rejects it."""
    strata = sorted({s for s, _ in calibration.cutoffs})
    out = F.lit(False)
    for s in strata:
        any_ = F.lit(False)
        for r in rules:
            if (s, r.name) in calibration.cutoffs:
                any_ = any_ | r.rejects(F.lit(calibration.cutoffs[s, r.name]))
        out = out | ((F.col("stratum") == s) & any_)
    return ~out


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang",
          label_col: str = "quality", max_false_rejection: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, MEASURES, base_failed, kept, stratum of every document.

    A null text has no words and so fails the base rule; a null stratum is the
    stratum of the empty string; documents without a label take no part in the
    choice of cutoffs; a document labelled twice counts as good if any label
    says so. Repeated rows are judged each, an empty table gives no rows, and
    without labels the base rule alone decides. Texts of any length are counted
    whole; columns other than the three named take no part, whatever they are called.
    """
    found = _shared.settle(measured(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), "measures")
    marked = labels.filter(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    good = found.filter(~F.col("base_failed")).join(marked, "doc_id", "left_semi")
    on = bounds(good, max_false_rejection=max_false_rejection, error=error)
    on = _shared.settle(on.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"at_{r.name}") for r in RULES]), "cutoffs")
    if on.count() <= FEW_STRATA:
        on = F.broadcast(on)
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(r.rejects(F.col(f"at_{r.name}")), F.lit(False))
    return found.join(on, "stratum", "left").select("doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "stratum")

"""Which columns an output is made of, read from the analysed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomwell.operators.audit import IntegrityError


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _names(expressions, known: dict[int, frozenset[str]]) -> frozenset[str]:
    """What the attributes that an expression refers to are made of."""
    out: frozenset[str] = frozenset()
    for e in expressions:
        for a in _each(e.references().toSeq()):
            out |= known.get(a.exprId().id(), frozenset()) | {a.name()}
    return out


def _walk(plan) -> dict[int, frozenset[str]]:
    """The columns behind each attribute that a plan gives out, by its id; an attribute's own name counts."""
    known: dict[int, frozenset[str]] = {}
    below = [c for c in _each(plan.children())]
    for c in below:
        for i, names in _walk(c).items():
            known[i] = known.get(i, frozenset()) | names
    kind = plan.nodeName()
    inputs = frozenset().union(*[known.get(a.exprId().id(), frozenset()) | {a.name()} for c in below for a in _each(c.output())]) if below else frozenset()
    expressions = list(_each(plan.expressions()))
    named = {e.exprId().id(): e for e in expressions if e.getClass().getSimpleName() == "Alias"}
    if kind == "Union":
        outs = [list(_each(c.output())) for c in below]
        for i, a in enumerate(_each(plan.output())):
            known[a.exprId().id()] = frozenset().union(*[known.get(o[i].exprId().id(), frozenset()) | {o[i].name()} for o in outs])
        return known
    for a in _each(plan.output()):
        i = a.exprId().id()
        if i in named:
            known[i] = _names([named[i]], known) | {a.name()}
        elif i not in known:
            # A leaf's own column; or what a function of whole rows or a generator gives, which may hold anything that goes in.
            known[i] = (_names(expressions, known) if kind == "Generate" else inputs) | {a.name()}
    return known


def lineage(df: DataFrame) -> dict[str, frozenset[str]]:
    """For each column of ``df`` the names of all columns it is made of, its own included.

    Values count, not the rows they stand in: what a filter or the condition of a join asks is
    no part of a column. Functions of whole rows may use all they are given. A
    written table is where its columns begin.
    """
    plan = df._jdf.queryExecution().analyzed()
    known = _walk(plan)
    return {a.name(): known[a.exprId().id()] for a in _each(plan.output())}


def expect_independent(df: DataFrame, forbidden: set[str]) -> DataFrame:
    """The frame, if no column of it is made of a forbidden one under whatever name; else an error that names both."""
    found = {c: sorted(names & forbidden) for c, names in lineage(df).items() if names & forbidden}
    if found:
        raise IntegrityError("; ".join(f"{c} is made of {', '.join(x)}" for c, x in sorted(found.items())))
    return df


def expect_aggregate(df: DataFrame, groups: set[str]) -> DataFrame:
    """The frame, if its rows come from an aggregation by no other columns than ``groups``; else an error."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Sort", "SubqueryAlias", "Filter", "GlobalLimit", "LocalLimit"):
        plan = plan.child()
    by = sorted({a.name() for e in _each(plan.groupingExpressions()) for a in _each(e.references().toSeq())} - groups) if plan.nodeName() == "Aggregate" else None
    if by is None or by:
        raise IntegrityError("the rows are no aggregates" if by is None else f"grouped by {', '.join(by)}")
    return df

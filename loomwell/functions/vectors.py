"""Expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v: Column) -> Column:
    """The vector with length 1; null for a zero vector."""
    return F.transform(as_double(v), lambda x: x / F.nullif(norm(v), F.lit(0.0)))


def is_usable(v: Column, dims: int | None = None) -> Column:
    """Not null, of the given size, finite throughout, and not zero."""
    ok = v.isNotNull() & F.forall(as_double(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(as_double(v), lambda x: x != 0)
    return F.coalesce(ok & (F.size(v) == dims) if dims else ok, F.lit(False))


def is_unit(v: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def box_union(lines: Column) -> Column:
    """Smallest box (struct x0, y0, x1, y1) around an array of boxes."""
    low = lambda f: F.array_min(F.transform(lines, lambda b: b[f]))
    high = lambda f: F.array_max(F.transform(lines, lambda b: b[f]))
    return F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))


def boundary_excess(box: Column, width: Column, y0: Column, y1: Column) -> Column:
    """How far a box reaches out of [0, width] x [y0, y1]; 0 inside."""
    return F.greatest(F.lit(0.0), -box["x0"], y0 - box["y0"], box["x1"] - width, box["y1"] - y1)

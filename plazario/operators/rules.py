"""Ordered-rule operators: pattern hits and decision ladders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(text: Column, patterns: list[str]) -> Column:
    """The first match of every pattern that matches, stripped, in the order of the patterns."""
    found = F.array(*[F.trim(F.regexp_substr(text, F.lit(p))) for p in patterns])
    return F.array_compact(found)


def any_hit(text: Column, patterns: list[str]) -> Column:
    """One alternation instead of one scan a pattern."""
    return F.coalesce(text.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def ladder(arms: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first arm whose condition holds."""
    out = None
    for condition, value in arms:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def verdict(label: str, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"))


def argmax(pairs: list[tuple[Column, Column]]) -> Column:
    """The value with the largest weight, the first on ties: pairs are (weight, value)."""
    ranked = F.array(*[F.struct(w.cast("double").alias("w"), F.lit(-i).alias("o"), v.alias("v")) for i, (w, v) in enumerate(pairs)])
    return F.array_max(ranked)["v"]

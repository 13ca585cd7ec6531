"""Comparison rules and status ladders as expressions.

A ladder is one ordered chain of conditions over flags that don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLACK = 1e-9


def compare(a: Column, op: Column, b: Column) -> Column:
    """Three-valued comparison by an operator column; null for an unknown operator or value."""
    return (
        F.when(op == ">", a > b).when(op == ">=", a >= b).when(op == "<", a < b).when(op == "<=", a <= b)
        .when(op == "==", a == b).when(op == "!=", a != b)
    )


def violates(kind: Column, expected: Column, actual: Column, tolerance: Column, low: Column, high: Column) -> Column:
    """Whether the actual value breaks the rule; null where the two can't be compared."""
    delta = F.abs(actual - expected)
    return (
        F.when(kind == "equal", ~actual.eqNullSafe(expected) & actual.isNotNull() & expected.isNotNull())
        .when(kind == "delta_pct", F.when(expected != 0, delta / F.abs(expected) * 100 > tolerance + SLACK))
        .when(kind == "decrease", actual < expected - SLACK)
        .when(kind == "increase", actual > expected + SLACK)
        .when(kind == "min", actual < low - SLACK)
        .when(kind == "max", actual > high + SLACK)
    )


def allowed(absolute: Column, percent: Column, reference: Column) -> Column:
    """The larger of an absolute and a relative tolerance."""
    return F.greatest(F.coalesce(absolute, F.lit(0.0)), F.abs(reference) * F.coalesce(percent, F.lit(0.0)) / 100)


def breaks(direction: str, base: Column, value: Column, tolerance: Column) -> Column:
    """A deviation beyond the tolerance in the direction that matters; one on the border is none."""
    delta = value - base
    return {
        "any": F.abs(delta) > tolerance + SLACK,
        "decrease": -delta > tolerance + SLACK,
        "increase": delta > tolerance + SLACK,
    }[direction]


def scale_mismatch(a: Column, b: Column, factors: list[float]) -> Column:
    """Two values whose ratio is near a unit factor: written in different units rather than changed."""
    ratio = F.greatest(a, b) / F.least(a, b)
    near = [(ratio >= f * 0.5) & (ratio <= f * 1.5) for f in factors]
    out = F.lit(False)
    for x in near:
        out = out | x
    return F.when((a > 0) & (b > 0), out).otherwise(False)


def ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    """The status of the first condition that holds."""
    chain = None
    for condition, status in steps:
        chain = F.when(condition, status) if chain is None else chain.when(condition, status)
    return chain.otherwise(otherwise)


#: Statuses from the worst to the mildest, to choose among objects of one parameter.
WORST_FIRST = ("CANDIDATE", "CLARIFICATION_REQUIRED", "NOT_COMPARABLE", "NEGATIVE_VERIFIED", "MISSING_EVIDENCE", "NOT_APPLICABLE")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, WORST_FIRST)), status)


def ordinal(value: Column, scale: list[str]) -> Column:
    """Place on an ordinal scale from 0; null off it."""
    place = F.array_position(F.array(*map(F.lit, scale)), value)
    return F.when(place > 0, place - 1)


def numeric_suffix(value: Column) -> Column:
    """The number that a class name ends in."""
    return F.nullif(F.regexp_extract(value, r"(\d+(?:[.,]\d+)?)\s*$", 1), F.lit("")).cast("double")


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    k = 10.0**digits
    return F.floor(value * k + 0.5) / k

"""Scores, grades and severity ladders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terraloom import fixed_values as fv


def grade(score: Column, has_input: Column | None = None) -> Column:
    out = F.lit(fv.GRADE_BANDS[-1][1])
    for floor, name in reversed(fv.GRADE_BANDS[:-1]):
        out = F.when(score >= floor, name).otherwise(out)
    return out if has_input is None else F.when(has_input, out).otherwise("pending")


def penalty(severity: Column, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, cost in table.items():
        out = F.when(severity == name, cost).otherwise(out)
    return out


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in fv.SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def clamp_score(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def missing_severity(ratio: Column) -> Column:
    return F.when(ratio > 0.5, fv.CRITICAL).when(ratio > 0.1, fv.WARNING)


def outlier_severity(ratio: Column) -> Column:
    return F.when(ratio > 0.1, fv.CRITICAL).when(ratio > 0.03, fv.WARNING).otherwise(fv.INFO)


def duplicate_severity(count: Column) -> Column:
    return F.when(count > 5, fv.WARNING).when(count > 0, fv.INFO)


def deviation_severity(deviation: Column, threshold: Column, critical_factor: float | None) -> Column:
    out = F.when(deviation > threshold, fv.WARNING).otherwise(fv.INFO)
    if critical_factor is None:
        return out
    return F.when(deviation > threshold * critical_factor, fv.CRITICAL).otherwise(out)


def label(column: Column, labels: dict[str, str]) -> Column:
    """Replace an English code by its original-language label."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)

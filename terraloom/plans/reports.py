"""A finished report: issue table, category states, score, and whatever frames belong to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from terraloom.operators import issues as I


@dataclass
class Report:
    issues: DataFrame
    categories: DataFrame
    summary: DataFrame
    frames: dict[str, DataFrame] = field(default_factory=dict)


def finish(
    found: Sequence[DataFrame], categories: Sequence[str], penalties: Mapping[str, int], prefix: str, has_input: bool = True,
    info_is_pass: bool = False, **frames: DataFrame,
) -> Report:
    all_issues = I.union_issues(found)
    return Report(
        issues=I.number_issues(all_issues, prefix), categories=I.category_status(all_issues, categories, info_is_pass),
        summary=I.score(all_issues, penalties, has_input), frames=frames,
    )

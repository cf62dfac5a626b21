"""Units: guessing one from a column name and converting to SI."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraloom import fixed_values as fv
from terraloom.functions.values import q

_UNIT_AT_END = re.compile(rf"(?:_|\(|\[)({'|'.join(fv.SUFFIX_UNITS)})[)\]]?$")


def infer_unit(name: str) -> str | None:
    """Explicit suffix first, then angle words, then anything that looks like a length in metres."""
    lowered = name.lower().strip()
    suffix = _UNIT_AT_END.search(lowered)
    if suffix:
        return suffix.group(1)
    if any(word in lowered for word in fv.ANGLE_WORDS):
        return "deg"
    if any(word in lowered for word in (*fv.METRE_WORDS, *fv.DEPTH_WORDS)):
        return "m"
    return None


@dataclass(frozen=True)
class UnitRule:
    field: str
    target: str
    factor: float
    source_unit: str
    target_unit: str


def header_unit_rules(names: Iterable[str], explicit: Mapping[str, float] | None = None) -> dict[str, UnitRule]:
    """Which columns to convert and what to call them afterwards.

    ``thickness_mm`` becomes ``thickness_m``; a bare angle name gets ``_rad``; units with factor
    1 are left alone; explicit factors win and keep the name.
    """
    names = list(names)
    rules: dict[str, UnitRule] = {}
    for name in names:
        suffix = _UNIT_AT_END.search(name.strip().lower())
        if suffix is None:
            if any(word in name.lower() for word in fv.ANGLE_WORDS):
                unit, factor = fv.UNITS["deg"]
                rules[name] = UnitRule(name, f"{name}_{unit}", factor, "deg", unit)
            continue
        source = suffix.group(1)
        unit, factor = fv.UNITS[source]
        if factor != 1.0:
            base = re.sub(rf"(?:_|\(|\[){re.escape(source)}[)\]]?$", "", name.strip(), flags=re.IGNORECASE).rstrip("_ ")
            rules[name] = UnitRule(name, f"{base}_{unit.replace('/', '_')}", factor, source, unit)
    for name, factor in (explicit or {}).items():
        if name in names:
            rules[name] = UnitRule(name, name, float(factor), "explicit", "configured")
    return rules


def unit_table(spark: SparkSession) -> DataFrame:
    rows = [(name, target, float(factor)) for name, (target, factor) in fv.UNITS.items()]
    return spark.createDataFrame(rows, "unit string, si_unit string, factor double")


def to_si(df: DataFrame, value: str, unit: str) -> DataFrame:
    """Long-format conversion: the unit stands in a column. Unknown units keep their value."""
    table = F.broadcast(unit_table(df.sparkSession))  # 34 rows, fixed
    key = F.lower(F.trim(q(unit)))
    return (
        df.join(table.withColumnRenamed("unit", "_unit"), key == F.col("_unit"), "left")
        .withColumn("si_value", q(value) * F.coalesce("factor", F.lit(1.0)))
        .withColumn("si_unit", F.coalesce("si_unit", q(unit)))
        .drop("_unit", "factor")
    )

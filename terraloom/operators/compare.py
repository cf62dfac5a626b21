"""Before/after comparison of models: pairing, deviations, attribute retention, report roll-up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import scoring, values as V
from terraloom.functions.ordering import group_index


@dataclass(frozen=True)
class Thresholds:
    position: float = 0.01
    extent: float = 0.05
    scale: float = 0.10
    attributes: float = 0.10
    boundary: float = 0.05


def pair_models(before: DataFrame, after: DataFrame) -> DataFrame:
    """One-to-one pairs (before_id, after_id, pair_name, rule): same file name first, then same stem.

    Both inputs hold (file_id BIGINT, name). Equal keys pair off in file_id order; what is left
    stays as one-sided pairs.
    """
    def numbered(df: DataFrame, key: Column, side: str) -> DataFrame:
        keyed = df.select(F.col("file_id"), F.col("name"), key.alias("key"))
        ranked = group_index(keyed, ["key"], "file_id", "nth")
        return ranked.select("key", "nth", F.col("file_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))

    by_name = lambda: F.lower(F.col("name"))
    first = numbered(before, by_name(), "before").join(numbered(after, by_name(), "after"), ["key", "nth"]).select(
        "before_id", "before_name", "after_id", "after_name", F.lit("name").alias("rule")
    )
    rest_b = before.join(first.select(F.col("before_id").alias("file_id")), "file_id", "left_anti")
    rest_a = after.join(first.select(F.col("after_id").alias("file_id")), "file_id", "left_anti")
    stem = lambda: V.pair_key(F.col("name"))
    second = numbered(rest_b, stem(), "before").join(numbered(rest_a, stem(), "after"), ["key", "nth"], "full_outer").select(
        "before_id", "before_name", "after_id", "after_name",
        F.when(F.col("before_id").isNotNull() & F.col("after_id").isNotNull(), "stem").otherwise("unmatched").alias("rule"),
    )
    return first.unionByName(second).withColumn("pair_name", F.coalesce("before_name", "after_name"))


def _item(dimension: str, metric: Column | str, before: Column, after: Column, deviation: Column, threshold: float,
          critical_factor: float | None, present: Column | None = None) -> Column:
    d = deviation
    item = F.struct(
        F.lit(dimension).alias("dimension"), (metric if isinstance(metric, Column) else F.lit(metric)).alias("metric"),
        before.cast("double").alias("value_before"), after.cast("double").alias("value_after"),
        F.bround(d, 6).alias("deviation"), F.lit(float(threshold)).alias("threshold"), (d <= threshold).alias("passed"),
        scoring.deviation_severity(d, F.lit(float(threshold)), critical_factor).alias("severity"),
    )
    return item if present is None else F.when(present, item)


def compare_bounds(pairs: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Long deviation table from paired boxes.

    ``pairs`` has b_ and a_ columns of ``model_bounds`` (vertices, min_x .. max_z, span_x .., centre_x ..,
    diagonal). Twelve checks a pair: diagonal, vertex count, three spans, the centre and six box sides.
    """
    b, a = (lambda n: F.col(f"b_{n}")), (lambda n: F.col(f"a_{n}"))
    floor = F.lit(1e-9)
    one = lambda c: F.when(c == 0, 1.0).otherwise(c)
    scale_b, scale_a = one(b("diagonal")), one(a("diagonal"))
    base = F.greatest(b("diagonal"), floor)
    items = [
        _item("scale", "diagonal", scale_b, scale_a, F.abs(scale_b - scale_a) / F.greatest(scale_b, floor), t.scale, None),
        _item("scale", "vertices", b("vertices"), a("vertices"),
              F.abs(b("vertices") - a("vertices")) / F.greatest(b("vertices"), F.lit(1)), t.scale, None,
              (b("vertices") > 0) & (a("vertices") > 0)),
    ]
    for axis in "xyz":
        sb, sa = b(f"span_{axis}"), a(f"span_{axis}")
        items.append(_item("extent", f"span_{axis}", sb, sa, F.abs(sb - sa) / F.greatest(F.abs(sb), floor), t.extent, 3))
    shift = F.sqrt(sum(((b(f"centre_{x}") - a(f"centre_{x}")) ** 2 for x in "yz"), (b("centre_x") - a("centre_x")) ** 2))
    items.append(_item("position", "centre_shift", F.lit(0.0), shift, shift / base, t.position, 5))
    for axis in "xyz":
        for side in ("min", "max"):
            vb, va = b(f"{side}_{axis}"), a(f"{side}_{axis}")
            items.append(_item("boundary", f"{side}_{axis}", vb, va, F.abs(vb - va) / base, t.boundary, None))
    return pairs.select("pair_name", F.inline(F.array_compact(F.array(*items))))


def compare_attributes(pairs: DataFrame, before: DataFrame, after: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Attribute retention per pair; each pair that loses fields gets a second, failing row.

    ``before`` and ``after`` hold (file_id, attribute), distinct. Pairs without any attribute are skipped.
    """
    left = pairs.join(before.withColumnRenamed("file_id", "before_id"), "before_id").select("pair_name", "attribute", F.lit(1).alias("b"))
    right = pairs.join(after.withColumnRenamed("file_id", "after_id"), "after_id").select("pair_name", "attribute", F.lit(1).alias("a"))
    both = left.join(right, ["pair_name", "attribute"], "full_outer")
    facts = both.groupBy("pair_name").agg(
        F.count("b").alias("nb"), F.count("a").alias("na"), F.count_if(F.col("b").isNotNull() & F.col("a").isNotNull()).alias("kept"),
    )
    lost = F.col("nb") - F.col("kept")
    retention = F.when(F.col("nb") > 0, F.col("kept") / F.col("nb")).otherwise(1.0)
    severity = F.when(retention < 0.5, fv.CRITICAL).when(lost > 0, fv.WARNING).otherwise(fv.INFO)
    main = F.struct(
        F.lit("attributes").alias("dimension"), F.lit("retention").alias("metric"), F.col("nb").cast("double").alias("value_before"),
        F.col("na").cast("double").alias("value_after"), F.bround(1 - retention, 6).alias("deviation"),
        F.lit(t.attributes).alias("threshold"), (retention >= 1 - t.attributes).alias("passed"), severity.alias("severity"),
    )
    extra = F.when(lost > 0, F.struct(
        F.lit("attributes").alias("dimension"), F.lit("lost_fields").alias("metric"), lost.cast("double").alias("value_before"),
        F.lit(0.0).alias("value_after"), F.lit(1.0).alias("deviation"), F.lit(0.0).alias("threshold"), F.lit(False).alias("passed"),
        F.lit(fv.CRITICAL).alias("severity"),
    ))
    return facts.select("pair_name", F.inline(F.array_compact(F.array(main, extra))))


def attribute_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_id, attribute, change) with change kept / lost / added."""
    b, a = before.withColumn("b", F.lit(1)), after.withColumn("a", F.lit(1))
    both = b.join(a, ["file_id", "attribute"], "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "lost").otherwise("kept")
    return both.select("file_id", "attribute", change.alias("change"))


def compare_unpaired(pairs: DataFrame) -> DataFrame:
    """One failing row per missing partner or per pair whose parse failed (``b_ok`` / ``a_ok`` false)."""
    missing_after = F.col("after_id").isNull()
    missing_before = F.col("before_id").isNull()
    broken = ~missing_after & ~missing_before & (~F.coalesce("b_ok", F.lit(True)) | ~F.coalesce("a_ok", F.lit(True)))
    metric = F.when(missing_after, "after_missing").when(missing_before, "before_missing").when(broken, "parse_failed")
    return pairs.filter(metric.isNotNull()).select(
        "pair_name", F.lit("position").alias("dimension"), metric.alias("metric"), F.lit(None).cast("double").alias("value_before"),
        F.lit(None).cast("double").alias("value_after"), F.when(broken, None).otherwise(1.0).alias("deviation"),
        F.lit(0.0).alias("threshold"), F.lit(False).alias("passed"),
        F.when(missing_before, fv.INFO).otherwise(fv.CRITICAL).alias("severity"),
    )


def dimension_rollup(items: DataFrame) -> DataFrame:
    """Total, passed, failed and pass rate of all five dimensions; a dimension without checks has zeros."""
    found = items.groupBy("dimension").agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"))
    known = items.sparkSession.createDataFrame([(d,) for d in fv.COMPARISON_DIMENSIONS], "dimension string")
    out = known.join(found, "dimension", "left").na.fill(0, ["total", "passed"])
    return out.withColumn("failed", F.col("total") - F.col("passed")).withColumn(
        "pass_rate", F.round(F.coalesce(F.try_divide(F.col("passed"), F.col("total")), F.lit(0.0)), 4)
    )


def comparison_score(items: DataFrame) -> DataFrame:
    facts = items.agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"))
    share = F.coalesce(F.try_divide(F.col("passed_checks") * 100, F.col("total_checks")), F.lit(0.0))
    scored = facts.withColumn("score", F.bround(share.cast("double"), 0).cast("int"))
    return scored.withColumn("grade", scoring.grade(F.col("score")))


def slice_positions(pairs: DataFrame, axis: str, ratio: float) -> DataFrame:
    """Cut position of each pair between the joint minimum and maximum along an axis."""
    low = F.least(F.col(f"b_min_{axis}"), F.col(f"a_min_{axis}"))
    high = F.greatest(F.col(f"b_max_{axis}"), F.col(f"a_max_{axis}"))
    ratio = max(0.0, min(1.0, ratio))
    return pairs.select("pair_name", "before_id", "after_id", (low + (high - low) * ratio).alias("position"))


def slice_deviation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Area deviation per pair of slice profiles keyed by pair_name; null when both areas are zero."""
    b = before.select("pair_name", F.col("area").alias("before_area"), F.col("perimeter").alias("before_perimeter"))
    a = after.select("pair_name", F.col("area").alias("after_area"), F.col("perimeter").alias("after_perimeter"))
    both = b.join(a, "pair_name", "full_outer").na.fill(0.0)
    gap = F.abs(F.col("before_area") - F.col("after_area")) / F.greatest(F.col("before_area"), F.lit(1e-9))
    return both.withColumn("area_deviation", F.when((F.col("before_area") != 0) | (F.col("after_area") != 0), gap))

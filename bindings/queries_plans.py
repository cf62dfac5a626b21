"""Registered queries over whole reports; their SQL is in ``oracle_plans``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as B
from bindings.queries import QUERIES, query, rounded
from bindings.tables import table
from terraloom.operators import compare
from terraloom.plans import batching, comparison, preprocessing, quality

__all__ = ["QUERIES"]

def _number():
    return F.regexp_extract("message", r"(\d+)", 1).try_cast("bigint").alias("n")


def _mesh(spark, sf):
    return B.mesh_vertices(spark, sf, F.col("p_type") != "PROMO"), B.mesh_corners(spark, sf)[0]


def _quality(spark, sf):
    vertices, corners = _mesh(spark, sf)
    rules = quality.QualityRules.of(coordinate_max_abs=1000.0)
    models = vertices.select("model_id").distinct().unionByName(spark.createDataFrame([("gone",)], "model_id string"))
    return quality.quality_report(spark, quality.mesh_quality_issues(vertices, corners, rules, models), [quality.mesh_coordinates(vertices)], rules)


@query
def mesh_quality_report(spark, sf):
    """Every mesh check on faces that refer to missing parts, and a model without a file."""
    return _quality(spark, sf).issues.select("code", "category", "severity", "file", _number(), "issue_id")


@query
def mesh_quality_states(spark, sf):
    return _quality(spark, sf).categories.select("category", "issue_count", "status")


@query
def mesh_light_report(spark, sf):
    found = preprocessing.mesh_light_issues("lineitem", *_mesh(spark, sf))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("code", "category", "severity", "file", _number())


def _comparison(spark, sf):
    points = B.nation_points(spark, sf)
    sides = []
    for after in (False, True):
        vertices = points.filter(F.col("is_after") == after).drop("is_after")
        models = vertices.select("model_id").distinct()
        files = models.select(F.concat(F.lit("a-" if after else "b-"), "model_id").alias("file_id"), F.concat("model_id", F.lit(".obj")).alias("name"), "model_id")
        # one file of either side has no partner
        lone = spark.createDataFrame([("x", "after_only.obj" if after else "before_only.obj", "none")], "file_id string, name string, model_id string")
        sides += [files.unionByName(lone), vertices]
    return comparison.comparison_report(*sides, thresholds=compare.Thresholds(position=0.0005, extent=0.0005, scale=0.01, boundary=0.0005))


@query
def comparison_report(spark, sf):
    """Deviation items of all pairs of files, from file lists and points."""
    items = _comparison(spark, sf).frames["items"]
    return rounded(items.filter("metric not like 'unpaired%' and value_before is not null and value_after is not null"), value_before=6, value_after=6, deviation=6)


@query
def clean_and_recheck(spark, sf):
    """Lines with holes and repeats, cleaned and checked again: issues by code before and after."""
    line = table(spark, sf, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = line.select(
        key.alias("_row_id"), F.when(key % 10 != 0, F.col("l_quantity")).alias("quantity"), F.when(key % 4 != 0, F.col("l_returnflag")).alias("flag"), F.col("l_extendedprice").alias("price"))
    before, cleaned, after = preprocessing.clean_and_recheck({"lines": rows.unionByName(rows.filter("_row_id % 50 = 0").withColumn("_row_id", F.col("_row_id") + 10_000_000_000))}, duplicate_keys=["quantity", "flag", "price"], sigma=1e9)
    kept = cleaned["lines"].agg(F.count(F.lit(1)).alias("rows"), F.count("quantity").alias("quantities"), F.count("flag").alias("flags"), F.round(F.sum("price"), 2).alias("price"))
    return kept

"""Comparison report of two sets of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terraloom.functions import vectors as G
from terraloom.operators import compare as C, mesh, nearest
from terraloom.plans.reports import Report
from terraloom.session import cut_lineage


def snapshots(files: DataFrame, vertices: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One row per file: box columns of its model and whether anything was read.

    files(file_id, name, model_id); attributes(model_id, attribute).
    """
    box = mesh.model_bounds(vertices)
    out = files.join(box, "model_id", "left")
    seen = F.coalesce(F.col("vertices"), F.lit(0)) > 0
    if attributes is not None:
        named = attributes.select("model_id").distinct().withColumn("_attr", F.lit(True))
        out = out.join(named, "model_id", "left")
        seen = seen | F.coalesce("_attr", F.lit(False))
    out = out.withColumn("ok", seen).drop("_attr")
    return out.na.fill(0, [c for c in box.columns if c != "model_id"])


def comparison_report(
    before_files: DataFrame, before_vertices: DataFrame, after_files: DataFrame, after_vertices: DataFrame,
    before_attributes: DataFrame | None = None, after_attributes: DataFrame | None = None, thresholds: C.Thresholds = C.Thresholds(),
) -> Report:
    """Deviation items of all pairs, dimension roll-up and score."""
    b, a = snapshots(before_files, before_vertices, before_attributes), snapshots(after_files, after_vertices, after_attributes)
    pairs = cut_lineage(C.pair_models(before_files, after_files))
    side = lambda df, p: df.select(F.col("file_id").alias(f"{'before' if p == 'b' else 'after'}_id"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in ("file_id", "name")])
    full = cut_lineage(pairs.join(side(b, "b"), "before_id", "left").join(side(a, "a"), "after_id", "left"))
    whole = full.filter("before_id is not null and after_id is not null and b_ok and a_ok")
    items = C.compare_bounds(whole, thresholds).unionByName(C.compare_unpaired(full))
    if before_attributes is not None and after_attributes is not None:
        by_file = lambda files, attrs: files.select("file_id", "model_id").join(attrs, "model_id").select("file_id", "attribute").distinct()
        items = items.unionByName(C.compare_attributes(whole, by_file(before_files, before_attributes), by_file(after_files, after_attributes), thresholds))
    return Report(issues=items.filter("not passed"), categories=C.dimension_rollup(items), summary=C.comparison_score(items), frames={"items": items, "pairs": full})


def pair_slices(pairs: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], plane: str = "XY", ratio: float = 0.5) -> DataFrame:
    """Slice area of both sides of every pair at the same position. Sides are (corners, vertices)."""
    cuts = C.slice_positions(pairs, G.PLANE_AXIS[plane], ratio)
    named = lambda side: pairs.select(F.col(f"{side}_model_id").alias("model_id"), "pair_name").join(cuts.select("pair_name", "position"), "pair_name")

    def profile(meshes, key):
        at = named(key)
        points = mesh.slice_points(meshes[0], meshes[1], plane, at.select("model_id", "position"))
        return mesh.slice_profile(points).join(at.select("model_id", "pair_name"), "model_id").select("pair_name", "points", "area", "perimeter")

    return C.slice_deviation(profile(before, "b"), profile(after, "a"))


def difference_map(before: DataFrame, after: DataFrame, plane: str = "XY", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points with distance and share of the diagonal, summary) per model_id present on both sides.

    ``limit`` keeps the evenly spaced sample of dense vids (targets ``limit``, at least 10; references at least
    1000); without it every point is compared.
    """
    if limit is not None:
        limit = max(10, int(limit))
        references = nearest.strided_sample(before, ["model_id"], "vid", max(limit, 1000))
        targets = nearest.strided_sample(after, ["model_id"], "vid", limit)
    else:
        references, targets = before, after
    diagonal = mesh.model_bounds(before).select("model_id", "diagonal")
    distances = cut_lineage(nearest.nearest_distances(targets, references, ["model_id"]))
    u, v = G.project(F.col("x"), F.col("y"), F.col("z"), plane)
    points = targets.join(distances, ["model_id", "x", "y", "z"]).join(diagonal, "model_id").select(
        "model_id", "vid", u.alias("u"), v.alias("v"), "distance", (F.col("distance") / F.greatest(F.col("diagonal"), F.lit(1e-9))).alias("normalized")
    )
    return points, nearest.distance_summary(targets, distances, ["model_id"], diagonal)

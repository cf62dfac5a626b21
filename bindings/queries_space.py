"""Registered queries over sparse grids and clipped meshes; their SQL is in ``oracle_space``."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import tables as B
from bindings.queries import QUERIES, query, rounded
from bindings.tables import table
from terraloom.operators import clipping, grids

__all__ = ["QUERIES"]

BOX = ((8.0, 42.0), (14.0, 47.0), (950.0, 1500.0))


def _points(spark, sf):
    """Lines as points: quantity, price and discount are the axes."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_tax", F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("maker"),
    )


@query
def attribute_idw(spark, sf):
    """Tax and quantity of the lines around every part, for each return flag."""
    flags = F.explode(F.array(*[F.lit(f) for f in "ANR"])).alias("model")
    targets = table(spark, sf, "part").select(
        "p_partkey", flags, F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"), (F.col("p_partkey") % 11).cast("double").alias("z"))
    samples = _points(spark, sf).withColumn("even_tax", F.when(F.col("id") % 2 == 0, F.col("l_tax")))
    found = grids.map_attributes(targets, samples, ["model"], ["l_tax", "even_tax"], 2.0)
    return rounded(found.drop("x", "y", "z"), nearest=6, l_tax=6, even_tax=6)


@query
def point_thinning(spark, sf):
    return grids.thin(_points(spark, sf), ["model"], 4.0, "id").select("model", "id")


@query
def point_thinning_first(spark, sf):
    return grids.thin(_points(spark, sf), ["model"], 9.0, "id", keep="first").select("model", "id")


@query
def voxel_table(spark, sf):
    counts = grids.voxel_counts(_points(spark, sf), ["model"], 5.0, ["l_tax"], ["maker"])
    return rounded(grids.voxels(counts, ["model"], ["l_tax"], ["maker"]), mean_l_tax=9)


@query
def voxel_coarse(spark, sf):
    """Voxels three times as large, from the counts of the small ones."""
    counts = grids.voxel_counts(_points(spark, sf), ["model"], 5.0, ["l_tax"], ["maker"])
    return rounded(grids.voxels(grids.coarsen(counts, ["model"], 3), ["model"], ["l_tax"], ["maker"]), mean_l_tax=9)


@query
def voxel_index(spark, sf):
    found = grids.voxels(grids.voxel_counts(_points(spark, sf), ["model"], 5.0), ["model"])
    return rounded(grids.range_index(found, ["model"], 5.0), occupancy=6)


@query
def voxel_fill(spark, sf):
    found = grids.voxels(grids.voxel_counts(_points(spark, sf), ["model"], 5.0, ["l_tax"]), ["model"], ["l_tax"])
    return rounded(grids.fill_empty(found.drop("points"), ["model"], ["mean_l_tax"]), mean_l_tax=9)


@query
def box_clip(spark, sf):
    """Corners and area of every face inside the box."""
    corners, _ = B.mesh_corners(spark, sf)
    parts = clipping.clip_rings(clipping.rings(B.mesh_vertices(spark, sf), corners), BOX)
    return rounded(parts.select("fid", F.size("ring").alias("corners"), clipping.ring_area().alias("area")), area=3)


@query
def box_clip_mesh(spark, sf):
    """Kept and new vertices of the clipped mesh, and how often faces use them."""
    corners, _ = B.mesh_corners(spark, sf)
    vertices = B.mesh_vertices(spark, sf)
    v, c = clipping.clip_mesh(vertices, corners, BOX)
    new = F.col("vid") > vertices.agg(F.max("vid")).scalar()
    uses = c.groupBy("vid").agg(F.count(F.lit(1)).alias("uses"))
    return rounded(v.join(uses, "vid").groupBy(new.alias("is_new"), "uses").agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("sum_xyz")), sum_xyz=2)

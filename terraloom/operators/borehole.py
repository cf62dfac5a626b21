"""Borehole documents and layer cylinders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions.ordering import group_index


def layer_array(layers: DataFrame, key: str, row_id: str, fields: dict[str, Column], part_layers: int) -> DataFrame:
    """(key, part, layers ARRAY): all layers in input order, cut into parts of bounded length."""
    ranked = group_index(layers, [key], row_id, "_nth")
    packed = ranked.select(
        key, F.floor(F.col("_nth") / part_layers).cast("int").alias("part"),
        F.struct("_nth", F.struct(*[c.alias(n) for n, c in fields.items()]).alias("layer")).alias("l"),
    )
    ordered = F.array_sort(F.collect_list("l"), lambda a, b: F.when(a["_nth"] < b["_nth"], -1).otherwise(1))
    return packed.groupBy(key, "part").agg(F.transform(ordered, lambda l: l["layer"]).alias("layers"))


def first_match(rows: DataFrame, key: str, row_id: str, fields: dict[str, Column], out: str) -> DataFrame:
    """First row per key as one struct, reduced before the shuffle."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c.alias(n) for n, c in fields.items()]), row_id).alias(out))


def nest_documents(
    boreholes: DataFrame, layers: DataFrame, groundwater: DataFrame, engineering: DataFrame, part_layers: int,
    key: str = "BH_ID", row_id: str = "_row_id",
) -> DataFrame:
    """One document per borehole: location, all layers in order, first groundwater and engineering rows.

    The caller states how many layers one row may hold: layers stand in rows numbered by ``part``, so that
    no single row holds an unbounded array; a borehole with fewer gives one row with part 0.
    """
    d = lambda c: F.col(c).cast("double")
    optional = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    stack = layer_array(layers, key, row_id, {"top": d("depth_top"), "bottom": d("depth_bottom"), "name": F.col("lithology")}, part_layers)
    water = first_match(groundwater, key, row_id, {
        "water_level": d("water_level"), "type": F.col("type"), "flow_direction": optional(groundwater, "flow_direction"),
        "remark": optional(groundwater, "remark"),
    }, "groundwater")
    tests = first_match(engineering, key, row_id, {c: d(c) for c in ("UCS", "RQD", "permeability")}, "engineering")
    return (
        boreholes.select(key, F.struct(d("X").alias("x"), d("Y").alias("y"), d("Z").alias("z")).alias("location"))
        .join(stack, key, "left").join(water, key, "left").join(tests, key, "left")
        .select(key, F.coalesce("part", F.lit(0)).alias("part"), "location",
                F.coalesce("layers", F.expr("array()").cast("array<struct<top:double,bottom:double,name:string>>")).alias("lithology"),
                "groundwater", "engineering")
    )


def layer_cylinders(boreholes: DataFrame, layers: DataFrame, key: str = "BH_ID", radius: float = 0.8) -> DataFrame:
    """Vertical cylinder of each layer: centre z = Z - (top + bottom) / 2, height = bottom - top."""
    d = lambda c: F.col(c).cast("double")
    joined = layers.join(boreholes.select(key, d("X").alias("_x"), d("Y").alias("_y"), d("Z").alias("_z")), key)
    centre_z = F.col("_z") - (d("depth_top") + d("depth_bottom")) / 2
    return joined.select(
        key, "lithology", F.struct(
            F.array("_x", "_y", centre_z).alias("center"), (d("depth_bottom") - d("depth_top")).alias("height"), F.lit(radius).alias("radius")
        ).alias("geometry"),
    )

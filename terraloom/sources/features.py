"""GeoJSON geometry as rows.

Coordinates stay text until they are cast, so an unreadable number is a row and not a lost file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terraloom.functions import vectors as G
from terraloom.functions.ordering import chunked_index
from terraloom.session import cut_lineage

_PARTS = "array<struct<part:int,ring:int,points:array<array<string>>>>"


def geometries(records: DataFrame) -> DataFrame:
    """file, ordinal, path, geom_type, coordinates (JSON text); collections are opened down to the last level.

    One round per level that occurs in the data; only the collections themselves go into the next round.
    """
    level = records.filter("geometry is not null").select("file", "ordinal", F.lit("").alias("path"), "geometry")
    done = None
    while True:
        kind = F.get_json_object("geometry", "$.type")
        flat = level.filter(F.coalesce(kind, F.lit("")) != "GeometryCollection")
        done = flat if done is None else done.unionByName(flat)
        inner = F.from_json("geometry", "struct<geometries:array<string>>")["geometries"]
        deeper = cut_lineage(level.filter(kind == "GeometryCollection"))
        if deeper.isEmpty():
            break
        level = deeper.select("file", "ordinal", "path", F.posexplode(inner).alias("i", "geometry")).select(
            "file", "ordinal", F.concat("path", F.lit("/"), F.col("i").cast("string")).alias("path"), "geometry"
        )
    return done.select(
        "file", "ordinal", "path", F.get_json_object("geometry", "$.type").alias("geom_type"),
        F.get_json_object("geometry", "$.coordinates").alias("coordinates"),
    )


def rings(geoms: DataFrame) -> DataFrame:
    """file, ordinal, path, geom_type, part, ring, points: every point list of every geometry."""
    c = F.col("coordinates")
    one = lambda points: F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("ring"), points.alias("points")))
    level1 = F.from_json(c, "array<string>")
    level2 = F.from_json(c, "array<array<string>>")
    level3 = F.from_json(c, "array<array<array<string>>>")
    level4 = F.from_json(c, "array<array<array<array<string>>>>")
    by_ring = F.transform(level3, lambda r, i: F.struct(F.lit(0).alias("part"), i.alias("ring"), r.alias("points")))
    by_part = F.transform(level3, lambda r, i: F.struct(i.alias("part"), F.lit(0).alias("ring"), r.alias("points")))
    both = F.flatten(F.transform(level4, lambda p, i: F.transform(p, lambda r, j: F.struct(i.alias("part"), j.alias("ring"), r.alias("points")))))
    kind = F.col("geom_type")
    parts = (
        F.when(kind == "Point", one(F.array(level1))).when(kind.isin("MultiPoint", "LineString"), one(level2))
        .when(kind == "MultiLineString", by_part).when(kind == "Polygon", by_ring).when(kind == "MultiPolygon", both)
    )
    return geoms.select("file", "ordinal", "path", "geom_type", F.inline(parts.cast(_PARTS)))


def positions(ring_rows: DataFrame) -> DataFrame:
    """One row per position: x, y, z (0 when absent) and whether all its numbers could be read."""
    out = ring_rows.select("file", "ordinal", "path", "geom_type", "part", "ring", F.posexplode("points").alias("pos", "p"))
    number = lambda i: F.get("p", i).try_cast("double")
    z = F.when(F.size("p") > 2, number(2)).otherwise(0.0)
    ok = (F.size("p") >= 2) & number(0).isNotNull() & number(1).isNotNull() & z.isNotNull()
    return out.select("file", "ordinal", "path", "geom_type", "part", "ring", F.col("pos").cast("bigint").alias("pos"),
                      number(0).alias("x"), number(1).alias("y"), z.alias("z"), F.coalesce(ok, F.lit(False)).alias("ok"))


def ring_checks(ring_rows: DataFrame) -> DataFrame:
    """Polygon rings: too short (under four positions) or open (first differs from last)."""
    polygons = ring_rows.filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))
    short = F.size("points") < 4
    return polygons.select(
        "file", "ordinal", "path", "part", "ring", F.size("points").alias("size"), short.alias("too_short"),
        (~short & G.ring_is_open(F.col("points"))).alias("open"),
    )


def model_tables(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(vertices, corners, line corners, vertex props, face props) of GeoJSON files, one model per file.

    Outer rings only, the closing vertex dropped, equal positions share one vertex numbered by first
    appearance, missing z = 0. A polygon's properties go to its faces, a point's to its vertex; where several points share
    a vertex the last one decides each key.
    """
    ring_rows = rings(geometries(records)).withColumnRenamed("file", "model_id")
    polygon = F.col("geom_type").isin("Polygon", "MultiPolygon")
    outer = ring_rows.filter(~polygon | (F.col("ring") == 0))
    closed = polygon & (F.size("points") > 1) & ~G.ring_is_open(F.col("points"))
    open_points = F.when(closed, F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points"))
    outer = outer.withColumn("points", open_points).withColumnRenamed("model_id", "file")
    used = positions(outer).filter("ok").withColumnRenamed("file", "model_id")
    place = F.struct("ordinal", "path", "part", "ring", "pos")
    firsts = used.groupBy("model_id", "x", "y", "z").agg(F.min(place).alias("place"))
    numbered = chunked_index(firsts, ["model_id"], F.shiftright(F.col("place.ordinal"), 12), ["place"], "vid")
    vertices = numbered.select("model_id", "vid", "x", "y", "z")
    hit = used.join(vertices, ["model_id", "x", "y", "z"])
    shape = F.struct("ordinal", "path", "part")

    def loops(rows: DataFrame, least: int) -> DataFrame:
        keyed = rows.withColumn("shape", shape)
        sizes = keyed.groupBy("model_id", "shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        ids = chunked_index(sizes, ["model_id"], F.shiftright(F.col("shape.ordinal"), 12), ["shape"], "fid").select("model_id", "shape", "fid")
        return keyed.join(ids, ["model_id", "shape"]).select("model_id", "fid", "pos", "vid", F.col("shape.ordinal").alias("ordinal"))

    own = records.filter(F.size(F.map_keys("props")) > 0).select(F.col("file").alias("model_id"), "ordinal", "props")
    corners = loops(hit.filter(polygon), 3)
    points = hit.filter(F.col("geom_type").isin("Point", "MultiPoint")).select("model_id", "vid", "ordinal", place.alias("place"))
    entries = points.join(own, ["model_id", "ordinal"]).select("model_id", "vid", "place", F.explode("props").alias("key", "value"))
    last = entries.groupBy("model_id", "vid", "key").agg(F.max_by(F.struct("key", "value"), "place").alias("e"))
    vertex_props = last.groupBy("model_id", "vid").agg(F.map_from_entries(F.collect_list("e")).alias("props"))
    face_props = corners.select("model_id", "fid", "ordinal").distinct().join(own, ["model_id", "ordinal"]).select("model_id", "fid", "props")
    return vertices, corners, loops(hit.filter(F.col("geom_type").isin("LineString", "MultiLineString")), 2), vertex_props, face_props


def cleaning_rows(records: DataFrame) -> DataFrame:
    """Features in the layout of ``cleaning.clean_features``."""
    kind, c = F.get_json_object("geometry", "$.type"), F.get_json_object("geometry", "$.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(c, "array<array<array<double>>>"))).when(
        kind == "MultiPolygon", F.from_json(c, "array<array<array<array<double>>>>")
    )
    return records.select(
        F.col("ordinal").alias("feature_id"), kind.alias("geom_type"), polygons.alias("polygons"),
        F.when(polygons.isNull(), F.col("geometry")).alias("rest"), "props",
    )

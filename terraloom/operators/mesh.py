"""Mesh topology, area, welding, cleaning and plane slices.

Tables: vertices(model_id, vid BIGINT, x, y, z) with vid counted from 0 per model;
corners(model_id, fid BIGINT, pos BIGINT, vid BIGINT), one row per face corner, pos from 0.
``corners_of`` turns faces(model_id, fid, loop ARRAY) into corners. No step gathers a model into
one task: everything is keyed by (model, vertex), (model, edge) or (model, face, piece of a face).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import vectors as G
from terraloom.functions.ordering import cyclic_lead, id_chunk, largest_group
from terraloom.functions.skew import join_checked, join_shuffled
from terraloom.operators.dedup import keep_first
from terraloom.session import cut_lineage

FACE_CHUNK_BITS = 16
SECTORS = 4096


def corners_of(faces: DataFrame) -> DataFrame:
    return faces.select("model_id", "fid", F.posexplode("loop").alias("pos", "vid")).select(
        "model_id", "fid", F.col("pos").cast("bigint").alias("pos"), F.col("vid").cast("bigint").alias("vid")
    )


def loops_of(corners: DataFrame) -> DataFrame:
    """faces(model_id, fid, loop): a face is one record in every mesh format, so its loop is one array."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "vid")))
    return corners.groupBy("model_id", "fid").agg(F.transform(ordered, lambda c: c["vid"]).alias("loop"))


def face_edges(faces: DataFrame) -> DataFrame:
    """Directed edges of array faces, built inside each row: no shuffle."""
    n = F.size("loop")
    edges = F.transform("loop", lambda v, i: F.struct(v.cast("bigint").alias("a"), F.get("loop", (i + 1) % n).cast("bigint").alias("b")))
    return faces.select("model_id", "fid", F.inline(edges))


def corner_edges(corners: DataFrame, largest: int | None = None) -> DataFrame:
    """Directed edges of corner rows; the last corner of a face leads back to its first.

    ``largest`` is the corner count of the biggest face, where known (see ``ordering``).
    """
    led = cyclic_lead(corners, ["model_id", "fid"], id_chunk("pos", FACE_CHUNK_BITS), ["pos"], ["vid"], largest=largest)
    return led.select("model_id", "fid", F.col("vid").alias("a"), F.col("next_vid").alias("b"))


def edge_uses(edges: DataFrame) -> DataFrame:
    """Undirected edges (u < v) with their uses and how many run from u to v."""
    return (
        edges.select("model_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), (F.col("a") <= F.col("b")).alias("up"))
        .groupBy("model_id", "u", "v")
        .agg(F.count(F.lit(1)).alias("uses"), F.count_if("up").alias("upward"))
    )


def boundary_edges(uses: DataFrame) -> DataFrame:
    return uses.filter("uses = 1")


def non_manifold_edges(uses: DataFrame) -> DataFrame:
    return uses.filter("uses > 2")


def orientation_conflicts(uses: DataFrame) -> DataFrame:
    """Edges used exactly twice and both times in the same direction."""
    return uses.filter("uses = 2 and upward in (0, 2)")


def topology_summary(uses: DataFrame) -> DataFrame:
    return uses.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(F.col("uses") == 1).alias("boundary"),
        F.count_if(F.col("uses") > 2).alias("non_manifold"),
        F.count_if((F.col("uses") == 2) & F.col("upward").isin(0, 2)).alias("orientation"),
    )


def face_validity(corners: DataFrame, vertices: DataFrame) -> DataFrame:
    """(model_id, fid, size, bad_refs, valid): fewer than three corners or an unknown vertex is invalid.

    References are reduced to distinct (model, vid) before they meet the vertex table.
    """
    known = vertices.select("model_id", "vid").distinct()
    unknown = corners.select("model_id", "vid").distinct().join(known, ["model_id", "vid"], "left_anti").withColumn("bad", F.lit(1))
    per_face = (
        corners.join(unknown, ["model_id", "vid"], "left")
        .groupBy("model_id", "fid").agg(F.count(F.lit(1)).alias("size"), F.count("bad").alias("bad_refs"))
    )
    return per_face.withColumn("valid", (F.col("size") >= 3) & (F.col("bad_refs") == 0))


def place_corners(corners: DataFrame, vertices: DataFrame) -> DataFrame:
    """Corners with the coordinates of their vertex; a hot vertex is split by the skew join of AQE."""
    return corners.join(vertices.select("model_id", "vid", "x", "y", "z"), ["model_id", "vid"])


def face_areas(corners: DataFrame, vertices: DataFrame, largest: int | None = None) -> DataFrame:
    """Fan area of every face from its first corner."""
    placed = place_corners(corners, vertices)
    led = cyclic_lead(placed, ["model_id", "fid"], id_chunk("pos", FACE_CHUNK_BITS), ["pos"], ["pos", "x", "y", "z"], "n_", "o_", largest)
    pick = lambda prefix: {k: F.col(prefix + k) for k in "xyz"}
    area = F.when((F.col("pos") > F.col("o_pos")) & (F.col("n_pos") > F.col("pos")), G.triangle_area(pick("o_"), pick(""), pick("n_")))
    return led.groupBy("model_id", "fid").agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("area"))


def degenerate_faces(areas: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    return areas.filter(F.col("area") <= tolerance)


def face_signature(corners: DataFrame) -> DataFrame:
    """The vertices of each face, repeats counted, as order-independent sums of two hashes: combined map-side, never gathered."""
    hashed = lambda seed: F.sum(F.xxhash64("vid", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}")
    parts = corners.groupBy("model_id", "fid").agg(F.count("vid").alias("n"), F.min("vid").alias("low"), F.max("vid").alias("high"), hashed(1), hashed(2))
    return parts.select("model_id", "fid", F.struct("n", "low", "high", "s1", "s2").alias("signature"))


def duplicate_faces(corners: DataFrame) -> DataFrame:
    """Per model: faces that repeat the vertex set of an earlier one."""
    counted = face_signature(corners).groupBy("model_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("model_id").agg(F.sum(F.col("n") - 1).alias("duplicate_faces"), F.count(F.lit(1)).alias("distinct_faces"))


def grid_key(tolerance: float) -> list[Column]:
    """Cell of a vertex under a tolerance: coordinates rounded to the grid; exact coordinates for 0."""
    if tolerance <= 0:
        return [F.col(a) for a in "xyz"]
    scale = 1.0 / tolerance
    return [F.bround(F.col(a) * F.lit(scale), 0).cast("decimal(38,0)") for a in "xyz"]


def duplicate_vertices(vertices: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    keys = [k.alias(f"k{i}") for i, k in enumerate(grid_key(tolerance))]
    counted = vertices.groupBy("model_id", *keys).agg(F.count(F.lit(1)).alias("n"), F.min("vid").alias("first_vid"))
    return counted.filter("n > 1").select("model_id", "first_vid", "n")


def weld_map(vertices: DataFrame, tolerance: float) -> DataFrame:
    """(model_id, vid, new_vid): every vertex goes to the lowest vid of its cell."""
    keyed = vertices.select("model_id", "vid", *[k.alias(f"k{i}") for i, k in enumerate(grid_key(tolerance))])
    keyed = keyed.filter("k0 is not null and k1 is not null and k2 is not null")
    shared = keyed.groupBy("model_id", "k0", "k1", "k2").agg(F.min("vid").alias("_low"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # cut, so that the join deals both sides out anew and a crowded cell can be split
    joined = keyed.join(cut_lineage(shared), ["model_id", "k0", "k1", "k2"], "left")
    return joined.select("model_id", "vid", F.coalesce("_low", "vid").alias("new_vid"))


def weld(vertices: DataFrame, corners: DataFrame, tolerance: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Merge vertices of one cell and rewrite the corners; welded vertices keep their lowest vid."""
    mapping = weld_map(vertices, tolerance if tolerance > 0 else 1e-12)
    kept = vertices.join(mapping.filter("vid = new_vid").select("model_id", "vid"), ["model_id", "vid"], "left_semi")
    return kept, _rewrite(corners, mapping)


def _rewrite(corners: DataFrame, mapping: DataFrame) -> DataFrame:
    """Unknown vertex ids stay as they are; only moved vertices need the join."""
    moved = mapping.filter("vid <> new_vid")
    return corners.join(moved, ["model_id", "vid"], "left").withColumn("vid", F.coalesce("new_vid", "vid")).drop("new_vid").select(corners.columns)


def clean_mesh(vertices: DataFrame, corners: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, corners, actions): exact merge, faces with under three distinct vertices dropped,
    repeated vertex sets dropped (the first face stays)."""
    mapping = weld_map(vertices, 0.0)
    kept = vertices.join(mapping.filter("vid = new_vid").select("model_id", "vid"), ["model_id", "vid"], "left_semi")
    known = corners.join(vertices.select("model_id", "vid"), ["model_id", "vid"], "left_semi")
    moved = _rewrite(known, mapping)
    sizes = moved.groupBy("model_id", "fid").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("vid").alias("n"))
    sound = sizes.filter("size >= 3 and n >= 3").select("model_id", "fid")
    solid = moved.join(sound, ["model_id", "fid"], "left_semi")
    firsts = keep_first(face_signature(solid), ["model_id", "signature"], ["fid"], trim=False).select("model_id", "fid")
    final = solid.join(firsts, ["model_id", "fid"], "left_semi")
    count = lambda df, name: df.groupBy("model_id").agg(F.count(F.lit(1)).alias(name))
    faces_in = corners.select("model_id", "fid").distinct()
    facts = count(vertices, "vertices_in")
    for frame, name in ((kept, "vertices_out"), (faces_in, "faces_in"), (sound, "faces_sound"), (firsts, "faces_out")):
        facts = facts.join(count(frame, name), "model_id", "left")
    facts = facts.na.fill(0)
    actions = facts.select(
        "*", (F.col("vertices_in") - F.col("vertices_out")).alias("merged_vertices"),
        (F.col("faces_in") - F.col("faces_sound")).alias("removed_invalid_faces"),
        (F.col("faces_sound") - F.col("faces_out")).alias("removed_duplicate_faces"),
    ).drop("faces_sound")
    return kept, final, actions


def clean_lines(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Line points (model_id, fid, pos, vid) moved to welded vertices; lines under two points dropped."""
    moved = lines.join(mapping, ["model_id", "vid"]).select("model_id", "fid", "pos", F.col("new_vid").alias("vid"))
    long = moved.groupBy("model_id", "fid").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("model_id", "fid")
    return moved.join(long, ["model_id", "fid"], "left_semi")


def triangles(faces: DataFrame) -> DataFrame:
    """Fan triangulation of array faces, built inside each row."""
    loop = F.col("loop")
    n = F.size(loop)
    fan = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.struct(loop[0].alias("a"), F.get(loop, i).alias("b"), F.get(loop, i + 1).alias("c"))),
    )
    return faces.select("model_id", "fid", F.posexplode(fan).alias("part", "t")).select("model_id", "fid", "part", "t.*")


def triangle_normals(tri: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with their corner points and unit normal."""
    out = tri
    for c in "abc":
        points = vertices.select("model_id", F.col("vid").alias(c), G.point(F.col("x"), F.col("y"), F.col("z")).alias(f"p_{c}"))
        out = join_shuffled(out, points, ["model_id", c])
    return out.withColumn("normal", G.unit_normal(F.col("p_a"), F.col("p_b"), F.col("p_c"))).withColumn(
        "raw_normal", G.raw_normal(F.col("p_a"), F.col("p_b"), F.col("p_c"))
    )


# --- bounds and coordinates ---------------------------------------------------------------


def model_bounds(vertices: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Box, spans, centre and diagonal per model."""
    b = vertices.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("vertices"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    )
    spans = {f"span_{a}": F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"}
    centres = {f"centre_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"}
    out = b.withColumns({**spans, **centres})
    return out.withColumn("diagonal", F.sqrt(sum((F.col(f"span_{a}") ** 2 for a in "yz"), F.col("span_x") ** 2)))


def model_summary(vertices: DataFrame, faces: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Vertices, faces, triangles (sum of n - 2) and lines per model."""
    out = vertices.groupBy("model_id").agg(F.count(F.lit(1)).alias("vertex_count"))
    per_face = faces.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("face_count"), F.sum(F.greatest(F.lit(0), F.size("loop") - 2)).alias("triangle_count")
    )
    out = out.join(per_face, "model_id", "full_outer")
    if lines is not None:
        out = out.join(lines.groupBy("model_id").agg(F.count(F.lit(1)).alias("line_count")), "model_id", "full_outer")
    else:
        out = out.withColumn("line_count", F.lit(0).cast("bigint"))
    return out.na.fill(0)


def attribute_fields(*tables: DataFrame) -> DataFrame:
    """Distinct property names per model over tables with a ``props`` map (long form)."""
    out = None
    for t in tables:
        part = t.select("model_id", F.explode(F.map_keys("props")).alias("attribute"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def shift_coordinates(vertices: DataFrame, rule: str = "keep") -> tuple[DataFrame, DataFrame | None]:
    """Move models to their min corner or centre. The offsets come back too, so it can be undone."""
    if rule not in ("min_corner", "centre"):
        return vertices, None  # 'keep', and anything unknown, leaves the coordinates alone
    bounds = model_bounds(vertices)
    prefix = "min" if rule == "min_corner" else "centre"
    offsets = bounds.select("model_id", *[F.col(f"{prefix}_{a}").alias(f"offset_{a}") for a in "xyz"])
    moved = join_checked(vertices, offsets, ["model_id"]).withColumns({a: F.col(a) - F.col(f"offset_{a}") for a in "xyz"})
    return moved.select(vertices.columns), offsets


def normalise_box(vertices: DataFrame) -> DataFrame:
    """Centre each model and divide by its largest span."""
    b = model_bounds(vertices).select(
        "model_id", *[F.col(f"centre_{a}") for a in "xyz"], F.greatest("span_x", "span_y", "span_z").alias("size")
    )
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(1.0)
    moved = join_checked(vertices, b, ["model_id"]).withColumns({a: (F.col(a) - F.col(f"centre_{a}")) / size for a in "xyz"})
    return moved.select(vertices.columns)


def keep_attributes(df: DataFrame, rule: str = "all") -> DataFrame:
    """all / identifiers / none, on a ``props`` map."""
    if rule == "none":
        return df.withColumn("props", F.expr("map()").cast("map<string,string>"))
    if rule == "identifiers":
        return df.withColumn("props", F.map_filter("props", lambda k, v: F.lower(k).isin(*fv.KEPT_IDENTIFIERS)))
    return df


# --- slices -------------------------------------------------------------------------------


def slice_points(
    corners: DataFrame, vertices: DataFrame, plane: str, positions: DataFrame | float, largest: int | None = None
) -> DataFrame:
    """Distinct points where face edges meet the plane: (model_id, u, v).

    ``positions`` is one number or a frame (model_id, position). An edge lying in the plane gives
    both ends. Points are distinct on a 1e-9 grid; faces with an unknown vertex are left out.
    """
    axis, eps = G.PLANE_AXIS[plane], 1e-9
    placed = place_corners(valid_refs(corners, vertices), vertices)
    led = cyclic_lead(placed, ["model_id", "fid"], id_chunk("pos", FACE_CHUNK_BITS), ["pos"], ["x", "y", "z"], "n_", largest=largest)
    if isinstance(positions, DataFrame):
        led = join_checked(led, positions.select("model_id", F.col("position").cast("double").alias("position")), ["model_id"])
    else:
        led = led.withColumn("position", F.lit(float(positions)))
    da, db = F.col(axis) - F.col("position"), F.col(f"n_{axis}") - F.col("position")
    flat = (F.abs(da) <= eps) & (F.abs(db) <= eps)
    t = F.when(F.abs(da) + F.abs(db) > eps, F.try_divide(F.abs(da), F.abs(da) + F.abs(db))).otherwise(0.0)
    mix = {a: F.col(a) + t * (F.col(f"n_{a}") - F.col(a)) for a in "xyz"}
    uv = lambda p: F.struct(*[c.alias(n) for n, c in zip(("u", "v"), G.project(p["x"], p["y"], p["z"], plane))])
    ends = F.array(uv({a: F.col(a) for a in "xyz"}), uv({a: F.col(f"n_{a}") for a in "xyz"}))
    met = led.filter(flat | (da * db <= 0)).select("model_id", F.explode(F.when(flat, ends).otherwise(F.array(uv(mix)))).alias("p"))
    grid = [F.bround(F.col(f"p.{c}") * 1e9, 0).cast("decimal(38,0)").alias(f"k{c}") for c in "uv"]
    return met.groupBy("model_id", *grid).agg(F.min("p").alias("p")).select("model_id", "p.u", "p.v")


def valid_refs(corners: DataFrame, vertices: DataFrame) -> DataFrame:
    """Corners of faces that know all their vertices; nothing is joined twice where all are known."""
    known = vertices.select("model_id", "vid")
    unknown = corners.select("model_id", "vid").distinct().join(known, ["model_id", "vid"], "left_anti")
    bad = corners.join(unknown, ["model_id", "vid"], "left_semi").select("model_id", "fid").distinct()
    return corners.join(bad, ["model_id", "fid"], "left_anti")


def slice_outline(points: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Points with their angle about the centroid and the point that follows by angle.

    The outline of a star-shaped section. Sorted in sectors of the full turn, so one big section is
    not sorted in one task.
    """
    keys = list(keys)
    points = cut_lineage(points)  # a section is small next to its mesh, and is read twice
    centre = points.groupBy(*keys).agg(F.avg("u").alias("cu"), F.avg("v").alias("cv"))
    largest = largest_group(points, keys)
    turned = join_checked(points, centre, keys).withColumn("angle", F.atan2(F.col("v") - F.col("cv"), F.col("u") - F.col("cu"))).drop("cu", "cv")
    sector = F.floor((F.col("angle") + math.pi) / (2 * math.pi) * SECTORS).cast("bigint")
    return cyclic_lead(turned, keys, sector, ["angle", "u", "v"], ["u", "v"], largest=largest)


def slice_profile(points: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Point count, area and perimeter of each section."""
    out = slice_outline(points, keys)
    twice = F.sum(F.col("u") * F.col("next_v") - F.col("next_u") * F.col("v"))
    step = F.sum(F.hypot(F.col("u") - F.col("next_u"), F.col("v") - F.col("next_v")))
    n = F.count(F.lit(1))
    return out.groupBy(*keys).agg(
        n.alias("points"), F.when(n < 3, 0.0).otherwise(F.abs(twice) / 2).alias("area"), F.when(n < 2, 0.0).otherwise(step).alias("perimeter")
    )

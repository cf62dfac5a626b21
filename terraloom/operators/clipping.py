"""Exact clipping of meshes to a box, face by face, with vertices that neighbouring faces share.

A face is one record in every mesh format and is cut inside its row: each of the six planes keeps the corners on its inner side
and puts a new corner where an edge crosses it. A crossing is computed from the edge's end that comes first in coordinate order,
so the two faces of an edge get the same numbers and the new vertex is one. Caps, which close a cut body, are signed triangles from
a fixed point of the plane to each cut; planes cut later cut the caps of earlier ones too. They make volumes right, for concave
faces as well, and are no faces to draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions.ordering import chunked_index
from terraloom.operators.mesh import place_corners
from terraloom.session import cut_lineage

XYZ = ("x", "y", "z")
Box = Sequence[Sequence[float]]  # ((x low, x high), (y low, y high), (z low, z high)); an infinite side does not cut


def rings(vertices: DataFrame, corners: DataFrame) -> DataFrame:
    """faces(model_id, fid, ring): corners in order with coordinates and vid; a face with an unknown vertex loses that corner."""
    placed = place_corners(corners, vertices)
    corner = F.struct("pos", F.struct(*XYZ, "vid").alias("p"))
    return placed.groupBy("model_id", "fid").agg(F.transform(F.array_sort(F.collect_list(corner)), lambda c: c["p"]).alias("ring"))


def _along(p: Column, axis: Column) -> Column:
    return F.when(axis == 0, p["x"]).when(axis == 1, p["y"]).otherwise(p["z"])


def _crossing(p: Column, q: Column, plane: Column) -> Column:
    """Where the edge of two corners meets the plane; the same numbers for either direction."""
    first = F.struct(*[p[a] for a in XYZ]) <= F.struct(*[q[a] for a in XYZ])
    axis, at = plane["axis"], plane["at"]

    def point(u, v):
        share = (at - _along(u, axis)) / (_along(v, axis) - _along(u, axis))
        return F.struct(
            *[F.when(axis == k, at).otherwise(u[a] + (v[a] - u[a]) * share).alias(a) for k, a in enumerate(XYZ)], F.lit(None).cast("bigint").alias("vid")
        )

    return F.when(first, point(p, q)).otherwise(point(q, p))


def _inside(p: Column, plane: Column) -> Column:
    value = _along(p, plane["axis"])
    return F.when(plane["upper"], value <= plane["at"]).otherwise(value >= plane["at"])


def _follow(ring: Column, i: Column) -> Column:
    return F.get(ring, (i + 1) % F.size(ring))


def _cut(ring: Column, plane: Column) -> Column:
    """The part of a ring on the inner side of a plane."""

    def step(p, i):
        q = _follow(ring, i)
        crossing = F.when(_inside(p, plane) != _inside(q, plane), _crossing(p, q, plane))
        return F.array(F.when(_inside(p, plane), p), crossing)

    return F.array_compact(F.flatten(F.transform(ring, step)))


def _caps(ring: Column, plane: Column) -> Column:
    """Signed triangles from the plane's anchor, one to each stretch of the plane that the cut ring runs along."""

    def mark(p, i):
        q = _follow(ring, i)
        return F.when(_inside(p, plane) != _inside(q, plane), F.struct(_crossing(p, q, plane).alias("p"), _inside(p, plane).alias("leaves")))

    def triangles(crossings):
        made = lambda c, i: F.when(c["leaves"], F.struct(plane["number"].alias("cap"), F.array(plane["anchor"], _follow(crossings, i)["p"], c["p"]).alias("ring")))
        return F.array_compact(F.transform(crossings, made))

    # a list of one, so that the crossings are worked out once
    return F.flatten(F.transform(F.array(F.array_compact(F.transform(ring, mark))), triangles))


def clip_rings(faces: DataFrame, box: Box, caps: bool = False) -> DataFrame:
    """faces(model_id, fid, ring) -> the parts inside the box, in rows (model_id, fid, cap, ring); rings under three corners are gone.

    Corners on a plane are inside. ``cap`` is 0 for faces and the number of the plane (1 to 6) for caps, which come only on request.
    The planes are folded over the list of a face's pieces, all in one expression of the row.
    """
    corner = [float(next((v for v in bounds if abs(v) != float("inf")), 0.0)) for bounds in box]
    planes = []
    for k in range(3):
        for upper, at in enumerate(box[k]):
            if abs(at) != float("inf"):
                anchor = F.struct(*[F.lit(float(at) if k == j else c).alias(a) for j, (a, c) in enumerate(zip(XYZ, corner, strict=True))], F.lit(None).cast("bigint").alias("vid"))
                planes.append(F.struct(
                    F.lit(k).alias("axis"), F.lit(float(at)).alias("at"), F.lit(bool(upper)).alias("upper"), F.lit(2 * k + upper + 1).alias("number"), anchor.alias("anchor")
                ))
    pieces = F.array(F.struct(F.lit(0).alias("cap"), F.col("ring").alias("ring")))

    def cut(state, plane):
        def one(piece):
            kept = F.array(F.struct(piece["cap"].alias("cap"), _cut(piece["ring"], plane).alias("ring")))
            return F.concat(kept, _caps(piece["ring"], plane)) if caps else kept

        return F.filter(F.flatten(F.transform(state, one)), lambda piece: F.size(piece["ring"]) >= 3)

    out = F.aggregate(F.array(*planes), pieces, cut) if planes else pieces
    found = faces.select("model_id", "fid", F.explode(out).alias("r")).select("model_id", "fid", "r.cap", "r.ring")
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"]) & (p["z"] == q["z"])
    # a corner on a plane is met twice, as itself and as a crossing
    fresh = F.filter("ring", lambda p, i: ~same(p, _follow(F.col("ring"), i)))
    return found.withColumn("ring", fresh).filter(F.size("ring") >= 3)


def area_vector(ring: str = "ring") -> Column:
    """The vector area of a ring, taken from its first corner."""
    first = F.get(ring, F.lit(0))

    def part(p, i):
        n = F.get(F.col(ring), (i + 1) % F.size(ring))
        u, v = [p[a] - first[a] for a in XYZ], [n[a] - first[a] for a in XYZ]
        return F.struct((u[1] * v[2] - u[2] * v[1]).alias("x"), (u[2] * v[0] - u[0] * v[2]).alias("y"), (u[0] * v[1] - u[1] * v[0]).alias("z"))

    add = lambda s, p: F.struct(*[(s[a] + 0.5 * p[a]).alias(a) for a in XYZ])
    return F.aggregate(F.transform(F.col(ring), part), F.struct(*[F.lit(0.0).alias(a) for a in XYZ]), add)


def ring_area(ring: str = "ring") -> Column:
    v = area_vector(ring)
    return F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])


def signed_volumes(rings_with_caps: DataFrame, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(model_id, volume) enclosed by closed bodies whose faces turn outward: fans of tetrahedra from a fixed origin."""
    def term(p, i):
        n = F.get(F.col("ring"), (i + 1) % F.size("ring"))
        f = F.get("ring", F.lit(0))
        a, b, c = ([t[k] - F.lit(float(o)) for k, o in zip(XYZ, origin, strict=True)] for t in (f, p, n))
        return (a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])) / 6

    per_ring = F.aggregate(F.transform(F.col("ring"), term), F.lit(0.0), lambda s, v: s + v)
    return rings_with_caps.select("model_id", per_ring.alias("v")).groupBy("model_id").agg(F.sum("v").alias("volume"))


def clipped_volume(vertices: DataFrame, corners: DataFrame, box: Box) -> DataFrame:
    """(model_id, volume) of each closed body inside the box."""
    origin = [next((float(v) for v in bounds if abs(v) != float("inf")), 0.0) for bounds in box]
    return signed_volumes(clip_rings(rings(vertices, corners), box, caps=True), origin)


def clip_mesh(vertices: DataFrame, corners: DataFrame, box: Box) -> tuple[DataFrame, DataFrame]:
    """(vertices, corners) inside the box: kept vertices keep their vid, cut edges get new ones, counted on from the model's last.

    New vertices with the same coordinates in a model are one vertex. Faces keep their fid.
    """
    clipped = clip_rings(rings(vertices, corners), box)
    placed = cut_lineage(clipped.select("model_id", "fid", F.posexplode("ring").alias("pos", "p")).select("model_id", "fid", F.col("pos").cast("bigint").alias("pos"), "p.*"))
    last = vertices.groupBy("model_id").agg(F.max("vid").alias("_last"))
    fresh = placed.filter("vid is null").select("model_id", *XYZ).distinct().withColumn("_h", F.xxhash64(*XYZ))
    numbered = chunked_index(fresh, ["model_id"], F.shiftright("_h", 52), ["_h", *XYZ], "_k", start=1).join(last, "model_id")
    new = cut_lineage(numbered.select("model_id", (F.col("_last") + F.col("_k")).alias("vid"), *XYZ))
    kept = placed.filter("vid is not null").select("model_id", "vid", *XYZ).distinct()
    on = ["model_id", *XYZ]
    cut = placed.filter("vid is null").drop("vid").join(new, on).select("model_id", "fid", "pos", "vid")
    return kept.unionByName(new), placed.filter("vid is not null").select("model_id", "fid", "pos", "vid").unionByName(cut)

"""Small vector algebra on struct columns with fields x, y and z."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def minus(a, b):
    return tuple(a[k] - b[k] for k in "xyz")


def cross(u, v):
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def length(v) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def triangle_area(a, b, c) -> Column:
    return F.lit(0.5) * length(cross(minus(b, a), minus(c, a)))


def unit_normal(a, b, c) -> Column:
    """Unit normal of a triangle; zero for a vanishing one."""
    n = cross(minus(b, a), minus(c, a))
    size = length(n)
    flat = size <= 1e-15
    return F.struct(*[F.when(flat, 0.0).otherwise(F.try_divide(n[i], size)).alias(k) for i, k in enumerate("xyz")])


def raw_normal(a, b, c) -> Column:
    n = cross(minus(b, a), minus(c, a))
    return F.struct(*[n[i].alias(k) for i, k in enumerate("xyz")])


def distance(a, b) -> Column:
    return length(minus(a, b))


def project(x: Column, y: Column, z: Column, plane: str) -> tuple[Column, Column]:
    return {"XY": (x, y), "XZ": (x, z), "YZ": (y, z)}[plane]


PLANE_AXIS = {"YZ": "x", "XZ": "y", "XY": "z"}


def close_ring(ring: Column) -> Column:
    """Append the first point when the last one differs."""
    return F.when(
        (F.size(ring) > 0) & ~ring[0].eqNullSafe(F.element_at(ring, -1)), F.array_append(ring, ring[0])
    ).otherwise(ring)


def ring_is_open(ring: Column) -> Column:
    return (F.size(ring) > 0) & ~ring[0].eqNullSafe(F.element_at(ring, -1))


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs (u, v) held in one row; 0 under three points."""
    n = F.size(points)
    terms = F.transform(
        points,
        lambda p, i: p["u"] * points[(i + 1) % n]["v"] - points[(i + 1) % n]["u"] * p["v"],
    )
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2)


def polygon_perimeter(points: Column) -> Column:
    n = F.size(points)
    steps = F.transform(
        points, lambda p, i: F.hypot(p["u"] - points[(i + 1) % n]["u"], p["v"] - points[(i + 1) % n]["v"])
    )
    return F.when(n < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, t: a + t))

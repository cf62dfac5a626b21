"""Exact nearest-neighbour distances between two point sets.

Reference points are filed in a tree of cubes, four times finer per level and axis. Each cube
keeps its tight box and one of its points. Targets walk down level by level: a cube's point gives
an upper bound of the distance, its box a lower bound, and cubes that cannot win are dropped. Only
the surviving leaf cubes are opened, each at the level where it holds few points. No target meets all references, and nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terraloom.functions.ordering import chunked_running_sum
from terraloom.functions.skew import join_checked, join_shuffled
from terraloom.session import cut_lineage, materialise

BITS = 2            # 4 x 4 x 4 children per cube
MAX_LEVELS = 24     # 48 bits per axis: about the precision of a double
LEAF_POINTS = 32
CELL_ROWS = 50_000  # up to so many cubes of a level are broadcast
AXES = ("x", "y", "z")
CUBE = ("cx", "cy", "cz")


def _cell(level: int) -> list[Column]:
    shift = BITS * (MAX_LEVELS - level)
    return [F.shiftright(F.col(f"q{a}"), shift).alias(f"c{a}") for a in AXES]


def nearest_distances(targets: DataFrame, references: DataFrame, group: Sequence[str], leaf_points: int = LEAF_POINTS) -> DataFrame:
    """targets(group.., x, y, z) -> distinct target points with ``distance`` to the nearest reference.

    Join the result back on the coordinates when targets repeat.
    """
    g = list(group)
    refs = materialise(references.select(*g, *AXES).distinct())  # for the boxes and the cubes
    boxes = refs.groupBy(*g).agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))], F.min(F.struct(*AXES)).alias("rep"))
    cube = F.greatest(*[F.col(f"hi{a}") - F.col(f"lo{a}") for a in AXES])
    boxes = boxes.withColumn("size", F.when(cube > 0, cube).otherwise(1.0))
    top = (1 << (BITS * MAX_LEVELS)) - 1
    share = lambda a: (F.col(a) - F.col(f"lo{a}")) / F.col("size")
    quant = {f"q{a}": F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share(a))) * F.lit(float(top))).cast("bigint") for a in AXES}
    boxes = cut_lineage(boxes)
    refs = materialise(join_checked(refs, boxes, g).withColumns(quant).select(*g, *AXES, *quant))  # every level reads it

    # a cube with up to ``leaf_points`` references is a leaf at its own level; only fuller ones are divided
    cells, leaves, rest = [], [], refs
    for level in range(1, MAX_LEVELS + 1):
        found = cut_lineage(rest.groupBy(*g, *_cell(level)).agg(
            F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))], F.min(F.struct(*AXES)).alias("rep")
        ))
        cells.append(found)
        filed = rest.select("*", *_cell(level), F.lit(level).alias("level"))
        full = found.filter(F.col("n") > leaf_points).select(*g, *CUBE, F.lit(True).alias("_full"))
        if level == MAX_LEVELS or full.isEmpty():  # one answer per level reaches the driver
            leaves.append(filed)
            break
        filed = materialise(join_checked(filed, full, [*g, *CUBE], "left"))
        leaves.append(filed.filter(F.col("_full").isNull()).drop("_full"))
        rest = filed.filter(F.col("_full").isNotNull()).select(refs.columns)

    # a first bound: one reference of each cube the target stands in
    own = [*g, *AXES]
    walk = join_checked(targets.select(*own).distinct(), boxes, g).withColumns(quant).select(*own, *[f"q{a}" for a in AXES], _to_rep().alias("best"))
    for level, found in enumerate(cells, start=1):
        walk = join_checked(walk.select("*", *_cell(level)), found.select(*g, *CUBE, "rep"), [*g, *CUBE], "left", CELL_ROWS)
        walk = walk.select(*own, *[f"q{a}" for a in AXES], F.least("best", _to_rep()).alias("best"))
    zero = F.lit(0).cast("bigint")
    walk = walk.select(*own, "best", F.lit(0).alias("level"), *[zero.alias(c) for c in CUBE], F.lit(0.0).alias("low"))

    for level, found in enumerate(cells, start=1):
        children = found.select(
            *g, F.lit(level - 1).alias("plevel"), *[F.shiftright(F.col(f"c{a}"), BITS).alias(f"p{a}") for a in AXES], *[F.col(f"c{a}").alias(f"k{a}") for a in AXES],
            *[F.col(f"{n}{a}") for a in AXES for n in ("lo", "hi")], "rep",
        )
        parents = walk.select(*own, "best", "low", F.col("level").alias("plevel"), *[F.col(f"c{a}").alias(f"p{a}") for a in AXES])
        step = join_checked(parents, children, [*g, "plevel", "px", "py", "pz"], "left", CELL_ROWS)  # a leaf has no children and stays
        inner = F.col("rep").isNotNull()
        gap = _norm([F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}")) for a in AXES])
        step = step.withColumn("low", F.when(inner, gap).otherwise(F.col("low"))).filter(F.col("low") <= F.col("best"))  # most cubes fall out before the shuffle
        step = step.select(
            *own, F.when(inner, F.lit(level)).otherwise(F.col("plevel")).alias("level"), *[F.when(inner, F.col(f"k{a}")).otherwise(F.col(f"p{a}")).alias(f"c{a}") for a in AXES],
            F.when(inner, F.least("best", _to_rep())).otherwise(F.col("best")).alias("up"), "low",
        )
        best = F.min("up").over(W.partitionBy(*own))
        walk = step.withColumn("best", best).filter(F.col("low") <= F.col("best")).drop("up")
    opened = None
    for part in leaves:
        part = part.select(*g, "level", *CUBE, *[F.col(a).alias(f"r{a}") for a in AXES])
        opened = part if opened is None else opened.unionByName(part)
    opened = join_shuffled(walk, opened, [*g, "level", *CUBE])
    exact = _norm([F.col(a) - F.col(f"r{a}") for a in AXES])
    return opened.groupBy(*own).agg(F.min(exact).alias("distance"))


def _to_rep() -> Column:
    """Distance to the cube's point; nothing is known (infinity) where a coordinate is missing, null where there is no cube."""
    away = _norm([F.col(a) - F.col(f"rep.{a}") for a in AXES])
    return F.when(F.col("rep").isNotNull(), F.coalesce(away, F.lit(float("inf"))))


def _norm(parts: Sequence[Column]) -> Column:
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def counted_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct points per key with their number ``n``, written once: the rows behind them are read a single time."""
    return materialise(points.groupBy(*keys, *AXES).agg(F.count(F.lit(1)).alias("n")))


def distance_summary(
    targets: DataFrame, distances: DataFrame, group: Sequence[str], diagonal: DataFrame | None = None, count: str | None = None
) -> DataFrame:
    """Mean, max and nearest-rank p95 of the distances, each target counted as often as it occurs.

    ``count`` names a column that holds how often a target row stands there, as ``counted_points`` gives it. The p95 is read from a frequency table of distances whose running count is cut by value ranges,
    so a large pair is not sorted in one task.
    """
    g = list(group)
    weight = targets.groupBy(*g, *AXES).agg((F.sum(count) if count else F.count(F.lit(1))).alias("n"))
    counted = distances.join(weight, [*g, *AXES]).groupBy(*g, "distance").agg(F.sum("n").alias("n"))
    counted = cut_lineage(counted)  # read for the totals and for the running count
    total = counted.groupBy(*g).agg(
        F.sum("n").alias("points"), F.sum(F.col("distance") * F.col("n")).alias("s"), F.max("distance").alias("max_distance")
    )
    placed = join_checked(counted, total.select(*g, "points", "max_distance"), g)
    slot = F.coalesce(F.floor(F.try_divide(F.col("distance"), F.col("max_distance")) * 4096), F.lit(0)).cast("bigint")
    running = chunked_running_sum(placed, g, slot, ["distance"], F.col("n"), "cum")
    p95 = running.filter(F.col("cum") >= F.ceil(F.col("points") * 0.95)).groupBy(*g).agg(F.min("distance").alias("p95_distance"))
    out = total.join(p95, g).withColumn("mean_distance", F.col("s") / F.col("points")).drop("s")
    if diagonal is not None:
        out = out.join(diagonal.select(*g, "diagonal"), g).withColumn(
            "normalized_max", F.col("max_distance") / F.greatest(F.col("diagonal"), F.lit(1e-9))
        )
    return out


def strided_sample(points: DataFrame, group: Sequence[str], index: str, limit: int) -> DataFrame:
    """The evenly spaced sample of at most ``limit`` points: index floor(i * n / limit).

    ``index`` counts densely from 0 inside the group, so membership is arithmetic on each row.
    """
    g = list(group)
    if g:
        counted = join_checked(points, points.groupBy(*g).agg(F.count(F.lit(1)).alias("_n")), g)
    else:
        counted = points.withColumn("_n", points.agg(F.count(F.lit(1))).scalar())
    step = F.col("_n") / F.lit(float(limit))
    turn = F.ceil(F.col(index) / step)
    hit = lambda i: (i < limit) & (F.least(F.floor(i * step), F.col("_n") - 1) == F.col(index))
    return counted.filter((F.col("_n") <= limit) | hit(turn) | hit(turn - 1)).drop("_n")

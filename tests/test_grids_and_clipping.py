import itertools
import math
import random

import pytest

from terraloom.operators import clipping as K, grids as G, mesh as M

POINTS = "m string, id long, x double, y double, z double, v double, w double, kind string"


def cloud(spark, rng, n, spread=10.0, model="a"):
    rows = [(model, i, *[round(rng.uniform(-spread, spread), 1) for _ in "xyz"], rng.choice([None, rng.uniform(0, 9)]), rng.uniform(0, 1), rng.choice("pqr")) for i in range(n)]
    return rows, spark.createDataFrame(rows, POINTS)


# --- inverse distance -------------------------------------------------------------------------


@pytest.mark.parametrize("crowd", [1, 7, 4096])
def test_mapped_attributes_equal_all_pairs(spark, crowd):
    rng = random.Random(1)
    samples, s = cloud(spark, rng, 150)
    samples += [("a", 900 + i, 1.0, 1.0, 1.0, None if i else 5.0, 2.0, "p") for i in range(30)] + [("a", 990, None, 1.0, 1.0, 1.0, 1.0, "p"), ("a", 991, math.nan, 1.0, 1.0, 1.0, 1.0, "p")]
    s = spark.createDataFrame(samples, POINTS)
    targets, _ = cloud(spark, rng, 60)
    targets += [("a", 901, 1.0, 1.0, 1.0, 0.0, 0.0, "p"), ("a", 902, None, 0.0, 0.0, 0.0, 0.0, "p"), ("b", 903, 1.0, 1.0, 1.0, 0.0, 0.0, "p"), ("a", 904, 4.0, 1.0, 1.0, 0.0, 0.0, "p"), targets[0]]
    t = spark.createDataFrame(targets, POINTS).select("m", "id", "x", "y", "z")
    radius, power = 3.0, 1.5
    got = {}
    for r in G.map_attributes(t, s, ["m"], ["v", "w"], radius, power, crowd).collect():
        got.setdefault(r["id"], []).append(r)
    assert sorted(k for k, rows in got.items() for _ in rows) == sorted(x[1] for x in targets)
    for m, i, *p, _, _, _ in targets:
        near = []
        for sm, _, *at, v, w, _ in samples:
            if sm == m and None not in p and None not in at and not any(map(math.isnan, at)) and math.dist(p, at) <= radius:
                near.append((math.dist(p, at), v, w))
        for r in got[i]:
            assert r["samples"] == len(near)
            assert r["method"] == ("none" if not near else "exact" if min(n[0] for n in near) == 0 else "inverse_distance")
            for k, name in ((1, "v"), (2, "w")):
                own = [(n[0], n[k]) for n in near if n[k] is not None]
                same = [v for d, v in own if d == 0]
                value = sum(same) / len(same) if same else sum(v * d ** -power for d, v in own) / sum(d ** -power for d, _ in own) if own else None
                assert r[name] == (None if value is None else pytest.approx(value))


def test_crowded_cell_is_split(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.random(), rng.random(), rng.random(), 1.0, float(i), "p") for i in range(300)]
    df = spark.createDataFrame(rows, POINTS)
    out = G.map_attributes(df.select("m", "id", "x", "y", "z"), df, ["m"], ["v"], 5.0, crowd=40).collect()
    assert len(out) == 300 and {r["samples"] for r in out} == {300} and {r["method"] for r in out} == {"exact"}
    assert G.map_attributes(df.select("m", "id", "x", "y", "z").limit(0), df, ["m"], ["v"], 5.0).count() == 0
    assert {r["method"] for r in G.map_attributes(df.select("m", "id", "x", "y", "z"), df.limit(0), ["m"], ["v"], 5.0).collect()} == {"none"}


def test_little_is_written_for_samples_that_no_target_reaches(spark, monkeypatch):
    """Far samples are left out before anything is written, and the smaller side is the one that is copied to its neighbours."""
    rng = random.Random(3)
    written = []
    for name in ("cut_lineage", "materialise"):
        if hasattr(G, name):
            monkeypatch.setattr(G, name, lambda df, f=getattr(G, name): written.append((out := f(df)).count()) or out)
    far = [("a", i, 100 + rng.random() * 50, rng.random() * 50, 0.0, 1.0, 1.0, "p") for i in range(2000)]
    near = [("a", 5000 + i, rng.random(), rng.random(), rng.random(), float(i), 1.0, "p") for i in range(200)]
    edge = [("a", 6000, math.inf, 0.0, 0.0, 1.0, 1.0, "p"), ("a", 6001, 0.0, -math.inf, 0.0, 1.0, 1.0, "p")]
    samples, targets = spark.createDataFrame(far + near + edge, POINTS), spark.createDataFrame(near[:10] + edge, POINTS).select("m", "id", "x", "y", "z")
    out = {r["id"]: (r["samples"], r["v"]) for r in G.map_attributes(targets, samples, ["m"], ["v"], 2.0).collect()}
    assert out == {**{5000 + i: (200, float(i)) for i in range(10)}, 6000: (0, None), 6001: (0, None)}
    assert sum(written) < 500


# --- thinning and voxels ----------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["centre", "first"])
def test_thinning_keeps_one_point_a_cell(spark, keep):
    rows, df = cloud(spark, random.Random(3), 400)
    got = {r["id"] for r in G.thin(df, ["m"], 4.0, "id", keep).collect()}
    best = {}
    for m, i, *p, _, _, _ in rows:
        cell = tuple(math.floor(c / 4.0) for c in p)
        d = sum(((k + 0.5) * 4.0 - c) ** 2 for k, c in zip(cell, p)) if keep == "centre" else 0
        best[m, cell] = min(best.get((m, cell), (math.inf, 0)), (d, i))
    assert got == {i for _, i in best.values()}


def test_voxels_and_their_coarser_form(spark):
    rows, df = cloud(spark, random.Random(4), 500)
    fine = G.voxel_counts(df, ["m"], 2.0, ["v", "w"], ["kind"])
    for counts, size in ((fine, 2.0), (G.coarsen(fine, ["m"], 3), 6.0)):
        cells = {}
        for r in rows:
            cells.setdefault(tuple(math.floor(c / size) for c in r[2:5]), []).append(r)
        got = {(r["ix"], r["iy"], r["iz"]): r for r in G.voxels(counts, ["m"], ["v", "w"], ["kind"]).collect()}
        assert set(got) == set(cells)
        for cell, own in cells.items():
            v = [r[5] for r in own if r[5] is not None]
            kinds = [r[7] for r in own]
            assert got[cell]["points"] == len(own)
            assert got[cell]["mean_v"] == (pytest.approx(sum(v) / len(v)) if v else None)
            assert got[cell]["mode_kind"] == min(set(kinds), key=lambda k: (-kinds.count(k), k))
    index = G.range_index(G.voxels(fine, ["m"]), ["m"], 2.0).first()
    assert index["voxels"] == len({tuple(math.floor(c / 2.0) for c in r[2:5]) for r in rows}) and index["points"] == 500 and index["lo_x"] <= min(r[2] for r in rows) <= index["lo_x"] + 2


def test_empty_voxels_are_filled_from_their_neighbours(spark):
    table = spark.createDataFrame([("a", 0, 0, 0, 1, 2.0), ("a", 4, 0, 0, 1, 6.0), ("b", 9, 9, 9, 1, 1.0)], "m string, ix long, iy long, iz long, points long, v double")
    got = {(r["m"], r["ix"]): (r["filled"], r["v"]) for r in G.fill_empty(table, ["m"], ["v"], rounds=2).collect()}
    assert got == {("a", 0): (0, 2.0), ("a", 4): (0, 6.0), ("a", 1): (1, 2.0), ("a", 3): (1, 6.0), ("a", 2): (2, 4.0), ("b", 9): (0, 1.0)}


# --- clipping ---------------------------------------------------------------------------------

CUBE = list(itertools.product((0.0, 4.0), repeat=3))
CUBE_FACES = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]


def body(spark, points, faces, model="m"):
    vertices = spark.createDataFrame([(model, i, *map(float, p)) for i, p in enumerate(points)], "model_id string, vid long, x double, y double, z double")
    corners = spark.createDataFrame([(model, f, k, v) for f, face in enumerate(faces) for k, v in enumerate(face)], "model_id string, fid long, pos long, vid long")
    return vertices, corners


@pytest.mark.parametrize("box,volume", [
    (((1, 3), (-1, 9), (0.5, 2)), 2 * 4 * 1.5), (((-9, 9),) * 3, 64), (((4, 9), (0, 4), (0, 4)), 0), (((5, 9), (0, 4), (0, 4)), 0), (((1, 2),) * 3, 1),
    (((-math.inf, 2), (-math.inf, math.inf), (1, math.inf)), 2 * 4 * 3),
])
def test_volume_of_a_clipped_box(spark, box, volume):
    found = K.clipped_volume(*body(spark, CUBE, CUBE_FACES), box).first()
    assert (found["volume"] if found else 0) == pytest.approx(volume, abs=1e-9)


def test_volume_of_clipped_concave_and_slanted_bodies(spark):
    outline = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]  # a U
    points = [(x, y, z) for z in (0, 3) for x, y in outline]
    n = len(outline)
    faces = [tuple(reversed(range(n))), tuple(range(n, 2 * n)), *[(i, (i + 1) % n, n + (i + 1) % n, n + i) for i in range(n)]]
    assert K.clipped_volume(*body(spark, points, faces), ((-1, 9), (4, 5), (1, 2))).first()["volume"] == pytest.approx(4 * 1 * 1)
    assert K.clipped_volume(*body(spark, points, faces), ((1, 5), (1, 9), (-1, 9))).first()["volume"] == pytest.approx(3 * (4 * 1 + 2 * 4))
    tetra = body(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])
    assert K.clipped_volume(*tetra, ((0, 1), (0, 1), (0, 0.5))).first()["volume"] == pytest.approx(1 / 6 - (1 / 2) ** 3 / 6)


def test_clipped_mesh_shares_new_vertices_and_keeps_a_closed_rim(spark):
    vertices, corners = body(spark, CUBE, CUBE_FACES)
    v, c = K.clip_mesh(vertices, corners, ((-9, 9), (-9, 9), (-9, 1)))
    v, c = v.collect(), c.collect()
    assert sorted((r["vid"], r["x"], r["y"], r["z"]) for r in v)[:4] == [(0, 0.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (4, 4.0, 0.0, 0.0), (6, 4.0, 4.0, 0.0)]
    assert sorted(r["vid"] for r in v)[4:] == [8, 9, 10, 11] and len(c) == 20 and {r["vid"] for r in c} == {r["vid"] for r in v}
    uses = {r["uses"]: r["n"] for r in M.edge_uses(M.corner_edges(spark.createDataFrame(c))).groupBy("uses").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert uses == {2: 8, 1: 4}  # the rim at the plane is the only boundary


def test_random_triangles_agree_from_both_sides(spark):
    rng = random.Random(6)
    points = [tuple(rng.uniform(-3, 3) for _ in "xyz") for _ in range(30)]
    faces = [tuple(rng.sample(range(30), 3)) for _ in range(60)]
    vertices, corners = body(spark, points, faces)
    box = ((-1, 2), (-2, 1), (-1.5, 1.5))
    there = {(r["fid"], tuple(sorted((p["x"], p["y"], p["z"]) for p in r["ring"]))) for r in K.clip_rings(K.rings(vertices, corners), box).collect()}
    back = body(spark, points, [tuple(reversed(f)) for f in faces])
    again = {(r["fid"], tuple(sorted((p["x"], p["y"], p["z"]) for p in r["ring"]))) for r in K.clip_rings(K.rings(*back), box).collect()}
    assert there == again and there
    for _, ring in there:
        assert all(-1 <= x <= 2 and -2 <= y <= 1 and -1.5 <= z <= 1.5 for x, y, z in ring)

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from terraloom.operators import compare, mesh, nearest
from terraloom.plans import comparison, conversion, preprocessing, quality
from terraloom.sources import meshes, sinks
from terraloom.sources.meshes import Meshes

BOX = [(x, y, z) for z in (0.0, 20.0) for x, y in ((0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0))]
BOX_FACES = [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]]
TETRA = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
TETRA_FACES = [[0, 2, 1], [0, 1, 3], [1, 2, 3], [2, 0, 3]]


def tables(spark, **models):
    v = [(name, i, *p) for name, (points, _) in models.items() for i, p in enumerate(points)]
    f = [(name, i, loop) for name, (_, loops) in models.items() for i, loop in enumerate(loops)]
    return (
        spark.createDataFrame(v, "model_id string, vid bigint, x double, y double, z double"),
        spark.createDataFrame(f, "model_id string, fid bigint, loop array<bigint>"),
    )


def test_topology_of_closed_and_open_meshes(spark):
    pyramid = ([*TETRA, (1.0, 1.0, 1.0)], [[0, 1, 4], [1, 2, 4], [2, 3, 4]])
    vertices, faces = tables(spark, tetra=(TETRA, TETRA_FACES), box=(BOX, BOX_FACES), pyramid=pyramid)
    corners = mesh.corners_of(faces)
    for edges in (mesh.face_edges(faces), mesh.corner_edges(corners), mesh.corner_edges(corners, 4)):
        got = {r["model_id"]: (r["edges"], r["boundary"], r["non_manifold"], r["orientation"]) for r in mesh.topology_summary(mesh.edge_uses(edges)).collect()}
        assert got == {"tetra": (6, 0, 0, 0), "box": (12, 0, 0, 0), "pyramid": (7, 5, 0, 0)}
    areas = {r["fid"]: r["area"] for r in mesh.face_areas(corners, vertices).filter("model_id = 'box'").collect()}
    assert areas == {0: 5000, 1: 5000, 2: 2000, 3: 1000, 4: 2000, 5: 1000}


def test_box_slice(spark):
    vertices, faces = tables(spark, box=(BOX, BOX_FACES))
    profile = mesh.slice_profile(mesh.slice_points(mesh.corners_of(faces), vertices, "XY", 10.0)).first()
    assert (profile["points"], profile["area"], profile["perimeter"]) == (4, 5000.0, 300.0)


def test_faults_are_found_once(spark):
    bad = ([*TETRA, (0.0, 0.0, 0.0), (2.0, 0.0, 0.0)], [*TETRA_FACES, [0, 1, 2], [0, 1, 99], [0, 1, 5], [1, 2]])
    vertices, faces = tables(spark, bad=bad, bare=(TETRA, []))
    rules = quality.QualityRules()
    models = spark.createDataFrame([("bad",), ("bare",), ("empty",)], "model_id string")
    report = quality.quality_report(spark, quality.mesh_quality_issues(vertices, mesh.corners_of(faces), rules, models), [quality.mesh_coordinates(vertices)], rules)
    codes = [r["code"] for r in report.issues.collect()]
    assert sorted(codes) == sorted([
        "EMPTY_GEOMETRY", "NO_FACES", "INVALID_INDEX", "DEGENERATE_FACE", "DUPLICATE_FACE", "OPEN_BOUNDARY", "NON_MANIFOLD_EDGE", "DUPLICATE_VERTEX",
    ])
    light = preprocessing.mesh_light_issues("m", vertices, mesh.corners_of(faces))
    assert sum(f.count() for f in light) == 3


def test_weld_and_clean(spark):
    points = [*TETRA, (0.0, 0.0, 0.0), (1.0, 0.0, 1e-13)]
    vertices, faces = tables(spark, m=(points, [[4, 2, 1], [0, 1, 2], [0, 4, 1], [3, 2, 5]]))
    kept, corners, actions = mesh.clean_mesh(vertices, mesh.corners_of(faces))
    row = actions.first()
    assert (row["vertices_out"], row["merged_vertices"], row["removed_invalid_faces"], row["removed_duplicate_faces"]) == (5, 1, 1, 1)
    assert {r["fid"]: r["loop"] for r in mesh.loops_of(corners).collect()} == {0: [0, 2, 1], 3: [3, 2, 5]}
    welded, moved = mesh.weld(vertices, mesh.corners_of(faces), 1e-9)
    assert welded.count() == 4 and mesh.loops_of(moved).filter("fid = 3").first()["loop"] == [3, 2, 1]
    far = spark.createDataFrame([("m", 0, 3.4e6, 0.0, 0.0), ("m", 1, 3.4e6, 0.0, 0.0), ("m", 2, 3.4e6 + 1e-6, 0.0, 0.0)], vertices.schema)
    assert mesh.duplicate_vertices(far, 1e-9).first()["n"] == 2


OBJ = "# c\no thing\nv 0 0 0\nv 1 0 0\nv 0 1 0\nf 1/1/1 2//2 3\nv 0 0 1\nf -4 -3 -1\nl 1 2 4\nv bad 0 0\n"
STL = "solid s\n" + "".join(
    "facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in (TETRA[i] for i in f)) + "endloop\nendfacet\n" for f in TETRA_FACES
) + "endsolid s\n"
PLY = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float z\nproperty float y\nproperty float x\nproperty int code\nelement face 4\nproperty list uchar int vertex_indices\nend_header\n"
PLY += "".join(f"{z} {y} {x} {i}\n" for i, (x, y, z) in enumerate(TETRA)) + "".join("3 " + " ".join(map(str, f)) + "\n" for f in TETRA_FACES)
VTK = "# vtk DataFile Version 3.0\nt\nASCII\nDATASET POLYDATA\nPOINTS 4 double\n0 0 0 1 0\n0 0 1 0\n0 0 1\nPOLYGONS 4 16\n" + "".join("3 " + " ".join(map(str, f)) + "\n" for f in TETRA_FACES)
VTK += "LINES 1 3\n2 0 3\n"


def shape(m: Meshes):
    """Faces as coordinate loops, so vertex numbering does not matter."""
    placed = mesh.place_corners(mesh.corners_of(m.faces), m.vertices)
    loops = {}
    for r in placed.orderBy("fid", "pos").collect():
        loops.setdefault(r["fid"], []).append((r["x"], r["y"], r["z"]))
    return [loops[k] for k in sorted(loops)]


WANT = [[TETRA[i] for i in f] for f in TETRA_FACES]


def test_obj(spark, write):
    m = meshes.read_obj(spark, write("a.obj", OBJ), bits=1)
    assert {r["fid"]: r["loop"] for r in m.faces.collect()} == {0: [0, 1, 2], 1: [0, 1, 3]}
    assert m.vertices.count() == 4 and m.lines.first()["path"] == [0, 1, 3] and m.rejected.first()["line_no"] == 10


def test_stl_ply_vtk(spark, write):
    ascii_stl = meshes.read_ascii_stl(spark, write("a.stl", STL), bits=2)
    assert shape(ascii_stl) == WANT and ascii_stl.vertices.count() == 4
    body = b"".join(struct.pack("<12fH", *([0.0] * 3), *[c for i in f for c in TETRA[i]], 0) for f in TETRA_FACES)
    path = write("b.stl", b"\0" * 80 + struct.pack("<I", 4) + body)
    binary = meshes.read_binary_stl(spark, path)
    assert shape(binary) == WANT and binary.vertices.count() == 4
    ply = meshes.read_ply(spark, write("a.ply", PLY))
    assert shape(ply) == WANT and {r["vid"]: r["props"] for r in ply.props.collect()}[2] == {"code": "2"}
    vtk = meshes.read_vtk(spark, write("a.vtk", VTK), bits=1)
    assert shape(vtk) == WANT and vtk.lines.first()["path"] == [0, 3]
    assert meshes.loose_triples(spark, write("c.vtk", VTK)).count() >= 4


@pytest.mark.parametrize("target", ["OBJ", "STL", "PLY", "VTK", "GEOJSON"])
def test_round_trip(spark, folder, target):
    points = [(x * 1.5 + 500000.123456, y, z) for x, y, z in TETRA]
    vertices, faces = tables(spark, good=(points, TETRA_FACES), broken=(TETRA, [[0, 1, 9]]))
    out = f"{folder}/{target}"
    done = conversion.convert(Meshes(vertices, faces), target, out)
    assert {r["model_id"]: r["state"] for r in done.status.collect()} == {"good": "success", "broken": "failed"}
    assert done.summary.first()["state"] == "partial"
    suffix = {"GEOJSON": ".geojson"}.get(target, "." + target.lower())
    parts = sorted(__import__("glob").glob(f"{out}/model_id=good/part-*"))
    text = "".join(open(p).read() for p in parts)
    if target == "GEOJSON":
        text = '{"type": "FeatureCollection", "features": [' + ",".join(text.strip().split("\n")) + "]}"
    path = f"{folder}/back{suffix}"
    open(path, "w").write(text)
    back = conversion.read_models(spark, suffix, path)
    rename = lambda df: df.withColumn("model_id", F.lit("good")) if df is not None else None
    back = Meshes(rename(back.vertices), rename(back.faces), rename(back.lines))
    expected = conversion.facts(Meshes(vertices, faces)).filter("model_id = 'good'")
    checks = {r["check"]: r["passed"] for r in conversion.read_back_check(expected, conversion.facts(back), target).collect()}
    assert all(checks.values()), checks


def test_ifc(spark, write):
    text = "ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n#1=IFCWALL('g1',$);\n#2=IFCWALL('g1',$);\n#2 = IFCCARTESIANPOINT((0.,1.5,2.));\n#4=IFCSITE('',$);\nENDSEC;\nEND-ISO-10303-21;\n"
    s = meshes.read_ifc(spark, write("a.ifc", text))
    audit = meshes.ifc_audit(s).first()
    assert (audit["entities"], audit["products"], audit["points"], audit["duplicate_ids"], audit["duplicate_global_ids"], audit["empty_global_ids"]) == (4, 3, 1, 1, 1, 1)
    assert audit["complete"] and s.filter("point is not null").first()["point"] == ["0.", "1.5", "2."]
    issues = quality.ifc_quality_issues(meshes.ifc_audit(s), quality.QualityRules())
    assert sum(f.count() for f in issues) == 3


def test_coordinates_and_attributes(spark):
    vertices, faces = tables(spark, box=([(x + 500000, y + 3400000, z + 100) for x, y, z in BOX], BOX_FACES))
    moved, offsets = mesh.shift_coordinates(vertices, "min_corner")
    assert tuple(offsets.first())[1:] == (500000.0, 3400000.0, 100.0) and moved.agg(F.min("x")).first()[0] == 0
    assert mesh.shift_coordinates(vertices, "reproject")[1] is None
    props = spark.createDataFrame([("m", 0, {"ID": "1", "colour": "red"})], "model_id string, vid bigint, props map<string,string>")
    assert mesh.keep_attributes(props, "identifiers").first()["props"] == {"ID": "1"} and mesh.keep_attributes(props, "none").first()["props"] == {}
    assert mesh.model_summary(vertices, faces).first()["triangle_count"] == 12
    tri = mesh.triangle_normals(mesh.triangles(faces), vertices).filter("fid = 1").first()
    assert tuple(tri["normal"]) == (0.0, 0.0, 1.0)
    losses = conversion.information_losses(conversion.content_flags(Meshes(vertices, faces, props=props.withColumn("model_id", F.lit("box")))), "stl")
    assert losses.count() == 1 and conversion.normalise_target("geo json / vtk") in ("GEOJSON", "VTK") and conversion.platform_of("ply") == "三维建模软件"
    plan = conversion.conversion_plan(spark.createDataFrame([("a/b.obj",), ("c.dwg",), ("d",)], "path string"), "GeoJSON / VTK")
    assert [(r["supported"], r["target_format"]) for r in plan.collect()] == [(True, "GEOJSON"), (False, "GEOJSON"), (False, "GEOJSON")]
    assert [sinks.general(F.lit(v)) is not None for v in (1.0,)] == [True]
    texts = spark.createDataFrame([(v,) for v in (0.1, 100.0, 1e-7, 1234567890123.0, 0.0, -2.50)], "v double").select(sinks.general(F.col("v"))).collect()
    assert [t[0] for t in texts] == [f"{v:.12g}" for v in (0.1, 100.0, 1e-7, 1234567890123.0, 0.0, -2.50)]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(5)
    cloud = lambda n, s: [("m", rng.gauss(0, s), rng.gauss(0, s), rng.gauss(0, s)) for _ in range(n)]
    # a third of the references share one point, the targets lie partly far outside
    refs = cloud(200, 1) + [("m", 0.5, 0.5, 0.5)] * 150 + cloud(100, 1e-7)
    targets = cloud(150, 3) + [("m", 50.0, -80.0, 10.0)] * 20 + cloud(30, 1e-7)
    schema = "model_id string, x double, y double, z double"
    t, r = spark.createDataFrame(targets, schema), spark.createDataFrame(refs, schema)
    got = {(x["x"], x["y"], x["z"]): x["distance"] for x in nearest.nearest_distances(t, r, ["model_id"], leaf_points=4).collect()}
    brute = {p[1:]: min(math.dist(p[1:], q[1:]) for q in refs) for p in targets}
    assert got.keys() == brute.keys() and all(got[k] == pytest.approx(brute[k], rel=1e-12) for k in brute)
    s = nearest.distance_summary(t, spark.createDataFrame([("m", *k, d) for k, d in got.items()], schema + ", distance double"), ["model_id"]).first()
    ordered = sorted(brute[p[1:]] for p in targets)
    assert s["p95_distance"] == pytest.approx(ordered[math.ceil(len(ordered) * 0.95) - 1]) and s["points"] == 200
    counted = nearest.counted_points(t, ["model_id"])
    again = nearest.distance_summary(counted, nearest.nearest_distances(counted, r, ["model_id"], leaf_points=4), ["model_id"], count="n").first()
    assert counted.count() == len(brute) and again["points"] == 200
    assert [again[k] for k in ("p95_distance", "max_distance", "mean_distance")] == pytest.approx([s[k] for k in ("p95_distance", "max_distance", "mean_distance")])


def test_small_cubes_are_leaves_at_their_own_level(spark, monkeypatch):
    """A dense heap among scattered points: only its cubes are divided further, the rest is opened where it lies."""
    rng = random.Random(7)
    far = [("m", rng.random() * 64, rng.random() * 64, rng.random() * 64) for _ in range(60)]
    heap = [("m", 10 + rng.random() / 64, 10 + rng.random() / 64, 10 + rng.random() / 64) for _ in range(200)]
    seen = []
    real = nearest.materialise
    monkeypatch.setattr(nearest, "materialise", lambda df: seen.append(real(df)) or seen[-1])
    schema = "model_id string, x double, y double, z double"
    got = {(x["x"], x["y"], x["z"]): x["distance"] for x in nearest.nearest_distances(spark.createDataFrame(far + heap[:20], schema), spark.createDataFrame(far[::2] + heap, schema), ["model_id"], leaf_points=8).collect()}
    assert all(got[p[1:]] == pytest.approx(min(math.dist(p[1:], q[1:]) for q in far[::2] + heap), abs=1e-12) for p in far + heap[:20])
    sizes = [df.filter("_full is null").count() for df in seen if "_full" in df.columns]
    assert len(sizes) > 2 and sizes[0] > 0 and seen[-1].count() < 230  # scattered points stop early


def test_strided_sample(spark):
    for n, limit in ((1000, 7), (10, 10), (17, 5), (999, 100), (3, 10)):
        df = spark.range(n).select(F.lit("m").alias("model_id"), F.col("id").alias("vid"))
        got = sorted(r["vid"] for r in nearest.strided_sample(df, ["model_id"], "vid", limit).collect())
        want = list(range(n)) if n <= limit else sorted({min(int(i * (n / limit)), n - 1) for i in range(limit)})
        assert got == want


def test_comparison_report(spark):
    shifted = [(x + 10, y, z) for x, y, z in BOX]
    bv, bf = tables(spark, b0=(BOX, BOX_FACES), b1=(TETRA, TETRA_FACES), b2=(BOX, []))
    av, af = tables(spark, a0=(shifted, BOX_FACES), a1=(TETRA, TETRA_FACES))
    files = lambda rows: spark.createDataFrame(rows, "file_id bigint, name string, model_id string")
    before, after = files([(1, "box_before.obj", "b0"), (2, "T.ply", "b1"), (3, "gone.obj", "b2"), (4, "bad.obj", "nothing")]), files([(7, "t.PLY", "a1"), (8, "box_after.obj", "a0"), (9, "extra.obj", "a1"), (10, "bad.obj", "a1")])
    attrs = lambda rows: spark.createDataFrame(rows, "model_id string, attribute string")
    report = comparison.comparison_report(before, bv, after, av, attrs([("b0", "id"), ("b0", "soil")]), attrs([("a0", "id")]))
    items = report.frames["items"].collect()
    by = {(r["pair_name"], r["metric"]): r for r in items}
    assert by[("T.ply", "diagonal")]["passed"] and not by[("box_before.obj", "centre_shift")]["passed"]
    assert by[("box_before.obj", "lost_fields")]["severity"] == "critical"
    assert {r["metric"] for r in items if r["pair_name"] in ("gone.obj", "extra.obj", "bad.obj")} == {"after_missing", "before_missing", "parse_failed"}
    assert report.summary.first()["total_checks"] == len(items) and report.categories.count() == 5
    pairs = spark.createDataFrame([("p", "b0", "a0", 1, 8, 0.0, 20.0, 0.0, 20.0)], "pair_name string, b_model_id string, a_model_id string, before_id int, after_id int, b_min_z double, b_max_z double, a_min_z double, a_max_z double")
    cut = comparison.pair_slices(pairs, (mesh.corners_of(bf), bv), (mesh.corners_of(af), av)).first()
    assert (cut["before_area"], cut["area_deviation"]) == (5000.0, 0.0)
    points, summary = comparison.difference_map(bv.filter("model_id = 'b0'").withColumn("model_id", F.lit("m")), av.filter("model_id = 'a0'").withColumn("model_id", F.lit("m")), limit=10)
    assert points.count() == 8 and summary.first()["max_distance"] == 10.0


def test_corners_of_the_order_mesh_read_the_lines_once(spark):
    """Faces under three corners fall out where the window has gathered them; a second count would shuffle all lines again."""
    from bindings import tables as B

    corners, largest = B.mesh_corners(spark, "/root/testdata/sf0.001")
    assert corners._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    sizes = corners.groupBy("fid").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    facts = sizes.agg(F.min("n"), F.max("n"), F.count_if(F.col("n") != F.col("last") + 1), F.count(F.lit(1))).first()
    line = B.table(spark, "/root/testdata/sf0.001", "lineitem").groupBy("l_orderkey").count().filter("count >= 3")
    assert tuple(facts) == (3, largest, 0, line.count())


def test_vertices_of_triangles_are_not_broadcast(spark, folder):
    """The size of a compressed file says little about the vertices made from its rows."""
    vertices, faces = tables(spark, tetra=(TETRA, TETRA_FACES))
    vertices.write.parquet(f"{folder}/v")
    normals = mesh.triangle_normals(mesh.triangles(faces), spark.read.parquet(f"{folder}/v"))
    plan = normals._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin" not in plan
    assert normals.count() == 4


def test_mesh_reports_compute_their_corners_once(spark):
    """No check goes back to where the corners come from; faces of two corners and unknown vertices among them."""
    vertices = spark.createDataFrame([("m", i, float(i % 2), float(i // 2), 0.0) for i in range(6)], "model_id string, vid long, x double, y double, z double")
    loops = [("m", 0, [0, 1, 3]), ("m", 1, [0, 3, 2]), ("m", 2, [3, 1, 0]), ("m", 3, [2, 3, 9]), ("m", 4, [4, 5])]
    corners = mesh.corners_of(spark.createDataFrame(loops, "model_id string, fid long, loop array<long>")).filter("fid > -424242")
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "424242" in plan(corners)
    found = quality.mesh_quality_issues(vertices, corners, quality.QualityRules()) + preprocessing.mesh_light_issues("m", vertices, corners)
    checks = {r["check_no"]: r["message"] for df in found for r in df.collect()}
    late = [df for df in found if "424242" in plan(df)]
    assert not late
    assert checks[22].startswith("2 invalid faces") and checks[25] == "2 boundary edges" and checks[26] == "1 non-manifold edges"
    assert checks[24] == "1 repeated faces" and checks[12] == "1 faces refer to unknown vertices"


def test_many_lines_are_dealt_out_by_face(spark, monkeypatch):
    """As many tasks as the lines need, a face in one of them, and the same corners."""
    from bindings import tables as B

    sf = "/root/testdata/sf0.001"
    before = {tuple(r) for r in B.mesh_corners(spark, sf)[0].collect()}
    monkeypatch.setattr(B, "FACE_ROWS", 200)
    lines = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("fid"))
    dealt = B.spread_lines(lines)
    assert dealt.rdd.getNumPartitions() == -(-lines.count() // 200)
    assert dealt.withColumn("p", F.spark_partition_id()).groupBy("fid").agg(F.count_distinct("p").alias("n")).filter("n > 1").isEmpty()
    assert {tuple(r) for r in B.mesh_corners(spark, sf)[0].collect()} == before

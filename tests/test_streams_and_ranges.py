import hashlib
import json
import random
import re

import numpy as np
import pandas as pd
import pytest

from terraloom.sources import byte_ranges as B, json_split as J, meshes, tables, token_streams as T


def loops_of(rng, n, longest):
    return [[rng.randrange(50) for _ in range(rng.randint(0, longest))] for _ in range(n)]


def frame(spark, streams):
    rows = [(name, k, v) for name, numbers in streams.items() for k, v in enumerate(numbers)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["s", "k", "v"]), "s string, k long, v long")


@pytest.mark.parametrize("chunk", [8, 32])
def test_records_of_a_stream(spark, chunk, monkeypatch):
    rng = random.Random(chunk)
    made = {"a": loops_of(rng, 200, 5), "b": loops_of(rng, 3, 2), "long": [[1] * 3, [7] * 100, [2, 2]], "cut": [[1, 2], [3]]}
    streams = {name: [x for loop in loops for x in (len(loop), *loop)] for name, loops in made.items()}
    streams["cut"] += [9, 1, 1]  # its last record never ends
    streams["broken"] = [1, 5, -1, 2, 3]
    made["broken"] = [[5]]
    got = {}
    for r in T.records(frame(spark, streams), ["s"], chunk).collect():
        got.setdefault(r["s"], {})[r["record"]] = list(r["items"])
    assert {name: [got[name][i] for i in range(len(got[name]))] for name in got} == made


def test_exit_map():
    exits, counts = T.exit_map(np.array([1, 9, 0, 2, 5]), 8)
    assert exits[:5].tolist() == [1, 6, 1, 1, 5] and counts[:5].tolist() == [3, 1, 2, 1, 1]
    assert T.exit_map(np.array([-1, 20]), 8)[0][:2].tolist() == [-1, -1]


def test_maps_are_no_longer_than_their_chunks(spark, monkeypatch):
    """Thousands of short streams must not cost a whole chunk each."""
    seen, kept = [], T.record_entries
    monkeypatch.setattr(T, "record_entries", lambda maps, keys: (seen.append(maps), kept(maps, keys))[1])
    loops = {f"s{i}": [[i], [1, 2]] for i in range(40)}
    streams = {name: [x for loop in made for x in (len(loop), *loop)] for name, made in loops.items()}
    found = T.records(frame(spark, streams), ["s"], 1024)
    assert {len(r["exits"]) for r in seen[0].collect()} == {5}
    assert sorted((r["s"], r["record"], list(r["items"])) for r in found.collect()) == sorted((s, k, loop) for s, made in loops.items() for k, loop in enumerate(made))


VTK = """# vtk DataFile Version 3.0
t
ASCII
DATASET POLYDATA
POINTS {n} float
{points}
POLYGONS {m} {size}
{cells}
LINES 1 3
2 0 1
"""


@pytest.mark.parametrize("width", [1, 10])
def test_vtk_words_may_be_wrapped_anywhere(spark, write, width):
    rng = random.Random(3)
    points = [[rng.randrange(9) for _ in "xyz"] for _ in range(40)]
    loops = [[rng.randrange(40) for _ in range(rng.randint(3, 9))] for _ in range(60)]
    words = [str(x) for loop in loops for x in (len(loop), *loop)]

    def text(wrapped):
        lines = [" ".join(words[i : i + width]) for i in range(0, len(words), width)] if wrapped else [" ".join(map(str, (len(x), *x))) for x in loops]
        flat = [str(c) for p in points for c in p]
        shown = [" ".join(flat[i : i + width]) for i in range(0, len(flat), width)] if wrapped else [" ".join(map(str, p)) for p in points]
        return VTK.format(n=40, points="\n".join(shown), m=60, size=len(words), cells="\n".join(lines))

    found = []
    for name, wrapped in (("wrapped.vtk", True), ("plain.vtk", False)):
        m = meshes.read_vtk(spark, write(name, text(wrapped)), bits=3, chunk=16)
        found.append((
            sorted((r["vid"], r["x"], r["y"], r["z"]) for r in m.vertices.collect()), sorted((r["fid"], list(r["loop"])) for r in m.faces.collect()),
            [(r["lid"], list(r["path"])) for r in m.lines.collect()],
        ))
    assert found[0] == found[1] == (
        [(i, *map(float, p)) for i, p in enumerate(points)], [(i, x) for i, x in enumerate(loops)], [(0, [0, 1])]
    )


# --- JSON documents ---------------------------------------------------------------------------


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return "".join(rng.choice('ab"\\{}[],: é\n') for _ in range(rng.randint(0, 9)))
    if kind < 5:
        return [None, True, 1.5, rng.randrange(99), "plain"][kind]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["type", "features", "a", 'k"{', "versions"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}


@pytest.mark.parametrize("indent,seed", [(None, 1), (2, 2)])
def test_documents_are_split_into_their_objects(spark, folder, write, indent, seed):
    rng = random.Random(seed)
    rich = lambda: {"type": "Feature", "id": value(rng), "properties": {"v": value(rng)}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    docs = {
        "many.json": {"crs": {"type": "name", "x": {"features": [{"no": 1}]}}, "type": "FeatureCollection", "bbox": [1, [2]], "features": [rich() for _ in range(40)], "end": {"a": [{}]}},
        "none.json": {"type": "FeatureCollection", "features": []}, "list.json": [{"a": value(rng)} for _ in range(9)], "empty.json": [], "one.json": rich(),
        "plain.json": {"features": [{"a": 1}, {"b": 2}], "type": "Other"}, "odd.json": {"type": "FeatureCollection", "features": [None, {"a": {}}, 3, {"b": "]}"}]},
        "late.json": {"features": [{"p": "}"}, {}], "type": "FeatureCollection"},
    }
    for name, doc in docs.items():
        write(name, json.dumps(doc, indent=indent, ensure_ascii=seed == 1) + ("\n" if indent else ""))
    items, shells = J.split_documents(spark, f"{folder}/*.json", "features", "FeatureCollection")
    got = {}
    for r in items.collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["ordinal"]] = json.loads(r["value"])
    expected = {"many.json": docs["many.json"]["features"], "list.json": docs["list.json"], "odd.json": [{"a": {}}, {"b": "]}"}], "late.json": docs["late.json"]["features"]}
    assert {name: [got[name][i] for i in range(len(got[name]))] for name in got} == expected
    kept = {r["file"].rsplit("/", 1)[1]: r for r in shells.collect()}
    assert set(kept) == set(docs)
    for name, r in kept.items():
        doc = docs[name]
        assert r["is_split"] == (name not in ("one.json", "plain.json")) and r["is_list"] == isinstance(doc, list)
        assert json.loads(r["shell"]) == ([] if isinstance(doc, list) else {**doc, "features": []} if r["is_split"] else doc)
    rows = tables.read_json_records(spark, f"{folder}/*.json").collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["ordinal"], r["json_type"]) for r in rows) == sorted(
        [(n, i, "List" if n == "list.json" else "FeatureCollection") for n, x in expected.items() for i in range(len(x))] + [("one.json", 0, "Feature"), ("plain.json", 0, "Object")])
    first = next(r for r in rows if r["file"].endswith("many.json") and r["ordinal"] == 7)
    assert json.loads(first["geometry"]) == docs["many.json"]["features"][7]["geometry"] and set(first["props"]) == {"v"}


# --- byte ranges ------------------------------------------------------------------------------


def binary_stl(points):
    raw = np.zeros(len(points), meshes._STL_RECORD)
    raw["points"] = points
    return b"solid but binary".ljust(80) + np.uint32(len(points)).tobytes() + raw.tobytes()


def test_stl_files_of_both_kinds_by_ranges(spark, folder, write):
    rng = np.random.default_rng(1)
    triangles = {"a b.stl": rng.integers(0, 5, (23, 3, 3)), "two.stl": rng.integers(0, 5, (7, 3, 3)), "text.stl": rng.integers(0, 5, (4, 3, 3))}
    for name, t in triangles.items():
        if name == "text.stl":
            write(name, "solid t\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {x} {y} {z}\n" for x, y, z in f) + "endloop\nendfacet\n" for f in t) + "endsolid t\n")
        else:
            write(name, binary_stl(t))
    write("short.stl", b"\x00" * 30)
    write("wrong.stl", binary_stl(rng.integers(0, 5, (3, 3, 3)))[:-1])
    for size in (50, 333, 1 << 20):
        m = meshes.read_stl(spark, f"{folder}/*.stl", weld_tolerance=None, range_bytes=size)
        got = {}
        for r in m.vertices.collect():
            got.setdefault(r["model_id"].rsplit("/", 1)[1].replace("%20", " "), {})[r["vid"]] = (r["x"], r["y"], r["z"])
        assert {n: [got[n][i] for i in range(len(got[n]))] for n in got} == {n: [tuple(map(float, p)) for p in t.reshape(-1, 3)] for n, t in triangles.items()}
    kinds = {r["path"].rsplit("/", 1)[1]: r["binary"] for r in meshes.stl_kinds(spark, f"{folder}/*.stl").collect()}
    assert kinds == {"a%20b.stl": True, "two.stl": True, "text.stl": False, "short.stl": False, "wrong.stl": False}
    assert B.ranges(meshes.stl_kinds(spark, f"{folder}/two.stl").drop("binary"), 84, 50, 100).count() == 4
    sums = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in B.checksums(spark, folder).collect()}
    assert sums["two.stl"] == hashlib.sha256(open(f"{folder}/two.stl", "rb").read()).hexdigest() and len(sums) == 5


def test_segments_of_documents_are_not_broadcast(spark, write):
    """A compressed table of repetitive text is small on disk only; joins of its rows must shuffle."""
    text = '{"versions": [' + ",".join('{"version_id": "V%d", "tags": ["a", "b}"]}' % i for i in range(500)) + "]}"
    items, _ = J.split_documents(spark, write("versions.json", text), "versions")
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[file#\w+, line_no#", plan) and not re.search(r"BroadcastHashJoin \[file#\w+, line_no#", plan)
    assert items.count() == 500

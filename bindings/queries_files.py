"""Registered queries that write files from the tables, one file for each block of 256 customers or orders, and read them back.

Their SQL is in ``oracle_files``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bindings.queries import QUERIES, _scratch, _versions, query, rounded
from bindings.tables import table
from terraloom.operators import versions
from terraloom.sources import byte_ranges, files, manifests, meshes, sinks, tables

__all__ = ["QUERIES"]

BLOCK = 256


def _blocks(spark, sf) -> DataFrame:
    """(g, n, c): customers of a block in order, as structs of i (place), x, y, z and k (3 to 6)."""
    key = F.col("c_custkey")
    row = F.struct(
        F.pmod(key, F.lit(BLOCK)).cast("int").alias("i"), (key % 100).alias("x"), F.col("c_nationkey").alias("y"), F.col("c_acctbal").cast("string").alias("z"), (key % 4 + 3).cast("int").alias("k"))
    return table(spark, sf, "customer").groupBy(F.floor(key / BLOCK).cast("int").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("c"))


def _written(spark, name: str, texts: DataFrame) -> str:
    """Write (g, text) as one file for each g."""
    path = _scratch(spark, name)
    texts.select("g", "text").write.partitionBy("g").text(path)
    return path


def _g(column: str = "model_id"):
    return F.regexp_extract(column, r"/g=(\d+)/", 1).cast("int").alias("g")


def _ids(i, k):
    """k neighbouring places from i on, around the block."""
    return F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.pmod(i + j, F.col("n")))


def _wrapped(words, width: int = 10):
    return F.regexp_replace(F.array_join(words, " "), rf"((?:\S+ ){{{width - 1}}}\S+) ", "$1\n")


def _place(c):
    # places of the first block begin at 1
    return c["i"] - F.col("c")[0]["i"]


def _summary(m: meshes.Meshes) -> DataFrame:
    points = m.vertices.groupBy("model_id").agg(F.count(F.lit(1)).alias("vertices"), F.sum("x").alias("x"), F.round(F.sum("z"), 2).alias("z"))
    cells = m.faces.groupBy("model_id").agg(F.count(F.lit(1)).alias("faces"), F.sum(F.size("loop")).alias("corners"), F.sum(F.aggregate("loop", F.lit(0).cast("bigint"), lambda s, v: s + v)).alias("ids"))
    return points.join(cells, "model_id").select(_g(), "vertices", "x", "z", "faces", "corners", "ids")


@query
def vtk_words(spark, sf):
    """VTK polygons of three to six corners, ten words to a line wherever that cuts them."""
    flat = lambda make: F.flatten(F.transform("c", make))
    points = flat(lambda c: F.array(c["x"].cast("string"), c["y"].cast("string"), c["z"]))
    cells = flat(lambda c: F.concat(F.array(c["k"].cast("string")), F.transform(_ids(_place(c), c["k"]), lambda v: v.cast("string"))))
    text = F.concat(
        F.lit("# vtk DataFile Version 3.0\nblock\nASCII\nDATASET POLYDATA\nPOINTS "), F.col("n"), F.lit(" double\n"), _wrapped(points),
        F.lit("\nPOLYGONS "), F.col("n"), F.lit(" "), F.size(cells), F.lit("\n"), _wrapped(cells),
    )
    path = _written(spark, "vtk", _blocks(spark, sf).select("g", text.alias("text")))
    return _summary(meshes.read_vtk(spark, f"{path}/*/*.txt"))


@query
def ply_properties(spark, sf):
    """ASCII PLY with a further vertex property."""
    vertex = F.transform("c", lambda c: F.concat_ws(" ", c["x"], c["k"], c["y"], c["z"]))
    face = F.transform("c", lambda c: F.concat_ws(" ", c["k"], F.array_join(_ids(_place(c), c["k"]), " ")))
    head = F.format_string(
        "ply\nformat ascii 1.0\nelement vertex %d\nproperty float x\nproperty int quality\nproperty float y\nproperty float z\nelement face %d\nproperty list uchar int vertex_indices\nend_header\n", "n", "n")
    path = _written(spark, "ply", _blocks(spark, sf).select("g", F.concat(head, F.array_join(vertex, "\n"), F.lit("\n"), F.array_join(face, "\n")).alias("text")))
    m = meshes.read_ply(spark, f"{path}/*/*.txt")
    quality = m.props.groupBy(_g()).agg(F.sum(F.col("props.quality").cast("bigint")).alias("quality"))
    return _summary(m).join(quality, "g")


@query
def stl_text(spark, sf):
    """Text STL through the reader of both kinds: headers are looked at first; equal corners are welded."""
    line = lambda *xyz: F.concat(F.lit("vertex "), F.concat_ws(" ", *xyz))
    facet = F.transform("c", lambda c: F.concat_ws("\n", F.lit("facet normal 0 0 0\nouter loop"), line(c["x"], c["y"], c["k"]), line(c["x"] + 1, c["y"], c["k"]), line(c["x"], c["y"] + 1, c["k"]), F.lit("endloop\nendfacet")))
    text = F.concat(F.lit("solid block\n"), F.array_join(facet, "\n"), F.lit("\nendsolid block"))
    path = _written(spark, "stl", _blocks(spark, sf).select("g", text.alias("text")))
    m = meshes.read_stl(spark, f"{path}/*/*.txt")
    counted = m.vertices.groupBy("model_id").agg(F.count(F.lit(1)).alias("vertices"), F.sum("x").alias("x"))
    return counted.join(m.faces.groupBy("model_id").agg(F.count(F.lit(1)).alias("faces")), "model_id").select(_g(), "vertices", "x", "faces")


@query
def ifc_statements(spark, sf):
    """STEP text: entities, products, points, repeated ids and GlobalIds of every file."""
    gid = lambda c: F.when(c["i"] % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("g"), c["i"] % 100))
    wall = lambda c: F.concat(F.lit("#"), c["i"] % 200, F.lit("=IFCWALL('"), gid(c), F.lit("',$)"))
    point = lambda c: F.concat(F.lit("#"), c["i"] + 1000, F.lit("=IFCCARTESIANPOINT(("), F.concat_ws(",", c["x"], c["y"], c["z"]), F.lit("))"))
    body = F.array_join(F.transform("c", lambda c: F.concat_ws(";\n", wall(c), point(c))), ";\n")
    text = F.concat(F.lit("ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n"), body, F.when(F.col("g") % 3 == 0, F.lit("")).otherwise(F.lit(";\nENDSEC;\nEND-ISO-10303-21;")))
    path = _written(spark, "ifc", _blocks(spark, sf).select("g", text.alias("text")))
    audit = meshes.ifc_audit(meshes.read_ifc(spark, f"{path}/*/*.txt"))
    return audit.select(_g("file"), "entities", "products", "points", "empty_global_ids", "complete", "duplicate_ids", "duplicate_global_ids")


@query
def json_documents(spark, sf):
    """Feature collections and lists, each a document of many lines or of one, taken apart into their objects."""
    props = lambda c: F.concat(F.lit('{"no": '), c["i"], F.lit(', "name": "} \\"[{ \\\\", "deep": {"features": [{}]}}'))
    place = lambda c: F.concat(F.lit('{"type": "Point", "coordinates": ['), F.concat_ws(", ", c["x"], c["y"], c["z"]), F.lit("]}"))
    feature = F.transform("c", lambda c: F.concat(F.lit('{"type": "Feature", "properties": '), props(c), F.lit(', "geometry": '), place(c), F.lit("}")))
    gap = F.when(F.col("g") % 2 == 0, F.lit(",\n  ")).otherwise(F.lit(","))
    collection = F.concat(F.lit('{"crs": {"features": [{"a": 1}]}, "type": "FeatureCollection", "features": ['), F.array_join(feature, "\u0001"), F.lit('], "end": {"a": [{}]}}'))
    listed = F.concat(F.lit("["), F.array_join(F.transform("c", props), "\u0001"), F.lit("]"))
    text = F.replace(F.when(F.col("g") % 3 == 1, listed).otherwise(collection), F.lit("\u0001"), gap)
    path = _written(spark, "json", _blocks(spark, sf).select("g", text.alias("text")))
    rows = tables.read_json_records(spark, f"{path}/*/*.txt")
    return rows.groupBy(_g("file"), "json_type").agg(
        F.count(F.lit(1)).alias("rows"), F.max("ordinal").alias("last"), F.sum(F.col("props.no").cast("bigint")).alias("no"),
        F.sum(F.get_json_object("geometry", "$.coordinates[0]").cast("bigint")).alias("x"), F.count_if(F.col("props.name") == '} "[{ \\').alias("names"),
    )


@query
def version_documents(spark, sf):
    """Version manifests, a document for each block of orders."""
    key = F.col("o_orderkey")
    item = F.format_string('{"version_id": "V%d", "version_number": "1.%d", "created_at": "%s", "tags": ["a", "b}"], "output_files": [{"path": "../out/f%d.csv"}]}', key, key % 7, F.date_format("o_orderdate", "yyyy-MM-dd"), key % 5)
    grouped = table(spark, sf, "orders").groupBy(F.floor(key / (4 * BLOCK)).cast("int").alias("g")).agg(F.array_join(F.array_sort(F.collect_list(item)), ",\n").alias("items"))
    text = F.concat(F.lit('{"project_name": "p'), "g", F.lit('", "versions": ['), "items", F.lit('], "module_name": "m"}'))
    path = _written(spark, "versions", grouped.select("g", text.alias("text")))
    found = manifests.read_version_manifests(spark, f"{path}/*/*.txt")
    return found.groupBy("project_name", "module_name", "version_number").agg(
        F.count(F.lit(1)).alias("versions"), F.min("created_at").alias("first"), F.sum(F.size("tags")).alias("tags"), F.max(F.col("output_files")[0]["name"]).alias("last_file"))


def _key_texts(spark, sf):
    return _blocks(spark, sf).select("g", F.array_join(F.transform("c", lambda c: c["z"]), "\n").alias("text"))


@query
def file_scan(spark, sf):
    """Written files by category."""
    path = _written(spark, "scan", _key_texts(spark, sf))
    return files.format_summary(files.scan_directories(spark, [path], ["*.txt"])).select("category", "count", "size_bytes")


@query
def file_digests(spark, sf):
    """SHA-256 of every file, streamed."""
    path = _written(spark, "digests", _key_texts(spark, sf))
    return byte_ranges.checksums(spark, f"{path}/*/*.txt").select(_g("path"), "length", "sha256")


@query
def run_manifest(spark, sf):
    """Two runs appended to a manifest table with the register of their outputs."""
    store = _scratch(spark, "manifest")
    for run in ("first", "second"):
        path = _written(spark, run, _key_texts(spark, sf))
        register = sinks.output_register(spark, f"{path}/*/*.txt", run)
        sinks.append_manifest(spark, store, run, "export", {"block": BLOCK}, {"files": register.count()}, register)
    runs, outputs = spark.read.parquet(f"{store}/runs"), spark.read.parquet(f"{store}/outputs")
    counted = outputs.groupBy("run_id").agg(F.count(F.lit(1)).alias("outputs"), F.sum("length").alias("bytes"), F.count_distinct("sha256").alias("digests"))
    return runs.join(counted, "run_id").select("run_id", "kind", F.col("parameters.block").alias("block"), F.col("metrics.files").alias("files"), "outputs", "bytes", "digests")


@query
def archive_tables(spark, sf):
    """Facet tables of the archived versions, written and read back."""
    v = _versions(spark, sf)
    done = versions.archive(v, v.filter("archived").select("version_id"), "/arch")
    outs = table(spark, sf, "orders").select(F.concat(F.lit("out"), F.substring("o_orderpriority", 1, 1)).alias("path")).distinct().filter("path <> 'out5'").withColumn("length", F.lit(10).cast("bigint"))
    path = _scratch(spark, "archive")
    sinks.write_archive(done, versions.archive_manifest(done, outs), versions.lineage(done), path)
    facets = None
    for name in ("metadata", "lineage", "quality", "parameters", "workflow", "copies"):
        part = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("version_id").alias("versions")).select(F.lit(name).alias("facet"), "rows", "versions")
        facets = part if facets is None else facets.unionByName(part)
    return facets


@query
def stl_writer(spark, sf):
    """Triangles of a block written as STL text by the sink and read back."""
    c = _blocks(spark, sf).select(F.concat(F.lit("m"), "g").alias("model_id"), F.explode("c").alias("c")).select("model_id", "c.i", "c.x", "c.y", "c.k")
    corner = [(0, 0), (1, 0), (0, 1)]
    vertices = c.select("model_id", F.inline(F.array(*[F.struct((F.col("i") * 3 + j).cast("bigint").alias("vid"), (F.col("x") + a).cast("double").alias("x"), (F.col("y") + b).cast("double").alias("y"), F.col("k").cast("double").alias("z")) for j, (a, b) in enumerate(corner)])))
    faces = c.select("model_id", F.col("i").cast("bigint").alias("fid"), F.array(*[(F.col("i") * 3 + j).cast("bigint") for j in range(3)]).alias("loop"))
    path = _scratch(spark, "stl")
    sinks.write_mesh_text(sinks.mesh_lines(vertices, faces, "STL"), path)
    m = meshes.read_ascii_stl(spark, f"{path}/*/*", weld_tolerance=None)
    return rounded(m.vertices.agg(F.count(F.lit(1)).alias("vertices"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("z").alias("z")), x=2, y=2, z=2)

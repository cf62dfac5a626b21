"""Writers: tables, GeoJSON lines, vertex tables, text meshes, sidecars, manifests, archives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.operators import mesh
from terraloom.sources.byte_ranges import checksums

TEXT_FORMATS = ("OBJ", "STL", "PLY", "VTK")
TITLE = "text mesh export"


def general(number: Column) -> Column:
    """Twelve significant digits without trailing zeros."""
    text = F.format_string("%.12g", number.cast("double"))
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    return F.when(number == 0, "0").otherwise(plain)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", "true").csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def feature_lines(vertices: DataFrame, corners: DataFrame, lines: DataFrame | None = None, face_props: DataFrame | None = None,
                  vertex_props: DataFrame | None = None) -> DataFrame:
    """(model_id, ordinal, value): one GeoJSON feature per line.

    Polygons where a model has faces, LineStrings where it has lines, Points only where it has neither.
    """
    def shaped(rows: DataFrame) -> DataFrame:
        placed = mesh.place_corners(rows, vertices)
        points = F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y", "z").alias("p"))))
        return placed.groupBy("model_id", "fid").agg(F.transform(points, lambda s: s["p"]).alias("points"))

    def feature(kind: str, coordinates: Column, id_name: str, number: Column, props: Column) -> Column:
        own = F.create_map(F.lit("source"), F.col("model_id"), F.lit(id_name), number.cast("string"))
        extra = F.map_filter(F.coalesce(props, F.expr("map()").cast("map<string,string>")), lambda k, v: ~k.isin("source", id_name))
        return F.to_json(F.struct(
            F.lit("Feature").alias("type"), F.map_concat(own, extra).alias("properties"),
            F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        ))

    no_props = F.lit(None).cast("map<string,string>")
    polygons = shaped(corners)
    if face_props is not None:
        polygons = polygons.join(face_props, ["model_id", "fid"], "left")
    ring = F.when(F.size("points") > 0, F.when(F.col("points")[0] == F.element_at("points", -1), F.col("points")).otherwise(F.array_append("points", F.col("points")[0])))
    out = polygons.select(
        "model_id", F.col("fid").alias("ordinal"),
        feature("Polygon", F.array(ring), "face_id", F.col("fid") + 1, F.col("props") if face_props is not None else no_props).alias("value"),
    )
    with_shapes = corners.select("model_id")
    if lines is not None:
        paths = shaped(lines).select("model_id", F.col("fid").alias("ordinal"), feature("LineString", F.col("points"), "line_id", F.col("fid") + 1, no_props).alias("value"))
        out, with_shapes = out.unionByName(paths), with_shapes.unionByName(lines.select("model_id"))
    bare = vertices.join(with_shapes.distinct(), "model_id", "left_anti")
    if vertex_props is not None:
        bare = bare.join(vertex_props, ["model_id", "vid"], "left")
    points = bare.select(
        "model_id", F.col("vid").alias("ordinal"),
        feature("Point", F.array("x", "y", "z"), "point_id", F.col("vid") + 1, F.col("props") if vertex_props is not None else no_props).alias("value"),
    )
    return out.unionByName(points)


def vertex_table(vertices: DataFrame, props: DataFrame | None = None, names: Sequence[str] = ()) -> DataFrame:
    """vertex_id from 1, x, y, z and attribute columns."""
    rows = vertices if props is None else vertices.join(props, ["model_id", "vid"], "left")
    extra = [F.try_element_at("props", F.lit(n)).alias(n) for n in names] if props is not None else []
    return rows.select("model_id", (F.col("vid") + 1).alias("vertex_id"), "x", "y", "z", *extra)


def mesh_lines(vertices: DataFrame, faces: DataFrame, fmt: str, lines: DataFrame | None = None) -> DataFrame:
    """(model_id, section, ordinal, value): the text of one file per model, to be read in that order.

    faces(model_id, fid, loop), lines(model_id, lid, path), vids dense from 0. Models without faces and
    lines get a points-only form; STL needs faces.
    """
    fmt = fmt.upper()
    if fmt not in TEXT_FORMATS:
        raise ValueError(f"unsupported text format {fmt}")
    spark_lines = lines if lines is not None else faces.sparkSession.createDataFrame([], "model_id string, lid bigint, path array<bigint>")
    text = lambda a, sep=" ": F.array_join(F.transform(a, lambda i: i.cast("string")), sep)
    row = lambda df, section, ordinal, value: df.select("model_id", F.lit(section).alias("section"), ordinal.cast("bigint").alias("ordinal"), value.alias("value"))
    if fmt == "STL":
        return _stl_lines(vertices, faces, row)
    xyz = F.concat_ws(" ", *[general(F.col(a)) for a in "xyz"])
    n_v = vertices.groupBy("model_id").agg(F.count(F.lit(1)).alias("nv"))
    n_f = faces.groupBy("model_id").agg(F.count(F.lit(1)).alias("nf"), F.sum(F.size("loop") + 1).alias("wf"))
    n_l = spark_lines.groupBy("model_id").agg(F.count(F.lit(1)).alias("nl"), F.sum(F.size("path") + 1).alias("wl"))
    facts = n_v.join(n_f, "model_id", "left").join(n_l, "model_id", "left").na.fill(0)
    bare = vertices.join(facts.filter("nf = 0 and nl = 0").select("model_id"), "model_id", "left_semi")
    shift = (lambda a: F.transform(a, lambda i: i + 1)) if fmt == "OBJ" else (lambda a: a)
    s = lambda c: F.col(c).cast("string")
    if fmt == "OBJ":
        head = row(facts, 0, F.lit(0), F.concat(F.lit("o "), F.regexp_replace("model_id", r"\s", "_")))
        parts = [
            row(vertices, 1, F.col("vid"), F.concat(F.lit("v "), xyz)), row(faces, 2, F.col("fid"), F.concat(F.lit("f "), text(shift(F.col("loop"))))),
            row(spark_lines, 3, F.col("lid"), F.concat(F.lit("l "), text(shift(F.col("path"))))),
            row(bare, 4, F.col("vid"), F.concat(F.lit("p "), (F.col("vid") + 1).cast("string"))),
        ]
    elif fmt == "PLY":
        header = F.array(
            F.lit("ply"), F.lit("format ascii 1.0"), F.lit(f"comment {TITLE}"), F.concat(F.lit("element vertex "), s("nv")),
            *[F.lit(f"property double {a}") for a in "xyz"], F.concat(F.lit("element face "), s("nf")),
            F.lit("property list uchar int vertex_indices"), F.lit("end_header"),
        )
        head = facts.select("model_id", F.lit(0).alias("section"), F.posexplode(header).alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
        parts = [row(vertices, 1, F.col("vid"), xyz), row(faces, 2, F.col("fid"), F.concat_ws(" ", F.size("loop").cast("string"), text(F.col("loop"))))]
    else:
        header = F.array(F.lit("# vtk DataFile Version 3.0"), F.lit(TITLE), F.lit("ASCII"), F.lit("DATASET POLYDATA"), F.concat(F.lit("POINTS "), s("nv"), F.lit(" double")))
        head = facts.select("model_id", F.lit(0).alias("section"), F.posexplode(header).alias("ordinal", "value")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
        record = lambda c: F.concat_ws(" ", F.size(c).cast("string"), text(F.col(c)))
        parts = [
            row(vertices, 1, F.col("vid"), xyz),
            row(facts.filter("nf > 0"), 2, F.lit(0), F.concat_ws(" ", F.lit("POLYGONS"), s("nf"), s("wf"))), row(faces, 3, F.col("fid"), record("loop")),
            row(facts.filter("nl > 0"), 4, F.lit(0), F.concat_ws(" ", F.lit("LINES"), s("nl"), s("wl"))), row(spark_lines, 5, F.col("lid"), record("path")),
            row(facts.filter("nf = 0 and nl = 0"), 6, F.lit(0), F.concat_ws(" ", F.lit("VERTICES"), s("nv"), (F.col("nv") * 2).cast("string"))),
            row(bare, 7, F.col("vid"), F.concat(F.lit("1 "), F.col("vid").cast("string"))),
        ]
    out = head
    for p in parts:
        out = out.unionByName(p)
    return out


def _stl_lines(vertices, faces, row):
    tri = mesh.triangle_normals(mesh.triangles(faces), vertices)
    words = lambda p: F.concat_ws(" ", *[general(F.col(f"{p}.{a}")) for a in "xyz"])
    body = F.array(
        F.concat(F.lit("  facet normal "), words("normal")), F.lit("    outer loop"),
        *[F.concat(F.lit("      vertex "), words(f"p_{c}")) for c in "abc"], F.lit("    endloop"), F.lit("  endfacet"),
    )
    names = faces.select("model_id").distinct()
    facets = tri.select("model_id", F.lit(1).alias("section"), F.col("fid").alias("ordinal"), "part", F.posexplode(body).alias("i", "value"))
    facets = facets.select("model_id", "section", F.col("ordinal").cast("bigint").alias("ordinal"), "value", "part", "i")
    row = lambda df, section, ordinal, value, plain=row: plain(df, section, ordinal, value).withColumns({"part": F.lit(0).cast(tri.schema["part"].dataType), "i": F.lit(0)})
    name = F.regexp_replace("model_id", r"\s", "_")
    return (
        row(names, 0, F.lit(0), F.concat(F.lit("solid "), name)).unionByName(facets)
        .unionByName(row(names, 2, F.lit(0), F.concat(F.lit("endsolid "), name)))
    )


def write_mesh_text(lines: DataFrame, path: str) -> None:
    """One folder per model; its part files in name order are the text. A large model spans several parts."""
    order = ["model_id", "section", "ordinal", *[c for c in ("part", "i") if c in lines.columns]]
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("model_id", "value").write.mode("overwrite").partitionBy("model_id").text(path)


def attribute_sidecar(vertex_props: DataFrame | None, face_props: DataFrame | None, metadata: DataFrame | None = None) -> DataFrame:
    """What the main file cannot hold: (model_id, owner, owner_id, props)."""
    parts = []
    if vertex_props is not None:
        parts.append(vertex_props.select("model_id", F.lit("vertex").alias("owner"), F.col("vid").alias("owner_id"), "props"))
    if face_props is not None:
        parts.append(face_props.select("model_id", F.lit("face").alias("owner"), F.col("fid").alias("owner_id"), "props"))
    if metadata is not None:
        parts.append(metadata.select("model_id", F.lit("model").alias("owner"), F.lit(None).cast("bigint").alias("owner_id"), "props"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.size(F.map_keys("props")) > 0)


def needs_sidecar(fmt: Column, has_faces: Column, has_lines: Column, vertex_props: Column, face_props: Column, metadata: Column) -> Column:
    return (
        F.when(fmt == "CSV", has_faces | has_lines | face_props | metadata)
        .when(fmt == "GEOJSON", metadata | (has_faces & vertex_props))
        .otherwise(vertex_props | face_props | metadata)
    )


def output_register(spark, output: str, run_id: str) -> DataFrame:
    """run_id, path, length, sha256 of every file under an output folder."""
    return checksums(spark, output).select(F.lit(run_id).alias("run_id"), "path", "length", "sha256")


def append_manifest(spark, table_path: str, run_id: str, kind: str, parameters: Mapping[str, object], metrics: Mapping[str, int], outputs: DataFrame | None = None) -> None:
    """Append one run (parameters, row counts, output digests) to the manifest table."""
    base = spark.createDataFrame(
        [(run_id, kind, {k: str(v) for k, v in parameters.items()}, {k: int(v) for k, v in metrics.items()})],
        "run_id string, kind string, parameters map<string,string>, metrics map<string,bigint>",
    )
    base.write.mode("append").parquet(f"{table_path}/runs")
    if outputs is not None:
        outputs.write.mode("append").parquet(f"{table_path}/outputs")


def write_archive(versions: DataFrame, manifest: DataFrame, trace: DataFrame, path: str) -> None:
    """Facet tables of archived versions, each in order of the version id, so that one version is a few row groups and no folder of its own."""
    done = versions.filter("archived")
    facets = {
        "metadata": done.select("version_id", "version_number", "project_name", "module_name", "description", "created_at", "created_by", "archive_path", "tags"),
        "lineage": trace.join(done.select("version_id"), "version_id", "left_semi"),
        "quality": done.select("version_id", "quality_results"),
        "parameters": done.select("version_id", "conversion_params"),
        "workflow": done.select("version_id", "workflow_steps"),
        "copies": manifest,
    }
    for name, frame in facets.items():
        frame.repartitionByRange("version_id").sortWithinPartitions("version_id").write.mode("overwrite").parquet(f"{path}/{name}")

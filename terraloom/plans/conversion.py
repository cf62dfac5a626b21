"""Conversion of mesh corpora: plan, losses, export, read-back check, status and score."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import values as V
from terraloom.functions.ordering import chunked_index, id_chunk
from terraloom.operators import mesh
from terraloom.session import cut_lineage
from terraloom.sources import features, meshes, sinks, tables
from terraloom.sources.meshes import Meshes

TARGETS = tuple(f for formats in fv.PLATFORM_FORMATS.values() for f in formats)


NO_PARSER = "no parser for this format"


def normalise_target(name: str) -> str:
    """'GeoJSON / VTK' -> 'GEOJSON': aliases first, then the first known word."""
    raw = (name or "").strip().upper()
    for word in (raw, *re.split(r"[/,，;；|\s]+", raw)):
        word = fv.FORMAT_ALIASES.get(word, word)
        if word in TARGETS:
            return word
    raise ValueError(f"unsupported target format {name!r}; known: {', '.join(TARGETS)}")


def platform_of(target: str) -> str:
    wanted = normalise_target(target)
    return next(p for p, formats in fv.PLATFORM_FORMATS.items() if wanted in formats)


def conversion_plan(files: DataFrame, target: str) -> DataFrame:
    """Per file: suffix, target, supported and a message. Creates nothing."""
    wanted = normalise_target(target)
    suffix = V.file_suffix(F.col("path"))
    supported = suffix.isin(*fv.SOURCE_SUFFIXES)
    message = F.when(supported, "can be converted").otherwise(NO_PARSER)
    return files.select(
        "path", F.coalesce(F.nullif(suffix, F.lit("")), F.lit("unknown")).alias("source_format"), F.lit(wanted).alias("target_format"),
        F.lit(platform_of(wanted)).alias("target_platform"), supported.alias("supported"), message.alias("message"),
    )


def information_losses(content: DataFrame, target: str) -> DataFrame:
    """(model_id, loss) for content flags has_faces, has_lines, vertex_props, face_props."""
    c = {n: F.col(n) for n in ("has_faces", "has_lines", "vertex_props", "face_props")}
    wanted = normalise_target(target)
    if wanted == "CSV":
        rules = [(c["has_faces"], "faces are kept in the sidecar only"), (c["has_lines"], "lines are kept in the sidecar only"), (c["face_props"], "face attributes are kept in the sidecar only")]
    elif wanted == "GEOJSON":
        rules = [(c["has_faces"] & c["vertex_props"], "vertex attributes of faces are kept in the sidecar only")]
    else:
        rules = [(c["vertex_props"] | c["face_props"], f"{wanted} does not hold all attributes; they are kept in the sidecar")]
        if wanted in ("STL", "IFC"):
            rules.append((c["has_lines"], f"{wanted} does not hold lines; they are kept in the sidecar"))
    notes = [F.when(when, F.lit(text)) for when, text in rules]
    return content.select("model_id", F.explode(F.array_compact(F.array(*notes))).alias("loss"))


def content_flags(models: Meshes) -> DataFrame:
    ids = models.vertices.select("model_id").distinct()
    flag = lambda df, name: df.select("model_id").distinct().withColumn(name, F.lit(True))
    out = ids.join(flag(models.faces, "has_faces"), "model_id", "left")
    out = out.join(flag(models.lines, "has_lines"), "model_id", "left") if models.lines is not None else out.withColumn("has_lines", F.lit(False))
    for name, props in (("vertex_props", models.props), ("face_props", models.face_props)):
        if props is not None:
            out = out.join(flag(props.filter(F.size(F.map_keys("props")) > 0), name), "model_id", "left")
        else:
            out = out.withColumn(name, F.lit(False))
    return out.na.fill(False)


def validate(models: Meshes) -> DataFrame:
    """(model_id, problem) of models that cannot be converted."""
    corners = mesh.corners_of(models.faces)
    bad = mesh.face_validity(corners, models.vertices).filter("not valid").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    out = bad.select("model_id", F.format_string("%d faces are too short or refer to unknown vertices", "n").alias("problem"))
    if models.rejected is not None:
        lost = models.rejected.groupBy("model_id").agg(F.min("line_no").alias("line"))
        out = out.unionByName(lost.select("model_id", F.format_string("line %d cannot be read", "line").alias("problem")))
    empty = models.faces.select("model_id").distinct().join(models.vertices.select("model_id").distinct(), "model_id", "left_anti")
    return out.unionByName(empty.select("model_id", F.lit("no vertices").alias("problem")))


READERS = {".obj": meshes.read_obj, ".ply": meshes.read_ply, ".vtk": meshes.read_vtk}


def read_models(spark: SparkSession, suffix: str, path) -> Meshes:
    """All files of one format under a path as model tables."""
    if suffix in READERS:
        return READERS[suffix](spark, path)
    if suffix == ".stl":
        return meshes.read_stl(spark, path)
    if suffix in (".geojson", ".json"):
        vertices, corners, lines, props, face_props = features.model_tables(tables.read_json_records(spark, path))
        lines = mesh.loops_of(lines).withColumnsRenamed({"fid": "lid", "loop": "path"})
        return Meshes(vertices, mesh.loops_of(corners), lines, props=props, face_props=face_props)
    if suffix in (".csv", ".txt"):
        df = tables.read_delimited(spark, path, "\t" if suffix == ".txt" else ",", keep_file=True)
        points = tables.table_points(df, keep=(tables.FILE,)).withColumnRenamed(tables.FILE, "model_id")
        points = cut_lineage(chunked_index(points, ["model_id"], id_chunk("row_id"), ["row_id"], "vid"))
        return Meshes(
            points.select("model_id", "vid", "x", "y", "z"), spark.createDataFrame([], "model_id string, fid bigint, loop array<bigint>"),
            props=points.select("model_id", "vid", "props"),
        )
    raise ValueError(NO_PARSER)


def facts(models: Meshes) -> DataFrame:
    """Counts and box per model, for comparison after a round trip."""
    summary = mesh.model_summary(models.vertices, models.faces, models.lines.withColumnRenamed("path", "loop") if models.lines is not None else None)
    return summary.join(mesh.model_bounds(models.vertices).drop("vertices"), "model_id", "left")


def read_back_check(expected: DataFrame, actual: DataFrame, target: str, tolerance: float = 1e-8) -> DataFrame:
    """(model_id, check, passed) after re-reading an export; model ids of both sides must agree."""
    wanted = normalise_target(target)
    e = expected.select("model_id", *[F.col(c).alias(f"e_{c}") for c in expected.columns if c != "model_id"])
    both = e.join(actual, "model_id", "left")
    close = F.lit(True)
    for a in "xyz":
        for side in ("min", "max"):
            x, y = F.col(f"e_{side}_{a}"), F.col(f"{side}_{a}")
            close = close & (F.abs(x - y) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(x), F.abs(y))))
    ok = lambda c: F.coalesce(c, F.lit(False))
    checks = [("readable", F.col("vertex_count").isNotNull()), ("vertices", F.col("e_vertex_count") == F.col("vertex_count")), ("bounds", close)]
    if wanted != "CSV":
        checks.append(("faces", (F.col("e_triangle_count") if wanted == "STL" else F.col("e_face_count")) == F.col("face_count")))
    if wanted in ("OBJ", "PLY", "VTK", "GEOJSON"):
        checks.append(("lines", F.col("e_line_count") == F.col("line_count")))
    return both.select("model_id", F.inline(F.array(*[F.struct(F.lit(n).alias("check"), ok(c).alias("passed")) for n, c in checks])))


@dataclass
class Conversion:
    status: DataFrame      # model_id, state, message, losses, quality_score
    summary: DataFrame     # one row
    offsets: DataFrame | None


def convert(
    models: Meshes, target: str, out_dir: str, coordinate_rule: str = "keep", attribute_rule: str = "all",
) -> Conversion:
    """Export every sound model; a broken one only fails itself. Attributes go to a sidecar table."""
    wanted = normalise_target(target)
    problems = validate(models).groupBy("model_id").agg(F.min("problem").alias("message"))
    good = lambda df: df.join(problems.select("model_id"), "model_id", "left_anti") if df is not None else None
    vertices, offsets = mesh.shift_coordinates(good(models.vertices), coordinate_rule)
    faces, lines, props, face_props = good(models.faces), good(models.lines), good(models.props), good(models.face_props)
    if wanted in ("STL", "IFC"):
        flat = vertices.select("model_id").distinct().join(faces.select("model_id").distinct(), "model_id", "left_anti")
        problems = problems.unionByName(flat.withColumn("message", F.lit(f"{wanted} needs faces")))
    if wanted == "IFC":
        raise ValueError("IFC export is not part of this library")
    props, face_props = (mesh.keep_attributes(p, attribute_rule) if p is not None else None for p in (props, face_props))
    if wanted == "CSV":
        names = [] if props is None else [r[0] for r in props.select(F.explode(F.map_keys("props"))).distinct().orderBy("col").collect()]  # the columns to write
        sinks.write_table(sinks.vertex_table(vertices, props, names), out_dir, "csv", ["model_id"])
    elif wanted == "GEOJSON":
        line_corners = mesh.corners_of(lines.withColumnsRenamed({"lid": "fid", "path": "loop"})) if lines is not None else None
        out = sinks.feature_lines(vertices, mesh.corners_of(faces), line_corners, face_props=face_props, vertex_props=props)
        sinks.write_mesh_text(out.withColumn("section", F.lit(0)), out_dir)
    else:
        sinks.write_mesh_text(sinks.mesh_lines(vertices, faces, wanted, lines), out_dir)
    if props is not None or face_props is not None:
        sinks.attribute_sidecar(props, face_props).write.mode("overwrite").parquet(out_dir.rstrip("/") + "_attributes")
    losses = information_losses(content_flags(Meshes(vertices, faces, lines, props, face_props=face_props)), wanted).groupBy("model_id").agg(F.count(F.lit(1)).alias("losses"))
    every = models.vertices.select("model_id").unionByName(models.faces.select("model_id")).distinct()
    status = every.join(problems, "model_id", "left").join(losses, "model_id", "left").select(
        "model_id", F.when(F.col("message").isNull(), "success").otherwise("failed").alias("state"), F.coalesce("message", F.lit("converted")).alias("message"),
        F.coalesce("losses", F.lit(0)).alias("losses"),
    )
    status = status.withColumn("quality_score", F.when(F.col("state") == "success", F.greatest(F.lit(0), 100 - 3 * F.col("losses"))))
    return Conversion(status, conversion_summary(status), offsets)


def conversion_summary(status: DataFrame) -> DataFrame:
    """Counts, state and score: mean artifact score times success ratio."""
    s = status.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "success").alias("success"), F.avg("quality_score").alias("mean_score"),
        F.coalesce(F.sum("losses"), F.lit(0)).alias("warnings"),
    )
    state = F.when((F.col("success") == F.col("total")) & (F.col("total") > 0), "completed").when(F.col("success") > 0, "partial").otherwise("failed")
    ratio = F.col("success") / F.greatest(F.lit(1), F.col("total"))
    return s.select("total", "success", (F.col("total") - F.col("success")).alias("failed"), "warnings", state.alias("state"),
                    F.bround(F.coalesce("mean_score", F.lit(0.0)) * ratio, 0).cast("int").alias("quality_score"))

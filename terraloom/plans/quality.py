"""Quality reports of tables, meshes, features and IFC texts under one switchable rule set."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import values as V
from terraloom.functions.skew import join_shuffled
from terraloom.functions.values import q
from terraloom.operators import dedup, issues as I, mesh, profiling
from terraloom.plans.reports import Report, finish
from terraloom.session import materialise
from terraloom.sources import features as FT

CATEGORIES = list(fv.QUALITY_CATEGORIES)


@dataclass(frozen=True)
class QualityRules:
    require_closed_geometry: bool = True
    check_topology: bool = True
    check_attributes: bool = True
    check_consistency: bool = True
    check_coordinate: bool = True
    required_attributes: tuple[str, ...] = ()
    max_missing_ratio: float = 0.0
    coordinate_max_abs: float = 1e8
    minimum_decimal_places: int = 0
    duplicate_vertex_tolerance: float = 1e-9
    degenerate_area_tolerance: float = 1e-12

    @staticmethod
    def of(data: dict | None = None, **overrides) -> "QualityRules":
        """Unknown keys dropped, values clamped to their range."""
        known = {f for f in QualityRules.__dataclass_fields__}
        r = QualityRules(**{k: v for k, v in {**(data or {}), **overrides}.items() if k in known})
        names = tuple(dict.fromkeys(str(a).strip() for a in r.required_attributes if str(a).strip()))
        return replace(
            r, required_attributes=names, max_missing_ratio=max(0.0, min(1.0, float(r.max_missing_ratio))),
            coordinate_max_abs=max(0.0, float(r.coordinate_max_abs)), minimum_decimal_places=max(0, int(r.minimum_decimal_places)),
            duplicate_vertex_tolerance=max(0.0, float(r.duplicate_vertex_tolerance)),
            degenerate_area_tolerance=max(0.0, float(r.degenerate_area_tolerance)),
        )


def _issue(frame: DataFrame, no: int, category: str, code: str, severity, message, file, **kw) -> DataFrame:
    return I.issue_rows(frame, check_no=no, category=category, code=code, file=file, severity=severity, message=message, **kw)


def location_samples(rows: DataFrame, keys: Sequence[str], place: str, k: int = 5) -> DataFrame:
    """First k places per key and their number; the ranking is limited before the shuffle."""
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(place))
    top = rows.withColumn("_rn", nth).filter(F.col("_rn") <= k)
    shown = top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(q(place))).cast("array<string>"), "、").alias("shown"))
    text = F.when(F.col("total") > k, F.format_string("%s and %d in all", "shown", "total")).otherwise(F.col("shown"))
    return total.join(shown, list(keys)).withColumn("places", text).drop("shown")


def coordinate_issues(cells: DataFrame, rules: QualityRules) -> list[DataFrame]:
    """cells(file, literal, value): non-finite, out of range and too coarse coordinates over all input."""
    finite = V.finite(F.col("value"))
    coarse = V.decimal_places(F.col("literal")) < rules.minimum_decimal_places
    facts = cells.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~finite).alias("bad"), F.count_if(finite & (F.abs("value") > rules.coordinate_max_abs)).alias("far"),
        F.count_if(finite).alias("ok"), F.count_if(finite & coarse).alias("coarse"),
    )
    make = lambda where, no, code, severity, message: _issue(facts.filter(where), no, "coordinate", code, severity, message, "coordinates")
    out = [
        make("n = 0", 40, "INVALID_COORDINATE", fv.WARNING, "no coordinates found"),
        make("bad > 0", 41, "INVALID_COORDINATE", fv.CRITICAL, F.format_string("%d coordinates are not finite", "bad")),
        make("far > 0", 42, "COORDINATE_RANGE", fv.WARNING, F.format_string(f"%d coordinates beyond {rules.coordinate_max_abs:g}", "far")),
    ]
    if rules.minimum_decimal_places > 0:
        out.append(make("ok > 0 and coarse / ok > 0.2", 43, "COORDINATE_PRECISION", fv.WARNING,
                        F.format_string(f"%d of %d coordinates have under {rules.minimum_decimal_places} decimals", "coarse", "ok")))
    return out


def table_quality_issues(name: str, df: DataFrame, rules: QualityRules, row_id: str = "_row_id", ragged: str = "_ragged") -> list[DataFrame]:
    spark, body = df.sparkSession, df.drop(row_id, ragged)
    names = body.columns
    out = [_issue(df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), 1, "attributes", "MISSING_ATTRIBUTE", fv.WARNING, "the table has no rows", name)]
    if rules.check_attributes:
        gone = [r for r in rules.required_attributes if r.lower() not in {c.strip().lower() for c in names}]
        if gone:
            out.append(_issue(spark.createDataFrame([(", ".join(gone),)], "n string"), 2, "attributes", "MISSING_ATTRIBUTE", fv.CRITICAL,
                              F.concat(F.lit("missing required columns: "), F.col("n")), name))
        holes = profiling.missing_by_field(body, names, "value").filter(F.col("missing") > 0).filter(F.col("ratio") > rules.max_missing_ratio)
        required = F.col("field").isin(*rules.required_attributes) if rules.required_attributes else F.lit(False)
        severity = F.when(required | (F.col("ratio") >= 0.5), fv.CRITICAL).otherwise(fv.WARNING)
        out.append(_issue(holes, 3, "attributes", "MISSING_ATTRIBUTE", severity, F.format_string("%s: %d of %d missing", "field", "missing", "total"), name, field=F.col("field")))
    if rules.check_consistency:
        if ragged in df.columns:
            bad = df.filter(q(ragged)).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("row")).filter("n > 0")
            out.append(_issue(bad, 4, "consistency", "INCONSISTENT_SCHEMA", fv.CRITICAL, F.format_string("%d rows have more cells than the header", "n"), name, row_id=F.col("row")))
        mixed = profiling.value_type_mix(body).filter("mixed")
        out.append(_issue(mixed, 5, "consistency", "INCONSISTENT_SCHEMA", fv.WARNING, F.concat(F.lit("mixed value types in "), F.col("field")), name, field=F.col("field")))
    identifier = profiling.first_identifier(names)
    if identifier and rules.check_topology:
        present = df.filter(V.has_value(q(identifier), df.schema[identifier].dataType))
        twins = dedup.duplicate_identifiers(present, identifier, row_id).agg(F.count_distinct("identifier").alias("n"), F.min("row_id").alias("row")).filter("n > 0")
        out.append(_issue(twins, 6, "topology", "DUPLICATE_ID", fv.CRITICAL, F.format_string("%d repeated identifiers", "n"), name, row_id=F.col("row")))
    return out + _table_coordinate_issues(name, df, rules, row_id)


def _table_coordinate_issues(name, df, rules, row_id):
    columns = profiling.coordinate_columns(df.columns)
    if not columns:
        note = df.sparkSession.createDataFrame([(1,)], "n int") if rules.check_coordinate else None
        return [_issue(note, 7, "coordinate", "INVALID_COORDINATE", fv.INFO, "no usual coordinate column", name)] if note is not None else []
    unread = F.lit(False)
    for c in columns:
        unread = unread | V.to_number(q(c), df.schema[c].dataType).isNull()
    return [_issue(df.filter(unread), 8, "coordinate", "INVALID_COORDINATE", fv.CRITICAL, "a coordinate is not a number", name, row_id=q(row_id))]


def table_coordinates(name: str, df: DataFrame) -> DataFrame | None:
    columns = profiling.coordinate_columns(df.columns)
    if not columns:
        return None
    cells = [F.struct(q(c).cast("string").alias("literal"), V.to_number(q(c), df.schema[c].dataType).alias("value")) for c in columns]
    return df.select(F.lit(name).alias("file"), F.inline(F.array(*cells))).filter("value is not null")


def mesh_quality_issues(vertices: DataFrame, corners: DataFrame, rules: QualityRules, models: DataFrame | None = None) -> list[DataFrame]:
    """All topology and geometry checks of a mesh set, one issue per model and code.

    ``models(model_id)`` lists the expected models, so that empty ones are seen too.
    """
    models = models if models is not None else vertices.select("model_id").distinct()
    file = F.col("model_id")
    corners = materialise(corners)  # every check below reads them
    has_v, has_f = vertices.select("model_id").distinct(), corners.select("model_id").distinct()
    out = [
        _issue(models.join(has_v, "model_id", "left_anti"), 20, "geometry", "EMPTY_GEOMETRY", fv.CRITICAL, "no vertices", file),
        _issue(models.join(has_v, "model_id", "left_semi").join(has_f, "model_id", "left_anti"), 21, "geometry", "NO_FACES", fv.WARNING, "no faces or cells", file),
    ]
    validity = materialise(mesh.face_validity(corners, vertices))
    largest = validity.agg(F.max("size")).first()[0] or 0
    counted = lambda df, how=F.count(F.lit(1)): df.groupBy("model_id").agg(how.alias("n"))
    bad = location_samples(validity.filter("not valid"), ["model_id"], "fid")
    out.append(_issue(bad, 22, "topology", "INVALID_INDEX", fv.CRITICAL, F.format_string("%d invalid faces: %s", "total", "places"), file))
    good = materialise(join_shuffled(corners, validity.filter("valid").select("model_id", "fid"), ["model_id", "fid"], "left_semi"))
    flat = location_samples(mesh.degenerate_faces(mesh.face_areas(good, vertices, largest), rules.degenerate_area_tolerance), ["model_id"], "fid")
    out.append(_issue(flat, 23, "geometry", "DEGENERATE_FACE", fv.CRITICAL, F.format_string("%d faces without area: %s", "total", "places"), file))
    uses = mesh.edge_uses(mesh.corner_edges(good, largest))
    topology = mesh.topology_summary(uses)
    if rules.require_closed_geometry:
        out.append(_issue(topology.filter("boundary > 0"), 25, "geometry", "OPEN_BOUNDARY", fv.CRITICAL, F.format_string("%d boundary edges", "boundary"), file))
    if rules.check_topology:
        out.append(_issue(topology.filter("non_manifold > 0"), 26, "topology", "NON_MANIFOLD_EDGE", fv.CRITICAL, F.format_string("%d non-manifold edges", "non_manifold"), file))
        out.append(_issue(topology.filter("orientation > 0"), 27, "topology", "INCONSISTENT_ORIENTATION", fv.WARNING, F.format_string("%d edges used twice in one direction", "orientation"), file))
    if rules.check_consistency:
        out.append(_issue(mesh.duplicate_faces(good).filter("duplicate_faces > 0"), 24, "consistency", "DUPLICATE_FACE", fv.WARNING, F.format_string("%d repeated faces", "duplicate_faces"), file))
        twins = counted(mesh.duplicate_vertices(vertices, rules.duplicate_vertex_tolerance), F.sum(F.col("n") - 1))
        meshed = twins.join(has_f, "model_id", "left_semi")
        out.append(_issue(meshed, 28, "consistency", "DUPLICATE_VERTEX", fv.WARNING, F.format_string("%d repeated vertices", "n"), file))
    return out


def mesh_coordinates(vertices: DataFrame) -> DataFrame:
    cells = [F.struct(F.col(a).cast("string").alias("literal"), F.col(a).alias("value")) for a in "xyz"]
    return vertices.select(F.col("model_id").alias("file"), F.inline(F.array(*cells)))


def material_issues(groups: DataFrame, rules: QualityRules) -> list[DataFrame]:
    if not rules.check_attributes:
        return []
    return [_issue(groups.filter("not has_groups"), 29, "attributes", "MISSING_MATERIAL", fv.INFO, "no material, group or object names", F.col("model_id"))]


def feature_quality_issues(records: DataFrame, rules: QualityRules) -> list[DataFrame]:
    """Rings, geometry, properties and key sets of GeoJSON features."""
    file, row = F.col("file"), F.col("ordinal")
    geoms = FT.geometries(records)
    rings = FT.ring_checks(FT.rings(geoms))
    out = [
        _issue(records.filter("geometry is null"), 30, "geometry", "MISSING_GEOMETRY", fv.CRITICAL, "no geometry", file, row_id=row),
        _issue(geoms.filter("coordinates is null"), 31, "geometry", "MISSING_GEOMETRY", fv.CRITICAL, "no coordinates", file, row_id=row),
        _issue(rings.filter("too_short"), 32, "geometry", "INVALID_RING", fv.CRITICAL, F.format_string("ring %d has under four positions", "ring"), file, row_id=row),
        _issue(FT.positions(FT.rings(geoms)).filter("not ok"), 34, "coordinate", "INVALID_COORDINATE", fv.CRITICAL, "a coordinate is not a number", file, row_id=row),
    ]
    if rules.require_closed_geometry:
        out.append(_issue(rings.filter("open"), 33, "geometry", "OPEN_BOUNDARY", fv.CRITICAL, F.format_string("ring %d is not closed", "ring"), file, row_id=row))
    if rules.check_attributes:
        out.append(_issue(records.filter("props is null"), 35, "attributes", "INCONSISTENT_SCHEMA", fv.CRITICAL, "properties are not an object", file, row_id=row))
        held = records.filter("props is not null")
        for name in rules.required_attributes:
            gone = ~V.has_value(F.try_element_at("props", F.lit(name)))
            out.append(_issue(held.filter(gone), 36, "attributes", "MISSING_ATTRIBUTE", fv.CRITICAL, f"required property {name} is missing", file, row_id=row, field=name))
        empty = F.map_keys(F.map_filter("props", lambda k, v: V.is_null_word(v, "value")))
        out.append(_issue(held.withColumn("e", empty).filter(F.size("e") > 0), 37, "attributes", "MISSING_ATTRIBUTE", fv.WARNING,
                          F.concat(F.lit("empty properties: "), F.array_join(F.array_sort("e"), ", ")), file, row_id=row))
    if rules.check_consistency:
        keys = F.array_join(F.array_sort(F.map_keys("props")), ",")
        sets = records.filter("props is not null").groupBy("file").agg(F.count_distinct(keys).alias("n")).filter("n > 1")
        out.append(_issue(sets, 38, "consistency", "INCONSISTENT_SCHEMA", fv.WARNING, F.format_string("%d different property sets", "n"), file))
    return out


def feature_coordinates(records: DataFrame) -> DataFrame:
    p = FT.positions(FT.rings(FT.geometries(records))).filter("ok")
    return p.select("file", F.inline(F.array(*[F.struct(F.col(a).cast("string").alias("literal"), F.col(a).alias("value")) for a in "xyz"])))


def ifc_quality_issues(audit: DataFrame, rules: QualityRules) -> list[DataFrame]:
    file = F.col("file")
    out = [
        _issue(audit.filter("not complete"), 50, "consistency", "INVALID_IFC_STRUCTURE", fv.CRITICAL, "header, data section or end mark is missing", file),
        _issue(audit.filter("duplicate_ids > 0"), 51, "topology", "DUPLICATE_ID", fv.CRITICAL, F.format_string("%d repeated entity numbers", "duplicate_ids"), file),
        _issue(audit.filter("entities = 0"), 54, "geometry", "EMPTY_GEOMETRY", fv.CRITICAL, "no entities in the data section", file),
    ]
    if rules.check_attributes:
        out.append(_issue(audit.filter("products > 0 and empty_global_ids > 0"), 52, "attributes", "MISSING_ATTRIBUTE", fv.CRITICAL, "products with an empty GlobalId", file))
    if rules.check_topology:
        out.append(_issue(audit.filter("duplicate_global_ids > 0"), 53, "topology", "DUPLICATE_ID", fv.CRITICAL, "GlobalIds repeat", file))
    return out


def unreadable_issues(files: DataFrame) -> list[DataFrame]:
    """files(name, exists, supported, error): missing, unsupported and unparsable files as issues."""
    return [
        _issue(files.filter("not exists"), 60, "consistency", "FILE_NOT_FOUND", fv.CRITICAL, "file does not exist", F.col("name")),
        _issue(files.filter("exists and not supported"), 61, "consistency", "UNSUPPORTED_FORMAT", fv.WARNING, "no parser for this format", F.col("name")),
        _issue(files.filter("exists and supported and error is not null"), 62, "consistency", "PARSE_ERROR", fv.CRITICAL, F.concat(F.lit("cannot be parsed: "), F.col("error")), F.col("name")),
    ]


def quality_report(spark: SparkSession, found: Sequence[DataFrame], cells: Sequence[DataFrame | None], rules: QualityRules, files: DataFrame | None = None) -> Report:
    """Assemble issues and the coordinate check over all inputs into one report."""
    has_input = bool(found)
    all_found = list(found) or [_issue(spark.createDataFrame([(1,)], "n int"), 0, "consistency", "FILE_NOT_FOUND", fv.CRITICAL, "no file selected", "none")]
    if rules.check_coordinate:
        known = [c for c in cells if c is not None]
        every = spark.createDataFrame([], "file string, literal string, value double")
        for c in known:
            every = every.unionByName(c)
        all_found += coordinate_issues(every, rules)
    report = finish(all_found, CATEGORIES, fv.QUALITY_PENALTY, "Q", has_input, info_is_pass=True)
    if files is not None:
        report.frames["files"] = I.file_status(files, I.union_issues(all_found))
    return report

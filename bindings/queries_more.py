"""Registered queries over sources, sinks, reports, states and streams; their SQL is in ``oracle_reports``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings.queries import QUERIES, _batch_items, _scratch, _versions, query
from bindings.tables import table
from terraloom.functions import values as V
from terraloom.operators import batch, compare, mesh, versions
from terraloom.plans import conversion, quality
from terraloom.session import cut_lineage
from terraloom.sources import features, sinks, tables
from terraloom.sources.meshes import Meshes
from terraloom.streaming import intake

__all__ = ["QUERIES"]


# --- features ---------------------------------------------------------------------------------


def _feature_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as features: open, closed and short rings, and points nested zero to six collections deep."""
    x = F.col("doc_id").cast("string")
    point = F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(",1]}"))
    nested = point
    for level in range(1, 7):
        outer = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), nested, F.lit(',{"type":"Point","coordinates":[0,2,3]}]}'))
        nested = F.when(F.col("n_chars") % 7 >= level, outer).otherwise(nested)
    ring = lambda *points: F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *points), F.lit("]]}"))
    start = F.concat(F.lit("["), x, F.lit(",0]"))
    at = lambda text: F.lit(text)
    kind = F.col("doc_id") % 4
    geometry = (
        F.when(kind == 0, ring(start, at("[4,0]"), at("[4,3]"), at("[0,3]"))).when(kind == 1, ring(start, at("[4,0]"), at("[4,3]"), start))
        .when(kind == 2, ring(start, at("[4,0]"), at("[4,3]"))).otherwise(nested)
    )
    props = F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("lang"), F.lit(""))).otherwise(F.create_map(F.lit("lang"), "lang", F.lit("n"), x))
    return table(spark, sf, "documents").select(
        F.col("source").alias("file"), F.col("doc_id").alias("ordinal"), F.lit("FeatureCollection").alias("json_type"), props.alias("props"), geometry.alias("geometry")
    )


@query
def geometry_points(spark, sf):
    """Positions of all geometries, collections opened to the last level."""
    found = features.positions(features.rings(features.geometries(_feature_records(spark, sf))))
    return found.groupBy("geom_type", F.size(F.split("path", "/")).alias("depth")).agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("sum_x"), F.sum("z").alias("sum_z"))


@query
def ring_checks(spark, sf):
    found = features.ring_checks(features.rings(features.geometries(_feature_records(spark, sf))))
    return found.groupBy("too_short", "open").agg(F.count(F.lit(1)).alias("rings"))


@query
def feature_quality(spark, sf):
    rules = quality.QualityRules.of(required_attributes=["lang"], coordinate_max_abs=150)
    records = _feature_records(spark, sf)
    report = quality.quality_report(spark, quality.feature_quality_issues(records, rules), [quality.feature_coordinates(records)], rules)
    return report.issues.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("issues"))


@query
def feature_models(spark, sf):
    """Features as models: vertices, faces and the attributes of both, by source."""
    vertices, corners, _, vertex_props, face_props = features.model_tables(_feature_records(spark, sf))
    count = lambda df, name, *ids: df.groupBy("model_id").agg(F.count_distinct(*ids).alias(name))
    out = count(vertices, "vertices", "vid").join(count(corners, "faces", "fid"), "model_id", "left").join(count(vertex_props, "vertex_props", "vid"), "model_id", "left")
    return out.join(count(face_props, "face_props", "fid"), "model_id", "left").na.fill(0)


@query
def feature_columns(spark, sf):
    named = tables.props_to_columns(_feature_records(spark, sf), ["lang", "n"], with_point=True)
    return named.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.count("n").alias("n"), F.sum(F.col("longitude").cast("double")).alias("longitude"))


# --- delimited text -----------------------------------------------------------------------------


@query
def csv_documents(spark, sf):
    """Documents written as quoted CSV and read back: texts with line breaks and quotes stay whole, empty ones are quoted and nulls are not."""
    path = _scratch(spark, "csv")
    table(spark, sf, "documents").select("doc_id", "text").write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    back = tables.read_delimited(spark, f"{path}/*.csv")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("text").alias("md5"), "_ragged")


@query
def csv_layouts(spark, sf):
    """Orders written under two headers and read as one table."""
    path = _scratch(spark, "csv")
    orders = table(spark, sf, "orders")
    orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).csv(f"{path}/a")
    orders.filter("o_orderkey % 2 = 1").select("o_totalprice", "o_orderkey", "o_custkey").write.option("header", True).csv(f"{path}/b")
    back = tables.read_delimited(spark, [f"{path}/a/*.csv", f"{path}/b/*.csv"])
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("o_orderkey").cast("bigint")).alias("keys"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("price"),
        F.count("o_custkey").alias("customers"), F.count_if("_ragged").alias("ragged"),
    )


@query
def table_points(spark, sf):
    """Parts as a coordinate table: brand numbers as x, blank z where the name starts with s."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("_row_id"), F.regexp_extract("p_brand", r"(\d+)", 1).alias("X"), F.col("p_size").cast("string").alias("y"),
        F.when(F.col("p_name").startswith("s"), " ").otherwise(F.col("p_retailprice").cast("string")).alias("Z"), "p_type",
    )
    points = tables.table_points(part)
    return points.groupBy(F.col("props")["p_type"].alias("kind")).agg(F.count(F.lit(1)).alias("points"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.round(F.sum("z"), 2).alias("z"))


# --- conversion ---------------------------------------------------------------------------------


@query
def conversion_plan(spark, sf):
    suffix = F.element_at(F.array(*map(F.lit, (".obj", ".STL", ".csv", ".las", ".dwg", ""))), (F.col("page_id") % 6 + 1).cast("int"))
    files = table(spark, sf, "pages").select(F.concat(F.lit("/in/"), F.col("page_id").cast("string"), suffix).alias("path"))
    return conversion.conversion_plan(files, "geojson").groupBy("source_format", "target_format", "target_platform", "supported", "message").agg(F.count(F.lit(1)).alias("files"))


def _content(spark, sf):
    bit = lambda n: F.shiftright(F.col("c_custkey"), n) % 2 == 1
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("model_id"), bit(0).alias("has_faces"), bit(1).alias("has_lines"), bit(2).alias("vertex_props"), bit(3).alias("face_props")
    )


@query
def information_losses(spark, sf):
    out = None
    for target in ("CSV", "GEOJSON", "OBJ", "STL"):
        one = conversion.information_losses(_content(spark, sf), target).groupBy("loss").agg(F.count(F.lit(1)).alias("models")).withColumn("target", F.lit(target))
        out = one if out is None else out.unionByName(one)
    return out


@query
def sidecar_need(spark, sf):
    formats = F.explode(F.array(*map(F.lit, ("CSV", "GEOJSON", "OBJ"))))
    flags = _content(spark, sf).select("*", formats.alias("fmt"), (F.col("model_id").cast("int") % 5 == 0).alias("metadata"))
    need = sinks.needs_sidecar(*map(F.col, ("fmt", "has_faces", "has_lines", "vertex_props", "face_props", "metadata")))
    return flags.groupBy("fmt", need.alias("needed")).agg(F.count(F.lit(1)).alias("models"))


@query
def csv_round_trip(spark, sf):
    """Parts as point models, one per brand, converted to CSV with their attributes and read back."""
    part = table(spark, sf, "part").withColumn("model_id", F.regexp_replace("p_brand", "#", ""))
    vertices = part.select("model_id", F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(0.0).alias("z"))
    props = part.select("model_id", F.col("p_partkey").alias("vid"), F.create_map(F.lit("kind"), "p_type", F.lit("name"), "p_name").alias("props"))
    out = _scratch(spark, "points")
    done = conversion.convert(Meshes(vertices, spark.createDataFrame([], "model_id string, fid bigint, loop array<bigint>"), props=props), "CSV", out)
    back = spark.read.option("header", True).csv(out)
    facts = back.groupBy("model_id", "kind").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.col("x").cast("double")).alias("x"), F.sum(F.col("vertex_id").cast("bigint")).alias("ids"), F.count_distinct("name").alias("names")
    )
    return facts.join(done.status.select("model_id", "state", "losses", "quality_score"), "model_id")


@query
def geojson_round_trip(spark, sf):
    """Suppliers as point features with attributes, written line by line and read back."""
    suppliers = table(spark, sf, "supplier").withColumn("model_id", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    vertices = suppliers.select("model_id", F.col("s_suppkey").alias("vid"), F.col("s_suppkey").cast("double").alias("x"), F.round("s_acctbal", 2).alias("y"), F.lit(1.0).alias("z"))
    props = suppliers.select("model_id", F.col("s_suppkey").alias("vid"), F.create_map(F.lit("name"), "s_name").alias("props"))
    none = spark.createDataFrame([], "model_id string, fid bigint, pos bigint, vid bigint")
    out = _scratch(spark, "geojson")
    sinks.write_mesh_text(sinks.feature_lines(vertices, none, vertex_props=props).withColumn("section", F.lit(0)), out)
    records = tables.read_json_records(spark, f"{out}/*", lines=True)
    points = features.positions(features.rings(features.geometries(records)))
    named = records.select("file", "ordinal", F.col("props")["source"].alias("model_id"), F.col("props")["name"].alias("name"))
    return points.join(named, ["file", "ordinal"]).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum("x").alias("x"), F.round(F.sum("y"), 2).alias("y"), F.count_distinct("name").alias("names"), F.count_if("ok").alias("ok")
    )


@query
def kept_attributes(spark, sf):
    props = table(spark, sf, "part").select(F.create_map(F.lit("ID"), F.col("p_partkey").cast("string"), F.lit("Name"), "p_name", F.lit("kind"), "p_type").alias("props"))
    kept = mesh.keep_attributes(props, "identifiers").select(F.explode("props").alias("key", "value"))
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("values"))


# --- reports and states --------------------------------------------------------------------------


@query
def table_quality(spark, sf):
    """Quality issues of the labelled documents as one table."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("string").alias("size")).join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.withColumn("size", F.when(F.col("doc_id") % 9 == 0, "many").otherwise(F.col("size"))).withColumn("_row_id", F.col("doc_id"))
    rules = quality.QualityRules.of(required_attributes=["quality", "owner"], check_coordinate=False)
    report = quality.quality_report(spark, quality.table_quality_issues("documents", rows, rules), [], rules)
    return report.issues.select("code", "category", "severity", "field", "message")


@query
def location_samples(spark, sf):
    """The first five orders of every priority, and how many there are."""
    return quality.location_samples(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey").select("o_orderpriority", "total", "places")


@query
def unpaired_models(spark, sf):
    """Customers before and orders after: missing partners and unreadable pairs."""
    before = table(spark, sf, "customer").select(F.col("c_custkey").alias("before_id"), (F.col("c_acctbal") > 0).alias("b_ok"))
    after = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("after_id")).distinct().withColumn("a_ok", F.lit(True))
    pairs = before.join(after, F.col("before_id") == F.col("after_id"), "full_outer").withColumn("pair_name", F.coalesce("before_id", "after_id").cast("string"))
    return compare.compare_unpaired(pairs).select("pair_name", "dimension", "metric", "deviation", "passed")


@query
def retry_outcomes(spark, sf):
    """Events as items: each succeeds at its own attempt; errors are retried only where their text allows it."""
    events = table(spark, sf, "events").select(F.col("event_id").alias("file_id"), (F.get_json_object("props", "$.k").cast("int") % 6).alias("need"), "event_type")

    def attempt(items, number):
        error = F.when(F.col("event_type") == "error", "broken").otherwise("读取 failed")
        rows = items.join(events, "file_id")
        return rows.select("file_id", (F.col("need") <= number).alias("ok"), F.when(F.col("need") > number, error).alias("error"))

    return batch.run_with_retry(events, attempt, 3).groupBy("state", "retries").agg(F.count(F.lit(1)).alias("items"), F.sum("file_id").alias("ids"))


@query
def job_list(spark, sf):
    first = table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.min("ts").cast("string").alias("created_at"))
    jobs = batch.job_status(_batch_items(spark, sf)).join(first, "job_id")
    return batch.list_jobs(jobs, "partial").select("job_id", "created_at", "total")


@query
def job_outputs(spark, sf):
    """Outputs and sidecars of each customer's orders, each path once at its first place."""
    out = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("o"), F.substring("o_orderpriority", 1, 1))).otherwise("")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("ordinal"), out.alias("output"),
        F.when(F.col("o_totalprice") > 200000, F.array(F.lit("side"), F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)))).alias("sidecar_files"),
    )
    return batch.collect_outputs(rows)


@query
def error_texts(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    letters = F.transform(F.sequence(F.lit(0), k % 7), lambda i: F.when(i == 1, "").otherwise(F.concat(F.lit("e"), i.cast("string"))))
    errors = F.when(F.col("event_type") == "error", letters)
    messages = F.when(F.col("event_type") == "click", F.array(F.lit("m"), F.lit("n")))
    return table(spark, sf, "events").groupBy(batch.error_text(errors, messages, F.col("event_type")).alias("text")).agg(F.count(F.lit(1)).alias("items"))


@query
def version_archive(spark, sf):
    v = _versions(spark, sf)
    done = versions.archive(v, v.filter("module_name = 'P'").select("version_id"), "/arch/")
    return done.filter("module_name <> 'O'").select("version_id", "archived", "archive_path")


@query
def archive_manifest(spark, sf):
    """What an archive of the finished versions copies; half of the outputs exist."""
    v = _versions(spark, sf)
    done = versions.archive(v, v.filter("archived").select("version_id"), "/arch")
    files = spark.createDataFrame([("out1", 10), ("out3", 30), ("out9", 90)], "path string, length bigint")
    return versions.archive_manifest(done, files).groupBy("name", "copied").agg(F.count(F.lit(1)).alias("versions"), F.count_if(F.col("archive_path") != "").alias("targets"))


@query
def number_kinds(spark, sf):
    """Automatic numbers of mixed cells."""
    cell = F.element_at(F.array(F.col("event_id").cast("string"), F.col("value").cast("string"), F.col("event_type"), F.lit(" "), F.lit("1e3")), (F.col("event_id") % 5 + 1).cast("int"))
    found = table(spark, sf, "events").select(V.auto_number(cell).alias("a"))
    return found.groupBy(F.col("a.kind").alias("kind")).agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum("a.number"), 3).alias("total"))


@query
def comparison_roles(spark, sf):
    stem = F.element_at(F.array(*map(F.lit, ("before/x", "after/x", "in/model_before", "in/model_after", "in/other"))), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), stem, F.lit(".obj"))
    return table(spark, sf, "pages").groupBy(V.comparison_role(path).alias("role")).agg(F.count(F.lit(1)).alias("files"))


# --- streams -------------------------------------------------------------------------------------


def _finished(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    path, marks = _scratch(spark, name), _scratch(spark, f"{name}-marks")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark, sf):
    stream = intake.file_stream(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


@query
def stream_dedup(spark, sf):
    """Distinct users and kinds of events, taken in as a stream with a watermark longer than the data."""
    rows = intake.dedup_stream(_event_stream(spark, sf), ["user_id", "event_type"], "at", "3650 days")
    return cut_lineage(_finished(rows.select("user_id", "event_type"), spark, "dedup")).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))


@query
def stream_issue_rate(spark, sf):
    """Issue rate per kind and day of the days that the watermark has closed."""
    rate = intake.issue_rate(_event_stream(spark, sf), "event_type", "at", F.col("value") > 100, "1 day", "10 minutes")
    return _finished(rate, spark, "rate").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "category", "rows", "issues")

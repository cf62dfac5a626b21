"""Registered queries: each operator over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings import tables as B
from bindings.tables import table
from terraloom import fixed_values as fv
from terraloom.functions import ordering, scoring, units, values as V, vectors as G
from terraloom.session import checkpoint_folder, cut_lineage
from terraloom.operators import batch, borehole, cleaning, compare, dedup, issues, mesh, nearest, profiling, semantic, templates, versions

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


# --- profiles -------------------------------------------------------------------------------

PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query
def profile_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = profiling.profile_fields(table(spark, sf, "lineitem"), PROFILED, sigma=1.0).drop("robust_sigma")
    return rounded(p, mean_val=4, std_val=4, median=6)


@query
def profile_event_values(spark, sf):
    p = profiling.profile_fields(table(spark, sf, "events"), ["value", "event_type", "props"], sigma=3.0).drop("robust_sigma")
    return rounded(p, mean_val=4, std_val=4, median=6)


@query
def profile_samples(spark, sf):
    s = profiling.samples(table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderpriority"], "o_orderkey")
    return s.select("field", F.array_join("sample_values", "|").alias("samples"))


@query
def profile_missing(spark, sf):
    # whether a text is there goes through the join, not the text
    there = [F.when(F.col(c).isNotNull(), True).alias(c) for c in ("text", "lang")]
    docs = table(spark, sf, "documents").select("doc_id", *there).join(table(spark, sf, "labels"), "doc_id", "left")
    m = profiling.missing_by_field(docs, ["text", "lang", "quality", "toxic"], "null")
    # as SQL rounds: F.round(.., 6) takes the decimal digits of the double, which differs where the seventh is the last and a 5
    return m.withColumn("severity", scoring.missing_severity(F.col("ratio"))).withColumn("ratio", F.round(F.col("ratio") * 1e6) / 1e6)


@query
def dtype_inference(spark, sf):
    events = table(spark, sf, "events").select(
        F.get_json_object("props", "$.k").alias("k"), "event_type", F.col("value").cast("string").alias("value"), F.get_json_object("props", "$.none").alias("none")
    )
    return profiling.infer_dtypes(events)


@query
def value_type_mix(spark, sf):
    cells = table(spark, sf, "lineitem").select(*[F.col(c).cast("string").alias(c) for c in (*PROFILED, "l_returnflag")])
    return profiling.value_type_mix(cells)


@query
def value_modes(spark, sf):
    return profiling.modes(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query
def value_frequencies(spark, sf):
    return profiling.value_frequencies(table(spark, sf, "part"), ["p_type", "p_size", "p_brand"])


@query
def duplicate_rows(spark, sf):
    docs = dedup.duplicate_rows(table(spark, sf, "documents"), ["text"]).withColumn("source", F.lit("documents"))
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return docs.unionByName(dedup.duplicate_rows(events, ["user_id", "event_type", "day"]).withColumn("source", F.lit("events"))).select(
        "source", "row_count", "duplicate_count", "key_fields"
    )


@query
def duplicate_identifiers(spark, sf):
    docs = table(spark, sf, "documents").withColumn("identifier", F.md5("text"))
    return dedup.duplicate_identifiers(docs, "identifier", "doc_id")


@query
def dedup_keep_first(spark, sf):
    return dedup.keep_first(table(spark, sf, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


@query
def coordinate_precision(spark, sf):
    lines = table(spark, sf, "lineitem")
    return profiling.coordinate_precision(lines, ["l_quantity", "l_extendedprice", "l_tax"], max_abs=50_000, minimum_decimals=2)


@query
def decimal_places(spark, sf):
    places = V.decimal_places(F.col("l_extendedprice").cast("string"))
    return table(spark, sf, "lineitem").groupBy(places.alias("places")).agg(F.count(F.lit(1)).alias("cells"))


@query
def schema_variants(spark, sf):
    return profiling.schema_variants(table(spark, sf, "events"), F.json_object_keys("props"))


@query
def key_union(spark, sf):
    return profiling.key_union(table(spark, sf, "events"), F.json_object_keys("props"), "event_id")


# --- cleaning -------------------------------------------------------------------------------


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labels = table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").withColumn("judged", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad"))


@query
def fill_median_mode(spark, sf):
    rows = _labelled(spark, sf)
    plan = cleaning.plan_cleaning(rows, "doc_id", deduplicate=False, sigma=0)
    return cleaning.clean(rows, plan, "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), "judged")


@query
def outlier_flags(spark, sf):
    flagged = cleaning.outlier_flags(table(spark, sf, "events"), "value", 3.0)
    return flagged.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_outlier").alias("outliers"))


@query
def clip_outliers(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    plan = cleaning.plan_cleaning(rows, "event_id", fill_strategy="none", deduplicate=False)
    return rounded(cleaning.clean(rows, plan, "event_id"), value=6)


@query
def clip_zscore(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "value")
    return rounded(cleaning.clip_zscore(rows, ["value"], 2.0), value=5)


@query
def clean_table(spark, sf):
    """dedup, fill, unit conversion and clip in one go."""
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"), F.col("value").alias("thickness_mm"),
        F.when(F.col("event_type") == "error", None).otherwise(F.get_json_object("props", "$.k")).alias("k"),
    )
    plan = cleaning.plan_cleaning(rows, "event_id", ["user_id", "event_type", "day"], exclude=["user_id", "k"])
    out = cleaning.clean(rows, plan, "event_id")
    return rounded(out.withColumn("k", F.col("k").try_cast("double")), thickness_m=8)


@query
def cleaning_actions(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").cast("string").alias("day"), F.col("value").alias("thickness_mm"))
    plan = cleaning.plan_cleaning(rows, "event_id", ["user_id", "event_type", "day"], exclude=["user_id"])
    return cleaning.cleaning_actions(rows, plan).select("action", "field", "method", "count")


@query
def clean_simple(spark, sf):
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "role", F.when(F.col("role") == "system", "n/a").otherwise(F.length("text").cast("string")).alias("size")
    )
    return cleaning.clean_simple(rows, "row_id", fill_missing="0", sigma=0, unit_factors={"size": 0.5})


@query
def unit_convert(spark, sf):
    unit = F.when(F.col("p_type") == "SMALL", "mm").when(F.col("p_type") == "MEDIUM", "cm").when(F.col("p_type") == "LARGE", "FT").when(
        F.col("p_type") == "PROMO", "g/cm3").otherwise("furlong")
    parts = table(spark, sf, "part").select("p_partkey", "p_size", unit.alias("unit"))
    return units.to_si(parts, "p_size", "unit").select("p_partkey", F.round("si_value", 6).alias("si_value"), "si_unit")


@query
def header_units(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("length_mm"), F.col("p_retailprice").alias("dip"))
    plan = cleaning.plan_cleaning(parts, "p_partkey", deduplicate=False, sigma=0)
    return rounded(cleaning.clean(parts, plan, "p_partkey"), length_m=6, dip_rad=6)


@query
def ring_closure(spark, sf):
    """Polygons of orders: rings closed where they are open, with area and perimeter."""
    corners, vertices = B.mesh_corners(spark, sf)[0], B.mesh_vertices(spark, sf)
    placed = mesh.place_corners(corners, vertices)
    ring = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(F.col("x").alias("u"), F.col("z").alias("v")).alias("p")))), lambda s: s["p"])
    rings = placed.groupBy("fid").agg(ring.alias("ring"))
    return rings.select(
        "fid", F.size("ring").alias("points"), F.size(G.close_ring(F.col("ring"))).alias("closed_points"),
        F.round(G.polygon_area(F.col("ring")), 4).alias("area"), F.round(G.polygon_perimeter(F.col("ring")), 4).alias("perimeter"),
    )


# --- issues and scores ----------------------------------------------------------------------


def _issues(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    common = dict(file=F.concat("l_returnflag", "l_linestatus"), row_id=F.col("row_id"))
    return issues.union_issues([
        issues.issue_rows(lines.filter("l_discount > 0.09"), check_no=1, category="attributes", code="RANGE", severity=fv.WARNING, field="l_discount",
                          message=F.concat(F.lit("discount "), F.col("l_discount").cast("string")), **common),
        issues.issue_rows(lines.filter("l_tax > 0.07"), check_no=2, category="attributes", code="RANGE", severity=fv.INFO, field="l_tax", message="tax too high", **common),
        issues.issue_rows(lines.filter("l_quantity = 50 and l_discount = 0"), check_no=3, category="topology", code="LIMIT", severity=fv.CRITICAL, field="l_quantity",
                          message="quantity at its limit", **common),
    ])


@query
def issue_rollup(spark, sf):
    return issues.issue_rollup(_issues(spark, sf), fv.QUALITY_PENALTY)


@query
def quality_score(spark, sf):
    per_file = _issues(spark, sf).filter("check_no = 3")
    return issues.score(per_file, fv.QUALITY_PENALTY)


@query
def severity_counts(spark, sf):
    return issues.severity_counts(_issues(spark, sf))


@query
def category_status(spark, sf):
    return issues.category_status(_issues(spark, sf), list(fv.QUALITY_CATEGORIES), info_is_pass=True)


@query
def file_status(spark, sf):
    files = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), F.lit("checked").alias("status")).distinct()
    return issues.file_status(files, _issues(spark, sf).filter("severity = 'critical'"))


@query
def issue_numbers(spark, sf):
    numbered = issues.number_issues(_issues(spark, sf).filter("check_no <> 2").dropDuplicates(["file", "check_no", "row_id", "message"]), "Q")
    return numbered.select("issue_id", "file", "check_no", "row_id", "message", "location")


# --- constraints and templates --------------------------------------------------------------


@query
def constraint_checks(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    return templates.check_constraints(lines, B.LINE_RULE)


@query
def range_violations(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = templates.violation_rows(lines, B.LINE_RULE, "row_id")
    return found.groupBy("field", "check").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("row_id").alias("rows"), F.max(F.col("value")).alias("highest"))


@query
def unique_key(spark, sf):
    return templates.unique_key_duplicates(table(spark, sf, "lineitem"), "l_orderkey + l_linenumber")


@query
def template_projection(spark, sf):
    done = templates.apply_template(table(spark, sf, "orders"), B.ORDER_TEMPLATE, "o_orderkey").rows
    return done.select("o_orderkey", "order_id", "customer_id", F.round("x", 6).alias("x"), "status", "priority", "origin", "status_std", "priority_std")


@query
def template_constraints(spark, sf):
    done = templates.apply_template(table(spark, sf, "orders"), B.ORDER_TEMPLATE, "o_orderkey").rows
    rows = done.select("order_id", "customer_id", "x", "status", "priority", "origin", "status_std", "priority_std")
    return templates.check_constraints(rows, B.ORDER_TEMPLATE.quality_check_rule)


@query
def transform_failures(spark, sf):
    rule = templates.RuleTemplate("props", field_mappings=[
        templates.FieldMapping("k", "k", transform="int(value) % 7"), templates.FieldMapping("kind", "kind", transform="float(value)"),
        templates.FieldMapping("none", "none", required=True),
    ])
    rows = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.none").alias("none"))
    return templates.apply_template(rows, rule, "event_id").problems.groupBy("field", "problem").agg(F.count(F.lit(1)).alias("cells"))


@query
def value_map_default(spark, sf):
    rule = templates.ValueMap("o_orderpriority", "level", {"1-URGENT": "high", "2-high": "high", "5-LOW": "low"}, default_value="normal")
    return table(spark, sf, "orders").groupBy(templates.map_value(F.col("o_orderpriority"), rule).alias("level"), "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query
def template_recommend(spark, sf):
    """Template scores against what the data hold: keys and kinds of the events as headers, suffixes of the pages as formats."""
    events = table(spark, sf, "events")
    headers = events.select(F.explode(F.json_object_keys("props")).alias("header")).unionByName(events.select(F.col("event_type").alias("header"))).distinct()
    suffix = V.file_suffix(V.file_name(F.regexp_replace("url", "[?#].*$", "")))
    formats = table(spark, sf, "pages").select(F.upper(F.regexp_replace(suffix, "^[.]", "")).alias("format")).distinct()
    scored = templates.recommend(templates.catalogue(spark, (*B.TEMPLATES, B.EVENT_TEMPLATE)), headers, formats, "隧道工程", "钻孔数据")
    return scored.select("name", "rule_count", "fields_hit", "field_count", F.round("field_coverage", 6).alias("field_coverage"), "score")


@query
def classify_inputs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "source", "lang", "text").alias("text"))
    out = templates.classify_inputs(docs, "text", fv.SOURCE_HINTS, fv.GENERIC_SOURCE, "kind")
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("inputs"))


# --- vocabulary -----------------------------------------------------------------------------


def _mapping_columns(m):
    return m.select("field", "domain", "raw", "rows", "canonical", "matched_by", F.round("confidence", 4).alias("confidence"), "project_code", "symbol", F.size("candidates").alias("candidates"))


@query
def term_mappings(spark, sf):
    return _mapping_columns(B.mapped_terms(spark, sf))


@query
def term_mappings_longest(spark, sf):
    return _mapping_columns(B.mapped_terms(spark, sf, "longest", "override"))


@query
def term_mappings_original(spark, sf):
    return _mapping_columns(B.mapped_terms(spark, sf, "keep_original", "keep_original"))


@query
def term_conflicts(spark, sf):
    return semantic.conflicts(B.mapped_terms(spark, sf, policy="override"), "review")


@query
def unmapped_terms(spark, sf):
    return semantic.unmapped(B.mapped_terms(spark, sf)).select("field", "raw", "rows")


@query
def term_relations(spark, sf):
    r = semantic.relations(B.mapped_terms(spark, sf), B.dictionary(spark))
    return r.select("field", "raw", "source_term", F.try_element_at("relation", F.lit("type")).alias("type"), F.try_element_at("relation", F.lit("target")).alias("target"))


@query
def semantic_coverage(spark, sf):
    return semantic.coverage(B.mapped_terms(spark, sf))


@query
def semantic_score(spark, sf):
    return semantic.semantic_score(B.mapped_terms(spark, sf))


@query
def normalise_table(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    mapping = semantic.map_columns(part, {"p_name": B.ROCK, "p_type": B.STRATA}, B.dictionary(spark), policy="override", target_system="SYMBOL")
    out = semantic.normalise_table(part, mapping, ["p_name", "p_type"], "SYMBOL")
    out = out.withColumn("p_name_confidence", F.round("p_name_confidence", 4))
    return out.select("p_partkey", "p_name_canonical", "p_name_project_code", "p_name_confidence", "p_type_canonical", "p_type_target_code", "p_type_matched_by")


@query
def normalise_table_hot(spark, sf):
    """The same with a low bar for frequent terms: those of p_type are broadcast, those of p_name shuffle."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    mapping = semantic.map_columns(part, {"p_name": B.ROCK, "p_type": B.STRATA}, B.dictionary(spark), policy="override", target_system="SYMBOL")
    out = semantic.normalise_table(part, mapping, ["p_name", "p_type"], "SYMBOL", hot_share=10)
    out = out.withColumn("p_name_confidence", F.round("p_name_confidence", 4))
    return out.select("p_partkey", "p_name_canonical", "p_name_project_code", "p_name_confidence", "p_type_canonical", "p_type_target_code", "p_type_matched_by")


@query
def infer_domains(spark, sf):
    index = semantic.term_index(B.dictionary(spark))
    out = semantic.infer_domains(table(spark, sf, "part"), ["p_name", "p_type", "p_brand"], index)
    for name, columns in (("events", ["event_type"]), ("documents", ["lang", "source"])):
        out = out.unionByName(semantic.infer_domains(table(spark, sf, name), columns, index))
    return out


@query
def dictionary_audit(spark, sf):
    """Audit of a dictionary made of the parts: type is the domain, name the canonical term, brand its code."""
    parts = table(spark, sf, "part").groupBy(F.col("p_type").alias("domain"), F.col("p_name").alias("canonical")).agg(
        F.min("p_brand").alias("brand"), F.min("p_size").cast("string").alias("size")
    )
    d = parts.select(
        "domain", "canonical", F.array(F.concat(F.lit("size "), "size")).alias("aliases"),
        F.when(F.col("brand") != "Brand#1", F.create_map(F.lit("PROJECT"), "brand")).alias("codes"),
    )
    return semantic.audit_dictionary(d)


@query
def dictionary_stats(spark, sf):
    parts = table(spark, sf, "part").groupBy(F.col("p_type").alias("domain"), F.col("p_name").alias("canonical")).agg(F.collect_set("p_brand").alias("aliases"))
    d = parts.select("domain", "canonical", "aliases", F.create_map(F.lit("PROJECT"), "canonical", F.lit("SYMBOL"), F.when(F.col("domain") == "PROMO", "").otherwise("x")).alias("codes"))
    return semantic.dictionary_stats(d)


@query
def dictionary_merge(spark, sf):
    """Project dictionary from nations laid over one from regions."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    none = F.lit(None).cast("string")
    entry = lambda df, canonical, alias, system, code: df.select(
        F.lit("strata").alias("domain"), canonical.alias("canonical"), F.array(alias).alias("aliases"), F.create_map(F.lit(system), code).alias("codes"),
        *[none.alias(c) for c in ("category", "subcategory", "unit", "description")], F.lit(None).cast("array<map<string,string>>").alias("relations"),
    )
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    base = entry(joined, F.col("n_name"), F.col("r_name"), "project", F.col("n_nationkey").cast("string")).withColumn("domain", F.lit(B.STRATA))
    added = entry(joined.filter("n_regionkey <> 0"), F.lower("n_name"), F.col("n_name"), "SYMBOL", F.col("r_name")).unionByName(
        entry(joined.filter("n_regionkey <> 0"), F.col("n_name"), F.lower("r_name"), "symbol", F.col("r_name"))
    )
    out = semantic.merge_dictionaries(base, added)
    return out.select(
        "domain", "canonical", F.array_join("aliases", "|").alias("aliases"), F.coalesce(F.try_element_at("codes", F.lit("PROJECT")), F.lit("")).alias("project"),
        F.coalesce(F.try_element_at("codes", F.lit("SYMBOL")), F.lit("")).alias("symbol"),
    )


@query
def code_translate(spark, sf):
    """Nation name -> region code through a dictionary of nations."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    d = nation.select(
        F.lit("nation").alias("domain"), F.col("n_name").alias("canonical"), F.array().cast("array<string>").alias("aliases"),
        F.create_map(F.lit("PROJECT"), F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")), F.lit("SYMBOL"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("codes"),
    )
    values = customer.select(F.lit("nation").alias("domain"), F.concat(F.lit("n "), F.col("c_nationkey").cast("string")).alias("value"), "c_custkey")
    distinct = values.select("domain", "value").distinct()
    out = semantic.translate_codes(distinct, d, "PROJECT", "SYMBOL")
    return values.join(out, ["domain", "value"]).groupBy("value", "mapped_value", "canonical_name", "route").agg(F.count(F.lit(1)).alias("customers"))


# --- meshes ---------------------------------------------------------------------------------


def _uses(spark, sf):
    return mesh.edge_uses(mesh.corner_edges(*B.mesh_corners(spark, sf)))


@query
def mesh_edges(spark, sf):
    return _uses(spark, sf).groupBy("uses").agg(F.count(F.lit(1)).alias("edges"), F.sum("upward").alias("upward"))


@query
def mesh_boundary(spark, sf):
    return mesh.boundary_edges(_uses(spark, sf)).select("u", "v")


@query
def mesh_nonmanifold(spark, sf):
    return mesh.non_manifold_edges(_uses(spark, sf)).select("u", "v", "uses")


@query
def mesh_orientation(spark, sf):
    return mesh.orientation_conflicts(_uses(spark, sf)).select("u", "v", "upward")


@query
def mesh_topology(spark, sf):
    return mesh.topology_summary(_uses(spark, sf))


@query
def mesh_duplicate_faces(spark, sf):
    return mesh.duplicate_faces(B.mesh_corners(spark, sf)[0])


@query
def mesh_invalid_index(spark, sf):
    """Faces against a vertex file that lacks the promotional parts."""
    v = mesh.face_validity(B.mesh_corners(spark, sf)[0], B.mesh_vertices(spark, sf, F.col("p_type") != "PROMO"))
    return v.groupBy("valid").agg(F.count(F.lit(1)).alias("faces"), F.sum("size").alias("corners"), F.sum("bad_refs").alias("bad_refs"))


@query
def face_areas(spark, sf):
    corners, largest = B.mesh_corners(spark, sf)
    return rounded(mesh.face_areas(corners, B.mesh_vertices(spark, sf), largest), area=3).select("fid", "area")


@query
def mesh_degenerate(spark, sf):
    corners, largest = B.mesh_corners(spark, sf)
    areas = mesh.face_areas(corners, B.mesh_vertices(spark, sf), largest)
    return mesh.degenerate_faces(areas).select("fid")


@query
def duplicate_vertices(spark, sf):
    points = table(spark, sf, "lineitem").select(
        F.lit("points").alias("model_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vid"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_tax").alias("z")
    )
    return mesh.duplicate_vertices(points, 1e-6).select("first_vid", "n")


@query
def vertex_weld(spark, sf):
    parts = table(spark, sf, "part").select(F.lit("parts").alias("model_id"), F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"), F.round(F.col("p_retailprice") / 100, 0).alias("y"), F.lit(0.0).alias("z"))
    return mesh.weld_map(parts, 0.0).select("vid", "new_vid")


@query
def mesh_clean(spark, sf):
    """Parts of equal size and brand are one vertex; faces and repeats follow."""
    part = table(spark, sf, "part").select(
        F.lit("lineitem").alias("model_id"), F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("double").alias("y"), F.lit(0.0).alias("z"),
    )
    vertices, corners, actions = mesh.clean_mesh(part, B.mesh_corners(spark, sf)[0])
    return actions


@query
def triangle_normals(spark, sf):
    faces = mesh.loops_of(B.mesh_corners(spark, sf)[0])
    tri = mesh.triangle_normals(mesh.triangles(faces), B.mesh_vertices(spark, sf))
    return tri.groupBy("fid").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum("normal.x"), 5).alias("nx"), F.round(F.sum(F.abs("normal.z")), 5).alias("nz"))


@query
def model_bounds(spark, sf):
    return rounded(mesh.model_bounds(B.nation_points(spark, sf)), diagonal=6, centre_y=6, span_y=6, min_y=6, max_y=6, min_z=6, max_z=6, span_z=6, centre_z=6)


@query
def model_summary(spark, sf):
    corners, _ = B.mesh_corners(spark, sf)
    return mesh.model_summary(B.mesh_vertices(spark, sf), mesh.loops_of(corners))


@query
def coordinate_shift(spark, sf):
    moved, _ = mesh.shift_coordinates(B.mesh_vertices(spark, sf), "centre")
    return rounded(moved, z=6)


@query
def normalised_box(spark, sf):
    return rounded(mesh.normalise_box(B.mesh_vertices(spark, sf)), x=8, y=8, z=8)


@query
def stride_sample(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    indexed = ordering.chunked_index(parts, [], ordering.id_chunk("p_partkey"), ["p_partkey"], "idx")
    return nearest.strided_sample(indexed, [], "idx", 100)


# --- slices, comparison and distances -------------------------------------------------------


@query
def plane_slice(spark, sf):
    vertices = B.mesh_vertices(spark, sf)
    box = mesh.model_bounds(vertices).select("model_id", F.col("centre_z").alias("position"))
    corners, largest = B.mesh_corners(spark, sf)
    points = mesh.slice_points(corners, vertices, "XY", box, largest)
    return points.select(F.round("u", 6).alias("u"), F.round("v", 6).alias("v"))


@query
def slice_area(spark, sf):
    vertices = B.mesh_vertices(spark, sf)
    box = mesh.model_bounds(vertices).select("model_id", F.col("centre_z").alias("position"))
    corners, largest = B.mesh_corners(spark, sf)
    points = mesh.slice_points(corners, vertices, "XY", box, largest)
    return rounded(mesh.slice_profile(points), area=2, perimeter=2)


def _paired_bounds(spark, sf):
    box = mesh.model_bounds(B.nation_points(spark, sf), ["model_id", "is_after"])
    side = lambda after, p: box.filter(F.col("is_after") == after).select("model_id", *[F.col(c).alias(f"{p}_{c}") for c in box.columns if c not in ("model_id", "is_after")])
    return side(False, "b").join(side(True, "a"), "model_id").withColumnRenamed("model_id", "pair_name")


def _items(spark, sf):
    return compare.compare_bounds(_paired_bounds(spark, sf), compare.Thresholds(position=0.0005, extent=0.0005, scale=0.01, boundary=0.0005))


@query
def compare_bounds(spark, sf):
    return rounded(_items(spark, sf), value_before=6, value_after=6)


@query
def comparison_rollup(spark, sf):
    return compare.dimension_rollup(_items(spark, sf))


@query
def comparison_score(spark, sf):
    return compare.comparison_score(_items(spark, sf))


def _event_attributes(spark, sf):
    events = table(spark, sf, "events").withColumn("after", F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz"))
    keys = events.select(F.col("event_type").alias("file_id"), "after", F.concat_ws("_", F.lit("k"), F.get_json_object("props", "$.k"), F.floor(F.col("value") / 30).cast("string")).alias("attribute")).distinct()
    return keys.filter("not after").drop("after"), keys.filter("after").drop("after")


@query
def attribute_changes(spark, sf):
    before, after = _event_attributes(spark, sf)
    return compare.attribute_changes(before, after).groupBy("file_id", "change").agg(F.count(F.lit(1)).alias("attributes"))


@query
def attribute_retention(spark, sf):
    before, after = _event_attributes(spark, sf)
    pairs = before.select("file_id").distinct().select(F.col("file_id").alias("pair_name"), F.col("file_id").alias("before_id"), F.col("file_id").alias("after_id"))
    return compare.compare_attributes(pairs, before, after)


@query
def pair_files(spark, sf):
    """Pages as files named by the last step of their address; http before, https after."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("file_id"), F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1).alias("name"), F.col("url").startswith("https").alias("after"))
    pairs = compare.pair_models(pages.filter("not after"), pages.filter("after"))
    return pairs.groupBy("rule").agg(F.count(F.lit(1)).alias("pairs"), F.sum("before_id").alias("before_ids"), F.sum("after_id").alias("after_ids"))


def _embedding_points(spark, sf):
    e = F.col("embedding")
    points = table(spark, sf, "embeddings").select(F.lit("all").alias("model_id"), F.col("vec_id"), *[e[i].cast("double").alias(a) for i, a in enumerate("xyz")], "label")
    return points.filter("label < 5"), points.filter("label >= 5")


@query
def nn_distances(spark, sf):
    before, after = _embedding_points(spark, sf)
    d = nearest.nearest_distances(after, before, ["model_id"])
    return after.join(d, ["model_id", "x", "y", "z"]).select("vec_id", F.round("distance", 9).alias("distance"))


@query
def nn_heatmap(spark, sf):
    before, after = _embedding_points(spark, sf)
    d = nearest.nearest_distances(after, before, ["model_id"])
    return rounded(nearest.distance_summary(after, d, ["model_id"], mesh.model_bounds(before)), mean_distance=8, max_distance=9, p95_distance=9, normalized_max=8, diagonal=8)


@query
def nn_lines(spark, sf):
    """Nearest line of the years before 2000 to each line of later years, per supplier nation."""
    points = nearest.counted_points(B.nation_points(spark, sf), ["model_id", "is_after"])
    d = nearest.nearest_distances(points.filter("is_after"), points.filter("not is_after"), ["model_id"])
    s = nearest.distance_summary(points.filter("is_after"), d, ["model_id"], count="n")
    return rounded(s, mean_distance=7, max_distance=8, p95_distance=8)


# --- boreholes, versions, batches -----------------------------------------------------------


def _borehole_tables(spark, sf):
    orders = table(spark, sf, "orders")
    holes = table(spark, sf, "customer").select(F.col("c_custkey").alias("BH_ID"), F.col("c_acctbal").alias("X"), F.col("c_nationkey").alias("Y"), F.lit(100.0).alias("Z"))
    layers = orders.select(F.col("o_custkey").alias("BH_ID"), F.col("o_orderkey").alias("_row_id"), (F.col("o_totalprice") / 1000).alias("depth_top"), (F.col("o_totalprice") / 500).alias("depth_bottom"), F.col("o_orderpriority").alias("lithology"))
    water = orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("BH_ID"), F.col("o_orderkey").alias("_row_id"), F.col("o_totalprice").alias("water_level"), F.col("o_orderpriority").alias("type"))
    tests = orders.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("BH_ID"), F.col("o_orderkey").alias("_row_id"), F.col("o_totalprice").alias("UCS"), F.lit(1.0).alias("RQD"), F.lit(2.0).alias("permeability"))
    return holes, layers, water, tests


@query
def nested_borehole(spark, sf):
    docs = borehole.nest_documents(*_borehole_tables(spark, sf), part_layers=100_000)
    return docs.select(
        "BH_ID", "part", F.size("lithology").alias("layers"), F.array_join(F.transform("lithology", lambda l: F.substring(l["name"], 1, 1)), "").alias("stack"),
        F.col("groundwater.water_level").alias("water_level"), F.col("groundwater.type").alias("water_type"), F.col("engineering.UCS").alias("ucs"),
    )


@query
def layer_cylinders(spark, sf):
    holes, layers, _, _ = _borehole_tables(spark, sf)
    c = borehole.layer_cylinders(holes, layers.select("BH_ID", "_row_id", "depth_top", "depth_bottom", F.concat_ws("#", F.col("_row_id").cast("string"), "lithology").alias("lithology")))
    return c.select("BH_ID", "lithology", F.round(F.element_at("geometry.center", 3), 6).alias("z"), F.round("geometry.height", 6).alias("height"), "geometry.radius")


def _versions(spark, sf):
    """Orders as versions: the customer is the project, status the module, priority and price make the number."""
    digit = F.substring("o_orderpriority", 1, 1)
    number = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("draft"), digit)).otherwise(F.concat(F.lit("V1."), digit, F.lit("."), F.floor(F.col("o_totalprice") / 50000).cast("string")))
    one_file = lambda name: F.array(F.struct(name.alias("name"), name.alias("path"), F.lit(".csv").alias("format"), F.lit("in").alias("role"), F.lit(0).cast("bigint").alias("size_bytes"), F.lit(True).alias("exists")))
    none = F.expr("array()").cast(f"array<{versions.FILE_TYPE}>")
    return table(spark, sf, "orders").select(
        F.format_string("VER-%08d", "o_orderkey").alias("version_id"), number.alias("version_number"), F.col("o_custkey").cast("string").alias("project_name"), F.col("o_orderstatus").alias("module_name"),
        F.col("o_orderpriority").alias("description"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.lit("x").alias("created_by"),
        F.when(F.col("o_totalprice") > 250000, one_file(F.concat(F.lit("f"), digit))).otherwise(none).alias("data_sources"),
        F.create_map(F.lit("price"), F.floor("o_totalprice").cast("string"), F.concat(F.lit("p"), digit), F.lit("1")).alias("conversion_params"),
        F.when(F.col("o_orderstatus") != "P", F.create_map(F.lit("score"), digit)).alias("quality_results"),
        F.array(F.struct(F.lit("load").alias("step"), F.lit("done").alias("status"), F.lit("").alias("timestamp"))).alias("workflow_steps"),
        one_file(F.concat(F.lit("out"), digit)).alias("output_files"), (F.col("o_orderstatus") == "F").alias("archived"), F.lit("").alias("archive_path"), F.array("o_orderstatus").alias("tags"),
        F.col("o_orderkey").alias("row_id"),
    )


@query
def version_numbers(spark, sf):
    return versions.next_numbers(_versions(spark, sf), ["project_name"]).select("project_name", "next_number")


@query
def version_latest(spark, sf):
    return versions.latest_versions(_versions(spark, sf), ["project_name"])


@query
def version_stats(spark, sf):
    return versions.version_stats(_versions(spark, sf), ["module_name"])


@query
def version_resolution(spark, sf):
    """Every number in use is asked for again within its module: where does it end up?"""
    v = _versions(spark, sf)
    return versions.resolve_numbers(v, v.filter("project_name <> '0'"), ["module_name"])


@query
def version_assignment(spark, sf):
    v = _versions(spark, sf)
    return versions.assign_numbers(v.filter("not archived"), v.filter("archived").select("project_name", "row_id"), "row_id", ["project_name"]).select("row_id", "version_number")


def _last_two(spark, sf):
    from pyspark.sql import Window as W

    v = _versions(spark, sf)
    newest = F.row_number().over(W.partitionBy("project_name").orderBy(F.desc("created_at"), F.desc("version_id")))
    two = v.select("project_name", "version_id", newest.alias("rn")).filter("rn <= 2")
    return two.groupBy("project_name").agg(F.max(F.when(F.col("rn") == 2, F.col("version_id"))).alias("id_a"), F.max(F.when(F.col("rn") == 1, F.col("version_id"))).alias("id_b")).filter("id_a is not null").select("id_a", "id_b")


@query
def version_diff(spark, sf):
    d = versions.diff_versions(_versions(spark, sf), _last_two(spark, sf))
    return d.select("id_a", "id_b", "field", "before", "after", "changed")


@query
def parameter_diff(spark, sf):
    """Line sets of one order status against another: quantities per part and supplier."""
    lines = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey", "l_linenumber").agg(F.sum("l_quantity").cast("bigint").cast("string").alias("value"))
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).select("l_suppkey", F.col("l_linenumber").cast("string").alias("name"), "value")
    return versions.parameter_diff(side("A"), side("R"), ["l_suppkey"])


@query
def version_lineage(spark, sf):
    return versions.lineage(_versions(spark, sf)).select("version_id", "trace_chain", F.size("phases").alias("phases"))


@query
def import_skip_duplicates(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", (F.col("ts") >= F.lit("2024-01-11").cast("timestamp_ntz")).alias("late"))
    keys = ["user_id", "event_type", "day"]
    return versions.skip_registered(events.filter("late"), events.filter("not late"), keys, ["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("imported"), F.sum("event_id").alias("ids"))


def _batch_items(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    error = F.col("event_type") == "error"
    state = F.when(error & (k > 80), "cancelled").when(error & (k > 20), "failed").when(error, "skipped")
    state = state.when((F.col("event_type") == "view") & (k < 10), "unselected").otherwise("success")
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("file_id"), state.alias("state"), F.when(F.col("event_type") == "error", k).otherwise(0).alias("retries"))


@query
def batch_status(spark, sf):
    return batch.job_status(_batch_items(spark, sf))


@query
def batch_summary(spark, sf):
    return batch.batch_summary(batch.job_status(_batch_items(spark, sf)))


@query
def batch_status_counts(spark, sf):
    return batch.status_counts(batch.job_status(_batch_items(spark, sf)))


@query
def template_outcomes(spark, sf):
    rows = table(spark, sf, "orders").withColumn("template_status", F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderpriority") == "5-LOW", None).otherwise(F.col("o_orderpriority")))
    return batch.template_stats(rows)


@query
def retryable(spark, sf):
    events = table(spark, sf, "events")
    message = F.concat(F.col("event_type"), F.when(F.col("value") > 50, " i/o stalled").when(F.col("value") > 20, " 源文件不存在 I/O").otherwise(""))
    return events.groupBy(V.is_retryable(message).alias("retryable"), "event_type").agg(F.count(F.lit(1)).alias("items"))


@query
def visible_logs(spark, sf):
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "DEBUG").when(F.col("event_type") == "click", "TRACE").otherwise("WARNING")
    logs = table(spark, sf, "events").select("event_id", F.col("ts").alias("timestamp"), level.alias("level"))
    return batch.visible_logs(logs, "INFO").select("event_id", "level")


@query
def file_distribution(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("category"), F.col("n_chars").cast("bigint").alias("length"))
    from terraloom.sources.files import format_summary

    return format_summary(docs).withColumn("size", V.human_size(F.col("size_bytes")))


@query
def file_names(spark, sf):
    url = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", V.file_suffix(url).alias("suffix"), V.safe_stem(V.file_name(url)).alias("stem"), V.pair_key(V.file_name(url)).alias("pair_key"))


@query
def ratio_parsing(spark, sf):
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.col("l_quantity").cast("string"), F.lit(" %"))).when(F.col("l_returnflag") == "N", F.col("l_discount").cast("string")).otherwise(F.concat(F.lit("x"), F.col("l_tax").cast("string")))
    return table(spark, sf, "lineitem").groupBy("l_returnflag", F.round(V.parse_ratio(text), 6).alias("ratio")).agg(F.count(F.lit(1)).alias("cells"))


@query
def text_entities(spark, sf):
    """Tags of web pages as entities: occurrences and pages, over whole texts."""
    tags = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag"))
    return tags.groupBy(F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("page_id").alias("pages"))


@query
def running_totals(spark, sf):
    """Running order count per customer, cut by order-key blocks."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return ordering.chunked_running_sum(orders, ["o_custkey"], ordering.id_chunk("o_orderkey", 8), ["o_orderkey"], (F.col("o_orderstatus") == "F").cast("int"), "finished")


# --- files and streams ----------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    import uuid

    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query
def mesh_round_trip(spark, sf):
    """The order mesh written as OBJ text and read back: counts and bounds before and after."""
    from terraloom.operators.mesh import loops_of
    from terraloom.plans import conversion
    from terraloom.sources.meshes import Meshes
    from terraloom.sources.sinks import write_mesh_text, mesh_lines
    from terraloom.sources import meshes as readers

    vertices, corners = B.mesh_vertices(spark, sf), B.mesh_corners(spark, sf)[0]
    faces = loops_of(ordering.chunked_index(loops_of(corners), ["model_id"], ordering.id_chunk("fid"), ["fid"], "k").select(
        "model_id", F.col("k").alias("fid"), F.posexplode("loop").alias("pos", "vid")))
    faces, out = cut_lineage(faces), _scratch(spark, "obj")
    write_mesh_text(mesh_lines(vertices, faces, "OBJ"), out)
    back = readers.read_obj(spark, out, by_folder=True)
    same = lambda df: df.withColumn("model_id", F.lit("lineitem"))
    before = cut_lineage(conversion.facts(Meshes(vertices, faces)))
    after = conversion.facts(Meshes(same(back.vertices), same(back.faces)))
    return conversion.read_back_check(before, after, "OBJ").join(before.select("model_id", "vertex_count", "face_count", "triangle_count"), "model_id")


@query
def stream_intake(spark, sf):
    """Events taken in as a stream: sound rows and dead letters by event type."""
    from terraloom.streaming import intake

    schema = table(spark, sf, "events").schema
    out = _scratch(spark, "intake")
    stream = intake.file_stream(spark, sf, schema, pattern="events.parquet")
    intake.split_intake(stream, f"{out}/checkpoint", f"{out}/good", f"{out}/dead", ["event_type"], {"value": (0, 100)}).awaitTermination()
    good = spark.read.parquet(f"{out}/good").select("event_type", F.lit("good").alias("state"))
    dead = spark.read.parquet(f"{out}/dead").select("event_type", F.lit("dead").alias("state"))
    return good.unionByName(dead).groupBy("event_type", "state").agg(F.count(F.lit(1)).alias("rows"))

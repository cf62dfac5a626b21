"""How the driver tables play the roles of surveys, meshes, dictionaries and version logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from terraloom.functions.ordering import SAFE_GROUP, chunked_index, largest_group
from terraloom.operators import semantic
from terraloom.session import cut_lineage
from terraloom.operators.templates import CoordinateRule, FieldMapping, QualityRule, RuleTemplate, ValueMap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- lineitem as a mesh: a face per order with at least three lines, parts as vertices -----

FACE_ROWS = 500_000  # lines that one task sorts, where there are many


def spread_lines(lines: DataFrame) -> DataFrame:
    """Many lines are dealt out by face, ``FACE_ROWS`` to a task.

    Left to itself, AQE merges partitions up to 64 MB of compressed shuffle data, and the sorts of so many lines take twenty times that.
    """
    n = lines.count()
    return lines.repartition(-(-n // FACE_ROWS), "fid") if n > 24 * FACE_ROWS else lines


def mesh_corners(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(corners, corner count of the biggest face)."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("model_id"), F.col("l_orderkey").alias("fid"), "l_linenumber", F.col("l_partkey").alias("vid")
    )
    largest = largest_group(lines, ["fid"])
    group = ["model_id", "fid"]
    ranked = chunked_index(spread_lines(lines), group, F.col("l_linenumber"), ["l_linenumber", "vid"], "pos", largest=largest)
    if largest <= SAFE_GROUP:
        # counted where the window has gathered and sorted the face already: the lines are read and shuffled once
        counted = ranked.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*group)))
        return counted.filter("n >= 3").select("model_id", "fid", "pos", "vid"), largest
    big = lines.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select(*group)
    return ranked.join(big, group, "left_semi").select("model_id", "fid", "pos", "vid"), largest


def mesh_vertices(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    part = table(spark, sf_dir, "part")
    if keep is not None:
        part = part.filter(keep)
    return part.select(
        F.lit("lineitem").alias("model_id"), F.col("p_partkey").alias("vid"), F.col("p_size").cast("double").alias("x"),
        F.regexp_extract("p_brand", r"(\d+)", 1).cast("double").alias("y"), F.col("p_retailprice").alias("z"),
    )


# --- suppliers' nations as models, lines as points -----------------------------------------


def nation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per supplier nation; before / after by ship date, the year 2000 dividing them."""
    lines = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("model_id"))
    return lines.join(supplier, "l_suppkey").select(
        "model_id", F.col("l_partkey").alias("vid"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"), (F.year("l_shipdate") >= 2000).alias("is_after"),
    )


# --- a dictionary over the words of part, event and document columns -----------------------

ROCK, STRATA, WATER, STRUCTURE = "岩性", "地层", "地下水", "构造"
DICTIONARY_ROWS = (
    {"domain": ROCK, "canonical": "ring", "aliases": ["hoop"], "codes": {"PROJECT": "LIT-RING", "SYMBOL": "R"}, "category": "round",
     "relations": [{"type": "next_to", "target": "bolt"}]},
    {"domain": ROCK, "canonical": "bolt", "aliases": ["screw"], "codes": {"PROJECT": "LIT-BOLT", "SYMBOL": "B"}, "category": "long"},
    {"domain": ROCK, "canonical": "red bolt", "aliases": ["scarlet bolt"], "codes": {"PROJECT": "LIT-RBOLT"}, "category": "long"},
    {"domain": ROCK, "canonical": "gear", "aliases": ["cog", "cold gear"], "codes": {"PROJECT": "LIT-GEAR"}, "category": "round"},
    {"domain": ROCK, "canonical": "anvil", "aliases": ["cold gear"], "codes": {"PROJECT": "LIT-ANVIL"}, "category": "block"},
    {"domain": ROCK, "canonical": "small", "aliases": ["tiny"], "codes": {"PROJECT": "LIT-SMALL"}},
    {"domain": STRATA, "canonical": "standard", "aliases": ["STD", "medium"], "codes": {"PROJECT": "STR-STD", "SYMBOL": "Q"}},
    {"domain": STRATA, "canonical": "economy", "aliases": ["ECO", "small", "promo"], "codes": {"PROJECT": "STR-ECO", "SYMBOL": "Q"}},
    {"domain": STRATA, "canonical": "promotion", "aliases": ["promo"], "codes": {"PROJECT": "STR-PRO"}},
    {"domain": WATER, "canonical": "click", "aliases": ["tap"], "codes": {"PROJECT": "GW-CLICK"}},
    {"domain": WATER, "canonical": "purchase", "aliases": ["buy", "view"], "codes": {"PROJECT": "GW-BUY"}},
    {"domain": WATER, "canonical": "registration", "aliases": [], "codes": {"PROJECT": "signup"}},
    {"domain": STRUCTURE, "canonical": "english", "aliases": ["en"], "codes": {"SYMBOL": "EN"}},
    {"domain": STRUCTURE, "canonical": "german", "aliases": ["de"], "codes": {"PROJECT": "LG-DE"}},
)


def dictionary(spark: SparkSession) -> DataFrame:
    return semantic.dictionary_from_rows(spark, DICTIONARY_ROWS)


def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dictionary roles in one long table: (field, domain, raw, rows)."""
    sources = (("part", {"p_name": ROCK, "p_type": STRATA}), ("events", {"event_type": WATER}), ("documents", {"lang": STRUCTURE}))
    out = None
    for name, fields in sources:
        part = semantic.column_terms(table(spark, sf_dir, name), fields)
        out = part if out is None else out.unionByName(part)
    return cut_lineage(out)


def mapped_terms(spark: SparkSession, sf_dir: str, strategy: str = "prefer_canonical", policy: str = "review") -> DataFrame:
    d = dictionary(spark)
    terms = dictionary_terms(spark, sf_dir)
    matched = semantic.attach_entries(semantic.match_terms(terms.select("domain", "raw").distinct(), semantic.term_index(d), strategy), d)
    return semantic.resolve_conflicts(terms.join(matched, ["domain", "raw"]), policy)


# --- templates ------------------------------------------------------------------------------

ORDER_TEMPLATE = RuleTemplate(
    name="orders", project_type="隧道工程", data_source="钻孔数据", input_formats=["CSV", "PARQUET"],
    field_mappings=[
        FieldMapping("order id", "order_id", aliases=["O_ORDERKEY"], required=True),
        FieldMapping("o_custkey", "customer_id", required=True),
        FieldMapping("o_totalprice", "x", data_type="float", transform="float(value) / 1000"),
        FieldMapping("o_orderstatus", "status", transform="value.lower()"),
        FieldMapping("o_orderpriority", "priority", transform="value.title().replace('-', ' ')"),
        FieldMapping("nowhere", "origin", default_value="unknown"),
    ],
    coordinate_rule=CoordinateRule(offset_x=5.0, scale_factor=2.0, precision=6),
    attribute_mappings=[
        ValueMap("status", "status_std", {"F": "finished", "O": "open"}, default_value="other"),
        ValueMap("o_orderpriority", "priority_std", {"1-urgent": "top", " 2-HIGH": "unreachable"}),
    ],
    quality_check_rule=QualityRule(
        max_missing_ratio=0.05, required_fields=["order_id", "x", "absent"], unique_fields=["customer_id+status"],
        numeric_ranges={"x": [100, 900], "status": [None, 1]}, allowed_values={"status": ["f", "o"], "priority_std": ["top"]},
    ),
)
CUSTOMER_TEMPLATE = RuleTemplate(
    name="customers", version="1.1.0", input_formats=["CSV"],
    field_mappings=[
        FieldMapping("c_custkey", "id"), FieldMapping("c_name", "name"), FieldMapping("c_phone", "phone", aliases=["telephone"]),
    ],
)
ORDER_COPY = RuleTemplate(name="orders light", field_mappings=ORDER_TEMPLATE.field_mappings[:2], input_formats=["PARQUET"], data_source="钻孔数据")
TEMPLATES = (ORDER_TEMPLATE, CUSTOMER_TEMPLATE, ORDER_COPY)
EVENT_TEMPLATE = RuleTemplate(
    name="events", input_formats=["HTML", "CSV"],
    field_mappings=[FieldMapping("k", "key"), FieldMapping("buy", "sale", aliases=["Purchase"]), FieldMapping("signup", "signup"), FieldMapping("nothing", "nothing")],
)

LINE_RULE = QualityRule(
    max_missing_ratio=0.1, required_fields=["l_orderkey", "l_shipdate"], unique_fields=["l_orderkey+l_linenumber"],
    numeric_ranges={"l_discount": [0, 0.05], "l_tax": [0, 0.06], "l_quantity": [10, None]},
    allowed_values={"l_returnflag": ["A", "N"]},
)

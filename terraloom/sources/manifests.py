"""Version manifests and dictionary libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.functions import values as V
from terraloom.functions.skew import join_checked
from terraloom.operators.semantic import canonical_domain
from terraloom.operators.versions import FILE_TYPE, STEP_TYPE
from terraloom.sources.json_split import split_documents

_ITEM = (
    "struct<version_id:string,version_number:string,project_name:string,module_name:string,description:string,created_at:string,"
    f"created_by:string,data_sources:array<string>,conversion_params:map<string,string>,quality_results:string,"
    f"workflow_steps:array<{STEP_TYPE}>,output_files:array<string>,archived:boolean,archive_path:string,tags:array<string>>"
)
DEFAULT_MODULE = "模型版本管理与成果追溯模块"


def _join_path(folder, path):
    """Relative paths are resolved against the manifest's folder, '..' and '.' folded away."""
    absolute = path.rlike(r"^(/|[A-Za-z]:|[a-z]+:/)")
    joined = F.concat(folder, F.lit("/"), path)
    root = F.regexp_extract(joined, r"^(?:[A-Za-z]+:)?/*", 0)
    steps = F.split(F.substr(joined, F.length(root) + 1), "/+")
    folded = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda done, step: F.when(step.isin("", "."), done).when(step != "..", F.array_append(done, step)).otherwise(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))),
    )
    return F.when(F.coalesce(path, F.lit("")) == "", "").when(absolute, path).otherwise(F.concat(root, F.array_join(folded, "/")))


def read_version_manifests(spark: SparkSession, path) -> DataFrame:
    """Version rows of manifest files; project and module names are inherited from the manifest root.

    File entries may be plain paths or objects. ``quality_path`` is set where the quality result is only
    a reference; ``attach_quality`` resolves it.
    """
    items, shells = split_documents(spark, path, "versions")
    root = shells.select("file", F.from_json("shell", "struct<project_name:string,module_name:string>").alias("m"))
    rows = join_checked(items.filter("not is_list").select("file", "ordinal", F.from_json("value", _ITEM).alias("v")), root, ["file"])
    rows = rows.select("file", F.col("m.project_name").alias("p"), F.col("m.module_name").alias("mod"), F.col("ordinal").cast("int").alias("ordinal"), "v")
    folder = F.regexp_replace("file", "/[^/]*$", "")

    def files(column):
        def one(text):
            is_object = text.startswith("{")
            f = F.from_json(text, FILE_TYPE)
            place = _join_path(folder, F.when(is_object, f["path"]).otherwise(text))
            return F.struct(
                F.coalesce(F.nullif(f["name"], F.lit("")), V.file_name(place)).alias("name"), place.alias("path"),
                F.coalesce(F.nullif(f["format"], F.lit("")), V.file_suffix(place)).alias("format"), f["role"].alias("role"),
                f["size_bytes"].alias("size_bytes"), f["exists"].alias("exists"),
            )

        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), one)

    quality = F.col("v.quality_results")
    as_map = F.from_json(quality, "map<string,string>")
    reference = F.when(quality.startswith("{"), F.when(F.map_contains_key(as_map, "path") & (F.size(as_map) <= 2), F.try_element_at(as_map, F.lit("path")))).otherwise(quality)
    empty = F.expr("map()").cast("map<string,string>")
    return rows.select(
        "file", "ordinal", F.coalesce("v.version_id", F.lit("")).alias("version_id"), F.coalesce("v.version_number", F.lit("")).alias("version_number"),
        F.coalesce("v.project_name", "p", F.lit("")).alias("project_name"), F.coalesce("v.module_name", "mod", F.lit(DEFAULT_MODULE)).alias("module_name"),
        F.coalesce("v.description", F.lit("")).alias("description"), F.coalesce("v.created_at", F.lit("")).alias("created_at"),
        F.coalesce("v.created_by", F.lit("")).alias("created_by"), files("v.data_sources").alias("data_sources"),
        F.coalesce("v.conversion_params", empty).alias("conversion_params"),
        F.when(reference.isNull(), F.coalesce(as_map, empty)).otherwise(empty).alias("quality_results"),
        F.col("v.workflow_steps").alias("workflow_steps"), files("v.output_files").alias("output_files"),
        F.coalesce("v.archived", F.lit(False)).alias("archived"), F.coalesce("v.archive_path", F.lit("")).alias("archive_path"),
        F.coalesce("v.tags", F.array().cast("array<string>")).alias("tags"), _join_path(folder, reference).alias("quality_path"),
    )


def attach_quality(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """Fill referenced quality results from documents(path, value JSON)."""
    found = documents.select(F.col("path").alias("quality_path"), F.from_json("value", "map<string,string>").alias("_q"))
    return versions.join(found, "quality_path", "left").withColumn("quality_results", F.coalesce("_q", "quality_results")).drop("_q", "quality_path")


def read_dictionary_library(spark: SparkSession, path) -> DataFrame:
    """Dictionary frame from a library JSON {domains: {domain: {canonical: entry}}}; raises when empty."""
    entry = (
        "struct<aliases:string,codes:map<string,string>,gb_code:string,category:string,subcategory:string,unit:string,"
        "description:string,relations:array<map<string,string>>>"
    )
    root = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("value"))
    domains = root.select(F.explode(F.from_json("value", "struct<domains:map<string,string>>")["domains"]).alias("d", "entries"))
    terms = domains.select(canonical_domain(F.col("d")).alias("domain"), F.explode(F.from_json("entries", f"map<string,{entry}>")).alias("canonical", "e"))
    from terraloom.operators.semantic import alias_list, normalise_codes

    listed = F.transform(F.from_json("e.aliases", "array<string>"), V.strip)
    aliases = F.when(F.col("e.aliases").startswith("["), F.filter(listed, lambda a: a != "")).otherwise(alias_list(F.col("e.aliases")))
    out = terms.filter("domain is not null and canonical <> ''").select(
        "domain", "canonical", aliases.alias("aliases"), normalise_codes(F.col("e.codes"), F.col("e.gb_code")).alias("codes"),
        *[F.col(f"e.{c}").alias(c) for c in ("category", "subcategory", "unit", "description", "relations")],
    )
    if out.isEmpty():
        raise ValueError(f"no dictionary entries in {path}")
    return out

"""Version records: numbering, latest, diff, lineage text, archive facets and import.

Version frame: version_id, version_number, project_name, module_name, description, created_at STRING,
created_by, data_sources ARRAY<STRUCT<name,path,format,..>>, conversion_params MAP, quality_results MAP,
workflow_steps ARRAY<STRUCT<step,..>>, output_files ARRAY<STRUCT<..>>, archived BOOLEAN, archive_path, tags ARRAY.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions import values as V
from terraloom.functions.ordering import chunked_index, group_index, id_chunk, next_free_number
from terraloom.operators.dedup import keep_first

FILE_TYPE = "struct<name:string,path:string,format:string,role:string,size_bytes:bigint,exists:boolean>"
STEP_TYPE = "struct<step:string,status:string,timestamp:string>"
VERSION_SCHEMA = (
    "version_id string, version_number string, project_name string, module_name string, description string, created_at string,"
    f" created_by string, data_sources array<{FILE_TYPE}>, conversion_params map<string,string>, quality_results map<string,string>,"
    f" workflow_steps array<{STEP_TYPE}>, output_files array<{FILE_TYPE}>, archived boolean, archive_path string, tags array<string>"
)
KEY = ("project_name", "module_name")


def next_numbers(versions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Next patch number after the highest V<major>.<minor>.<patch> of each key."""
    parsed = versions.select(*keys, V.semver_parts(F.col("version_number")).alias("v")).filter("v is not null")
    top = parsed.groupBy(*keys).agg(F.max("v").alias("v"))
    return top.select(
        *keys, F.format_string("V%d.%d.%d", "v.major", "v.minor", F.col("v.patch") + 1).alias("next_number"),
        "v.major", "v.minor", F.col("v.patch").alias("patch"),
    )


def assign_numbers(existing: DataFrame, new: DataFrame, row_id: str, keys: Sequence[str] = KEY) -> DataFrame:
    """Numbers for a batch of new versions: the highest patch goes on by one per row, V1.0.0 starts a key."""
    ranked = group_index(new, list(keys), row_id, "_nth")
    base = next_numbers(existing, keys).select(*keys, "major", "minor", "patch")
    joined = ranked.join(base, list(keys), "left")
    fresh = F.col("major").isNull()
    number = F.format_string(
        "V%d.%d.%d", F.coalesce("major", F.lit(1)), F.coalesce("minor", F.lit(0)),
        F.when(fresh, F.col("_nth")).otherwise(F.col("patch") + 1 + F.col("_nth")),
    )
    return joined.withColumn("version_number", number).drop("_nth", "major", "minor", "patch")


def resolve_numbers(existing: DataFrame, requested: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Requested numbers that are taken move on: the patch to the next free one, other forms get -2, -3, ..."""
    keys = list(keys)
    used = existing.select(*keys, "version_number").distinct()
    asked = requested.select(*keys, "version_number").distinct()
    clash = asked.join(used, [*keys, "version_number"], "left_semi")
    free = asked.join(used, [*keys, "version_number"], "left_anti").withColumn("assigned", F.col("version_number"))

    part = V.semver_parts(F.col("version_number"))
    numeric = lambda df: df.withColumn("_v", part).filter("_v is not null").select(*keys, "version_number", "_v.major", "_v.minor", "_v.patch")
    moved = next_free_number(numeric(used), numeric(clash), [*keys, "major", "minor"], "patch", "free")
    by_patch = numeric(clash).join(moved, [*keys, "major", "minor", "patch"]).select(
        *keys, "version_number", F.format_string("V%d.%d.%d", "major", "minor", "free").alias("assigned")
    )
    plain = clash.filter(part.isNull())
    tail = used.select(
        *keys, F.regexp_extract("version_number", r"^(.*)-(\d+)$", 1).alias("version_number"),
        F.regexp_extract("version_number", r"^(.*)-([1-9]\d*)$", 2).try_cast("bigint").alias("suffix"),
    ).filter("suffix >= 2")
    floor = plain.withColumn("suffix", F.lit(1).cast("bigint"))
    taken = tail.join(plain, [*keys, "version_number"], "left_semi").unionByName(floor)
    suffixed = next_free_number(taken, floor, [*keys, "version_number"], "suffix", "free").select(
        *keys, "version_number", F.concat("version_number", F.lit("-"), F.col("free").cast("string")).alias("assigned")
    )
    return free.unionByName(by_patch).unionByName(suffixed)


def version_ids(df: DataFrame, row_id: str, date: Column, start: int = 0) -> DataFrame:
    """Ids VER-yyyymmdd-0001 in row order."""
    numbered = chunked_index(df, [], id_chunk(row_id), [row_id], "_n", start=start + 1)
    text = F.col("_n").cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return numbered.withColumn("version_id", F.concat(F.lit("VER-"), F.date_format(date, "yyyyMMdd"), F.lit("-"), padded)).drop("_n")


def latest_versions(versions: DataFrame, keys: Sequence[str] = KEY, columns: Sequence[str] = ("version_id", "version_number")) -> DataFrame:
    """Latest by (created_at, version_id) per key, reduced before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct("created_at", "version_id"))
    return versions.groupBy(*keys).agg(newest.alias("latest"), F.count(F.lit(1)).alias("total_versions")).select(*keys, "latest.*", "total_versions")


def version_stats(versions: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    filled = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return versions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("archived", F.lit(False))).alias("archived"),
        filled("data_sources").alias("with_sources"), filled(F.map_keys("quality_results")).alias("with_quality"),
        filled("output_files").alias("with_outputs"),
    )


def names_of(files: Column) -> Column:
    return F.transform(F.coalesce(files, F.expr("array()").cast(f"array<{FILE_TYPE}>")), lambda f: F.coalesce(f["name"], F.lit("")))


def list_change(before: Column, after: Column) -> Column:
    """'added: x、y；removed: z' of two name lists, 'unchanged' when they hold the same names."""
    added, removed = F.array_sort(F.array_except(after, before)), F.array_sort(F.array_except(before, after))
    parts = F.array_compact(F.array(
        F.when(F.size(added) > 0, F.concat(F.lit("added: "), F.array_join(added, "、"))),
        F.when(F.size(removed) > 0, F.concat(F.lit("removed: "), F.array_join(removed, "、"))),
    ))
    return F.when(F.size(parts) == 0, "unchanged").otherwise(F.array_join(parts, "；"))


def diff_versions(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Field-by-field differences of version pairs (id_a, id_b), one row per compared field.

    Parameters are compared over the union of both maps, a missing one counting as ''.
    """
    side = lambda p: versions.select(*[F.col(c).alias(f"{p}_{c}") for c in versions.columns])
    known = pairs.join(side("a"), F.col("id_a") == F.col("a_version_id"), "left").join(
        side("b"), F.col("id_b") == F.col("b_version_id"), "left"
    )
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    score = lambda p, k: F.coalesce(F.try_element_at(F.col(f"{p}_quality_results"), F.lit(k)), F.lit("-"))
    row = lambda name, b, a, s=None: F.struct(
        F.lit(name).alias("field") if isinstance(name, str) else name.alias("field"), b.alias("before"), a.alias("after"),
        (s if s is not None else F.when(b == a, "unchanged").otherwise(F.concat(b, F.lit(" → "), a))).alias("summary"),
    )
    scalar = [row(c, text(F.col(f"a_{c}")), text(F.col(f"b_{c}"))) for c in ("version_number", "module_name", "description", "created_by")]
    quality = [row(f"quality_{k}", score("a", k), score("b", k)) for k in ("score", "grade")]
    none = F.array().cast("array<string>")
    lists = []
    for name, get in (
        ("data_sources", lambda p: names_of(F.col(f"{p}_data_sources"))),
        ("output_files", lambda p: names_of(F.col(f"{p}_output_files"))),
        ("tags", lambda p: F.coalesce(F.col(f"{p}_tags"), none)),
    ):
        lists.append(row(name, F.array_join(get("a"), ","), F.array_join(get("b"), ","), list_change(get("a"), get("b"))))
    state = lambda p: F.when(F.coalesce(F.col(f"{p}_archived"), F.lit(False)), "archived").otherwise("not archived")
    empty = F.expr("map()").cast("map<string,string>")
    pa, pb = F.coalesce("a_conversion_params", empty), F.coalesce("b_conversion_params", empty)
    keys = F.array_sort(F.array_distinct(F.concat(F.map_keys(pa), F.map_keys(pb))))
    params = F.transform(keys, lambda k: row(
        F.concat(F.lit("param_"), k), F.coalesce(F.try_element_at(pa, k), F.lit("")), F.coalesce(F.try_element_at(pb, k), F.lit(""))
    ))
    params = F.when(F.size(keys) > 0, params).otherwise(F.array(row("params", F.lit(""), F.lit(""), F.lit("no parameters recorded"))))
    found = F.col("a_version_id").isNotNull() & F.col("b_version_id").isNotNull()
    gone = F.array(row("version", F.col("id_a"), F.col("id_b"), F.lit("version not found")))
    rows = F.when(found, F.concat(F.array(*scalar, *quality, *lists, row("archived", state("a"), state("b"))), params)).otherwise(gone)
    return known.select("id_a", "id_b", F.inline(rows)).withColumn(
        "changed", (F.col("before") != F.col("after")) | (F.col("summary") == "version not found")
    )


def parameter_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameters in long form (keys.., name, value) compared by a full outer join."""
    b = before.withColumnRenamed("value", "before")
    a = after.withColumnRenamed("value", "after")
    both = b.join(a, [*keys, "name"], "full_outer").na.fill("", ["before", "after"])
    return both.withColumn("changed", F.col("before") != F.col("after"))


def lineage(versions: DataFrame) -> DataFrame:
    """Trace text and the five phases of each version."""
    head3 = lambda arr: F.slice(arr, 1, 3)
    empty = F.expr("map()").cast("map<string,string>")
    params = F.coalesce("conversion_params", empty)
    steps = F.transform(F.coalesce("workflow_steps", F.expr("array()").cast(f"array<{STEP_TYPE}>")), lambda s: F.coalesce(s["step"], F.lit("")))
    quality = F.coalesce("quality_results", empty)
    sources, outputs = names_of(F.col("data_sources")), names_of(F.col("output_files"))
    pick = lambda k: F.coalesce(F.try_element_at(quality, F.lit(k)), F.lit("-"))
    pairs = F.transform(F.map_entries(params), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    part = lambda on, label, body: F.when(F.size(on) > 0, F.concat(F.lit(label), body))
    segments = F.array_compact(F.array(
        part(sources, "sources: ", F.array_join(head3(sources), ", ")),
        part(pairs, "params: ", F.array_join(head3(pairs), ", ")),
        part(steps, "workflow: ", F.array_join(head3(steps), " / ")),
        part(F.map_keys(quality), "quality: ", pick("score")),
        part(outputs, "outputs: ", F.array_join(head3(outputs), ", ")),
    ))
    prefix = F.concat(F.lit("version "), F.col("version_number"), F.lit(" ("), F.col("version_id"), F.lit(")"))
    trace = F.when(F.size(segments) > 0, F.concat(prefix, F.lit(" | "), F.array_join(segments, " → "))).otherwise(prefix)
    phase = lambda name, records: F.struct(F.lit(name).alias("phase"), records.alias("records"))
    return versions.select(
        "version_id", "version_number", "project_name", "module_name",
        F.array(phase("intake", sources), phase("parameters", pairs), phase("workflow", steps),
                phase("quality", F.array(F.concat(pick("score"), F.lit("/"), pick("grade")))), phase("outputs", outputs)).alias("phases"),
        trace.alias("trace_chain"),
    )


def version_report(versions: DataFrame, current_number: str = "", keys: Sequence[str] = KEY) -> DataFrame:
    """Per key: version count, latest and the newest version that carries ``current_number``."""
    mine = latest_versions(versions.filter(F.col("version_number") == current_number), keys).select(
        *keys, F.col("version_id").alias("current_id"), F.col("version_number").alias("current_version")
    )
    newest = latest_versions(versions, keys).withColumnsRenamed({"version_id": "latest_id", "version_number": "latest_version"})
    return newest.join(mine, list(keys), "left")


IMPORT_KEY = ("project_name", "module_name", "version_number", "created_at")


def skip_registered(
    incoming: DataFrame, registered: DataFrame, keys: Sequence[str] = IMPORT_KEY, order_by: Sequence[str] = ("ordinal",)
) -> DataFrame:
    """Incoming rows not registered yet; of repeats inside the import the first by ``order_by`` stays."""
    return keep_first(incoming, keys, order_by, trim=False).join(registered.select(*keys).distinct(), list(keys), "left_anti")


def with_file_facts(versions: DataFrame, files: DataFrame, column: str = "data_sources") -> DataFrame:
    """Long list of a version's files with size and existence looked up in ``files(path, length)``."""
    long = versions.select("version_id", F.posexplode(F.col(column)).alias("ordinal", "f")).select("version_id", "ordinal", "f.*")
    facts = files.select("path", F.col("length").alias("_length"))
    return long.join(facts, "path", "left").select(
        "version_id", "ordinal", F.coalesce(F.nullif("name", F.lit("")), V.file_name(F.col("path"))).alias("name"), "path",
        F.coalesce(F.nullif("format", F.lit("")), V.file_suffix(F.col("path"))).alias("format"),
        F.coalesce("_length", F.lit(0)).alias("size_bytes"), F.col("_length").isNotNull().alias("exists"),
    )


def archive(versions: DataFrame, ids: DataFrame, root: str) -> DataFrame:
    """Mark versions as archived under ``root``/<number>_<id>."""
    safe = F.regexp_replace("version_number", "[^0-9A-Za-z._-]+", "_")
    hit = ids.select("version_id").distinct().withColumn("_hit", F.lit(True))
    path = F.concat(F.lit(root.rstrip("/") + "/"), safe, F.lit("_"), F.col("version_id"))
    return versions.join(hit, "version_id", "left").withColumns(
        {"archived": F.coalesce("_hit", "archived"), "archive_path": F.when(F.col("_hit"), path).otherwise(F.col("archive_path"))}
    ).drop("_hit")


def archive_manifest(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Copy status of every output of archived versions."""
    outputs = with_file_facts(versions.filter("archived"), files, "output_files")
    places = versions.select("version_id", "archive_path")
    target = F.concat("archive_path", F.lit("/artifacts/"), V.file_name(F.col("path")))
    return outputs.join(places, "version_id").select(
        "version_id", "name", F.col("path").alias("source_path"), F.when(F.col("exists"), target).otherwise("").alias("archive_path"),
        F.col("exists").alias("copied"),
    )

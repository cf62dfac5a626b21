"""Templates inside a batch, and version records from finished tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom import fixed_values as fv
from terraloom.operators import templates as T, versions as R

TABULAR = {".csv": "CSV", ".txt": "TXT", ".json": "JSON", ".geojson": "GEOJSON"}


@dataclass
class TemplateOutcome:
    status: str                 # not_requested / skipped / applied / failed
    message: str
    rows: DataFrame | None = None
    problems: DataFrame | None = None
    checks: DataFrame | None = None


def apply_in_batch(df: DataFrame | None, suffix: str, template: T.RuleTemplate | None, row_id: str = "_row_id", keep=("geometry",)) -> TemplateOutcome:
    """Map a file group before conversion; formats the template does not name pass unchanged.

    A missing required cell or a broken required / unique constraint fails the group.
    """
    if template is None:
        return TemplateOutcome("not_requested", "")
    allowed = {f.upper() for f in template.input_formats}
    fmt = TABULAR.get(suffix.lower())
    if fmt is None or df is None or (allowed and fmt not in allowed):
        return TemplateOutcome("skipped", f"template does not apply to {suffix} files")
    done = T.apply_template(df, template, row_id, [k for k in keep if k in df.columns])
    checks = T.check_constraints(done.rows.drop(row_id, *keep), template.quality_check_rule) if template.quality_check_rule else None
    missing = done.problems.filter("problem = 'missing_required'").groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy("field").limit(4).collect()
    errors = [f"{r['field']}: {r['n']} required cells missing" for r in missing]
    if checks is not None:
        errors += [f"{r['check']} {r['field']}: {r['count']}" for r in checks.filter("severity = 'error'").orderBy("check", "field").limit(4).collect()]
    if errors:
        return TemplateOutcome("failed", "；".join(errors[:4]), None, done.problems, checks)
    return TemplateOutcome("applied", "mapped", done.rows, done.problems, checks)


def template_report(inputs: DataFrame, headers: DataFrame, table: DataFrame, project: str = fv.ALL_CATEGORIES, source: str = fv.ALL_CATEGORIES) -> dict[str, DataFrame]:
    """Classify inputs(path, text), then score the templates for the commonest project and source.

    ``headers(header)`` are the inputs' columns.
    """
    known = F.create_map(*[F.lit(x) for kv in fv.EXTENSION_FORMATS.items() for x in kv])
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    other = F.coalesce(F.nullif(F.upper(F.regexp_replace(suffix, r"^\.", "")), F.lit("")), F.lit("UNKNOWN"))
    analysed = inputs.withColumn("format", F.coalesce(F.try_element_at(known, suffix), other))
    analysed = T.classify_inputs(analysed, "text", fv.SOURCE_HINTS, fv.GENERIC_SOURCE, "inferred_source")
    analysed = T.classify_inputs(analysed, "text", fv.PROJECT_HINTS, fv.GENERIC_PROJECT, "inferred_project")
    if project == fv.ALL_CATEGORIES:
        project = T.most_common(analysed, "inferred_project", fv.GENERIC_PROJECT) or project
    if source == fv.ALL_CATEGORIES:
        source = T.most_common(analysed, "inferred_source", fv.GENERIC_SOURCE) or source
    scored = T.recommend(table, headers, analysed.select("format"), project, source)
    return {"files": analysed, "matching": scored, "best": T.best_template(scored), "audit": T.audit_catalogue(table)}


def versions_from_tasks(existing: DataFrame, tasks: DataFrame, row_id: str = "row_id") -> DataFrame:
    """New version rows for finished tasks: numbered, identified, default workflow filled in.

    tasks: row_id BIGINT plus the version columns except version_id, version_number and archive fields.
    """
    step = lambda name, ok: F.struct(F.lit(name).alias("step"), F.when(ok, "done").otherwise("not given").alias("status"), F.lit(None).cast("string").alias("timestamp"))
    quality = F.coalesce(F.size(F.map_keys("quality_results")), F.lit(0)) > 0
    outputs = F.coalesce(F.size("output_files"), F.lit(0)) > 0
    default = F.array(step("intake", F.lit(True)), step("parameters", F.lit(True)), step("conversion", F.lit(True)), step("quality", quality), step("register", outputs))
    workflow = F.when(F.coalesce(F.size("workflow_steps"), F.lit(0)) > 0, F.col("workflow_steps")).otherwise(default)
    numbered = R.assign_numbers(existing, tasks.withColumn("workflow_steps", workflow), row_id)
    last = existing.agg(F.coalesce(F.max(_counter()), F.lit(0))).first()[0]
    out = R.version_ids(numbered, row_id, F.to_date("created_at"), start=last)
    names = [p.strip().split(" ")[0] for p in _columns(R.VERSION_SCHEMA)]
    return out.withColumn("archived", F.lit(False)).withColumn("archive_path", F.lit("")).select(*names)


def _counter():
    from terraloom.functions.values import counter_from_id

    return counter_from_id(F.col("version_id"))


def _columns(schema: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def register(existing_path: str, new: DataFrame) -> None:
    """Append version rows to the versions table."""
    new.write.mode("append").parquet(existing_path)


def empty_versions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], R.VERSION_SCHEMA)

"""Profile a set of tables, raise issues, optionally clean and check again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import scoring
from terraloom.operators import cleaning, dedup, issues as I, profiling
from terraloom.plans.reports import Report, finish
from terraloom.session import materialise

CATEGORIES = list(fv.PREPROCESSING_CATEGORIES)
CODES = fv.PREPROCESSING_CODES


def table_issues(name: str, df: DataFrame, row_id: str, profile: DataFrame, required: Sequence[str] = (), keys: Sequence[str] | None = None,
                 sigma: float = 3.0) -> list[DataFrame]:
    spark = df.sparkSession
    body = df.drop(row_id)
    issue = lambda frame, no, category, **kw: I.issue_rows(frame, check_no=no, category=category, code=CODES[category], file=name, **kw)
    out = [issue(body.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), 1, "field_validation", severity=fv.WARNING, message="the table has no rows")]
    gone = profiling.missing_required(body, required)
    if gone:
        lost = spark.createDataFrame([(", ".join(gone),)], "names string")
        out.append(issue(lost, 2, "field_validation", severity=fv.CRITICAL, message=F.concat(F.lit("missing required fields: "), F.col("names")),
                         suggestion="add the columns or change the rule"))
    ratio = F.col("outlier_count") / F.col("numeric_count")
    out.append(issue(
        profile.filter("outlier_count > 0"), 3, "outliers", severity=scoring.outlier_severity(ratio), field=F.col("field"),
        message=F.format_string(f"%s: %d values beyond {sigma} sigma", "field", "outlier_count"), suggestion="check where they come from",
    ))
    units = F.create_map(*[F.lit(x) for u, (t, f) in fv.UNITS.items() if f != 1.0 for x in (u, f"{t} (x {f!r})")])
    target = F.try_element_at(units, F.col("unit_detected"))
    out.append(issue(
        profile.filter(F.col("unit_detected").isNotNull() & target.isNotNull()), 4, "unit_normalization", severity=fv.INFO, field=F.col("field"),
        message=F.concat(F.col("field"), F.lit(" looks like "), F.col("unit_detected"), F.lit(", convert to "), target),
    ))
    share = F.try_divide(F.col("missing"), F.col("total"))
    out.append(issue(
        profile.filter(share > 0.1), 5, "missing_values", severity=scoring.missing_severity(share), field=F.col("field"),
        message=F.format_string("%s: %.1f%% missing", F.col("field"), share * 100), suggestion="fill the gaps or drop the field",
    ))
    twins = dedup.duplicate_rows(body, keys).filter("duplicate_count > 0")
    out.append(issue(
        twins, 6, "duplicates", severity=scoring.duplicate_severity(F.col("duplicate_count")),
        message=F.format_string("%d repeated rows over %d key fields", "duplicate_count", "key_fields"),
    ))
    return out


def preprocessing_report(
    tables: Mapping[str, DataFrame], row_id: str = "_row_id", required_fields: Sequence[str] = (), duplicate_keys: Sequence[str] | None = None,
    sigma: float = 3.0,
) -> Report:
    """Issues, field profiles and score of several tables; every table carries a unique ``row_id``."""
    found, profiles = [], None
    for name, df in tables.items():
        profile = profiling.profile_fields(df, [c for c in df.columns if c != row_id], sigma, row_id)
        found += table_issues(name, df, row_id, profile, required_fields, duplicate_keys, sigma)
        profile = profile.withColumn("file", F.lit(name))
        profiles = profile if profiles is None else profiles.unionByName(profile)
    return finish(found, CATEGORIES, fv.PREPROCESSING_PENALTY, "D", fields=profiles)


def clean_and_recheck(
    tables: Mapping[str, DataFrame], row_id: str = "_row_id", required_fields: Sequence[str] = (), duplicate_keys: Sequence[str] | None = None,
    sigma: float = 3.0, fill_strategy: str = "median_mode", unit_factors: Mapping[str, float] | None = None,
) -> tuple[Report, dict[str, DataFrame], Report]:
    """(report before, cleaned tables, report after). The first report also holds the actions taken."""
    tables = {name: materialise(df) for name, df in tables.items()}  # two reports and a plan read them some twenty times
    before = preprocessing_report(tables, row_id, required_fields, duplicate_keys, sigma)
    cleaned, actions = {}, None
    for name, df in tables.items():
        plan = cleaning.plan_cleaning(df, row_id, duplicate_keys, fill_strategy, unit_factors, sigma)
        cleaned[name] = cleaning.clean(df, plan, row_id)
        done = cleaning.cleaning_actions(df, plan).withColumn("file", F.lit(name))
        actions = done if actions is None else actions.unionByName(done)
    before.frames["actions"] = actions
    return before, cleaned, preprocessing_report(cleaned, row_id, required_fields, duplicate_keys, sigma)


def mesh_light_issues(name: str, vertices: DataFrame, corners: DataFrame | None = None) -> list[DataFrame]:
    """Repeated vertices, invalid faces and boundary edges of one mesh set (outlier checks stay off)."""
    from terraloom.operators import mesh

    issue = lambda frame, no, category, **kw: I.issue_rows(frame, check_no=no, category=category, code=CODES[category], file=F.col("model_id"), **kw)
    twins = mesh.duplicate_vertices(vertices, 0.0).groupBy("model_id").agg(F.sum(F.col("n") - 1).alias("n"))
    out = [issue(twins, 11, "duplicates", severity=F.when(F.col("n") > 10, fv.WARNING).otherwise(fv.INFO), message=F.format_string("%d repeated vertices", "n"))]
    if corners is not None:
        corners = materialise(corners)  # for the references and for the edges
        validity = materialise(mesh.face_validity(corners, vertices))
        largest = validity.agg(F.max("size")).first()[0] or 0
        bad = validity.filter("bad_refs > 0").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
        out.append(issue(bad, 12, "field_validation", severity=fv.CRITICAL, message=F.format_string("%d faces refer to unknown vertices", "n")))
        edge = mesh.topology_summary(mesh.edge_uses(mesh.corner_edges(corners, largest))).filter("boundary > 0")
        out.append(issue(edge, 13, "outliers", severity=fv.WARNING, message=F.format_string("%d boundary edges: the mesh is open", "boundary")))
    return out

"""Issue tables: numbering, roll-ups, scores and statuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import scoring
from terraloom.functions.ordering import range_index

ISSUE_SCHEMA = (
    "check_no int, category string, code string, file string, field string, row_id bigint, severity string,"
    " message string, suggestion string"
)
ISSUE_COLUMNS = ["check_no", "category", "code", "file", "field", "row_id", "severity", "message", "suggestion"]


def empty_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def issue_rows(
    df: DataFrame, *, check_no: int, category: str, code: str, file: Column | str, severity: Column | str,
    message: Column | str, field: Column | str | None = None, row_id: Column | None = None, suggestion: str = "",
) -> DataFrame:
    """Rows of ``df`` as issues in the common layout."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        F.lit(check_no).alias("check_no"), F.lit(category).alias("category"), F.lit(code).alias("code"),
        lit(file).cast("string").alias("file"), lit(field).cast("string").alias("field"),
        (row_id if row_id is not None else F.lit(None)).cast("bigint").alias("row_id"), lit(severity).alias("severity"),
        lit(message).alias("message"), F.lit(suggestion).alias("suggestion"),
    )


def union_issues(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def location(issues: DataFrame) -> Column:
    return (
        F.when(F.col("row_id").isNotNull(), F.concat(F.lit("row "), F.col("row_id").cast("string")))
        .when(F.col("field").isNotNull(), F.concat(F.lit("field "), F.col("field")))
        .otherwise("file")
    )


def number_issues(issues: DataFrame, prefix: str) -> DataFrame:
    """Sequential ids over (file, check, field, row), such as Q-0001."""
    numbered = range_index(issues, [F.coalesce("file", F.lit("")), "check_no", F.coalesce("field", F.lit("")), F.coalesce("row_id", F.lit(-1)), "message"], "_no", start=1)
    text = F.col("_no").cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return numbered.withColumn("issue_id", F.concat(F.lit(prefix + "-"), padded)).withColumn("location", location(issues)).drop("_no")


def severity_counts(issues: DataFrame) -> DataFrame:
    """One row: number of issues of each severity."""
    return issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in fv.SEVERITY_RANK])


def issue_rollup(issues: DataFrame, penalties: Mapping[str, int]) -> DataFrame:
    """Counts and penalty per (category, severity), per category and in total."""
    return (
        issues.rollup("category", "severity")
        .agg(F.count(F.lit(1)).alias("issue_count"), F.sum(scoring.penalty(F.col("severity"), dict(penalties))).alias("penalty"))
    )


def score(issues: DataFrame, penalties: Mapping[str, int], has_input: bool = True) -> DataFrame:
    """One row: score, grade, issue count and the pass flag."""
    out = issues.agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.coalesce(F.sum(scoring.penalty(F.col("severity"), dict(penalties))), F.lit(0)).alias("penalty"),
        F.count_if(F.col("severity").isin(fv.CRITICAL, fv.WARNING)).alias("_bad"),
    ).withColumn("score", scoring.clamp_score(F.lit(100) - F.col("penalty")))
    return out.select(
        "issue_count", "penalty", "score", scoring.grade(F.col("score"), F.lit(has_input)).alias("grade"),
        (F.lit(has_input) & (F.col("_bad") == 0)).alias("passed"),
    )


def category_status(issues: DataFrame, categories: Sequence[str], info_is_pass: bool = False) -> DataFrame:
    """Per category: issue count, worst severity as status, first message. Empty categories pass."""
    found = issues.groupBy("category").agg(
        F.count(F.lit(1)).alias("issue_count"),
        F.max(scoring.severity_rank(F.col("severity"))).alias("worst"),
        F.min_by("message", F.struct("file", "check_no", "field", "row_id", "message")).alias("summary"),
    )
    known = issues.sparkSession.createDataFrame([(i, c) for i, c in enumerate(categories)], "ordinal int, category string")
    status = (
        F.when(F.col("worst") == 3, "failed").when(F.col("worst") == 2, "review")
        .when(F.col("worst") == 1, "passed" if info_is_pass else "passed_with_notes").otherwise("passed")
    )
    return (
        known.join(found, "category", "left")
        .select(
            "ordinal", "category", F.coalesce("issue_count", F.lit(0)).alias("issue_count"), status.alias("status"),
            F.coalesce("summary", F.lit("no issue found")).alias("summary"),
        )
    )


def file_status(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Issue count per file; a checked file with issues becomes 'issues_found'."""
    counts = issues.groupBy("file").agg(F.count(F.lit(1)).alias("issue_count"))
    return (
        files.join(counts, files["name"] == counts["file"], "left")
        .drop(counts["file"])
        .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
        .withColumn("status", F.when((F.col("status") == "checked") & (F.col("issue_count") > 0), "issues_found").otherwise(F.col("status")))
    )

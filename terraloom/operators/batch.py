"""State of batch runs: item states, job status, retries, logs and summaries.

Items: job_id, file_id, state (success / failed / skipped / cancelled / unselected), retries, error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import values as V
from terraloom.session import cut_lineage


def job_status(items: DataFrame) -> DataFrame:
    """Counts and status per job: completed if nothing failed or was left out, partial with some success, else failed.

    Items never selected count as skipped but do not touch the status; cancelled ones count as skipped and do.
    """
    n = lambda s: F.count_if(F.col("state") == s)
    out = items.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("_skipped"),
        n("cancelled").alias("cancelled"), n("unselected").alias("_unselected"), F.coalesce(F.sum("retries"), F.lit(0)).alias("retried"),
    )
    status = (
        F.when((F.col("cancelled") > 0) & (F.col("failed") > 0), "failed")
        .when((F.col("failed") == 0) & (F.col("_skipped") + F.col("cancelled") == 0), "completed")
        .when(F.col("success") > 0, "partial").otherwise("failed")
    )
    done = F.col("total") - F.col("cancelled")
    skipped = F.col("_skipped") + F.col("_unselected") + F.col("cancelled")
    return out.select(
        "job_id", "total", "success", "failed", skipped.alias("skipped"), "cancelled", "retried", status.alias("status"),
        F.round(F.try_divide(done, F.col("total")) * 100, 4).alias("progress"),
    )


def batch_summary(jobs: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), total("total").alias("total_files"), total("success").alias("total_success"),
        total("failed").alias("total_failed"), total("skipped").alias("total_skipped"), total("retried").alias("total_retried"),
    )
    rate = F.try_divide(F.col("total_success"), F.col("total_success") + F.col("total_failed"))
    return out.withColumn("success_rate", F.round(F.coalesce(rate, F.lit(0.0)), 4))


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status; failed includes partial."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return jobs.agg(
        F.count(F.lit(1)).alias("total"), n("queued").alias("queued"), n("running").alias("running"), n("completed").alias("completed"),
        n("failed", "partial").alias("failed"), n("cancelled").alias("cancelled"),
    )


def list_jobs(jobs: DataFrame, status: str | None = None) -> DataFrame:
    return (jobs.filter(F.col("status") == status) if status else jobs).orderBy(F.desc("created_at"), F.desc("job_id"))


def template_stats(items: DataFrame, column: str = "template_status") -> DataFrame:
    """Items by template outcome; an unknown outcome counts as failed, a missing one as not requested."""
    known = ("applied", "skipped", "not_requested", "failed")
    status = F.coalesce(F.col(column), F.lit("not_requested"))
    folded = F.when(status.isin(*known), status).otherwise("failed")
    return items.groupBy(folded.alias("status")).agg(F.count(F.lit(1)).alias("items"))


def run_with_retry(
    items: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], max_retries: int = 3, strategy: str = "retry",
    key: str = "file_id",
) -> DataFrame:
    """Run ``attempt(items, number)`` and again on what failed with a retryable error.

    ``attempt`` returns (key, ok BOOLEAN, error). One Spark job per round over the failed subset;
    results are cut from their lineage, so a round is not repeated. Strategies: retry, skip, abort. Every key
    comes back once; a negative number of retries means none.
    """
    rounds = max(0, max_retries)
    open_, finished = items.select(key).distinct(), None
    for number in range(rounds + 1):
        tried = cut_lineage(attempt(open_, number).withColumn("retries", F.lit(number)))
        state = F.when(F.col("ok"), "success").otherwise("skipped" if strategy == "skip" else "failed")
        tried = tried.withColumn("state", state).withColumn("again", ~F.col("ok") & V.is_retryable(F.coalesce("error", F.lit(""))))
        last = number == rounds or strategy != "retry"
        done = tried if last else tried.filter("not again")
        result = done.select(key, "state", "retries", "error")
        finished = result if finished is None else finished.unionByName(result)
        if last:
            break
        open_ = tried.filter("again").select(key)
        if open_.isEmpty():
            break
    if strategy == "abort" and not finished.filter("state = 'failed'").isEmpty():
        first = finished.filter("state = 'failed'").first()
        raise RuntimeError(f"batch aborted at {first[key]}: {first['error']}")
    return finished


def collect_outputs(artifacts: DataFrame) -> DataFrame:
    """Outputs, sidecars and manifest of each report, in order and without repeats.

    artifacts: report_id, ordinal, output, sidecar_files ARRAY<STRING>; a report lists one run's files.
    """
    none = F.array().cast("array<string>")
    own = F.concat(F.when(F.coalesce("output", F.lit("")) != "", F.array("output")).otherwise(none), F.coalesce("sidecar_files", none))
    long = artifacts.select("report_id", "ordinal", F.posexplode(own).alias("pos", "path"))
    return long.groupBy("report_id", "path").agg(F.min(F.struct("ordinal", "pos")).alias("place")).select(
        "report_id", "path", F.col("place.ordinal").alias("ordinal"), F.col("place.pos").alias("pos")
    )


def error_text(errors: Column, messages: Column, status: Column) -> Column:
    """First four errors joined, else the first four failure messages, else the status."""
    join4 = lambda a: F.array_join(F.slice(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda t: t != ""), 1, 4), "；")
    return F.coalesce(F.nullif(join4(errors), F.lit("")), F.nullif(join4(messages), F.lit("")), status)


def log_rank(level: Column) -> Column:
    levels = F.array(*[F.lit(x) for x in fv.LOG_LEVELS])
    place = F.array_position(levels, level)
    return F.when(place > 0, place - 1).otherwise(1)


def visible_logs(logs: DataFrame, floor: str = "INFO") -> DataFrame:
    """Log rows at or above a level, by time."""
    return logs.filter(log_rank(F.col("level")) >= log_rank(F.lit(floor))).orderBy("timestamp")

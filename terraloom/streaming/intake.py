"""Structured Streaming intake: the batch rules on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from terraloom.functions import values as V
from terraloom.functions.values import q


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 500, pattern: str | None = None, **options) -> DataFrame:
    """Files of a folder as a stream; at most ``max_files`` new ones per micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max(1, max_files)).options(**options)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def row_problems(df: DataFrame, required: Sequence[str] = (), ranges: dict[str, tuple[float | None, float | None]] | None = None) -> Column:
    """Array of problems of a row: missing required cells and numbers out of fixed bounds.

    The bounds come from the last batch profile, since exact medians cannot be kept in a stream.
    """
    notes = [F.when(~V.has_value(q(c), df.schema[c].dataType), F.lit(f"missing:{c}")) for c in required]
    for c, (low, high) in (ranges or {}).items():
        n = V.to_number(q(c), df.schema[c].dataType)
        bad = n.isNull()
        bad = bad if low is None else bad | (n < low)
        bad = bad if high is None else bad | (n > high)
        notes.append(F.when(V.has_value(q(c), df.schema[c].dataType) & F.coalesce(bad, F.lit(True)), F.lit(f"range:{c}")))
    return F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")


def split_intake(
    stream: DataFrame, checkpoint: str, good_path: str, dead_letter_path: str, required: Sequence[str] = (),
    ranges: dict | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Write sound rows and dead letters of each micro-batch to their folders.

    A batch lands in a folder named by its id and replaces it on a retry, so replays add nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        marked = (prepare(batch) if prepare else batch).withColumn("problems", row_problems(batch, required, ranges)).persist()
        try:
            marked.filter(F.size("problems") == 0).drop("problems").write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
            marked.filter(F.size("problems") > 0).write.mode("overwrite").parquet(f"{dead_letter_path}/batch={batch_id}")
        finally:
            marked.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def dedup_stream(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of each other."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def issue_rate(stream: DataFrame, category: str, time: str, is_issue: Column, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Issues per category and tumbling window; rows later than ``delay`` are left out."""
    return (
        stream.withWatermark(time, delay).groupBy(F.window(time, width), q(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if(is_issue).alias("issues"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "category", "rows", "issues")
    )

"""Parts of binary files as rows, so that one large file is read by many tasks.

Spark lists the files; a range is a row (path, offset, length), dealt over the tasks and read there with the file systems of
pyarrow (local or mounted paths, hdfs, s3, gs, abfs). In a store that only Spark's own readers open, a file is one row of Spark's
binary reader, cut into the same ranges in its task; there a file must fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RANGE = 64 << 20
STEP = 8 << 20  # bytes in memory at a time where a file is streamed
SCHEMES = {"", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss"}


def listing(spark: SparkSession, path: Sequence[str] | str) -> DataFrame:
    """(path, length) of files, spelled as the line readers spell them; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


def opened(path: str):
    """A stream of one file on an executor."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def _reachable(spark: SparkSession, path: Sequence[str] | str) -> bool:
    """Whether pyarrow opens the store of these paths; a path without a scheme stands in the session's default store."""
    default = urlparse(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///").scheme
    return all((urlparse(p).scheme or default) in SCHEMES for p in ([path] if isinstance(path, str) else path))


def read_ranges(spark: SparkSession, path: Sequence[str] | str, wanted: DataFrame) -> DataFrame:
    """wanted(path, offset, size) -> the same rows with ``content``, the bytes there; fewer where the file ends."""
    schema = "path string, offset bigint, size bigint, content binary"
    rows = wanted.select("path", "offset", "size")
    if not _reachable(spark, path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        whole = files.select(F.col("_metadata.file_path").alias("path"), F.col("content").alias("_all"))
        piece = F.expr("substring(_all, cast(offset + 1 as int), cast(size as int))")
        return rows.join(whole, "path").select("path", "offset", "size", piece.alias("content"))

    def read(batches):
        for batch in batches:
            for p, offset, size in zip(batch["path"], batch["offset"], batch["size"], strict=True):
                with opened(p) as f:
                    f.seek(offset)
                    yield pd.DataFrame({"path": [p], "offset": [offset], "size": [size], "content": [f.read(size)]})

    return rows.repartition("path", "offset").mapInPandas(read, schema)


def ranges(files: DataFrame, header: int, record: int, size: int = RANGE) -> DataFrame:
    """(path, offset, size, first): ranges of whole records behind a header; ``first`` counts the records before a range."""
    each = max(1, size // record)
    n = F.floor((F.col("length") - header) / record)
    starts = files.withColumn("_n", n).filter("_n > 0").select("path", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(each).cast("bigint"))).alias("first"))
    return starts.select("path", (F.col("first") * record + header).alias("offset"), (F.least(F.lit(each), F.col("_n") - F.col("first")) * record).alias("size"), "first")


def little_endian(content: Column, at: int) -> Column:
    """The unsigned 32-bit number at a byte position (from 0)."""
    le = F.hex(F.substring(content, at + 1, 4))
    return F.conv(F.concat(*[F.substring(le, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint")


def checksums(spark: SparkSession, path: Sequence[str] | str) -> DataFrame:
    """(path, length, sha256) of files; a file streams through its task in steps of a few megabytes."""
    if not _reachable(spark, path):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(F.col("_metadata.file_path").alias("path"), "length", F.sha2("content", 256).alias("sha256"))

    def run(batches):
        for batch in batches:
            sums = []
            for p in batch["path"]:
                state = hashlib.sha256()
                with opened(p) as f:
                    while step := f.read(STEP):
                        state.update(step)
                sums.append(state.hexdigest())
            yield batch.assign(sha256=sums)

    return listing(spark, path).repartition("path").mapInPandas(run, "path string, length bigint, sha256 string")

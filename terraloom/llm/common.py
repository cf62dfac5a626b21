"""What the operators of this package share: words, hashes, bounded slices of Arrow batches, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from terraloom.session import checkpoint_folder

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
MASK = 0xFFFFFFFFFFFFFFFF

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: str = "text") -> Column:
    """Words of a text; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fourth document by checksum; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


KEYS = ("_key1", "_key2")


def keyed(docs: DataFrame) -> DataFrame:
    """Add a 128-bit key of doc_id, source and text; only repeated rows share it, and it is never null."""
    return docs.withColumns({KEYS[0]: F.xxhash64("doc_id", "source", "text"), KEYS[1]: F.xxhash64("text", "doc_id", F.lit(1), "source")})


def wrapped(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct ``_doc`` beside their key, so that no column of theirs clashes with an inner one."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key1, key2 = F.xxhash64("doc_id", "source", "text"), F.xxhash64("text", "doc_id", F.lit(1), "source")
    return docs.select(F.struct(*columns).alias("_doc"), key1.alias(KEYS[0]), key2.alias(KEYS[1]))


def hash_sample(keys: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group (a few groups), the lowest by ``order``, a 64-bit hash.

    The counts of the groups give each a bound on the hash under which about four times the wanted rows lie; only those are
    ranked, so the ranking task of a group gets a bounded number of rows, however large the group is.
    """
    counts = {r[group]: r["n"] for r in keys.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    low = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        # hashes lie evenly between -2^63 and 2^63
        bound = (1 << 63) - 1 if n <= 4 * most else -(1 << 63) + (1 << 64) * 4 * most // n
        low = low | ((F.col(group) == F.lit(value)) & (F.col(order) <= F.lit(bound)))
    rank = F.row_number().over(W.partitionBy(group).orderBy(order))
    return keys.filter(low).withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def save(df: DataFrame) -> DataFrame:
    """Write a frame as a compressed table in the shared checkpoint folder and read it back: it cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice has few rows and, one long text aside, few bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(batch.schema.get_field_index(text))
        lengths = [0 if n is None else n for n in pc.binary_length(lengths).to_pylist()]
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and (total + n > size or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in an array of UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", BASE), ("_inverses", _BASE_INVERSE)):
            steps = np.full(size, base & MASK, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


class SpanHash:
    """64-bit hashes of any spans of one byte array, from one pass over it; equal spans have equal hashes."""

    def __init__(self, raw: np.ndarray):
        powers, _ = _power_tables(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[raw] * powers[: len(raw)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        _, inverses = _power_tables(len(self.sums))
        value = (self.sums[stop] - self.sums[start]) * inverses[start]
        return mixed(value + np.uint64(0x8CB92BA72F3D8DD7) * (np.asarray(stop) - np.asarray(start)).astype(np.uint64))


def utf8(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)

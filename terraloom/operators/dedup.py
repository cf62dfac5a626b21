"""Duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.functions.values import q, strip
from terraloom.session import cut_lineage


def key_columns(df: DataFrame, keys: Sequence[str] | None) -> list[str]:
    """Known key names; every column when none of them is known."""
    return [k for k in (keys or df.columns) if k in df.columns] or list(df.columns)


def keep_first(df: DataFrame, keys: Sequence[str] | None, order_by: Sequence[str], trim: bool = True) -> DataFrame:
    """First row of each key in the given order.

    ``row_number() = 1`` is planned with a limit per key before the shuffle, so a key that holds
    a third of all rows still ships one row per task. Rows are sorted by a hash of the key first: eight
    bytes decide nearly every comparison, where texts that begin alike are compared to their end.
    """
    cells = []
    for name in key_columns(df, [k for k in (keys or df.columns) if keys or k not in order_by]):
        text = F.coalesce(q(name).cast("string"), F.lit(""))
        is_text = df.schema[name].dataType.simpleString() == "string"
        cells.append(strip(text) if trim and is_text else text)
    first = W.partitionBy(F.xxhash64(*cells), *cells).orderBy(*[q(c) for c in order_by])
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier key (no trimming, missing counts as '')."""
    names = key_columns(df, keys)
    groups = df.groupBy(*[F.coalesce(q(k).cast("string"), F.lit("")).alias(f"k{i}") for i, k in enumerate(names)])
    return (
        groups.agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
        )
        .withColumn("key_fields", F.lit(len(names)))
    )


def duplicate_identifiers(df: DataFrame, identifier: str, row_id: str) -> DataFrame:
    """Every row whose identifier occurs more than once, with that count (long form)."""
    # cut, so that the join deals both sides out anew and a frequent identifier can be split
    counts = cut_lineage(df.groupBy(q(identifier).alias("identifier")).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1"))
    rows = df.select(q(identifier).alias("identifier"), q(row_id).alias("row_id"))
    return rows.join(counts, "identifier")

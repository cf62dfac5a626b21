"""Joining rows to a lookup table when some keys hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from terraloom.functions.values import q
from terraloom.session import cut_lineage

BROADCAST_ROWS = 200_000  # narrow rows: tens of megabytes at most
HOT_SHARE = 20_000  # at most this many keys can each hold 1/HOT_SHARE of all rows
SPREAD = 10_007


def join_by_weight(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], weight: str, total_rows: int, hot_share: int = HOT_SHARE, absent: Column | None = None
) -> DataFrame:
    """Left join to a lookup whose ``weight`` column counts the rows of each key.

    Keys with at least ``total_rows / hot_share`` rows are broadcast; by that rule there are at most ``hot_share`` of
    them. Then the light keys are shuffled; rows that found a hot key are spread over many groups there, so no task gets
    one key's rows. So are rows that cannot find anything: those with a null key, and those where ``absent`` holds, which the caller
    knows to have no entry, blank cells for example. Both joins stand in one chain: ``rows`` are read once, however many lookups
    follow each other.
    """
    limit = max(1, -(-total_rows // hot_share))
    own = [c for c in lookup.columns if c not in (*on, weight)]
    entry = F.struct(*[q(c) for c in own])
    hot = lookup.filter(F.col(weight) >= limit).select(*on, entry.alias("_hot"))
    # always -1, but no literal: the optimiser would put it into the condition and shuffle by the keys alone
    minus_one = F.pmod(F.xxhash64(*on), F.lit(1)).cast("int") - 1
    light = lookup.filter(F.col(weight) < limit).select(*on, minus_one.alias("_spread"), entry.alias("_light"))
    hashed = [q(f.name) for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marked = rows.join(F.broadcast(hot), list(on), "left")
    nothing = F.lit(False) if absent is None else F.coalesce(absent, F.lit(True))
    for key in on:
        nothing = nothing | q(key).isNull()
    # the light side has -1 only
    spread = F.when(F.col("_hot").isNotNull() | nothing, F.pmod(F.xxhash64(*hashed), F.lit(SPREAD)).cast("int")).otherwise(-1)
    found = marked.withColumn("_spread", spread).join(light, [*on, "_spread"], "left").withColumn("_entry", F.coalesce("_hot", "_light"))
    return found.select(*[q(c) for c in rows.columns], *[F.col("_entry")[c].alias(c) for c in own])


def join_checked(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows to a table with one row per group, such as bounds per model.

    The lookup is computed once and counted. Up to ``limit`` rows it is broadcast, so a group that
    holds most rows is not shuffled at all; beyond that the join shuffles and AQE splits hot groups.
    """
    ready = cut_lineage(lookup)
    return rows.join(F.broadcast(ready), list(on), how) if ready.count() <= limit else join_shuffled(rows, ready, on, how)


def join_shuffled(rows: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join two tables that both have many rows.

    Without a hint Spark broadcasts a table by the size of its files, and repetitive text that takes a few megabytes there, or in
    what was checkpointed from it, takes hundreds in the driver.
    """
    return rows.join(other.hint("merge"), list(on), how)

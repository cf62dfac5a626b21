"""Order-dependent steps that never put a whole group into one task.

A group (a file, a mesh, a face) may hold a third of all rows, so a plain
``Window.partitionBy(group)`` is not safe. Every function here takes ``chunk``: an expression
that is a monotone prefix of the order, cutting a group into pieces. Rows are only sorted
inside (group, chunk); what crosses chunk borders travels through a small table with one row
per chunk. Unique integer ids give such a chunk for free: ``id >> 20`` holds at most 2^20 rows.

Where the largest group is known to be small (``largest_group``), pass it as ``largest``: up to
``SAFE_GROUP`` rows a plain window per group is used and the chunk table is not needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terraloom.session import cut_lineage, materialise

ID_CHUNK_BITS = 20
SAFE_GROUP = 1_000_000
BROADCAST_KEYS = 100_000


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the largest group: one pre-aggregated count, one number to the driver."""
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def id_chunk(column: str | Column, bits: int = ID_CHUNK_BITS) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.shiftright(c.cast("long"), bits)


def _windows(group, order):
    inside = W.partitionBy(*group, "_chunk").orderBy(*order)
    across = W.partitionBy(*group).orderBy("_chunk") if group else W.partitionBy(F.lit(0)).orderBy("_chunk")
    return inside, across


def chunked_index(
    df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence, out: str = "idx", start: int = 0,
    largest: int | None = None,
) -> DataFrame:
    """Dense row number inside a group, counted from ``start``."""
    return chunked_running_sum(df, group, chunk, order, F.lit(1), out, shift=start - 1, largest=largest)


def range_index(df: DataFrame, order: Sequence, out: str = "idx", start: int = 0) -> DataFrame:
    """Dense row number over the whole frame, for any order, also one without an integer to cut it by.

    Rows are range-partitioned by the order, so the table that crosses partitions has one row per partition. Rows equal in the
    order are told apart by an arbitrary id, so that even a third of all rows with one key spread over partitions.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order, strict=True)})
    keyed = materialise(keyed.withColumn("_tie", F.monotonically_increasing_id()))  # the id must not change between sampling and sorting
    # written as a table, so that a partition number stays with its rows
    rows = materialise(keyed.repartitionByRange(*names, "_tie").withColumn("_part", F.spark_partition_id()))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*names, "_tie"))
    numbered = rows.withColumn("_place", place).join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part")  # one row per partition
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_before") + F.lit(start - 1)).alias(out))


def group_index(
    df: DataFrame, group: Sequence[str], row_id: str, out: str = "idx", start: int = 0, heavy: int = SAFE_GROUP, bits: int = ID_CHUNK_BITS
) -> DataFrame:
    """Dense row number inside a group by a unique integer ``row_id``, for many small groups and perhaps a few huge ones.

    Groups are counted first (map-side). Those with up to ``heavy`` rows take a plain window, one shuffle of the rows; only
    the counted heavy ones, at most rows / ``heavy`` of them, go through the chunk table.
    """
    group = list(group)
    large = cut_lineage(df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy).select(*[F.col(g).alias(f"_k_{g}") for g in group]))
    plain = F.row_number().over(W.partitionBy(*group).orderBy(row_id)).cast("long") + F.lit(start - 1)
    n_large = large.count()
    if not n_large:
        return df.withColumn(out, plain)
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    keys = F.broadcast(large) if n_large <= BROADCAST_KEYS else large
    light = df.join(keys, same, "left_anti").withColumn(out, plain)
    rest = chunked_index(df.join(keys, same, "left_semi"), group, id_chunk(row_id, bits), [row_id], out, start)
    return light.unionByName(rest)


def chunked_running_sum(
    df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence, value: Column, out: str, shift: int = 0,
    largest: int | None = None,
) -> DataFrame:
    """Running sum (current row included) over a group's order."""
    return chunked_running_sums(df, group, chunk, order, {out: value}, shift, largest)


def chunked_running_sums(
    df: DataFrame, group: Sequence[str], chunk: Column, order: Sequence, values: dict[str, Column], shift: int = 0,
    largest: int | None = None,
) -> DataFrame:
    """Several running sums in one pass."""
    group = list(group)
    if largest is not None and largest <= SAFE_GROUP and group:
        whole = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return df.withColumns({n: F.sum(v.cast("long")).over(whole) + F.lit(shift) for n, v in values.items()})
    inside, across = _windows(group, order)
    rows = df.withColumn("_chunk", chunk).withColumns({f"_v_{n}": v.cast("long") for n, v in values.items()})
    totals = rows.groupBy(*group, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *group, "_chunk", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values]
    )
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(running) for n in values})
    joined = _join_chunks(rows, totals, [*group, "_chunk"])
    return joined.select(
        *[c for c in df.columns if c not in values],
        *[(F.col(f"_v_{n}") + F.col(f"_before_{n}") + F.lit(shift)).alias(n) for n in values],
    )


def _join_chunks(rows: DataFrame, per_chunk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the one-row-per-chunk table back to the rows (null-safe on the group columns)."""
    renamed = per_chunk.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in per_chunk.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(renamed, condition, "left").drop(*[f"_k_{k}" for k in keys])


def cyclic_lead(
    df: DataFrame,
    group: Sequence[str],
    chunk: Column,
    order: Sequence,
    columns: Sequence[str],
    next_prefix: str = "next_",
    first_prefix: str | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add the following row's values, the last row of a group being followed by its first.

    ``first_prefix`` also adds the values of the group's first row.
    """
    group = list(group)
    if largest is not None and largest <= SAFE_GROUP:
        whole = W.partitionBy(*group).orderBy(*order)
        first = F.first("_row").over(whole.rowsBetween(W.unboundedPreceding, W.currentRow))
        rows = df.withColumn("_row", F.struct(*columns))
        rows = rows.withColumn("_group_head", first).withColumn("_next", F.coalesce(F.lead("_row").over(whole), F.col("_group_head")))
        return rows.select(
            *df.columns,
            *[F.col("_next")[c].alias(next_prefix + c) for c in columns],
            *([F.col("_group_head")[c].alias(first_prefix + c) for c in columns] if first_prefix else []),
        )
    inside, _ = _windows(group, order)
    rows = df.withColumn("_chunk", chunk).withColumn("_row", F.struct(*columns))
    heads = rows.groupBy(*group, "_chunk").agg(F.min_by("_row", F.struct(*order)).alias("_head"))
    over = W.partitionBy(*group).orderBy("_chunk")
    heads = (
        heads.withColumn("_group_head", F.first("_head").over(over))
        .withColumn("_after", F.coalesce(F.lead("_head").over(over), F.col("_group_head")))
        .drop("_head")
    )
    rows = rows.withColumn("_lead", F.lead("_row").over(inside)).drop("_row")
    joined = _join_chunks(rows, heads, [*group, "_chunk"])
    following = F.coalesce("_lead", "_after")
    out = joined.select(
        *df.columns,
        *[following[c].alias(next_prefix + c) for c in columns],
        *([F.col("_group_head")[c].alias(first_prefix + c) for c in columns] if first_prefix else []),
    )
    return out


def next_free_number(
    used: DataFrame, wanted: DataFrame, group: Sequence[str], number: str, out: str = "free", bits: int = ID_CHUNK_BITS
) -> DataFrame:
    """Smallest number above ``wanted.number`` that ``used`` does not hold in the group.

    The end of every run of used numbers gives a candidate; each request takes the first
    candidate at or after itself, looked up inside its chunk first and by chunk after that.
    """
    group = list(group)
    taken = used.select(*group, F.col(number).cast("long").alias("_n")).distinct()
    ends = (
        taken.withColumn("_n", F.col("_n") + 1)
        .join(taken, [*group, "_n"], "left_anti")
        .select(*group, F.col("_n").alias("_candidate"), id_chunk("_n", bits).alias("_chunk"), F.lit(None).alias("_request"))
    )
    asks = wanted.select(
        *group, F.col(number).cast("long").alias("_n"), F.lit(None).cast("long").alias("_candidate")
    ).distinct()
    asks = asks.select(*group, "_candidate", id_chunk(F.col("_n") + 1, bits).alias("_chunk"), F.col("_n").alias("_request"))
    both = ends.withColumn("_request", F.col("_request").cast("long")).unionByName(asks)
    position = F.coalesce(F.col("_candidate"), F.col("_request") + 1)
    ahead = (
        W.partitionBy(*group, "_chunk")
        .orderBy(position, F.col("_candidate").isNull().desc())
        .rowsBetween(W.currentRow, W.unboundedFollowing)
    )
    inside = both.withColumn("_near", F.min("_candidate").over(ahead)).filter(F.col("_request").isNotNull())
    by_chunk = both.groupBy(*group, "_chunk").agg(F.min("_candidate").alias("_first"))
    later = W.partitionBy(*group).orderBy("_chunk").rowsBetween(1, W.unboundedFollowing)
    by_chunk = by_chunk.withColumn("_far", F.min("_first").over(later)).drop("_first")
    found = inside.join(by_chunk, [*group, "_chunk"], "left").select(
        *group,
        F.col("_request").alias(number),
        F.coalesce("_near", "_far", F.col("_request") + 1).alias(out),
    )
    return found

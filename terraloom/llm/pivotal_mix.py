"""Mixing sources to target weights by pivotal dependent rounding.

Sources, ordered by code point with null last, get the weights 5, 2, 1, 5, 2, 1, ... and share the words of the whole
corpus by them; no target exceeds three times its source. A document's expected copies are target / source size: a whole
part and a fractional probability. Two documents with fractional probabilities exchange *words* in a random direction, such
that the expected copies of each stay as they are and the words of the pair stay constant, until one of them is integral.
Chunks of a source settle independently and leave at most one open document each; the open ones are combined by a reduction
tree with the same fan-in, so a source of any size is never one task. A source's words miss its target by one document at most.

Defined cases: null and empty texts have size 0, get copies by an independent draw and take no words; a null source is a
source of its own; repeated rows are documents of their own, settled
together; an empty table gives an empty mix. The draw depends only on
the rows and ``seed``, never on partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.llm.common import KEYS, keyed, word_count, wrapped
from terraloom.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
FAN_IN = 4096
BROADCAST_SOURCES = 50_000  # narrow rows, counted before the broadcast
NEAR_INTEGER = 1e-9

ROWS = "_key1 long, _key2 long, doc_id long, source string, size long, source_size long, target double"
STATE = ROWS + ", n long, copies long, share double, chunk long"


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Dense number of each source in code-point order, null last, without one sorted partition."""
    parts = cut_lineage(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    offsets = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return parts.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(offsets.select("_part", "_before")), "_part").select(
        *sources.columns, (F.col("_before") + F.col("_n") - 1).alias("number")
    )


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight, filled up to ``most`` times the source and no further."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")).cast("long")
    table = cut_lineage(numbered_sources(sources).withColumn("weight", weight).withColumn("_cap", most * F.col("source_size")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # every round fills at least one more source, or ends
        above = F.col("_cap") < F.lit(level) * F.col("weight")
        row = table.agg(
            F.sum(F.when(above, F.col("_cap"))).alias("cap"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count(F.when(above, 1)).alias("n")
        ).first()
        if row["n"] == full or not row["weight"]:
            break
        full = row["n"] if level else -1
        level = (total - (row["cap"] or 0)) / row["weight"]
    return table.select("source", "source_size", "n_docs", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def settle(size: np.ndarray, share: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Pivotal rounding of ``share``: at most one entry stays strictly between 0 and 1; sum(size * share) is kept."""
    size, share = size.tolist(), share.tolist()
    held = -1
    for i, draw in enumerate(draws.tolist()):
        if not 0.0 < share[i] < 1.0:
            continue
        if size[i] == 0:
            share[i] = 1.0 if draw < share[i] else 0.0
            continue
        if held < 0:
            held = i
            continue
        ratio = size[i] / size[held]
        up, down = min(1.0 - share[i], share[held] / ratio), min(share[i], (1.0 - share[held]) / ratio)
        step = up if draw * (up + down) < down else -down
        mine, other = share[i] + step, share[held] - step * ratio
        share[i] = 0.0 if mine < NEAR_INTEGER else 1.0 if mine > 1.0 - NEAR_INTEGER else mine
        share[held] = 0.0 if other < NEAR_INTEGER else 1.0 if other > 1.0 - NEAR_INTEGER else other
        if not 0.0 < share[held] < 1.0:
            held = i if 0.0 < share[i] < 1.0 else -1
    return np.array(share)


def _settle_group(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*KEYS, "size"], kind="stable", na_position="last").reset_index(drop=True)
        source = pdf["source"].iloc[0]
        name = b"\0" if source is None or source is pd.NA or source != source else str(source).encode()
        rng = np.random.default_rng([seed, level, int(pdf["chunk"].iloc[0]), zlib.crc32(name)])
        share = settle(pdf["size"].to_numpy("float64"), pdf["share"].to_numpy("float64"), rng.random(len(pdf)))
        if last:
            share = np.where((share > 0) & (share < 1), rng.random(len(share)) < share, share)
        whole = (share <= 0) | (share >= 1)
        return pdf.assign(copies=pdf["copies"] + np.where(whole, share, 0).astype("int64"), share=np.where(whole, 0.0, share))

    return run


def mix(
    docs: DataFrame, seed: int = 0, weights: Sequence[int] = WEIGHTS, most: int = MAX_COPIES, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per document: its key, doc_id, source, size, source_size, target, copies, taken."""
    sized = cut_lineage(keyed(docs.select("doc_id", "source", "text")).select(*KEYS, "doc_id", "source", word_count().alias("size")))
    targets = cut_lineage(source_targets(sized, weights, most)).withColumnsRenamed({"source": "_source"})
    n_sources, most_docs = targets.agg(F.count(F.lit(1)), F.max("n_docs")).first()
    table = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    rows = sized.join(table, sized["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + NEAR_INTEGER)
    # repeated rows are one entry with the copies of all of them: at most one of their copies is open
    rows = rows.groupBy(*KEYS, "doc_id", "source", "size", "source_size", "target", "n_docs").agg(F.count(F.lit(1)).alias("n"))
    open_ = F.greatest(rate - whole, F.lit(0.0)) * F.col("n")
    full = F.floor(open_ + NEAR_INTEGER)
    rows = rows.select(
        *KEYS, "doc_id", "source", "size", "source_size", "target", "n", (whole * F.col("n") + full).alias("copies"), F.greatest(open_ - full, F.lit(0.0)).alias("share"),
        F.pmod(F.col(KEYS[0]), F.ceil(F.col("n_docs") / fan_in)).alias("chunk"),
    )
    chunks, level, done = -(-(most_docs or 0) // fan_in), 0, []
    while True:
        last = chunks <= 1
        rows = cut_lineage(rows.groupBy("source", "chunk").applyInPandas(_settle_group(seed, level, last), STATE))
        if last:
            done.append(rows)
            break
        done.append(rows.filter("share = 0"))
        rows = rows.filter("share > 0").withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        chunks, level = -(-chunks // fan_in), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    each = out.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("_nth") <= F.col("copies") % F.col("n")).cast("bigint")
    return each.select(*KEYS, "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with all its columns."""
    counts = mix(docs, **options).groupBy(*KEYS).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    rows = wrapped(docs).join(counts, list(KEYS))
    rows = rows.withColumn("_row", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.lit(0))))  # repeated rows share a key
    each = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_row") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    taken = rows.withColumn("_each", each.cast("int")).filter("_each > 0")
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_each")))).select("_doc.*")

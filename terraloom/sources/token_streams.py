"""Records of variable length in a stream of numbers: each begins with the count of the numbers that follow it.

Where one record begins depends on the one before, so a stream is cut into chunks and every chunk is read for all places at which a
record could enter it: where does it leave the chunk, and after how many records. Such maps are composed in a tree of ``FAN``
children a node; walking the tree down again gives each chunk the one place where records really enter, and their number so far.
No task sees more than ``FAN`` maps of ``chunk`` numbers, and no stream is read in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from terraloom.session import cut_lineage

CHUNK = 65_536
FAN = 64
MAPPED = 1 << 20  # places of the maps that a task holds at once
MAP = "exits array<int>, counts array<long>"


def exit_map(values: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a chunk: where a record chain from there enters the next chunk (-1: never), and how many records begin on the way."""
    n = len(values)
    exits, counts = np.full(chunk, -1, np.int64), np.zeros(chunk, np.int64)
    for p in range(n - 1, -1, -1):
        v = values[p]
        follow = p + 1 + v
        if v < 0 or follow >= n + chunk:
            continue
        exits[p] = exits[follow] if follow < n else follow - n
        counts[p] = 1 + (counts[follow] if follow < n else 0)
    return exits, counts


def _then(exits: np.ndarray, counts: np.ndarray, more_exits: np.ndarray, more_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alive = (exits >= 0) & (exits < len(more_exits))
    at = np.where(alive, exits, 0)
    return np.where(alive, more_exits[at], -1), counts + np.where(alive, more_counts[at], 0)


def record_entries(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """maps(keys.., node, exits, counts) -> (keys.., node, entry, before): where records enter each chunk (-1: nowhere), and records before it.

    A map has an entry for each place its chunk really holds; the last chunk of a stream is short, and nothing begins behind its end.
    """
    types = {f.name: f.dataType.simpleString() for f in maps.schema}
    names = ", ".join(f"{k} {types[k]}" for k in keys)

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        exits, counts = None, None
        for e, c in zip(rows["exits"], rows["counts"], strict=True):
            exits, counts = (np.asarray(e), np.asarray(c)) if exits is None else _then(exits, counts, np.asarray(e), np.asarray(c))
        first = rows.iloc[0]
        return pd.DataFrame([{**{k: first[k] for k in keys}, "node": first["parent"], "exits": exits, "counts": counts}])

    def descend(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        entry, before, out = int(rows["entry"].iloc[0]), int(rows["before"].iloc[0]), []
        for e, c in zip(rows["exits"], rows["counts"], strict=True):
            out.append((entry, before))
            entry, before = (int(e[entry]), before + int(c[entry])) if 0 <= entry < len(e) else (-1, before)
        return rows[[*keys, "node"]].assign(entry=[x[0] for x in out], before=[x[1] for x in out])

    last = maps.agg(F.max("node")).first()[0]
    if not last:
        return maps.select(*keys, "node", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("before"))
    dealt = maps.withColumn("parent", F.floor(F.col("node") / FAN).cast("bigint"))
    parents = cut_lineage(dealt.groupBy(*keys, "parent").applyInPandas(compose, f"{names}, node bigint, {MAP}"))
    above = record_entries(parents, keys).withColumnRenamed("node", "parent")
    return dealt.join(above, [*keys, "parent"]).groupBy(*keys, "parent").applyInPandas(descend, f"{names}, node bigint, entry int, before bigint")


def records(tokens: DataFrame, keys: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """tokens(keys.., k from 0, v) -> (keys.., record, items): the numbers of every record in order, records counted from 0.

    Streams whose last record is cut short, or whose counts are negative or missing, keep the records before the break. A record
    longer than a chunk ends a map; streams with such ones are read again with chunks sixteen times as large.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in tokens.schema}
    names = ", ".join(f"{k} {types[k]}" for k in keys)
    placed = tokens.select(*keys, F.floor(F.col("k") / chunk).cast("bigint").alias("node"), F.struct("k", "v").alias("t"))
    chunks = placed.groupBy(*keys, "node").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.coalesce(t["v"], F.lit(-1))).alias("v"))
    chunks = cut_lineage(chunks)

    def mapped(batches):
        """Maps no longer than their chunks, handed on after about ``MAPPED`` places, however many chunks a batch has."""
        for batch in batches:
            places = np.cumsum([len(v) for v in batch["v"]]) // MAPPED
            for part in np.unique(places):
                rows = batch[places == part]
                found = [[m[:len(v)].copy() for m in exit_map(np.asarray(v), chunk)] for v in rows["v"]]
                yield rows[[*keys, "node"]].assign(exits=[e for e, _ in found], counts=[c for _, c in found])

    entries = cut_lineage(record_entries(cut_lineage(chunks.mapInPandas(mapped, f"{names}, node bigint, {MAP}")), keys))

    def members(batches):
        """Every number that is no count, with its record; those before the entry belong to the record that came in."""
        for batch in batches:
            for row in batch.to_dict("records"):
                v, entry, before = np.asarray(row["v"]), row["entry"], row["before"]
                starts, p = [], entry
                while 0 <= p < len(v) and v[p] >= 0:
                    starts.append(p)
                    p += 1 + int(v[p])
                begin = np.zeros(len(v), np.int64)
                begin[starts] = 1
                record = before - 1 + np.cumsum(begin)
                stop = min(p, len(v)) if entry >= 0 else 0
                keep = np.flatnonzero((begin[:stop] == 0) & (record[:stop] >= 0))
                yield pd.DataFrame({
                    **{k: row[k] for k in keys}, "record": np.concatenate([record[keep], record[starts]]), "k": row["node"] * chunk + np.concatenate([keep, starts]),
                    "v": np.concatenate([v[keep], np.full(len(starts), -1)]), "n": np.concatenate([np.zeros(len(keep), np.int64), v[starts]]),
                })

    joined = chunks.join(entries, [*keys, "node"])
    rows = joined.mapInPandas(members, f"{names}, record bigint, k bigint, v bigint, n bigint")
    whole = rows.groupBy(*keys, "record").agg(F.max("n").alias("n"), F.filter(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda t: t["v"] != -1).alias("t"))
    out = whole.filter(F.size("t") == F.col("n")).select(*keys, "record", F.transform("t", lambda t: t["v"]).alias("items"))
    too_long = chunks.select(*keys, "node", F.size("v").alias("size")).join(entries, [*keys, "node"], "left").filter(f"entry is null or entry < 0")
    stuck = cut_lineage(too_long.select(*keys).distinct())
    if chunk < 1 << 28 and not stuck.isEmpty():
        longest = tokens.join(stuck, keys, "left_semi").groupBy(*keys).agg(F.max("k").alias("last")).filter(F.col("last") >= chunk)
        again = tokens.join(longest.select(*keys), keys, "left_semi")
        if not again.isEmpty():
            out = out.join(longest.select(*keys), keys, "left_anti").unionByName(records(again, keys, chunk * 16))
    return out

"""Exact order statistics in bounded memory.

A builtin exact ``percentile`` keeps every distinct value of a column in one buffer, so it only
sees a checked number of rows. Before that the wanted rank is narrowed down: each round counts the
values of the current range in equal-width bins (a hash aggregate, merged map-side), finds the bin
that holds the rank and continues with the true minimum and maximum of that bin. A round is one
scan, and at most two rows per column reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SMALL_ROWS = 50_000
BINS = 4096


@dataclass(frozen=True)
class Moments:
    rows: int
    count: int
    low: float | None
    high: float | None
    mean: float | None
    std: float | None


def moments(df: DataFrame, exprs: dict[str, Column]) -> dict[str, Moments]:
    """Count, min, max, mean and population deviation of several expressions in one scan."""
    cells = df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs.values())])  # each expression is computed once
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(exprs)):
        e = F.col(f"c{i}")
        aggs += [
            F.count(e).alias(f"n{i}"), F.min(e).alias(f"lo{i}"), F.max(e).alias(f"hi{i}"),
            F.avg(e).alias(f"m{i}"), F.stddev_pop(e).alias(f"s{i}"),
        ]
    row = cells.agg(*aggs).first()
    return {
        name: Moments(row["rows"], row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"], row[f"s{i}"])
        for i, name in enumerate(exprs)
    }


@dataclass
class _Search:
    low: float        # the range that holds both ranks
    high: float
    below: int        # rows under it
    inside: int       # rows in it
    ranks: tuple[int, int]


def medians(
    df: DataFrame, exprs: dict[str, Column], stats: dict[str, Moments], small_rows: int = SMALL_ROWS, bins: int = BINS
) -> dict[str, float | None]:
    """Exact medians of several expressions; an even count averages the middle two."""
    out: dict[str, float | None] = dict.fromkeys(exprs)
    open_ = {}
    for k in exprs:
        m = stats[k]
        if m.count and m.low == m.high:
            out[k] = float(m.low)
        elif m.count:
            open_[k] = _Search(float(m.low), float(m.high), 0, m.count, ((m.count - 1) // 2, m.count // 2))
    names = {k: f"c{i}" for i, k in enumerate(open_)}
    cells = df.select(*[exprs[k].alias(names[k]) for k in open_]) if open_ else df
    while open_:
        small = {k: s for k, s in open_.items() if s.inside <= small_rows}
        if small:
            found = _read_ranks(cells, names, small)
        else:
            found = _narrow(cells, names, open_, bins)
        for k, pair in found.items():
            out[k] = (pair[0] + pair[1]) / 2
            del open_[k]
    return out


def _read_ranks(cells: DataFrame, names: dict[str, str], searches: dict[str, _Search]) -> dict[str, tuple[float, float]]:
    """Values at the two ranks, straight from the few rows left in each range."""
    aggs = []
    for k, s in searches.items():
        cell = f"if({names[k]} between {s.low!r}D and {s.high!r}D, {names[k]}, null)"
        for side, rank in zip(("lo", "hi"), s.ranks):
            share = (rank - s.below + 0.5) / s.inside
            aggs.append(F.expr(f"percentile_disc({share!r}D) within group (order by {cell})").alias(f"{side}_{names[k]}"))
    row = cells.agg(*aggs).first()
    return {k: (row[f"lo_{names[k]}"], row[f"hi_{names[k]}"]) for k in searches}


def _narrow(cells: DataFrame, names: dict[str, str], searches: dict[str, _Search], bins: int) -> dict[str, tuple[float, float]]:
    """One histogram round; returns finished ranks and tightens the other searches in place."""
    keys = list(searches)
    structs = []
    for i, (k, s) in enumerate(searches.items()):
        c = F.col(names[k])
        share = (c - F.lit(s.low)) / F.lit(s.high - s.low)
        at = F.when((c >= s.low) & (c <= s.high), F.least(F.lit(bins - 1), F.floor(share * bins)).cast("int"))
        structs.append([F.lit(i).alias("k"), c.alias("v"), at.alias("bin")])
    # numbers as keys, and no array for a single column: this is a scan over all rows
    long = cells.select(*structs[0]) if len(structs) == 1 else cells.select(F.inline(F.array(*[F.struct(*x) for x in structs])))
    long = long.filter("bin is not null")
    filled = long.groupBy("k", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(W.partitionBy("k").orderBy("bin"))  # at most ``bins`` rows per column
    placed = filled.withColumn("end", upto)
    want = F.lit(False)
    for i, s in enumerate(searches.values()):
        for rank in s.ranks:
            r = rank - s.below
            want = want | ((F.col("k") == i) & (F.col("end") > r) & (F.col("end") - F.col("n") <= r))
    hits: dict[str, list] = {}
    for row in placed.filter(want).collect():
        hits.setdefault(keys[row["k"]], []).append(row)
    done = {}
    for k, rows in hits.items():
        s = searches[k]
        rows.sort(key=lambda r: r["bin"])
        first, last = rows[0], rows[-1]
        if first["bin"] != last["bin"]:
            done[k] = (first["hi"], last["lo"])  # the ranks part between two bins
        elif first["lo"] == first["hi"]:
            done[k] = (first["lo"], first["hi"])
        else:
            stuck = first["n"] == s.inside and (first["lo"], first["hi"]) == (s.low, s.high)
            s.below += first["end"] - first["n"]
            s.low, s.high, s.inside = first["lo"], first["hi"], first["n"]
            if stuck:  # a range too wide to be cut evenly: halve it in log space
                s.low, s.high, s.below, s.inside = _halve(cells, names[k], s)
    return done


def _halve(cells: DataFrame, name: str, s: _Search) -> tuple[float, float, int, int]:
    c = F.col(name)
    root = F.signum(c) * F.log1p(F.abs(c))
    inside = (c >= s.low) & (c <= s.high)
    middle = cells.filter(inside).agg((F.min(root) + F.max(root)) / 2).first()[0]
    left = inside & (root <= middle)
    row = cells.agg(
        F.count_if(left), F.max(F.when(left, c)), F.min(F.when(inside & (root > middle), c))
    ).first()
    if s.ranks[1] - s.below < row[0] or row[2] is None:
        return s.low, row[1], s.below, row[0]
    if s.ranks[0] - s.below >= row[0]:
        return row[2], s.high, s.below + row[0], s.inside - row[0]
    return s.low, s.high, s.below, s.inside


@dataclass(frozen=True)
class Robust:
    median: float
    sigma: float          # 1.4826 * MAD, or the deviation when MAD vanishes
    from_mad: bool


def robust_scales(
    df: DataFrame, exprs: dict[str, Column], stats: dict[str, Moments], minimum: int, small_rows: int = SMALL_ROWS
) -> dict[str, Robust | None]:
    """Median and robust sigma; None with fewer than ``minimum`` values or no spread at all."""
    out: dict[str, Robust | None] = dict.fromkeys(exprs)
    usable = {k: e for k, e in exprs.items() if stats[k].count >= minimum}
    middle = medians(df, usable, stats, small_rows)
    away = {k: F.abs(e - F.lit(middle[k])) for k, e in usable.items()}
    span = {
        k: Moments(stats[k].rows, stats[k].count, 0.0, max(abs(stats[k].low - middle[k]), abs(stats[k].high - middle[k])), None, None)
        for k in usable
    }
    spread = medians(df, away, span, small_rows)
    for k in usable:
        sigma, from_mad = 1.4826 * spread[k], True
        if sigma <= 1e-12:
            sigma, from_mad = stats[k].std or 0.0, False
        if sigma > 1e-12:
            out[k] = Robust(middle[k], sigma, from_mad)
    return out

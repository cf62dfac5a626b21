"""Cleaning of tables: deduplicate, fill, convert units, clip - in that order.

``plan_cleaning`` reads a few one-row statistics and fixes every fill value, factor and bound as
a literal; ``clean`` is then a lazy projection over the deduplicated rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from terraloom import fixed_values as fv
from terraloom.functions import stats as S, values as V
from terraloom.functions.units import UnitRule, header_unit_rules
from terraloom.functions.values import q
from terraloom.operators.dedup import keep_first, key_columns
from terraloom.operators.profiling import modes, numbers
from terraloom.session import materialise

MAX_CLIP_ROUNDS = 20


@dataclass
class CleaningPlan:
    columns: list[str]
    keys: list[str] = field(default_factory=list)
    fills: dict[str, tuple[str, object]] = field(default_factory=dict)          # column -> (method, value)
    units: dict[str, UnitRule] = field(default_factory=dict)                    # source column -> rule
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)        # final column -> range
    rows_in: int = 0
    rows_out: int = 0
    deduplicated: DataFrame | None = None

    def final_name(self, column: str) -> str:
        return self.units[column].target if column in self.units else column


def plan_cleaning(
    df: DataFrame,
    order_by: str,
    duplicate_keys: Sequence[str] | None = None,
    fill_strategy: str = "median_mode",
    unit_factors: Mapping[str, float] | None = None,
    sigma: float = 3.0,
    exclude: Sequence[str] = (),
    deduplicate: bool = True,
    convert_units: bool = True,
    small_rows: int = S.SMALL_ROWS,
) -> CleaningPlan:
    columns = [c for c in df.columns if c != order_by]
    plan = CleaningPlan(columns, keys=key_columns(df.drop(order_by), duplicate_keys))
    # several statistics follow, so the duplicate search is done once
    rows = materialise(keep_first(df, plan.keys, [order_by])) if deduplicate else df
    plan.deduplicated = rows
    plan.rows_in = df.count()
    types = V.column_types(df)
    nums = numbers(rows, columns)
    present = {c: V.has_value(q(c), types[c]) for c in columns}

    # shares and moments, one scan
    staged = rows.select(
        *[present[c].alias(f"h{i}") for i, c in enumerate(columns)], *[V.to_number(q(c), types[c]).alias(f"v{i}") for i, c in enumerate(columns)]
    )
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i in range(len(columns)):
        h, v = F.col(f"h{i}"), F.col(f"v{i}")
        aggs += [F.count_if(h).alias(f"p{i}"), F.count_if(h & v.isNotNull()).alias(f"r{i}")]
    row = staged.agg(*aggs).first()
    plan.rows_out = row["rows"]
    facts = {c: (row[f"p{i}"], row[f"r{i}"]) for i, c in enumerate(columns)}

    # fills
    if fill_strategy.lower() not in fv.NO_FILL:
        holes = [c for c in columns if 0 < facts[c][0] < row["rows"]]
        numeric = [c for c in holes if facts[c][1] / facts[c][0] >= 0.8]
        chosen = {c: nums[c] for c in numeric}
        middle = S.medians(rows, chosen, S.moments(rows, chosen), small_rows) if numeric else {}
        plan.fills.update({c: ("median", middle[c]) for c in numeric if middle[c] is not None})
        texts = [c for c in holes if c not in numeric]
        if texts:
            kept = rows.select(q(order_by), *[F.when(present[c], q(c).cast("string")).alias(c) for c in texts])
            for top in modes(kept, texts, order_by).collect():  # one row per column
                plan.fills[top["field"]] = ("mode", top["mode"])

    # units: a rename needs at least one converted cell
    if convert_units:
        rules = header_unit_rules(columns, unit_factors)
        plan.units = {c: r for c, r in rules.items() if facts[c][1] > 0}

    # bounds
    if sigma > 0:
        wanted = [c for c in columns if plan.final_name(c) not in exclude and c not in exclude]
        plan.bounds = _robust_bounds(rows, plan, wanted, sigma, small_rows)
    return plan


def _prepared(plan: CleaningPlan, types: Mapping[str, T.DataType], column: str) -> Column:
    """Cell after fill and unit conversion."""
    cell, data_type = q(column), types[column]
    if column in plan.fills:
        method, value = plan.fills[column]
        gone = ~V.has_value(cell, data_type)
        if isinstance(data_type, T.StringType):
            text = value if method == "mode" else _short_text(value)
            cell = F.when(gone, F.lit(text)).otherwise(cell)
        elif method == "median":
            whole = isinstance(data_type, T.IntegralType) and float(value).is_integer()
            cell = F.when(gone, F.lit(value)).otherwise(cell.cast("double"))
            cell = cell.cast(data_type) if whole else cell
        else:
            cell = F.when(gone, F.lit(value).cast(data_type)).otherwise(cell)
    if column in plan.units:
        factor = plan.units[column].factor
        if isinstance(data_type, T.StringType):
            scaled = V.to_number(cell) * F.lit(factor)
            cell = F.when(~V.is_null_word(cell, "value") & scaled.isNotNull(), scaled.cast("string")).otherwise(cell)
        else:
            cell = cell.cast("double") * F.lit(factor)
    return cell


def _short_text(number: float) -> str:
    return repr(float(number))


def _number_of(cell: Column, data_type: T.DataType) -> Column:
    n = V.to_number(cell) if isinstance(data_type, T.StringType) else cell.cast("double")
    return F.when(V.finite(n), n)


def _robust_bounds(rows, plan, columns, sigma, small_rows):
    """Bounds of the repeated clip. With a MAD and sigma * 1.4826 >= 2 clipping moves neither the
    median nor the MAD, so one round is final; other columns are clipped again until nothing moves."""
    types = V.column_types(rows)
    base = {
        c: _number_of(_prepared(plan, types, c), types[c])
        for c in columns
        if isinstance(types[c], (T.StringType, T.NumericType))
    }
    bounds: dict[str, tuple[float, float]] = {}
    active = dict(base)
    for _ in range(MAX_CLIP_ROUNDS):
        if not active:
            break
        known = S.moments(rows, active)
        scales = S.robust_scales(rows, active, known, 5, small_rows)
        following = {}
        for c in active:
            s = scales[c]
            if s is None:
                continue
            low, high = s.median - sigma * s.sigma, s.median + sigma * s.sigma
            if known[c].low >= low and known[c].high <= high:
                continue
            if c in bounds:  # clipping twice is clipping once to the common range
                low, high = max(low, bounds[c][0]), min(high, bounds[c][1])
            bounds[c] = (low, high)
            if not (s.from_mad and sigma * 1.4826 >= 2):
                following[c] = F.when(base[c].isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), base[c])))
        active = following
    return {plan.final_name(c): b for c, b in bounds.items()}


def clean(df: DataFrame, plan: CleaningPlan, order_by: str) -> DataFrame:
    rows = plan.deduplicated if plan.deduplicated is not None else df
    types = V.column_types(rows)
    out = [q(order_by)]
    for c in plan.columns:
        name = plan.final_name(c)
        cell = _prepared(plan, types, c)
        if name in plan.bounds:
            low, high = plan.bounds[name]
            n = _number_of(cell, types[c])
            held = F.greatest(F.lit(low), F.least(F.lit(high), n))
            outside = (n < low) | (n > high)
            if isinstance(types[c], T.StringType):
                cell = F.when(outside, held.cast("string")).otherwise(cell)
            elif isinstance(types[c], T.IntegralType):
                cell = F.when(outside, held).otherwise(cell.cast("double"))
            else:
                cell = F.when(outside, held).otherwise(cell)
        out.append(cell.alias(name))
    return rows.select(*out)


def cleaning_actions(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """What the plan does to the data: one row per action with its count, method and value."""
    rows = plan.deduplicated if plan.deduplicated is not None else df
    types = V.column_types(rows)
    todo: list[tuple[str, str | None, str | None, str | None]] = []
    aggs = [F.count(F.lit(1)).alias("rows_out")]
    for c, (method, value) in plan.fills.items():
        todo.append(("fill_missing", c, method, str(value)))
        aggs.append(F.count_if(~V.has_value(q(c), types[c])).alias(f"a{len(todo)}"))
    for c, rule in plan.units.items():
        todo.append(("normalize_unit", c, f"{rule.source_unit}->{rule.target_unit}", repr(rule.factor)))
        filled = _prepared(CleaningPlan(plan.columns, fills=plan.fills), types, c)
        aggs.append(F.count(V.to_number(filled, types[c])).alias(f"a{len(todo)}"))
    for c in plan.columns:
        name = plan.final_name(c)
        if name in plan.bounds:
            low, high = plan.bounds[name]
            n = _number_of(_prepared(plan, types, c), types[c])
            todo.append(("clip_outliers", name, "median_mad", f"[{low!r}, {high!r}]"))
            aggs.append(F.count_if((n < low) | (n > high)).alias(f"a{len(todo)}"))
    wide = rows.agg(*aggs)
    structs = [
        F.struct(
            F.lit("remove_duplicates").alias("action"), F.lit(",".join(plan.keys)).alias("field"),
            F.lit("keep_first").alias("method"), F.lit(None).cast("string").alias("value"),
            (F.lit(plan.rows_in) - F.col("rows_out")).alias("count"),
        )
    ]
    for i, (action, name, method, value) in enumerate(todo, start=1):
        structs.append(
            F.struct(
                F.lit(action).alias("action"), F.lit(name).alias("field"), F.lit(method).alias("method"),
                F.lit(value).alias("value"), F.col(f"a{i}").alias("count"),
            )
        )
    return wide.select(F.inline(F.array(*structs))).filter("count > 0")


def outlier_flags(df: DataFrame, column: str, sigma: float = 3.0, small_rows: int = S.SMALL_ROWS) -> DataFrame:
    """Rows with a robust z-score beyond sigma, flagged in place."""
    nums = numbers(df, [column])
    known = S.moments(df, nums)
    s = S.robust_scales(df, nums, known, 3, small_rows)[column]
    if s is None:
        return df.withColumn("is_outlier", F.lit(False))
    return df.withColumn(
        "is_outlier", F.coalesce(F.abs(nums[column] - F.lit(s.median)) > F.lit(sigma * s.sigma), F.lit(False))
    )


def clip_zscore(df: DataFrame, columns: Sequence[str], sigma: float = 3.0) -> DataFrame:
    """One-pass clip to mean +- sigma * population deviation (five values at least)."""
    nums = numbers(df, columns)
    known = S.moments(df, nums)
    out = {}
    for c in columns:
        m = known[c]
        if m.count >= 5 and m.std >= 1e-12:
            low, high = m.mean - sigma * m.std, m.mean + sigma * m.std
            held = F.greatest(F.lit(low), F.least(F.lit(high), nums[c]))
            outside = (nums[c] < low) | (nums[c] > high)
            if isinstance(df.schema[c].dataType, T.StringType):
                out[c] = F.when(outside, held.cast("string")).otherwise(q(c))
            else:
                out[c] = F.when(outside, held).otherwise(q(c).cast("double"))
    return df.withColumns(out) if out else df


def clean_simple(
    df: DataFrame, order_by: str, drop_duplicates: bool = True, fill_missing: str = "", sigma: float = 3.0,
    duplicate_keys: Sequence[str] | None = None, unit_factors: Mapping[str, float] | None = None,
) -> DataFrame:
    """Constant fill, given factors, mean +- sigma clip; keys are compared untrimmed."""
    columns = [c for c in df.columns if c != order_by]
    rows = keep_first(df, duplicate_keys or columns, [order_by], trim=False) if drop_duplicates else df
    types = V.column_types(rows)
    out = {}
    for c in columns:
        cell = q(c)
        if fill_missing != "":
            constant = F.lit(fill_missing).try_cast(types[c]) if not isinstance(types[c], T.StringType) else F.lit(fill_missing)
            cell = F.when(~V.has_value(cell, types[c]), constant).otherwise(cell)
        if c in (unit_factors or {}):
            scaled = V.to_number(cell, types[c]) * F.lit(float(unit_factors[c]))
            if isinstance(types[c], T.StringType):
                cell = F.coalesce(scaled.cast("string"), cell)
            else:
                cell = scaled
        out[c] = cell
    rows = rows.withColumns(out)
    return clip_zscore(rows, [c for c in columns if isinstance(rows.schema[c].dataType, (T.StringType, T.NumericType))], sigma) if sigma > 0 else rows


def clean_features(
    features: DataFrame, duplicate_keys: Sequence[str] | None = None, fill_strategy: str = "median_mode",
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Clean GeoJSON features: align properties to one schema, convert units, close rings, drop repeats.

    ``features``: feature_id BIGINT, geom_type STRING, polygons (rings of positions, null for other
    types), rest STRING (remaining geometry as text), props MAP<STRING,STRING>. ``fields`` may name
    the properties; without it their union is read first (one row per property name).
    """
    names = list(fields) if fields else sorted(
        r["key"] for r in features.select(F.explode(F.map_keys("props")).alias("key")).distinct().collect()
    )
    props = F.coalesce("props", F.expr("map()").cast("map<string,string>"))
    cells = {n: F.try_element_at(props, F.lit(n)) for n in names}
    if fill_strategy.lower() not in fv.NO_FILL:
        wide = features.select("feature_id", *[F.when(V.has_value(cells[n]), cells[n]).alias(n) for n in names])
        top = {r["field"]: r["mode"] for r in modes(wide, names, "feature_id").collect()}  # one row per property
        cells = {n: F.when(~V.has_value(c), F.lit(top.get(n))).otherwise(c) if n in top else c for n, c in cells.items()}
    rules = header_unit_rules(names)
    entries = []
    for n, cell in cells.items():
        scaled = V.to_number(cell) * F.lit(rules[n].factor) if n in rules else F.lit(None).cast("double")
        use = V.has_value(cell) & scaled.isNotNull()
        key = F.when(use, F.lit(rules[n].target)).otherwise(F.lit(n)) if n in rules else F.lit(n)
        entries.append(F.struct(key.alias("key"), F.when(use, scaled.cast("string")).otherwise(cell).alias("value"),
                                (cell.isNotNull() | F.array_contains(F.map_keys(props), n)).alias("there")))
    aligned = F.map_from_entries(
        F.transform(F.filter(F.array(*entries), lambda e: e["there"]), lambda e: F.struct(e["key"], e["value"]))
    )
    from terraloom.functions.vectors import close_ring

    closed = features.withColumn("props", aligned).withColumn(
        "polygons", F.transform("polygons", lambda polygon: F.transform(polygon, close_ring))
    )
    canonical = F.to_json(F.struct("geom_type", "polygons", "rest", F.array_sort(F.map_entries("props")).alias("props")))
    key = (
        F.to_json(F.array(*[F.coalesce(F.try_element_at("props", F.lit(k)), F.lit("\u0000")) for k in duplicate_keys]))
        if duplicate_keys
        else canonical
    )
    keyed = closed.withColumn("_key", F.sha2(key, 256))
    return keep_first(keyed, ["_key"], ["feature_id"], trim=False).drop("_key")

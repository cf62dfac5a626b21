"""Column profiles: counts, distinct values, types, robust outliers, missing shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from terraloom import fixed_values as fv
from terraloom.functions import stats as S, values as V
from terraloom.functions.units import infer_unit
from terraloom.functions.values import q

NUMERIC_SHARE = 0.8


def numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Finite numeric reading of each column; other cells are null."""
    types = V.column_types(df)
    out = {}
    for c in columns:
        n = V.to_number(q(c), types[c])
        out[c] = n if isinstance(types[c], T.IntegralType) else F.when(V.finite(n), n)
    return out


def is_blank(df: DataFrame, column: str) -> Column:
    """Missing for profiles: null or blank text ('nan' is a present number here)."""
    c = q(column)
    return (c.isNull() | (V.strip(c) == "")) if isinstance(df.schema[column].dataType, T.StringType) else c.isNull()


def to_long(wide: DataFrame, fields: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """One wide row of aggregates -> one row per field. ``columns`` maps output name -> SQL with {i}."""
    structs = [
        F.struct(F.lit(f).alias("field"), *[F.expr(sql.format(i=i)).alias(name) for name, sql in columns.items()])
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*structs)))


def value_frequencies(df: DataFrame, columns: Sequence[str], order_by: str | None = None) -> DataFrame:
    """(field, value, n[, first_row]) of the non-blank cells; pre-aggregated before the shuffle."""
    typed = {c: not isinstance(df.schema[c].dataType, T.StringType) for c in columns}
    cells = [
        F.struct(F.lit(c).alias("field"), F.when(~is_blank(df, c), q(c).cast("string")).alias("cell"), F.lit(typed[c]).alias("typed"))
        for c in columns
    ]
    row = [q(order_by).alias("row")] if order_by else []
    long = df.select(F.inline(F.array(*cells)), *row).filter("cell is not null")
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("row").alias("first_row")] if order_by else [])
    if all(typed.values()):
        return long.withColumnRenamed("cell", "value").groupBy("field", "value").agg(*aggs)
    # a text is parsed once for each of its spellings, not once a row
    spelled = long.groupBy("field", "cell", "typed").agg(*aggs)
    canonical = F.when(F.col("typed"), F.col("cell")).otherwise(V.canonical_of(F.col("_t"), F.col("_n")))
    aggs = [F.sum("n").alias("n")] + ([F.min("first_row").alias("first_row")] if order_by else [])
    return V.staged(spelled, "cell").withColumn("value", canonical).groupBy("field", "value").agg(*aggs)


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, unique, duplicate_count). Numbers are grouped as numbers; only text cells are parsed."""
    kinds = {"bigint": [], "double": [], "text": []}
    for c in columns:
        t = df.schema[c].dataType
        kinds["bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, (T.FloatType, T.DoubleType)) else "text"].append(c)
    groups = []
    for kind in ("bigint", "double"):
        if kinds[kind]:
            cells = [F.struct(F.lit(c).alias("field"), q(c).cast(kind).alias("value")) for c in kinds[kind]]
            long = df.select(F.inline(F.array(*cells))).filter("value is not null")
            groups.append(long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")).select("field", "n"))
    if kinds["text"]:
        groups.append(value_frequencies(df, kinds["text"]).select("field", "n"))
    out = groups[0]
    for g in groups[1:]:
        out = out.unionByName(g)
    return out.groupBy("field").agg(F.count(F.lit(1)).alias("unique"), F.sum(F.col("n") - 1).alias("duplicate_count"))


def modes(df: DataFrame, columns: Sequence[str], order_by: str) -> DataFrame:
    """Most frequent value per field; a tie goes to the value seen first."""
    return (
        value_frequencies(df, columns, order_by)
        .groupBy("field")
        .agg(F.max_by(F.struct("value", "n"), F.struct(F.col("n"), -F.col("first_row"))).alias("top"))
        .select("field", F.col("top.value").alias("mode"), F.col("top.n").alias("mode_count"))
    )


def samples(df: DataFrame, columns: Sequence[str], order_by: str, k: int = 5) -> DataFrame:
    """First k non-blank cells per field, as text, in row order."""
    cells = [F.struct(F.lit(c).alias("field"), F.when(~is_blank(df, c), q(c).cast("string")).alias("value")) for c in columns]
    long = df.select(q(order_by).alias("row"), F.inline(F.array(*cells))).filter("value is not null")
    first = long.withColumn("rn", F.row_number().over(W.partitionBy("field").orderBy("row"))).filter(F.col("rn") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("rn", "value")))
    return first.groupBy("field").agg(F.transform(ordered, lambda s: s["value"]).alias("sample_values"))


def profile_fields(
    df: DataFrame, columns: Sequence[str] | None = None, sigma: float = 3.0, order_by: str | None = None,
    small_rows: int = S.SMALL_ROWS,
) -> DataFrame:
    """One row per field with 14 statistics (15 with samples, which need ``order_by``)."""
    columns = list(columns or df.columns)
    types = V.column_types(df)
    nums = numbers(df, columns)
    known = S.moments(df, nums)
    scales = S.robust_scales(df, nums, known, 3, small_rows)
    staged = df.select(
        *[is_blank(df, c).alias(f"b{i}") for i, c in enumerate(columns)],
        *[V.to_number(q(c), types[c]).alias(f"n{i}") for i, c in enumerate(columns)],
    )
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        n, s = F.col(f"n{i}"), scales[c]
        outlier = V.finite(n) & (F.abs(n - F.lit(s.median)) > F.lit(sigma * s.sigma)) if s else F.lit(False)
        aggs += [F.count_if(f"b{i}").alias(f"missing{i}"), F.count(n).alias(f"numeric{i}"), F.count_if(outlier).alias(f"outlier{i}")]
    counts = to_long(
        staged.agg(*aggs), columns,
        {"total": "total", "missing": "missing{i}", "numeric_count": "numeric{i}", "outlier_count": "outlier{i}"},
    )
    distinct = distinct_counts(df, columns)
    facts = []
    for c in columns:
        m, unit = known[c], infer_unit(c)
        enough = m.count >= 3
        facts.append((
            c, *((float(m.low), float(m.high), round(m.mean, 6), round(m.std, 6)) if enough else (None,) * 4),
            unit if enough and unit != "m" else None,
            scales[c].median if scales[c] else None, scales[c].sigma if scales[c] else None,
        ))
    fixed = df.sparkSession.createDataFrame(
        facts, "field string, min_val double, max_val double, mean_val double, std_val double, unit_detected string,"
        " median double, robust_sigma double",
    )
    present = F.col("total") - F.col("missing")
    out = (
        counts.join(F.broadcast(fixed), "field", "left")  # one row per column
        .join(distinct, "field", "left")
        .withColumn("unique", F.coalesce("unique", F.lit(0)))
        .withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(0)))
        .withColumn("null_ratio", F.round(F.try_divide(F.col("missing"), F.col("total")), 4))
        .withColumn("dtype", dtype_of(F.col("numeric_count"), present))
    )
    names = [
        "field", "total", "missing", "null_ratio", "unique", "duplicate_count", "numeric_count", "outlier_count", "dtype",
        "min_val", "max_val", "mean_val", "std_val", "median", "robust_sigma", "unit_detected",
    ]
    if order_by:
        out = out.join(samples(df, columns, order_by), "field", "left")
        names.append("sample_values")
    return out.select(*names)


def dtype_of(numeric: Column, present: Column, share: float = NUMERIC_SHARE) -> Column:
    return F.when(present == 0, "empty").when(numeric / present > share, "numeric").otherwise("text")


def infer_dtypes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """numeric (strictly more than 80 % parse) / text / empty per column, in one scan."""
    columns = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [
            F.count_if(~is_blank(df, c)).alias(f"present{i}"),
            F.count(V.to_number(q(c), df.schema[c].dataType)).alias(f"numeric{i}"),
        ]
    long = to_long(df.agg(*aggs), columns, {"present": "present{i}", "numeric_count": "numeric{i}"})
    return long.withColumn("dtype", dtype_of(F.col("numeric_count"), F.col("present")))


def missing_by_field(df: DataFrame, columns: Sequence[str] | None = None, policy: str = "value") -> DataFrame:
    """Missing count and share per field under one null policy; under ``null`` blank texts are present."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, c in enumerate(columns):
        data_type = df.schema[c].dataType
        gone = {
            "null": lambda: q(c).isNull(),
            "profile": lambda: is_blank(df, c),
            "value": lambda: ~V.has_value(q(c), data_type),
            "template": lambda: V.missing_in_template(q(c), data_type),
        }[policy]()
        aggs.append(F.count_if(gone).alias(f"missing{i}"))
    long = to_long(df.agg(*aggs), columns, {"total": "total", "missing": "missing{i}"})
    return long.withColumn("ratio", F.try_divide(F.col("missing"), F.col("total")))


def value_type_mix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Which of text / number / integer occur per column; integer with number is not a mix."""
    columns = list(columns or df.columns)
    cells = [
        F.struct(F.lit(c).alias("field"), F.when(V.has_value(q(c), df.schema[c].dataType), q(c).cast("string")).alias("cell"))
        for c in columns
    ]
    long = V.staged(df.select(F.inline(F.array(*cells))).filter("cell is not null"), "cell")
    kinds = long.select("field", V.value_type_of(F.col("_n")).alias("kind"))
    counted = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("text", "number", "integer")]
    known = df.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    out = known.join(kinds.groupBy("field").agg(*counted), "field", "left").na.fill(0)
    return out.withColumn("mixed", (F.col("text_count") > 0) & ((F.col("number_count") > 0) | (F.col("integer_count") > 0)))


def schema_variants(df: DataFrame, keys: Column) -> DataFrame:
    """Distinct property-key sets with their row counts; more than one row means an uneven schema."""
    return df.groupBy(F.array_join(F.array_sort(keys), ",").alias("key_set")).agg(F.count(F.lit(1)).alias("rows"))


def key_union(df: DataFrame, keys: Column, order_by: str) -> DataFrame:
    """Union of keys in order of first appearance (long form: ordinal by first row and position)."""
    return (
        df.select(q(order_by).alias("row"), F.posexplode(keys).alias("pos", "key"))
        .groupBy("key")
        .agg(F.min(F.struct("row", "pos")).alias("first"))
        .select("key", F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    )


def coordinate_precision(
    df: DataFrame, axes: Sequence[str], max_abs: float = 1e8, minimum_decimals: int = 0
) -> DataFrame:
    """Counts over all coordinate cells: unreadable, non-finite, out of range, too few decimals."""
    cells = [F.struct(q(a).cast("string").alias("literal"), V.to_number(q(a), df.schema[a].dataType).alias("v")) for a in axes]
    long = df.select(F.inline(F.array(*cells)))
    ok = F.col("v").isNotNull() & V.finite(F.col("v"))
    out = long.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("v").isNull()).alias("invalid"),
        F.count_if(F.col("v").isNotNull() & ~V.finite(F.col("v"))).alias("non_finite"),
        F.count_if(ok).alias("finite_cells"),
        F.count_if(ok & (F.abs("v") > max_abs)).alias("out_of_range"),
        F.count_if(ok & (V.decimal_places(F.col("literal")) < minimum_decimals)).alias("low_precision"),
    )
    ratio = F.coalesce(F.try_divide(F.col("low_precision"), F.col("finite_cells")), F.lit(0.0))
    return out.withColumn("low_precision_flag", F.lit(minimum_decimals > 0) & (ratio > 0.2))


def missing_required(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required headers that no column carries, case ignored."""
    present = {c.strip().lower() for c in df.columns}
    return sorted({r.strip().lower() for r in required} - present)


def first_identifier(columns: Sequence[str]) -> str | None:
    lowered = {c.strip().lower(): c for c in columns}
    return next((lowered[n] for n in fv.IDENTIFIER_COLUMNS if n in lowered), None)


def coordinate_columns(columns: Sequence[str], groups=fv.QUALITY_AXES) -> list[str]:
    lowered = {c.strip().lower(): c for c in columns}
    found = [next((lowered[a] for a in aliases if a in lowered), None) for aliases in groups]
    return [c for c in found if c]

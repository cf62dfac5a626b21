"""Delimited text, JSON records and coordinate tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import values as V
from terraloom.functions.ordering import chunked_index, chunked_running_sums, id_chunk
from terraloom.functions.skew import join_checked, join_shuffled
from terraloom.functions.values import q
from terraloom.session import cut_lineage, materialise
from terraloom.sources.files import numbered_lines
from terraloom.sources.json_split import split_documents

ROW_ID, RAGGED, FILE = "_row_id", "_ragged", "_file"


def _leaves_open(value: Column, sep: str) -> Column:
    """1 if a text that begins outside quotes ends inside a quoted cell. A quote opens at the start of a cell only, or doubled."""
    # \\G stands at the end of the match before, where a doubled quote goes on with the cell
    cell = rf'(?:^|{re.escape(sep)}|\G(?!^))"[^"]*'
    return F.regexp_count(value, F.lit(rf'{cell}("|\z)')) - F.regexp_count(value, F.lit(f'{cell}"'))


def _joined_records(lines: DataFrame, sep: str) -> DataFrame:
    """Lines of a quoted cell with line breaks put together; ``line_no`` is the record's first line.

    What a line does to the state (inside a quoted cell or not) is known for both states before it. A line without effect
    keeps it, others set it or turn it over; running sums per file carry it on. Only the lines of a cell are grouped; where no
    line leaves a cell open nothing is shuffled. Lines after a cell that never closes stay lines; its own is ``unclosed``. Between
    lines of a cell stands what ended them (``end``).
    """
    quote = F.lit('"')
    marks = lines.filter(F.contains("value", quote)).select(
        "file", "line_no", _leaves_open(F.col("value"), sep).alias("out"), _leaves_open(F.concat(quote, "value"), sep).alias("in")
    )
    marks = cut_lineage(marks.filter(~((F.col("out") == 0) & (F.col("in") == 1))))
    if marks.filter(F.col("out") == 1).isEmpty():
        return lines.drop("end").withColumn("unclosed", F.lit(False))
    sets = F.col("out") == F.col("in")
    sums = {"nth": F.lit(1), "part": sets.cast("int"), "turns": (~sets).cast("int")}
    marks = chunked_running_sums(marks, ["file"], id_chunk("line_no"), ["line_no"], sums)
    bases = marks.filter(sets).select("file", "part", (F.col("out") + F.col("turns")).alias("base"))
    state = ((F.coalesce("base", F.lit(0)) + F.col("turns")) % 2).alias("after")
    states = cut_lineage(join_shuffled(marks, bases, ["file", "part"], "left").select("file", "line_no", "nth", state))
    before = states.select("file", (F.col("nth") + 1).alias("nth"), F.col("after").alias("before"))
    turned = join_shuffled(states, before, ["file", "nth"], "left").filter(F.col("after") != F.coalesce("before", F.lit(0))).select("file", "line_no")
    ends = chunked_index(turned, ["file"], id_chunk("line_no"), ["line_no"], "nth")
    spans = ends.groupBy("file", F.floor(F.col("nth") / 2).alias("pair")).agg(F.min("line_no").alias("first"), F.max("line_no").alias("stop"), F.count(F.lit(1)).alias("n"))
    inside = spans.select("file", "first", "stop", (F.col("n") == 1).alias("unclosed"), F.explode(F.sequence("first", "stop")).alias("line_no"))
    inside = inside.withColumn("goes_on", F.col("line_no") < F.col("stop")).drop("stop")
    marked = join_checked(lines, inside, ["file", "line_no"], "left")  # few lines of cells are broadcast and no text is shuffled
    ended = F.when(F.col("goes_on"), F.concat("value", "end")).otherwise(F.col("value"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", ended.alias("value")))), lambda p: p["value"])
    whole = marked.filter("first is not null").groupBy("file", F.col("first").alias("line_no")).agg(F.array_join(parts, "").alias("value"), F.max("unclosed").alias("unclosed"))
    return marked.filter("first is null").select("file", "line_no", "value", F.lit(False).alias("unclosed")).unionByName(whole)


def read_delimited(
    spark: SparkSession, path: Sequence[str] | str, sep: str = ",", encoding: str | None = None, keep_file: bool = False
) -> DataFrame:
    """All cells as text plus ``_row_id`` (the header is line 1) and ``_ragged`` (more cells than headers, or a quoted cell
    that its file never closes).

    Every file is read under its own header; columns are aligned by name, in the order of the first file and of new names
    after it, and are null in files that lack them. A quoted cell may hold line breaks, which stay as they are; ``_row_id`` is the
    first line of a record. A quoted cell without text is an empty text, any other empty cell is null. Delimiter and encoding are the
    caller's choice; encodings beyond Spark's allowed list need ``spark.sql.legacy.javaCharsets``.
    """
    lines = materialise(_joined_records(numbered_lines(spark, path, encoding=encoding, keep_ends=True), sep))  # read for the headers and for the cells
    heads = cut_lineage(lines.filter("line_no = 1").select("file", F.col("value").alias("head")))
    kinds = [r["head"] for r in heads.groupBy("head").agg(F.min("file").alias("file")).orderBy("file").collect()]  # one row per layout
    if not kinds:
        raise ValueError("no header line")
    # no cell equals the word for null, so that "" is a text; left to itself, Spark takes a character 0 for an escape and drops it
    options = {"sep": sep, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": uuid.uuid4().hex}
    layouts = []
    for head in kinds:
        one = spark.createDataFrame([(head,)], "value string")
        width = one.select(F.schema_of_csv(F.lit(head), {"sep": sep})).first()[0].count(":")
        cells = ",".join(f"c{i} string" for i in range(width))
        layouts.append([(c or f"_c{i}").strip() for i, c in enumerate(one.select(F.from_csv("value", F.lit(cells), options).alias("r")).first()["r"])])
    wide = max(map(len, layouts))
    cells = ",".join(f"c{i} string" for i in range(wide + 1))
    body = lines.filter((F.col("line_no") > 1) & (F.trim("value") != "")).withColumn("r", F.from_csv("value", F.lit(cells), options))
    if len(layouts) == 1:
        columns, ragged = [F.col(f"r.c{i}").alias(n) for i, n in enumerate(layouts[0])], F.col(f"r.c{wide}").isNotNull()
    else:
        body = body.join(heads, "file")
        layout = F.array_position(F.array(*[F.lit(h) for h in kinds]), F.col("head")) - 1

        def pick(places):
            out = F.lit(None).cast("string")
            for k, i in places:
                out = F.when(layout == k, F.col(f"r.c{i}")).otherwise(out)
            return out

        names = list(dict.fromkeys(n for names in layouts for n in names))
        columns = [pick([(k, names_.index(n)) for k, names_ in enumerate(layouts) if n in names_]).alias(n) for n in names]
        ragged = pick([(k, len(names_)) for k, names_ in enumerate(layouts)]).isNotNull()
    return body.select(F.col("line_no").alias(ROW_ID), *([F.col("file").alias(FILE)] if keep_file else []), *columns, (ragged | F.col("unclosed")).alias(RAGGED))


FEATURE = "struct<type:string,properties:map<string,string>,geometry:string>"


def read_json_records(spark: SparkSession, path: Sequence[str] | str, lines: bool = False) -> DataFrame:
    """file, ordinal, json_type, props MAP, geometry (JSON text).

    A FeatureCollection gives one row per feature, a list one per object, anything else one row. Documents of any size are taken
    apart by ``json_split``; elements that are no objects are left out. ``lines=True`` reads one JSON value a line.
    """
    kind = lambda text: F.get_json_object(text, "$.type")
    feature = lambda f: F.struct(f["properties"].alias("props"), f["geometry"].alias("geometry"))
    plain = lambda m: F.struct(m.alias("props"), F.lit(None).cast("string").alias("geometry"))
    one_feature, one_object = feature(F.from_json("value", FEATURE)), plain(F.from_json("value", "map<string,string>"))
    shown = ["file", F.col("ordinal").cast("bigint").alias("ordinal"), "json_type", "r.props", "r.geometry"]
    if not lines:
        items, shells = split_documents(spark, path, "features", "FeatureCollection")
        parts = items.select(
            "file", "ordinal", F.when(F.col("is_list"), "List").otherwise("FeatureCollection").alias("json_type"), F.when(F.col("is_list"), one_object).otherwise(one_feature).alias("r")
        )
        whole = shells.filter("not is_split and not is_list").select("file", F.lit(0).alias("ordinal"), F.col("shell").alias("value"))
        is_feature = kind(F.col("value")).eqNullSafe(F.lit("Feature"))
        whole = whole.select("file", "ordinal", F.when(is_feature, "Feature").otherwise("Object").alias("json_type"), F.when(is_feature, one_feature).otherwise(one_object).alias("r"))
        return parts.select(*shown).unionByName(whole.select(*shown))
    base = numbered_lines(spark, path).filter(F.trim("value") != "").select("file", F.col("line_no").alias("base"), "value")
    is_list = F.trim("value").startswith("[")
    text = F.col("value")
    from_features = F.transform(F.from_json(text, f"struct<features:array<{FEATURE}>>")["features"], feature)
    from_list = F.transform(F.from_json(text, "array<map<string,string>>"), plain)
    rows = F.when(kind(text) == "FeatureCollection", from_features).when(kind(text) == "Feature", F.array(one_feature)).when(is_list, from_list).otherwise(F.array(one_object))
    label = F.when(is_list, "List").when(kind(text).isin("FeatureCollection", "Feature"), kind(text)).otherwise("Object")
    exploded = base.select("file", "base", label.alias("json_type"), F.posexplode(rows).alias("pos", "r"))
    return exploded.withColumn("ordinal", F.col("base") + F.col("pos")).select(*shown)


def props_to_columns(records: DataFrame, names: Sequence[str] | None = None, with_point: bool = False) -> DataFrame:
    """Property map -> text columns, over the union of keys; Points may add longitude, latitude, elevation."""
    if names is None:
        names = sorted(r[0] for r in records.select(F.explode(F.map_keys("props"))).distinct().collect())  # one row per property
    out = [F.try_element_at("props", F.lit(n)).alias(n) for n in names]
    if with_point:
        point = F.when(F.get_json_object("geometry", "$.type") == "Point", F.col("geometry"))
        out += [
            F.get_json_object(point, f"$.coordinates[{i}]").alias(n) for i, n in enumerate(("longitude", "latitude", "elevation"))
        ]
    return records.select("file", (F.col("ordinal") + 2).alias(ROW_ID), *out)


def axis_columns(columns: Sequence[str], aliases=fv.CONVERTER_AXES) -> dict[str, str]:
    """axis -> column; the last matching header wins, as headers are read left to right."""
    return {axis: c for c in columns for axis, names in aliases.items() if c.strip().lower() in names}


def table_points(df: DataFrame, mode: str = "strict", row_id: str = ROW_ID, aliases=None, keep: Sequence[str] = ()) -> DataFrame:
    """Coordinate rows of a table: (row_id, x, y, z, props MAP) and the columns to keep, z = 0 where absent or blank.

    strict fails on the first unreadable row, skip leaves such rows out.
    """
    axes = axis_columns(df.columns, aliases or (fv.CONVERTER_AXES if mode == "strict" else fv.SNAPSHOT_AXES))
    if not {"x", "y"} <= axes.keys():
        raise ValueError("no x and y columns")
    types = V.column_types(df)
    number = lambda axis: V.to_number(q(axes[axis]), types[axes[axis]])
    z = F.lit(0.0)
    if "z" in axes:
        blank = q(axes["z"]).isNull() | (V.strip(q(axes["z"])) == "")
        z = F.when(blank, 0.0).otherwise(number("z"))
    ok = number("x").isNotNull() & number("y").isNotNull() & z.isNotNull()
    if mode == "strict":
        ok = ok & V.finite(number("x")) & V.finite(number("y")) & V.finite(z)
    others = [c for c in df.columns if c not in axes.values() and c not in (row_id, RAGGED, FILE)]
    props = F.create_map(*[x for c in others for x in (F.lit(c), q(c).cast("string"))]) if others else F.expr("map()").cast("map<string,string>")
    if mode == "strict":
        failure = F.raise_error(F.concat(F.lit("bad coordinate in row "), q(row_id).cast("string"))).cast("double")
        return df.select(q(row_id).alias("row_id"), F.when(ok, number("x")).otherwise(failure).alias("x"), number("y").alias("y"), z.alias("z"), props.alias("props"), *[q(c) for c in keep])
    return df.filter(ok).select(q(row_id).alias("row_id"), number("x").alias("x"), number("y").alias("y"), z.alias("z"), props.alias("props"), *[q(c) for c in keep])

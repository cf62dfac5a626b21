"""Text meshes as corpus jobs: many files at once, large files split across tasks.

Each reader returns vertices(model_id, vid, x, y, z), faces(model_id, fid, loop) and, where the
format has them, lines. Parsing is by line; what depends on earlier lines (vertex numbers, relative
indices, section membership) comes from running sums cut into pieces of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from terraloom.functions import values as V
from terraloom.functions.ordering import chunked_running_sums, id_chunk
from terraloom.functions.skew import join_checked
from terraloom.operators import mesh
from terraloom.session import cut_lineage
from terraloom.sources import byte_ranges, token_streams
from terraloom.sources.files import numbered_lines


@dataclass
class Meshes:
    vertices: DataFrame
    faces: DataFrame
    lines: DataFrame | None = None
    props: DataFrame | None = None      # model_id, vid, props MAP
    rejected: DataFrame | None = None   # model_id, line_no, value
    face_props: DataFrame | None = None  # model_id, fid, props MAP


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def _number(word: Column) -> Column:
    return V.to_number(word)


def _xyz(words: Column, first: int) -> list[Column]:
    return [_number(F.get(words, first + i)).alias(a) for i, a in enumerate("xyz")]


def _complete(df: DataFrame) -> Column:
    return F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()


def read_obj(spark: SparkSession, path, bits: int = 20, by_folder: bool = False) -> Meshes:
    """OBJ: v / f / l; indices count from 1, negative ones back from the vertices seen so far.

    ``by_folder`` reads the part files of an export as one model per folder.
    """
    words = numbered_lines(spark, path, by_folder=by_folder).select(F.col("file").alias("model_id"), "line_no", "value", _words(F.col("value")).alias("w"))
    tag = F.lower(F.get("w", 0))
    wide = F.size("w")
    rows = words.withColumn(
        "kind", F.when((tag == "v") & (wide >= 4), "v").when((tag == "f") & (wide >= 4), "f").when((tag == "l") & (wide >= 3), "l")
    ).filter("kind is not null")
    good = F.size(F.filter(F.slice("w", 2, 3), lambda c: _number(c).isNotNull())) == 3
    rejected = rows.filter((F.col("kind") == "v") & ~good).select("model_id", "line_no", "value")
    rows = rows.filter((F.col("kind") != "v") | good).drop("value")
    is_ = lambda k: (F.col("kind") == k).cast("int")
    rows = chunked_running_sums(rows, ["model_id"], id_chunk("line_no", bits), ["line_no"], {"nv": is_("v"), "nf": is_("f"), "nl": is_("l")})
    vertices = rows.filter("kind = 'v'").select("model_id", (F.col("nv") - 1).alias("vid"), *_xyz(F.col("w"), 1))
    raw = F.filter(
        F.transform(F.slice("w", 2, 1 << 30), lambda t: F.split_part(t, F.lit("/"), F.lit(1)).try_cast("bigint")), lambda i: i.isNotNull()
    )
    loop = F.transform(raw, lambda i: F.when(i > 0, i - 1).otherwise(F.col("nv") + i))
    faces = rows.filter("kind = 'f'").select("model_id", (F.col("nf") - 1).alias("fid"), loop.alias("loop"), "line_no")
    lines = rows.filter("kind = 'l'").select("model_id", (F.col("nl") - 1).alias("lid"), loop.alias("path"))
    return Meshes(vertices, faces, lines, rejected=rejected)


def obj_has_groups(spark: SparkSession, path) -> DataFrame:
    """model_id, has_groups: whether a file names materials, groups or objects."""
    tag = F.get(_words(F.col("value")), 0)
    return numbered_lines(spark, path).groupBy(F.col("file").alias("model_id")).agg(
        (F.count_if(tag.isin("usemtl", "mtllib", "g", "o")) > 0).alias("has_groups")
    )


def read_ascii_stl(spark: SparkSession, path, bits: int = 20, weld_tolerance: float | None = 0.0) -> Meshes:
    """ASCII STL: three vertex lines per triangle; equal vertices are welded unless tolerance is None."""
    words = numbered_lines(spark, path).select(F.col("file").alias("model_id"), "line_no", _words(F.col("value")).alias("w"))
    vertex = words.filter((F.size("w") == 4) & (F.lower(F.get("w", 0)) == "vertex"))
    counted = chunked_running_sums(vertex, ["model_id"], id_chunk("line_no", bits), ["line_no"], {"n": F.lit(1)})
    points = counted.select("model_id", (F.col("n") - 1).alias("vid"), *_xyz(F.col("w"), 1))
    return _triangle_soup(points, weld_tolerance)


def _triangle_soup(points: DataFrame, weld_tolerance: float | None) -> Meshes:
    corners = points.select("model_id", F.floor(F.col("vid") / 3).alias("fid"), F.pmod("vid", F.lit(3)).alias("pos"), "vid")
    vertices = points
    if weld_tolerance is not None:
        mapping = mesh.weld_map(points, weld_tolerance)
        vertices = points.join(mapping.filter("vid = new_vid").select("model_id", "vid"), ["model_id", "vid"], "left_semi")
        corners = mesh._rewrite(corners, mapping)
    faces = mesh.loops_of(corners).filter(F.size("loop") == 3)
    return Meshes(vertices, faces)


_STL_RECORD = np.dtype([("normal", "<f4", 3), ("points", "<f4", (3, 3)), ("attr", "<u2")])
_STL_HEADER, _STL_BYTES = 84, 50


def _decode_stl(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for model_id, offset, content in zip(batch["path"], batch["offset"], batch["content"], strict=True):
            records = np.frombuffer(content, _STL_RECORD, count=len(content) // _STL_BYTES)
            before = (offset - _STL_HEADER) // _STL_BYTES
            for start in range(0, len(records), 200_000):
                xyz = records["points"][start : start + 200_000].reshape(-1, 3).astype("f8")
                first = (before + start) * 3
                yield pd.DataFrame({
                    "model_id": model_id, "vid": np.arange(first, first + len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2],
                })


def stl_kinds(spark: SparkSession, path) -> DataFrame:
    """(path, length, binary): a binary file has exactly 84 + 50 n bytes, n being the count at byte 80; no more than the header is read."""
    files = byte_ranges.listing(spark, path)
    heads = byte_ranges.read_ranges(spark, path, files.select("path", F.lit(0).cast("bigint").alias("offset"), F.lit(_STL_HEADER).cast("bigint").alias("size")))
    n = byte_ranges.little_endian(F.col("content"), 80)
    known = files.join(heads.select("path", n.alias("n"), F.length("content").alias("head")), "path")
    return known.select("path", "length", ((F.col("head") == _STL_HEADER) & (F.col("length") == _STL_HEADER + F.col("n") * _STL_BYTES) & (F.col("n") > 0)).alias("binary"))


def read_binary_stl(spark: SparkSession, path, weld_tolerance: float | None = 0.0, range_bytes: int = byte_ranges.RANGE, kinds: DataFrame | None = None) -> Meshes:
    """Binary STL by ranges of its 50-byte records, so one file is read by many tasks; other files are passed over."""
    kinds = stl_kinds(spark, path) if kinds is None else kinds
    parts = byte_ranges.ranges(kinds.filter("binary"), _STL_HEADER, _STL_BYTES, range_bytes)
    points = byte_ranges.read_ranges(spark, path, parts).mapInPandas(_decode_stl, "model_id string, vid bigint, x double, y double, z double")
    return _triangle_soup(points, weld_tolerance)


def read_stl(spark: SparkSession, path, weld_tolerance: float | None = 0.0, range_bytes: int = byte_ranges.RANGE) -> Meshes:
    """STL files of both kinds: headers tell them apart, then each reader gets its own files."""
    kinds = cut_lineage(stl_kinds(spark, path))
    found = read_binary_stl(spark, path, weld_tolerance, range_bytes, kinds)
    texts = [unquote(r["path"]) for r in kinds.filter("not binary").select("path").collect()]  # names, as every listing holds them
    if not texts:
        return found
    text = read_ascii_stl(spark, texts, weld_tolerance=weld_tolerance)
    return Meshes(text.vertices.unionByName(found.vertices), text.faces.unionByName(found.faces))


def read_ply(spark: SparkSession, path) -> Meshes:
    """ASCII PLY: counts and property order from the header; other vertex properties become a map."""
    lines = numbered_lines(spark, path).select(F.col("file").alias("model_id"), "line_no", _words(F.col("value")).alias("w"))
    first = F.get("w", 0)
    end = lines.filter(first == "end_header").groupBy("model_id").agg(F.min("line_no").alias("end"))
    marked = lines.join(end, "model_id")
    head = marked.filter("line_no < end")  # a header holds a few lines
    so_far = W.partitionBy("model_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = head.withColumn("element", F.last(F.when(first == "element", F.lower(F.get("w", 1))), ignorenulls=True).over(so_far))
    count = lambda name: F.max(F.when((first == "element") & (F.col("element") == name), F.get("w", 2).try_cast("bigint")))
    prop = F.when((first == "property") & (F.col("element") == "vertex"), F.struct("line_no", F.lower(F.element_at("w", -1)).alias("p")))
    facts = head.groupBy("model_id").agg(
        F.coalesce(count("vertex"), F.lit(0)).alias("nv"), F.coalesce(count("face"), F.lit(0)).alias("nf"),
        F.transform(F.array_sort(F.collect_list(prop)), lambda s: s["p"]).alias("names"),
        F.max((first == "format") & (F.get("w", 1) == "ascii")).alias("ascii"), F.max("end").alias("end"),
    )
    body = lines.join(facts.filter("ascii"), "model_id").filter("line_no > end").withColumn("k", F.col("line_no") - F.col("end") - 1)
    at = lambda name: _number(F.get("w", F.array_position("names", F.lit(name)).cast("int") - 1))
    points = body.filter("k < nv")
    vertices = points.select("model_id", F.col("k").alias("vid"), *[at(a).alias(a) for a in "xyz"])
    named = F.filter(F.arrays_zip(F.col("names").alias("key"), F.slice("w", 1, F.size("names")).alias("value")), lambda e: ~e["key"].isin("x", "y", "z"))
    props = points.select("model_id", F.col("k").alias("vid"), F.map_from_entries(named).alias("props"))
    cells = body.filter("k >= nv and k < nv + nf and size(w) > 0")
    loop = F.transform(F.slice("w", 2, F.greatest(F.lit(0), first.try_cast("int"))), lambda t: t.try_cast("bigint"))
    faces = cells.select("model_id", (F.col("k") - F.col("nv")).alias("fid"), loop.alias("loop"))
    rejected = facts.filter("not ascii").select("model_id", F.lit(1).cast("bigint").alias("line_no"), F.lit("not ASCII PLY").alias("value"))
    return Meshes(vertices, faces, props=props, rejected=rejected)


_VTK_SECTIONS = ("POINTS", "POLYGONS", "CELLS", "LINES", "VERTICES", "CELL_TYPES", "POINT_DATA", "CELL_DATA", "SCALARS", "LOOKUP_TABLE")


def read_vtk(spark: SparkSession, path, bits: int = 20, chunk: int = token_streams.CHUNK) -> Meshes:
    """Legacy ASCII VTK as a stream of words: line breaks inside a section mean nothing.

    Points take three words each by running word count. A cell is a count and as many vertex ids; in sections with one cell to each
    line, lines are cells, all others are taken apart by ``token_streams``. Cells that end with the section or not at all are left
    out, and cells of a section beyond its stated number too.
    """
    lines = numbered_lines(spark, path).select(F.col("file").alias("model_id"), "line_no", _words(F.col("value")).alias("w"))
    word = F.upper(F.get("w", 0))
    keyword = F.coalesce(word.isin(*_VTK_SECTIONS), F.lit(False))
    rows = lines.withColumn("kw", F.when(keyword, word)).withColumn("words", F.when(keyword, 0).otherwise(F.size("w")))
    rows = cut_lineage(chunked_running_sums(
        rows, ["model_id"], id_chunk("line_no", bits), ["line_no"],
        {"section": keyword.cast("int"), "seen": F.col("words"), "record": (~keyword & (F.size("w") > 0)).cast("int")},
    ))
    heads = rows.filter("kw is not null").select(
        "model_id", "section", F.col("kw").alias("name"), F.get("w", 1).try_cast("bigint").alias("n"), F.get("w", 2).try_cast("bigint").alias("size"),
        F.col("seen").alias("seen0"), F.col("record").alias("record0"),
    )
    heads = cut_lineage(heads)  # a few rows for each file
    body = join_checked(rows.filter("kw is null and size(w) > 0"), heads, ["model_id", "section"])
    first = F.col("seen") - F.size("w") - F.col("seen0")
    values = body.filter("name = 'POINTS'").select("model_id", "n", first.alias("base"), F.posexplode("w").alias("i", "t"))
    values = values.withColumn("k", F.col("base") + F.col("i")).filter(F.col("k") < F.col("n") * 3)
    axis = F.pmod("k", F.lit(3))
    vertices = values.groupBy("model_id", F.floor(F.col("k") / 3).alias("vid")).agg(
        *[F.max(F.when(axis == i, _number(F.col("t")))).alias(a) for i, a in enumerate("xyz")]
    )
    body = body.filter("name in ('POLYGONS', 'CELLS', 'LINES')")
    count = F.get("w", 0).try_cast("bigint")
    record = F.col("record") - F.col("record0") - 1
    shown = ["model_id", "section", "name"]
    by_line = F.coalesce((F.size("w") == count + 1) | (record >= F.col("n")), F.lit(False))
    loose = cut_lineage(body.groupBy("model_id", "section").agg(F.bool_and(by_line).alias("by_line")).filter("not by_line").select("model_id", "section"))
    aligned = join_checked(body, loose.withColumn("loose", F.lit(True)), ["model_id", "section"], "left").filter(F.col("loose").isNull() & (record < F.col("n")))
    ids = F.transform(F.slice("w", 2, 1 << 30), lambda t: t.try_cast("bigint"))
    cells = aligned.select(*shown, record.alias("record"), ids.alias("loop"))
    if not loose.isEmpty():
        stream = join_checked(body, loose, ["model_id", "section"]).select("model_id", "section", "size", first.alias("base"), F.posexplode("w").alias("i", "t"))
        tokens = stream.select("model_id", "section", (F.col("base") + F.col("i")).alias("k"), F.col("t").try_cast("bigint").alias("v"), "size")
        tokens = tokens.filter(F.col("size").isNull() | (F.col("k") < F.col("size"))).drop("size")
        found = token_streams.records(tokens, ["model_id", "section"], chunk)
        found = join_checked(found, heads.select("model_id", "section", "name", "n"), ["model_id", "section"]).filter(F.col("record") < F.col("n"))
        cells = cells.unionByName(found.select(*shown, "record", F.col("items").alias("loop")))
    faces = cells.filter("name in ('POLYGONS', 'CELLS')").select("model_id", F.col("record").alias("fid"), "loop")
    paths = cells.filter("name = 'LINES'").select("model_id", F.col("record").alias("lid"), F.col("loop").alias("path"))
    return Meshes(vertices, faces, paths)


def loose_triples(spark: SparkSession, path) -> DataFrame:
    """Lines of a PLY or VTK file that start with three numbers, as points (the light check)."""
    words = numbered_lines(spark, path).select(F.col("file").alias("model_id"), "line_no", _words(F.col("value")).alias("w"))
    points = words.filter(F.size("w") >= 3).select("model_id", "line_no", *_xyz(F.col("w"), 0))
    return points.filter(_complete(points))


# --- IFC text facts -----------------------------------------------------------------------

IFC_PRODUCTS = "BUILDINGELEMENTPROXY|WALL|SLAB|BEAM|COLUMN|FOOTING|PILE|SITE"
IFC_MARKERS = ("ISO-10303-21", "HEADER", "DATA", "END-ISO-10303-21")


def read_ifc(spark: SparkSession, path) -> DataFrame:
    """STEP statements: file, line_no, text, entity_id, entity_type, global_id, point ARRAY<STRING>.

    Statements end with ';', which serves as the record separator, so large files split.
    """
    text = F.trim(F.regexp_replace("value", r"[\r\n]+", " "))
    base = numbered_lines(spark, path, line_sep=";").select("file", "line_no", text.alias("text"))
    entity = r"(?i)^#(\d+)\s*=\s*(IFC[A-Z0-9_]+)\s*\("
    point = F.regexp_extract("text", r"(?i)IFCCARTESIANPOINT\s*\(\s*\(([^)]*)\)\s*\)", 1)
    product = F.col("text").rlike(rf"(?i)=\s*IFC(?:{IFC_PRODUCTS})\s*\(")
    gid = rf"(?i)^#\d+\s*=\s*IFC(?:{IFC_PRODUCTS})\s*\(\s*'([^']*)'"
    return base.select(
        "file", "line_no", "text", F.nullif(F.regexp_extract("text", entity, 1), F.lit("")).alias("entity_id"),
        F.nullif(F.regexp_extract("text", entity, 2), F.lit("")).alias("entity_type"), product.alias("is_product"),
        F.when(F.col("text").rlike(gid), F.regexp_extract("text", gid, 1)).alias("global_id"),
        F.when(point != "", F.transform(F.split(point, ","), lambda t: F.trim(t))).alias("point"),
    )


def ifc_audit(statements: DataFrame) -> DataFrame:
    """Per file: entities, products, points, missing markers, repeated ids, empty and repeated GlobalIds."""
    marks = [F.max(F.upper("text") == m).alias(f"m{i}") for i, m in enumerate(IFC_MARKERS)]
    facts = statements.groupBy("file").agg(
        F.count("entity_id").alias("entities"), F.count_if("is_product").alias("products"), F.count("point").alias("points"),
        F.count_if(V.strip(F.col("global_id")) == "").alias("empty_global_ids"), *marks,
    )
    repeats = lambda c, out: (
        statements.filter(F.col(c).isNotNull()).groupBy("file", c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .groupBy("file").agg(F.count(F.lit(1)).alias(out))
    )
    whole = F.lit(True)
    for i in range(len(IFC_MARKERS)):
        whole = whole & F.col(f"m{i}")
    return (
        facts.withColumn("complete", whole).drop(*[f"m{i}" for i in range(len(IFC_MARKERS))])
        .join(repeats("entity_id", "duplicate_ids"), "file", "left").join(repeats("global_id", "duplicate_global_ids"), "file", "left")
        .na.fill(0, ["duplicate_ids", "duplicate_global_ids"])
    )

"""JSON documents of any size as rows of their elements.

A document is read in segments that end at closing braces, so one file, even on a single line, spreads over tasks. Whether a segment
begins inside a string is the parity of the quotes before it, how deep it begins is a running sum of brackets; both are summed
piece by piece over narrow rows, without the text. Segments that begin at the depth of the wanted array or above are scanned for its
borders. The elements of the array are then put together from their own segments; no task sees more than one element.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terraloom.functions.ordering import chunked_running_sum, id_chunk
from terraloom.functions.skew import join_checked, join_shuffled
from terraloom.session import cut_lineage, materialise
from terraloom.sources.files import numbered_lines

_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.DOTALL)
_COLON = re.compile(r"\s*:")


def _depth_change(plain: Column, opened: bool) -> Column:
    """Brackets opened less brackets closed outside strings, in a text without escapes that begins inside a string or not."""
    rest = F.regexp_replace(F.concat(F.lit('"'), plain) if opened else plain, r'"[^"]*("|$)', "")
    count = lambda pattern: F.regexp_count(rest, F.lit(pattern))
    return count(r"[{\[]") - count(r"\]")


def border_events(text: str, depth: int, opened: bool, key: str) -> list[tuple[str, int]]:
    """Borders in one segment: ``list`` or ``open`` (behind the bracket that begins the elements), ``close`` and ``end`` (before the bracket that
    ends the array of a member, or the list)."""
    found, name = [], None
    at = 0
    if opened:
        m = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL).match(text)
        at = m.end() if m else len(text)
    for m in _PARTS.finditer(text, at):
        part = m.group()
        if part[0] == '"':
            if depth == 1 and _COLON.match(text, m.end()):
                name = part[1:-1]
            continue
        if part in "{[":
            if part == "[" and depth == 0:
                found.append(("list", m.end()))
            elif part == "[" and depth == 1 and name == key:
                found.append(("open", m.end()))
            depth += 1
        else:
            depth -= 1
            if part == "]" and depth <= 1:
                found.append(("close" if depth else "end", m.start()))
    return found


def split_documents(spark: SparkSession, path, key: str, root_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(items(file, ordinal, is_list, value), shells(file, is_list, is_split, shell)) of JSON documents.

    Items are the objects of a list, or of the array in the root member ``key``, as JSON text and counted from 0; other elements
    are left out. A shell is what remains of a document, the array being empty in it. With ``root_type`` only documents whose ``type``
    it is are split, other objects stay whole in their shell.
    """
    segments = materialise(numbered_lines(spark, path, line_sep="}"))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    narrow = segments.select("file", "line_no", plain.alias("p")).select(
        "file", "line_no", F.regexp_count("p", F.lit('"')).alias("quotes"), _depth_change(F.col("p"), False).alias("d0"), _depth_change(F.col("p"), True).alias("d1")
    )
    counted = chunked_running_sum(narrow, ["file"], id_chunk("line_no"), ["line_no"], F.col("quotes"), "so_far")
    inside, inside_after = (F.col("so_far") - F.col("quotes")) % 2 == 1, F.col("so_far") % 2 == 1
    # the brace that ends a segment closes something unless it stands in a string
    change = F.when(inside, F.col("d1")).otherwise(F.col("d0")) - F.when(inside_after, 0).otherwise(1)
    states = counted.select("file", "line_no", inside.alias("opened"), (~inside_after).alias("closes"), change.alias("change"))
    states = chunked_running_sum(states, ["file"], id_chunk("line_no"), ["line_no"], F.col("change"), "after")
    states = cut_lineage(states.select("file", "line_no", "opened", "closes", "after", (F.col("after") - F.col("change")).alias("depth")))

    def events(batches):
        for b in batches:
            rows = [
                (f, n, kind, at) for f, n, v, d, o in zip(b["file"], b["line_no"], b["value"], b["depth"], b["opened"], strict=True)
                for kind, at in border_events(v, int(d), bool(o), key)
            ]
            yield pd.DataFrame(rows, columns=["file", "line_no", "kind", "at"])

    shallow = join_shuffled(segments, states.filter("depth <= 2"), ["file", "line_no"]).select("file", "line_no", "value", "depth", "opened")
    found = cut_lineage(shallow.mapInPandas(events, "file string, line_no bigint, kind string, at int"))
    place = F.struct("line_no", "at")
    opens = found.groupBy("file").agg(
        F.min(F.when(F.col("kind") == "open", place)).alias("open"), F.min(F.when(F.col("kind") == "list", place)).alias("list"), F.max(F.when(F.col("kind") == "end", place)).alias("end")
    )
    closes = join_checked(found.filter("kind = 'close'"), opens.select("file", "open"), ["file"]).filter(place >= F.col("open")).groupBy("file").agg(F.min(place).alias("close"))
    borders = opens.join(closes, "file", "left").select(
        "file", F.col("list").isNotNull().alias("is_list"), F.coalesce("list", "open").alias("open"),
        F.when(F.col("list").isNotNull(), F.col("end")).otherwise(F.col("close")).alias("close"), F.when(F.col("list").isNotNull(), 1).otherwise(2).alias("level"),
    )
    borders = cut_lineage(borders)  # a row for each file

    text = F.concat(F.col("value"), F.when(F.col("after") >= 0, F.lit("}")).otherwise(F.lit("")))
    placed = join_checked(join_shuffled(segments, states, ["file", "line_no"]), borders, ["file"], "left")
    after_open = F.col("line_no") >= F.col("open.line_no")
    before_close = F.col("close").isNull() | (F.col("line_no") <= F.col("close.line_no"))
    cut_front = F.when(F.col("line_no") == F.col("open.line_no"), F.substr(text, F.col("open.at") + 1)).otherwise(text)
    is_end = (F.col("after") == F.col("level")) & F.col("closes")

    head = F.when(F.col("open").isNull() | (F.col("line_no") < F.col("open.line_no")), text).when(F.col("line_no") == F.col("open.line_no"), F.substr("value", F.lit(1), F.col("open.at")))
    tail = F.when(F.col("line_no") > F.col("close.line_no"), text).when(F.col("line_no") == F.col("close.line_no"), F.substr(text, F.col("close.at") + 1))
    outer = placed.select("file", "line_no", F.concat(F.coalesce(head, F.lit("")), F.coalesce(tail, F.lit(""))).alias("value")).filter("value <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda p: p["value"]), "")
    shells = cut_lineage(outer.groupBy("file").agg(joined.alias("shell")).join(borders, "file", "left"))
    split = F.col("open").isNotNull()
    if root_type is not None:
        split = split & (F.col("is_list") | (F.get_json_object("shell", "$.type").eqNullSafe(F.lit(root_type))))
    shells = shells.select("file", F.coalesce("is_list", F.lit(False)).alias("is_list"), F.coalesce(split, F.lit(False)).alias("is_split"), "shell")
    if root_type is not None:
        # documents of another type are one element each, whatever arrays they hold
        others = join_checked(join_shuffled(segments, states, ["file", "line_no"]), shells.filter("not is_split").select("file"), ["file"])
        whole = others.select("file", "line_no", text.alias("value")).groupBy("file").agg(joined.alias("shell"))
        shells = shells.filter("is_split").unionByName(whole.select("file", F.lit(False).alias("is_list"), F.lit(False).alias("is_split"), "shell"))
        shells = cut_lineage(shells)

    within = join_checked(placed.filter(after_open & before_close), shells.filter("is_split").select("file", "is_split"), ["file"])
    within = within.select("file", "line_no", "is_list", cut_front.alias("value"), is_end.cast("int").alias("is_end"))
    # the segment that ends an element belongs to it
    numbers = chunked_running_sum(within.select("file", "line_no", "is_end"), ["file"], id_chunk("line_no"), ["line_no"], F.col("is_end"), "ends")
    numbers = numbers.select("file", "line_no", (F.col("ends") - F.col("is_end")).alias("ordinal"))
    elements = join_shuffled(within, numbers, ["file", "line_no"]).groupBy("file", "ordinal").agg(joined.alias("value"), F.max("is_end").alias("whole"), F.first("is_list").alias("is_list"))
    items = elements.filter("whole = 1").select("file", "ordinal", "is_list", F.regexp_replace("value", r"^[^{]*", "").alias("value"))
    return items, shells

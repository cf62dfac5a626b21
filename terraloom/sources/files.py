"""File listings: discovery, facts, distribution, checksums, and numbered text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from terraloom import fixed_values as fv
from terraloom.functions import values as V
from terraloom.functions.skew import join_checked
from terraloom.session import materialise


def with_file_facts(df: DataFrame) -> DataFrame:
    """Name, suffix and category of each path."""
    table = {s: c for c, suffixes in fv.FILE_CATEGORIES.items() for s in suffixes}
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    suffix = V.file_suffix(F.col("path"))
    return df.withColumns({
        "name": V.file_name(F.col("path")), "suffix": suffix,
        "category": F.coalesce(F.try_element_at(pairs, suffix), F.lit(fv.UNKNOWN_CATEGORY)),
    })


def list_files(spark: SparkSession, roots: Sequence[str], pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of every file; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(list(roots)).select("path", "length", "modificationTime")


def scan_directories(
    spark: SparkSession, roots: Sequence[str], patterns: Sequence[str] = ("*",), category: str = fv.ALL_CATEGORIES,
    recursive: bool = True, max_files: int | None = None,
) -> DataFrame:
    """Files of the wanted category, each path once, ordered by (category, name, path).

    All files, unless ``max_files`` asks for the first ones; that cut comes after the total order.
    """
    pattern = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    found = with_file_facts(list_files(spark, roots, pattern or "*", recursive)).dropDuplicates(["path"])
    known = fv.FILE_CATEGORIES.get(category) or tuple(s for suffixes in fv.FILE_CATEGORIES.values() for s in suffixes)
    out = found.filter(F.col("suffix").isin(*known)).orderBy("category", "name", "path")
    return out if max_files is None else out.limit(max(1, int(max_files)))


def format_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("category").agg(F.count(F.lit(1)).alias("count"), F.sum("length").alias("size_bytes"))


LONGEST = 1 << 26  # bytes between line feeds that are taken apart in one row


def _taken_apart(rows: DataFrame) -> DataFrame:
    """Texts between line feeds -> their lines, each with the characters in ``end`` that ended it."""
    others = [c for c in rows.columns if c != "value"]
    last = F.when(F.endswith("value", F.lit("\r")), "\r\n").otherwise("\n")
    pieces = F.split(F.regexp_replace("value", r"\r\z", ""), "\r", -1)
    staged = rows.select(*others, last.alias("last"), pieces.alias("pieces"), F.size(pieces).alias("n"))  # the text itself is not repeated
    ended = staged.select(*others, "last", "n", F.posexplode("pieces").alias("pos", "value"))
    return ended.select(*others, "value", F.when(F.col("pos") < F.col("n") - 1, "\r").otherwise(F.col("last")).alias("end"))


def numbered_lines(
    spark: SparkSession, paths: Sequence[str] | str, line_sep: str | None = None, encoding: str | None = None, by_folder: bool = False,
    keep_ends: bool = False,
) -> DataFrame:
    """file, line_no (from 1), value - for files of any size, split as usual.

    Inside one split of one file the scan's row ids are consecutive, so a line's number is the count
    of lines in earlier splits plus its offset from the split's first id; both come from one compressed table, so
    nothing depends on two scans splitting alike. The text is not shuffled while the table of splits, a row each, is small. With ``by_folder`` the part files of a folder, by their
    number and then their name, are one text and ``file`` is that folder. With ``keep_ends`` a further column ``end`` holds what ended
    the line: files with carriage returns are read at line feeds and taken apart after that. A file with ``LONGEST`` bytes or more between
    two line feeds is read as ever, so that no task holds it whole, and its ends are told as line feeds.
    """
    reader = spark.read
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    if encoding:
        reader = reader.option("encoding", encoding)
    path = F.col("_metadata.file_path")

    def numbered(text: DataFrame, ended: bool = False) -> DataFrame:
        folder = F.regexp_replace(path, "/[^/]*$", "") if by_folder else path
        rows = text.select(folder.alias("file"), path.alias("part"), F.col("_metadata.file_block_start").alias("block"), "value")
        return (_taken_apart(rows) if ended else rows).withColumn("mid", F.monotonically_increasing_id())

    if keep_ends:
        feeds = {"lineSep": "\n", **({"encoding": encoding} if encoding else {})}
        # Hadoop skips longer lines here, so a file without line feeds is never held whole; what it skips is missing from the sum
        looked = spark.read.options(**{"lineSep": "\n", "mapreduce.input.linerecordreader.line.maxlength": str(LONGEST)}).text(paths)
        looked = looked.select(path.alias("part"), F.col("_metadata.file_size").alias("size"), "value").groupBy("part").agg(
            F.bool_or(F.contains("value", F.lit("\r"))).alias("back"), F.sum(F.octet_length("value") + 1).alias("found"), F.max("size").alias("size")
        )
        marked = path.isin([r["part"] for r in looked.filter("back and found >= size - 3").collect()])  # one row per file; a mark of byte order is left out
        plain = numbered(reader.text(paths).filter(~marked)).withColumn("end", F.lit("\n"))
        base = materialise(plain.unionByName(numbered(spark.read.options(**feeds).text(paths).filter(marked), ended=True)))
    else:
        base = materialise(numbered(reader.text(paths)))
    blocks = base.groupBy("file", "part", "block").agg(F.min("mid").alias("first_mid"), F.count(F.lit(1)).alias("n"))
    number = F.regexp_extract("part", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    earlier = W.partitionBy("file").orderBy(number, "part", "block").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    line_no = F.col("before") + F.col("mid") - F.col("first_mid") + 1
    text = F.when(F.col("line_no") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return join_checked(base, blocks, ["file", "part", "block"]).withColumn("line_no", line_no).select("file", "line_no", text.alias("value"), *(["end"] if keep_ends else []))

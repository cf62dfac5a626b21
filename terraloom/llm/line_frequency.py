"""Quality rules with cross-document line frequency.

Base rules look at a document alone: too few words, or too many words inside repeated five-word windows. The method then
looks at lines across documents. Lines are normalised (lower case, every digit as 0, other ASCII signs and white space
dropped) and hashed; for every host (``source``) and line it counts the distinct documents that hold the line. A line above the
host's limit is removed, and a document that keeps too small a share of its words, or too few, is rejected as depleted.

Copies of a document are one document here: documents are told apart by a 128-bit hash of their whole sequence of lower-case
words, so a text does not lose its lines by being copied; that is the work of deduplication. Texts that differ in one word are
two documents. The limit is the larger of ``min_docs`` and ``share`` of the host's distinct documents.

Defined cases: a null text has no words and fails the base rule; a null source is a host of its own; repeated rows get a row
each; a very long text is one row's work in numpy; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraloom.llm.common import KEYS, SpanHash, keyed, mixed, slices, utf8, word_bounds, wrapped
from terraloom.session import cut_lineage

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
MIN_DOCS = 20
SHARE = 0.01
MIN_LEFT_WORDS = 5
MIN_LEFT_SHARE = 0.3
SALTS = 16

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_WORD_CHARACTER = np.array([b & 0xC0 != 0x80 and b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
_DROPPED = bytes(b for b in range(128) if b != 10 and not chr(b).isalnum())
_ONE_DIGIT = bytes(48 if 48 <= b <= 57 else b for b in range(256))

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
DOCUMENT = ("document1", "document2")
PROFILE = f"_key1 long, _key2 long, doc_id long, source string, {STATS}, document1 long, document2 long, lines array<struct<line: long, words: long>>"


def repeated_words(words: np.ndarray) -> int:
    """Words that stand in a five-word window which occurs at least twice in the text, its first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    window = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        window = mixed(window + words[k : k + n] * np.uint64(2 * k + 3))
    ordered = np.sort(window)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return 0
    spot = np.minimum(np.searchsorted(again, window), len(again) - 1)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    found = np.flatnonzero(again[spot] == window)
    np.add.at(edges, found, 1)
    np.add.at(edges, found + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def normalised(text: str) -> np.ndarray:
    """UTF-8 bytes of the lower-case text, digits as 0, other ASCII signs and spaces dropped, line breaks kept."""
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass").translate(_ONE_DIGIT, _DROPPED), dtype=np.uint8)


def _lines(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    breaks = np.flatnonzero(raw == 10)
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(raw)]])


def document_hash(text: str) -> tuple[int, int]:
    """128 bits of the whole sequence of lower-case words; only copies share them."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


NO_LINES = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


def profile_text(text: str | None) -> tuple:
    """Base statistics, the hash of the document, and the hashes and words of the distinct normalised lines of one whole text.

    Lines without a word, letter or digit carry no hash, so they are never removed.
    """
    raw = utf8(text)
    n_symbols = int(_SYMBOL[raw].sum())
    start, stop = word_bounds(raw)
    if not len(start):
        return 0, 0, n_symbols, 0, 0, 0, 0, NO_LINES
    span = SpanHash(raw)
    words = span(start, stop)
    line_start, line_stop = _lines(raw)
    n_words = np.searchsorted(start, line_stop) - np.searchsorted(start, line_start)
    exact = span(line_start[n_words > 0], line_stop[n_words > 0])
    plain = normalised(text)
    first, last = _lines(plain)
    used = (n_words > 0) & (last > first)
    hashes, at = np.unique(SpanHash(plain)(first[used], last[used]).astype(np.int64), return_inverse=True)
    return (
        len(words), int(_WORD_CHARACTER[raw].sum()), n_symbols, len(exact) - len(np.unique(exact)), repeated_words(words), *document_hash(text),
        (hashes, np.bincount(at, weights=n_words[used], minlength=len(hashes)).astype(np.int64)),
    )


def profiles(docs: DataFrame) -> DataFrame:
    """A row per document: base statistics, hash of the document and line hashes."""

    def run(batches):
        for b in slices(batches):
            columns = list(zip(*[profile_text(t) for t in b.column("text").to_pylist()], strict=True))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in columns[7]])]), pa.int32())
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([x[k] for x in columns[7]]), pa.int64()) for k in (0, 1)], ["line", "words"])
            lines = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in (*KEYS, "doc_id", "source")], *[pa.array(c, pa.int64()) for c in columns[:7]], lines],
                [*KEYS, "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *DOCUMENT, "lines"],
            )

    return keyed(docs.select("doc_id", "source", "text")).mapInArrow(run, PROFILE)


def frequent_lines(lines: DataFrame, hosts: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(source_key, no_source, line, n_docs) of the lines above their host's limit; ``n_docs`` counts distinct documents."""
    distinct = lines.groupBy("source", "line", *DOCUMENT).agg(F.lit(1).alias("one"))
    counts = distinct.groupBy("source", "line").agg(F.count("one").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    counts = counts.select(F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("no_source"), "line", "n_docs")
    hosts = hosts.select(F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("no_source"), "host_docs")
    limit = F.greatest(F.lit(float(min_docs)), F.lit(share) * F.col("host_docs"))
    return counts.join(hosts, ["source_key", "no_source"]).filter(F.col("n_docs") > limit).select("source_key", "no_source", "line", "n_docs")


def _judged(docs: DataFrame, min_docs: int, share: float, min_left_words: int, min_left_share: float, keep_lines: bool = False) -> DataFrame:
    rows = cut_lineage(profiles(docs).withColumn("row", F.monotonically_increasing_id()))
    lines = rows.select("row", "source", *DOCUMENT, F.explode("lines").alias("_l")).select("row", "source", *DOCUMENT, "_l.line", "_l.words")
    hosts = rows.groupBy("source", *DOCUMENT).agg(F.lit(1).alias("one")).groupBy("source").agg(F.count("one").alias("host_docs"))
    frequent = cut_lineage(frequent_lines(lines, hosts, min_docs, share))
    # a frequent line is in many rows of its host: the few frequent lines are copied under every salt, the rows take one each
    salted = frequent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = lines.select(
        "row", "line", "words", F.coalesce("source", F.lit("")).alias("source_key"), F.col("source").isNull().alias("no_source"),
        (F.col("row") % SALTS).cast("int").alias("_salt"),
    )
    gone = spread.join(salted, ["source_key", "no_source", "line", "_salt"]).groupBy("row").agg(
        F.sum("words").alias("n_removed_words"), F.count(F.lit(1)).alias("n_removed_lines"), *([F.collect_list("line").alias("removed_lines")] if keep_lines else [])
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    joined = rows.drop("lines", *DOCUMENT).join(gone, "row", "left").fillna(0, ["n_removed_words", "n_removed_lines"])
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < min_left_words) | (left < min_left_share * F.col("n_words")))
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & ~depleted)


def judge(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_left_words: int = MIN_LEFT_WORDS, min_left_share: float = MIN_LEFT_SHARE,
) -> DataFrame:
    """A row per document: base statistics, ``base_failed``, ``n_removed_words``, ``n_removed_lines`` and ``kept``."""
    return _judged(docs, min_docs, share, min_left_words, min_left_share).select(
        "doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines"
    )


def without_lines(text: str, removed: set[int]) -> str:
    plain = normalised(text)
    first, last = _lines(plain)
    hashes = SpanHash(plain)(first, last).astype(np.int64).tolist()
    kept = [line for line, h, n in zip(text.split("\n"), hashes, (last - first).tolist(), strict=True) if not n or h not in removed]
    return "\n".join(kept)


def clean(
    docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, min_left_words: int = MIN_LEFT_WORDS, min_left_share: float = MIN_LEFT_SHARE,
) -> DataFrame:
    """The kept documents without their removed lines; all columns stay, ``n_chars`` follows the text."""
    judged = _judged(docs, min_docs, share, min_left_words, min_left_share, keep_lines=True)
    touched = judged.filter("not kept or n_removed_lines > 0").groupBy(*KEYS).agg(  # repeated rows have the same verdict
        F.first("kept").alias("_kept"), F.first("removed_lines").alias("_removed")
    )
    names, schema, removed_name = docs.columns, docs.schema, "_removed"
    while removed_name in names:
        removed_name += "_"
    joined = wrapped(docs).join(touched, list(KEYS), "left").filter("_kept is null or _kept").select("_doc.*", F.col("_removed").alias(removed_name))

    def run(batches):
        for b in slices(batches):
            columns = {n: b.column(n) for n in names}
            texts, removed = columns["text"].to_pylist(), b.column(removed_name).to_pylist()
            texts = [t if not r else without_lines(t, set(r)) for t, r in zip(texts, removed, strict=True)]
            columns["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return joined.mapInArrow(run, schema)

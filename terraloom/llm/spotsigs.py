"""SpotSigs document fingerprints.

A spot signature is an anchor, a very common word, followed by a chain of the next two content words; content words are those
that are no anchors themselves. A document's fingerprint is the set of its signatures; a text without one has its whole word
sequence as the only signature. Fingerprints are shown as the size and a 128-bit digest of the set and compared by Jaccard
likeness.

``near_pairs`` finds all pairs of different sets with a likeness at or above a threshold. Sets are partitioned by length, so
that two like sets stand in the same or in neighbouring partitions; only the rarest signatures of a set are looked up (two like
sets share one of them); the lengths, and the position of the shared signature, prune a pair before its sets are compared.
``likeness`` compares two given sets, pruned to an exact zero or one where lengths or ranges decide.

Defined cases: a null text counts as the empty one; texts without words have an empty set, two empty sets are alike (1), an empty
and another set are not (0); repeated rows are documents of their own; a very long text is one row's work; an empty table gives
an empty result; a null doc_id stands last in the order of neighbours; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.llm.common import SpanHash, mixed, save, slices, utf8, word_bounds
from terraloom.session import cut_lineage

CHAIN = 2
THRESHOLD = 0.8
# anchors: very common words of the languages that the corpus may hold
ANCHORS = (
    "a an the is are was were be been to of in on and that this it for with as by at from have he she they not or but which had has will would there their "
    "der die das den dem des ein eine einer und ist nicht zu mit auf für von im sich auch es an wie als ich sie "
    "le la les un une des du de et est en que qui dans pour pas au sur par ce il elle ne se plus "
    "el los las una unos y es por con para como su al lo más del"
).split()


def _hash_of(words: list[str]) -> np.ndarray:
    raw = utf8(" ".join(words))
    start, stop = word_bounds(raw)
    return np.sort(SpanHash(raw)(start, stop))


_ANCHOR_HASHES = np.unique(_hash_of(ANCHORS))
_STRIP = bytes(b for b in range(128) if not chr(b).isalnum() and not chr(b).isspace())


def signatures(text: str | None) -> np.ndarray:
    """The sorted distinct signatures of one whole text: lower case, ASCII signs dropped, words cut at white space."""
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass").translate(None, _STRIP), dtype=np.uint8)
    start, stop = word_bounds(raw)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    words = SpanHash(raw)(start, stop)
    spot = np.minimum(np.searchsorted(_ANCHOR_HASHES, words), len(_ANCHOR_HASHES) - 1)
    is_anchor = _ANCHOR_HASHES[spot] == words
    content = words[~is_anchor]
    following = np.cumsum(~is_anchor)[is_anchor]  # content words up to an anchor: the index of the next one
    full = following + CHAIN <= len(content)
    if not full.any():
        whole = np.frombuffer(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), dtype="<u8")
        return whole.astype(np.uint64)
    value, following = words[is_anchor][full], following[full]
    for k in range(CHAIN):
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + content[following + k])
    return np.unique(value)


def shown(signs: np.ndarray) -> str:
    """A fingerprint as text: the number of signatures and a digest of the set."""
    return f"{len(signs)}:{hashlib.blake2b(signs.astype('<u8').tobytes(), digest_size=16).hexdigest()}"


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as the lengths rule ``floor`` out or the ranges do not meet."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if min(len(a), len(b)) < floor * max(len(a), len(b)) or a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


# --- neighbours and edits ----------------------------------------------------------------------


def edited(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by the first as many code points of another (or all of it)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id, text: str, following: str, cache: dict) -> tuple:
    changed = edited(text, following)
    own = cache.get("own") if cache.get("text") is text else signatures(text)
    changed_signs, next_signs = signatures(changed), signatures(following)
    cache.update(text=following, own=next_signs)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(changed_signs),
        likeness(own, changed_signs), likeness(own, next_signs),
    )


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in OUT.split(", ")]
PARTS = OUT + ", part int, head_id long, head string, tail string"


def with_neighbours(docs: DataFrame) -> DataFrame:
    """A row per document, compared with its edited text and with the next document by descending doc_id.

    The documents are range-partitioned by id and sorted inside the partitions; a partition gives its first and last text to a
    table with one row per partition, which links each partition's last document to the next partition's first one.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").desc_nulls_last()).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, head, cache = None, None, {}
        kinds = pa.schema([
            *[(n, pa.int64()) for n in NAMES[:2]], *[(n, pa.string()) for n in NAMES[2:5]], *[(n, pa.float64()) for n in NAMES[5:]],
            ("part", pa.int32()), ("head_id", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        ])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if held is None:
                    head = doc_id, text
                else:
                    rows.append((*_row(*held, text, cache), None, None, None, None))
                held = doc_id, text
            if rows:
                yield batch(rows)
        if held is not None:  # one row for the border: the last document waits for the next partition's first
            yield batch([(held[0], *[None] * 6, part, head[0], head[1], held[1])])

    rows = save(ordered.mapInArrow(run, PARTS))
    borders = rows.filter("part is not null")
    order = W.orderBy("part")  # a row for each partition
    borders = borders.select("doc_id", "tail", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("following"))

    def finish(batches):
        for b in batches:
            columns = [b.column(k).to_pylist() for k in range(3)]
            out = [_row(*x, {}) for x in zip(*columns, strict=True)]
            if out:
                kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], NAMES)

    return rows.filter("part is null").select(*NAMES).unionByName(borders.mapInArrow(finish, OUT))


# --- all like pairs -------------------------------------------------------------------------------


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, signs): the signature set of every document."""

    def run(batches):
        for b in slices(batches):
            signs = [signatures(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([shown(s) for s in signs]), pa.array([s.view(np.int64) for s in signs], pa.list_(pa.int64()))],
                ["doc_id", "fingerprint", "signs"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, signs array<long>")


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): the class of every document by equal fingerprints, and all pairs of classes that are alike."""
    rows = save(sets(docs))
    members = rows.select("doc_id", "fingerprint")
    distinct = rows.groupBy("fingerprint").agg(F.first("signs").alias("signs")).withColumn("n", F.size("signs")).filter("n > 0")
    distinct = cut_lineage(distinct)
    sign = distinct.select("fingerprint", "n", F.explode("signs").alias("sign"))
    frequency = sign.groupBy("sign").agg(F.count(F.lit(1)).alias("_df"))
    rank = W.partitionBy("fingerprint").orderBy("_df", "sign")
    prefix = sign.join(frequency, "sign").withColumn("at", F.row_number().over(rank))
    prefix = prefix.filter(F.col("at") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).filter("_df > 1")
    # length partitions: like sets differ by at most one step of this scale
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(-float(np.log(threshold)))).cast("int")
    prefix = prefix.select("sign", "fingerprint", "n", "at", step.alias("part"))
    other = prefix.select("sign", *[F.col(c).alias(f"{c}2") for c in ("fingerprint", "n", "at")], F.explode(F.array(F.col("part") - 1, "part", F.col("part") + 1)).alias("part"))
    fits = (F.col("n2") >= F.lit(threshold) * F.col("n")) & ((F.col("n2") > F.col("n")) | (F.col("fingerprint2") > F.col("fingerprint"))) & (F.col("n2") >= F.col("n"))
    fits = fits & (F.col("n") >= F.lit(threshold) * F.col("n2"))
    # the first common signature in this order is in both prefixes; from it on, so many can still be common
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) + 1
    fits = fits & (room >= F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n2")) - 1e-9)
    candidates = prefix.join(other, ["sign", "part"]).filter(fits).select("fingerprint", "fingerprint2").distinct()
    left = distinct.select("fingerprint", F.col("signs").alias("a"))
    right = distinct.select(F.col("fingerprint").alias("fingerprint2"), F.col("signs").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    both = candidates.join(left, "fingerprint").join(right, "fingerprint2").withColumn("_common", common)
    both = both.withColumn("near", F.col("_common") / (F.size("a") + F.size("b") - F.col("_common"))).filter(F.col("near") >= threshold)
    return members, both.select("fingerprint", "fingerprint2", "near")

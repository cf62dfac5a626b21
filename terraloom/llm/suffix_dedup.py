"""Removal of repeated byte strings with a sparse, range-partitioned suffix array.

Every byte that a string of ``length`` bytes covers which also starts anywhere else is removed, in the same document or another.

*Sampling without loss.* Each window of ``length`` bytes has one anchor: the place inside it where the hash of the next
``lead`` bytes is smallest (the leftmost on ties). Equal windows have their anchor at the same place, so only the suffixes
that begin at anchors need to be compared: about one byte in seventy. Neighbouring windows with the same anchor form a stretch.

*What needs no sorting.* An anchor whose leading bytes are unique in the corpus cannot lie in a repeated window and is dropped.
A stretch that occurs twice as a whole is repeated as a whole. Both are counts of hashes with map-side combine; equal stretches
meet under two 64-bit hashes. Leads and stretches that a large share of the rows hold are looked up by broadcast, the others by shuffle.

*Sorting.* Of the rest one example of each different stretch stays. Their suffixes are range-partitioned by their leading bytes,
with splitters that Spark samples; every bucket sorts its suffixes by multikey quicksort over 8-byte words. The common prefix with
the two neighbours bounds how far a window may reach to the right, which drops most windows at once; the others are compared among
the suffixes with the same lead. Suffixes with the same lead fall into the same bucket; where more than ``group_rows`` different
stretches share a lead they are not kept in a bucket but compared across all buckets, as counted window hashes.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; repeated rows repeat each other's bytes; equal
rows (same doc_id and text) are looked up by one 64-bit key; very long texts are cut into pieces of ``PIECE`` windows for the anchors,
never for the matches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from terraloom.functions.skew import join_by_weight, join_checked
from terraloom.llm.common import SpanHash, _BYTE_CODES, _power_tables, mixed, save, slices, utf8
from terraloom.session import cut_lineage

LENGTH = 400
LEAD = 256
PIECE = 1 << 19
GROUP_ROWS = 20_000
BUCKET_ROWS = 10_000
BLOCK = 1024
ROWS = "uid long, a int, b int, p int, lead long, stretch long"
SPANS = "uid long, start int, stop int"


# --- anchors --------------------------------------------------------------------------------


def anchors(raw: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> np.ndarray:
    """Columns a, b, p, lead hash, stretch hash: the windows starting at a..b have their anchor at p."""
    if len(raw) < length:
        return np.zeros((5, 0), dtype=np.int64)
    span, width = SpanHash(raw), length - lead + 1
    grams = span(np.arange(len(raw) - lead + 1), np.arange(lead, len(raw) + 1))
    out = []
    for first in range(0, len(raw) - length + 1, PIECE):
        windows = min(PIECE, len(raw) - length + 1 - first)
        n = windows + width - 1
        own = grams[first : first + n]
        keys = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        keys[:n] = (own & ~np.uint64(0xFFFFF)) | np.arange(n, dtype=np.uint64)  # the place breaks ties to the left
        blocks = keys.reshape(-1, width)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(backward[:windows], forward[width - 1 : width - 1 + windows])
        place = (least & np.uint64(0xFFFFF)).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1]) + 1
        a, b = np.concatenate([[0], change]) + first, np.concatenate([change, [windows]]) - 1 + first
        p = place[np.concatenate([[0], change])] + first
        out.append(np.stack([a, b, p, grams[p].view(np.int64), span(a, b + length).view(np.int64)]))
    return np.concatenate(out, axis=1)


def anchor_rows(docs: DataFrame, length: int, lead: int) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            found = [anchors(utf8(t), length, lead) for t in b.column("text").to_pylist()]
            columns = np.concatenate(found, axis=1)
            if columns.shape[1]:
                uid = np.repeat(b.column("uid").to_numpy(), [x.shape[1] for x in found])
                small = [pa.array(c.astype(np.int32)) for c in columns[:3]]
                yield pa.RecordBatch.from_arrays([pa.array(uid), *small, pa.array(columns[3]), pa.array(columns[4])], ["uid", "a", "b", "p", "lead", "stretch"])

    return docs.select("uid", "text").mapInArrow(run, ROWS)


# --- local sort and comparison --------------------------------------------------------------------


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows by their 64-bit words: three-way partitions by one word at a time."""
    order = []
    stack = [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= 1 or depth == words.shape[1]:
            order.append(rows)
        elif len(rows) <= 48:
            order.append(rows[np.lexsort(words[rows, depth:].T[::-1])])
        else:
            keys = words[rows, depth]
            pivot = np.sort(keys[[0, len(keys) // 2, -1]])[1]
            low, high = keys < pivot, keys > pivot
            stack += [(rows[high], depth), (rows[~low & ~high], depth + 1), (rows[low], depth)]
    return np.concatenate(order) if order else np.zeros(0, dtype=np.int64)


def _aligned(lefts: list[bytes], rights: list[bytes], width: int, length: int) -> np.ndarray:
    """Stretches as rows of bytes with the anchors in one column; zeros fill both ends."""
    out = np.zeros((len(lefts), width - 1 + length), dtype=np.uint8)
    for k, (left, right) in enumerate(zip(lefts, rights, strict=True)):
        out[k, width - 1 - len(left) : width - 1 + len(right)] = np.frombuffer(left + right, dtype=np.uint8)
    return out


def window_values(table: np.ndarray, width: int, length: int) -> np.ndarray:
    """Hash of every window, by row and by place of its start (column 0 starts width - 1 bytes before the anchor)."""
    powers, _ = _power_tables(table.shape[1] + 1)
    sums = np.zeros((len(table), table.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_BYTE_CODES[table] * powers[: table.shape[1]], axis=1, out=sums[:, 1:])
    return mixed(sums[:, length : length + width] - sums[:, :width] + np.arange(width, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def compare_bucket(uid: np.ndarray, a: np.ndarray, lefts: list[bytes], rights: list[bytes], length: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (uid, start, stop) of the windows that two stretches of the bucket share."""
    width, n = length - lead + 1, len(uid)
    pad = -length % 8
    suffix = np.zeros((n, length + pad), dtype=np.uint8)
    for k, right in enumerate(rights):
        suffix[k, : len(right)] = np.frombuffer(right, dtype=np.uint8)
    order = multikey_order(suffix.view(">u8").astype(np.uint64))
    common = np.zeros(n + 1, dtype=np.int64)  # of each suffix with the one before
    for at in range(1, n, BLOCK):
        differ = suffix[order[at : at + BLOCK]] != suffix[order[at - 1 : min(n, at + BLOCK) - 1]]
        common[at : at + len(differ)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    group = np.cumsum(common[:n] < lead)
    reach = np.maximum(common[:n], common[1:])  # no window that reaches further right is shared
    values, rows, places = [], [], []
    for at in range(0, n, BLOCK):
        part = order[at : at + BLOCK]
        left, right = [lefts[k] for k in part], [rights[k] for k in part]
        before, after = np.array([len(x) for x in left]), np.array([len(x) for x in right])
        place = np.arange(width)[None, :]
        ends = place - (width - 1) + length  # right of the anchor
        inside = (place >= (width - 1 - before)[:, None]) & (ends <= after[:, None]) & (ends <= reach[at : at + BLOCK, None])
        found = window_values(_aligned(left, right, width, length), width, length)
        i, j = np.nonzero(inside)
        values.append(mixed(found[i, j] ^ (group[at + i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))
        rows.append(part[i])
        places.append(a[part[i]] + j - (width - 1 - before[i]))
    if not values:
        return uid[:0], a[:0], a[:0]
    values, rows, places = np.concatenate(values), np.concatenate(rows), np.concatenate(places)
    by = np.argsort(values, kind="stable")
    same = values[by][1:] == values[by][:-1]
    again = np.zeros(len(values), dtype=bool)
    again[by[1:][same]] = again[by[:-1][same]] = True
    rows, places = rows[again], places[again]
    by = np.lexsort([places, rows])
    rows, places = rows[by], places[by]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (places[1:] != places[:-1] + 1)])[: len(rows)]
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(rows)]])[: len(first)] - 1
    return uid[rows[first]], places[first], places[last] + length


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans, as maximal runs."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            if stop > out[-1][1]:
                out[-1] = out[-1][0], stop
        else:
            out.append((start, stop))
    return out


# --- Spark steps ------------------------------------------------------------------------------


def packed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, packed): the texts as compressed bytes, for the two joins by document."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in slices(batches):
            data = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(data, pa.binary())], ["uid", "doc_id", "packed"])

    return docs.select("uid", "doc_id", "text").mapInArrow(run, "uid long, doc_id long, packed binary")


def _suffixes(with_text: DataFrame, length: int) -> DataFrame:
    """One row per compared stretch: the bytes from its anchor on and those before it."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, "packed", rows=64):
            rows = []
            for uid, data, places in zip(*[b.column(c).to_pylist() for c in ("uid", "packed", "places")], strict=True):
                raw = open_(data)
                rows += [(uid, x["a"], x["giant"], raw[x["a"] : x["p"]], raw[x["p"] : x["b"] + length]) for x in places]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["uid", "a", "giant", "before", "suffix"])

    return with_text.mapInArrow(run, "uid long, a int, giant boolean, before binary, suffix binary")


def _compare(rows: DataFrame, length: int, lead: int) -> DataFrame:
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            uid, a = t.column("uid").to_numpy(), t.column("a").to_numpy().astype(np.int64)
            out = compare_bucket(uid, a, t.column("before").to_pylist(), t.column("suffix").to_pylist(), length, lead)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32))], ["uid", "start", "stop"])

    return rows.mapInArrow(run, SPANS)


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """Every window of the stretches under two hashes, for leads that too many stretches share."""

    def run(batches):
        for b in slices(batches, "suffix", rows=256):
            for uid, a, before, suffix in zip(*[b.column(c).to_pylist() for c in ("uid", "a", "before", "suffix")], strict=True):
                raw = before + suffix
                starts = np.arange(len(raw) - length + 1)
                one = SpanHash(np.frombuffer(raw, dtype=np.uint8))(starts, starts + length)
                two = [int.from_bytes(hashlib.blake2b(raw[s : s + length], digest_size=8).digest(), "little", signed=True) for s in starts.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), uid)), pa.array((a + starts).astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two, pa.int64())],
                    ["uid", "start", "h1", "h2"],
                )

    return rows.mapInArrow(run, "uid long, start int, h1 long, h2 long")


def _present(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Rows whose key is in ``keys``, which holds each key once with its number of rows; those of a frequent key are dealt out over many tasks."""
    found = join_by_weight(rows, keys.select(*on, weight, F.col(weight).alias("_present")), on, weight, rows.count())
    return found.filter("_present is not null").drop("_present")


def repeated_spans(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS, texts: DataFrame | None = None) -> DataFrame:
    """(uid, start, stop): spans of documents (with ``uid``) whose union is every byte of a repeated window."""
    texts = packed(docs) if texts is None else texts
    rows = save(anchor_rows(docs, length, lead))
    often = cut_lineage(rows.groupBy("lead").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    some = save(_present(rows, often, ["lead"], "_n"))
    kinds = some.groupBy("lead", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "a", "b", "p")).alias("one"))
    kinds = cut_lineage(kinds)
    whole = _present(some, kinds.filter("n > 1"), ["lead", "stretch"], "n")
    whole = whole.select("uid", F.col("a").alias("start"), (F.col("b") + F.lit(length)).cast("int").alias("stop"))
    shared = cut_lineage(kinds.groupBy("lead").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1"))
    sized = join_by_weight(kinds, shared.withColumn("giant", F.col("_kinds") > group_rows), ["lead"], "_kinds", kinds.count())
    compared = sized.filter("giant is not null").select("one.*", "giant")
    places = cut_lineage(compared.groupBy("uid").agg(F.collect_list(F.struct("a", "b", "p", "giant")).alias("places")))  # at most a document's anchors
    total, giants = places.agg(F.sum(F.size("places")), F.max(F.exists("places", lambda x: x["giant"]))).first()
    if not total:
        return whole
    suffixes = save(_suffixes(texts.select("uid", "packed").join(places, "uid"), length))
    buckets = max(1, -(-total // bucket_rows))
    ordered = suffixes.filter("not giant").repartitionByRange(buckets, F.substring("suffix", 1, lead))
    spans = whole.unionByName(_compare(ordered, length, lead))
    if giants:
        windows = save(_windows(suffixes.filter("giant"), length))
        twice = cut_lineage(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
        found = _present(windows, twice, ["h1", "h2"], "_n")
        spans = spans.unionByName(found.select("uid", "start", (F.col("start") + F.lit(length)).cast("int").alias("stop")))
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("uid", F.xxhash64("doc_id", "text"))


def without_repeats(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document's remaining bytes."""
    return _cut(docs, length, lead, False, **options)


def digests(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): the same with a digest of the remaining bytes."""
    return _cut(docs, length, lead, True, **options)


def _cut(docs: DataFrame, length: int, lead: int, digest: bool, **options) -> DataFrame:
    rows = keyed(docs)
    # rows that stand there more than once are worked on once: all their windows are repeated, and so is the whole text
    repeats = cut_lineage(rows.groupBy("uid").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1"))
    again = not repeats.isEmpty()
    if again:
        one = join_checked(rows, repeats.select("uid"), ["uid"]).dropDuplicates(["uid"])
        rows = join_checked(rows, repeats.select("uid"), ["uid"], "left_anti").unionByName(one)
    spans = repeated_spans(rows, length, lead, **options)
    if again:
        size = F.octet_length("text").cast("int")
        whole = one.filter(size >= length).select("uid", F.lit(0).alias("start"), size.alias("stop"))
        spans = spans.unionByName(whole)
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # at most a few for each of a document's anchors
    last = ("kept_sha256", pa.string()) if digest else ("kept", pa.binary())

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        for b in slices(batches, "packed", rows=256):
            out = []
            for data, found in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = open_(data)
                runs = merged([(x["start"], x["stop"]) for x in found or []])
                at, parts = 0, []
                for start, stop in runs:
                    parts.append(raw[at:start])
                    at = stop
                kept = b"".join([*parts, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [last[1]], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", last[0]])

    joined = packed(rows).join(spans, "uid", "left")
    ddl = f"doc_id long, n_bytes long, n_removed long, n_spans long, {last[0]} {'string' if digest else 'binary'}"
    if not again:
        return joined.select("doc_id", "packed", "spans").mapInArrow(run, ddl)
    counted = join_checked(joined, repeats, ["uid"], "left").select("doc_id", "packed", "spans", F.coalesce("_rows", F.lit(1)).alias("_rows"))
    single = counted.filter("_rows = 1").select("doc_id", "packed", "spans").mapInArrow(run, ddl)
    names = [c.split()[0] for c in ddl.split(", ")]
    # the number of repeats goes along as a further id
    many = counted.filter("_rows > 1").select(F.struct("doc_id", "_rows").alias("doc_id"), "packed", "spans")
    done = many.mapInArrow(run, ddl.replace("doc_id long", "doc_id struct<doc_id:bigint,_rows:bigint>"))
    each = done.select(F.col("doc_id.doc_id").alias("doc_id"), *names[1:], F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("doc_id._rows"))))
    return single.unionByName(each.select(*names))

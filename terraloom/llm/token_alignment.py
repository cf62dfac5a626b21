"""Alignment of two tokenizers: groups of tokens that end together, links between tokens that overlap, and how common a link is.

Fragments of byte ranges form a monoid. A fragment holds the tokens before its first common end (open prefix), the closed groups
between its first and last common end, and the tokens behind it (open suffix); ``compose`` joins the suffix of one with the prefix
of the next into a group. A text of up to ``CHUNK`` bytes is one fragment, computed where it is read. A longer text is cut at
fixed byte positions into ranges that are dealt over the tasks. A range is encoded with a few words around it, from one place
where no token of either vocabulary crosses (a space between two visible characters) to another, and keeps the tokens that end
in it; where no such place lies between two positions, the ranges are one. A tree of compositions with ``FAN_IN`` fragments a node
joins the ranges of a text; a node carries open ends and border groups only, never the closed groups.

Links: the end positions of both encodings cut a text into stretches; each stretch is one overlapping pair of tokens. The number of
documents of a pair comes from dictionaries of blocks of documents, each pair once a block, so a pair that stands in every
document is a row per block, not per document; frequent pairs of dictionaries are broadcast (``join_by_weight`` bounds their
number), the others shuffle. Texts of many ranges count a pair once by a distinct (document, pair). A second pass reads the stored pairs, not the texts.

Defined cases: null and empty texts, and texts whose bytes the tokens do not give back, have no tokens: zeros and '' as digest.
Repeated rows count as documents of their own; null ids stay; an empty table gives an empty table; other columns are ignored.
Words between lone spaces are encoded once and looked up after that; a worker keeps the ids of at most ``KEPT_WORDS`` words and a slice's.
Memory of a task: these words, a slice of texts or the longest stretch without a cut, and a block's dictionary of about ``BLOCK_PAIRS`` pairs or
``BLOCK_BYTES`` characters.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.functions.skew import join_by_weight
from terraloom.llm import vocabularies as V
from terraloom.llm.common import save, slices
from terraloom.llm.token_counts import packed

CHUNK = 65_536  # bytes of a range
FAN_IN = 16
BLOCK_PAIRS = 200_000
BLOCK_BYTES = 8 << 20
SLICE = 1 << 20
BATCH = 128 << 10
KEPT_WORDS = 400_000  # of a worker, and those of one slice
KEPT_CHARACTERS = 8 << 20
KEPT_LENGTH = 64
B_IDS = 1 << 24  # a pair is one number: id of A times this, plus id of B

KEY = ["k1", "k2"]
SHORT = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, "
         "place array<int>, times array<int>, pairs array<long>, n_docs array<int>")
RANGE = "k1 long, k2 long, part int, low long, high long, base long, window string, first boolean, last boolean"
ENDS = "pre_a array<int>, pre_a_end array<long>, pre_b array<int>, pre_b_end array<long>, suf_a array<int>, suf_a_end array<long>, suf_b array<int>, suf_b_end array<long>"
BORDERS = "border_part array<int>, border_text array<string>, border_pairs array<array<long>>"
FRAGMENT = f"k1 long, k2 long, part int, valid boolean, cut boolean, first_cut int, n_a long, n_b long, n_groups long, n_links long, {ENDS}, {BORDERS}"


class Tokens(NamedTuple):
    """Ids and end offsets in bytes of one tokenizer's tokens."""

    ids: np.ndarray
    ends: np.ndarray

    def where(self, mask: np.ndarray) -> Tokens:
        return Tokens(self.ids[mask], self.ends[mask])

    def then(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))


NONE = Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64))


class Fragment(NamedTuple):
    cut: bool = False  # whether a common end (or the start of the text) lies in it
    first_cut: int = -1  # the range of the first one
    prefix: tuple[Tokens, Tokens] = (NONE, NONE)
    suffix: tuple[Tokens, Tokens] = (NONE, NONE)
    counts: tuple[int, int, int, int] = (0, 0, 0, 0)  # tokens of A and of B that end in it, groups, links
    borders: tuple[tuple[int, str, list[int]], ...] = ()  # (range behind it, text, pairs) of groups closed by composing
    valid: bool = True


def compose(f: Fragment, g: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges; associative, with ``Fragment()`` as the neutral element."""
    between = (f.suffix[0].then(g.prefix[0]), f.suffix[1].then(g.prefix[1])) if f.cut else (f.prefix[0].then(g.prefix[0]), f.prefix[1].then(g.prefix[1]))
    counts = np.add(f.counts, g.counts)
    borders = f.borders + g.borders
    prefix, suffix = f.prefix, g.suffix
    if f.cut and g.cut:
        if len(between[0].ids):
            pairs = links(*between)[0].tolist()
            borders = (*f.borders, (g.first_cut, f"{_ids(between[0].ids)}|{_ids(between[1].ids)}", pairs), *g.borders)
            counts = counts + (0, 0, 1, len(pairs))
    elif f.cut:
        suffix = between
    else:
        prefix = between
    return Fragment(f.cut or g.cut, f.first_cut if f.cut else g.first_cut, prefix, suffix, tuple(int(x) for x in counts), borders, f.valid and g.valid)


def _ids(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def links(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of two encodings of the same bytes, in order, and the end of each one's overlap."""
    ends = np.union1d(a.ends, b.ends)
    return a.ids[np.searchsorted(a.ends, ends)] * B_IDS + b.ids[np.searchsorted(b.ends, ends)], ends


class Segments(NamedTuple):
    """Stretches of bytes, each covered by whole tokens of both sides; n_* and texts have one entry for each."""

    n_groups: np.ndarray
    n_links: np.ndarray
    texts: list[str]
    pairs: np.ndarray  # of all stretches in order
    owner: np.ndarray  # the stretch of each pair


@functools.lru_cache(maxsize=4)
def _spelled(n: int, inner: str, last: str) -> np.ndarray:
    return np.array([f"{i}{inner}" for i in range(n)] + [f"{i}{last}" for i in range(n)], dtype=object)


def segments(a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> Segments:
    """Groups and links of many stretches at once; ``a_size`` and ``b_size`` hold the bytes of every id."""
    count = len(a)
    ids_a, ids_b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
    n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    end_a, end_b = np.cumsum(a_size[ids_a]), np.cumsum(b_size[ids_b])
    total = int(end_a[-1]) if len(end_a) else 0
    ends = np.concatenate([[0], end_a])[np.cumsum(n_a)]  # of the stretches
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_a[end_a] = is_b[end_b] = True
    common = is_a & is_b
    before_a, before_b, before_cut = (np.cumsum(x, dtype=np.int32) for x in (is_a, is_b, common))
    at, cuts = np.flatnonzero(is_a | is_b), np.flatnonzero(common)
    pairs = ids_a[before_a[at] - is_a[at]] * B_IDS + ids_b[before_b[at] - is_b[at]]
    owner = np.searchsorted(ends, at)
    group_a, group_b = before_cut[end_a] - common[end_a], before_cut[end_b] - common[end_b]
    a_until, b_until = before_a[cuts], before_b[cuts]
    spelled = np.empty(len(ids_a) + len(ids_b), dtype=object)
    spelled[np.arange(len(ids_a)) + np.concatenate([[0], b_until])[group_a]] = _spelled(len(a_size), ",", "|")[ids_a + len(a_size) * common_last(group_a)]
    spelled[np.arange(len(ids_b)) + a_until[group_b]] = _spelled(len(b_size), ",", ";")[ids_b + len(b_size) * common_last(group_b)]
    spelled = spelled.tolist()
    stops = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    return Segments(
        np.bincount(np.searchsorted(ends, cuts), minlength=count), np.bincount(owner, minlength=count),
        ["".join(spelled[i:j])[:-1] for i, j in zip(stops, stops[1:], strict=False)], pairs, owner,
    )


def common_last(group: np.ndarray) -> np.ndarray:
    """Which tokens are the last of their group."""
    last = np.ones(len(group), bool)
    last[:-1] = group[1:] != group[:-1]
    return last


class Encoders:
    """Both vocabularies in one Python worker, with the ids of the words of the last slices."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = V.byte_level(a, False), V.pieces(b)
        self.a_bytes, self.b_bytes = V.byte_level_bytes(a), V.piece_bytes(b)
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.by_words = V.cuts_at_words(a) and V.cuts_at_spaces(b)
        self.known: dict[str, int] = {}  # place of a word in the tables
        self.sound, self.hits = np.zeros(0, bool), np.zeros(0, np.int64)
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.characters = 0

    def _forget(self) -> None:
        """Keep the half of the words that was met most often, long ones aside."""
        words = list(self.known)
        often = np.argsort(-self.hits, kind="stable")[: KEPT_WORDS // 2].tolist()
        kept = np.array([i for i in often if len(words[i]) <= KEPT_LENGTH], np.int64)
        for side in range(2):
            spread, ends = self._spread(side, kept)
            self.ids[side], self.starts[side] = spread, ends
        self.sound, self.hits = self.sound[kept], self.hits[kept] // 2
        self.known = {words[i]: k for k, i in enumerate(kept.tolist())}
        self.characters = sum(map(len, self.known))

    def _spread(self, side: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of one side of the words at these places, and where each word's ids begin and end."""
        starts, ids = self.starts[side], self.ids[side]
        size = starts[places + 1] - starts[places]
        ends = np.concatenate([[0], np.cumsum(size)])
        return ids[np.arange(ends[-1]) + np.repeat(starts[places] - ends[:-1], size)], ends

    def _learn(self, words: list[str]) -> None:
        coded = self.whole(words)
        self.sound = np.concatenate([self.sound, np.array([x is not None for x in coded], bool)])
        for side in range(2):
            found = [x[side] if x is not None else NONE.ids for x in coded]
            ends = self.starts[side][-1] + np.cumsum(np.array([len(x) for x in found], np.int64))
            self.starts[side] = np.concatenate([self.starts[side], ends])
            self.ids[side] = np.concatenate([self.ids[side], *found]).astype(np.int32)
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.characters += sum(map(len, words))

    def encode(self, windows: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for windows that begin with a space; None where the tokens do not give the bytes back.

        Neither side has a token across a lone space, so a window's ids are those of its words, and each word is encoded once.
        A window with a word that does not come back is encoded whole: what is lost at one word may come back at another.
        """
        if not self.by_words or not windows:
            return self.whole(windows)
        if len(self.known) >= KEPT_WORDS or self.characters >= KEPT_CHARACTERS:
            self._forget()
        cut = list(map(V.BEFORE_LONE_SPACE.findall, windows))
        new = list(set(itertools.chain.from_iterable(cut)).difference(self.known))
        if new:
            self._learn(new)
        places = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(cut)), np.int64)
        words = np.concatenate([[0], np.cumsum([len(x) for x in cut])])
        self.hits += np.bincount(places, minlength=len(self.hits))
        sides = []
        for side in range(2):
            spread, ends = self._spread(side, places)
            sides.append(np.split(spread.astype(np.int64), ends[words[1:-1]]))
        out = list(zip(*sides, strict=True))
        unsound = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(~self.sound[places])])[words])).tolist()
        for k, ids in zip(unsound, self.whole([windows[k] for k in unsound]), strict=True):
            out[k] = ids
        return out

    def whole(self, windows: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The same with every window encoded as it is."""
        out = []
        for start, stop in packed([len(w) for w in windows], BATCH):  # the library's own results are large
            part = windows[start:stop]
            for a, b, window in zip(
                self.a.encode_batch_fast(part, add_special_tokens=False), self.b.encode([w[1:] for w in part], num_threads=1), part, strict=True
            ):
                raw, ids = window.encode(), a.ids
                same = b"".join(map(self.a_bytes.__getitem__, ids)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
                out.append((np.array(ids, np.int64), np.array(b, np.int64)) if same else None)
        return out


@functools.lru_cache(maxsize=2)
def encoders(a: bytes, b: bytes) -> Encoders:
    return Encoders(a, b)


class Dictionary:
    """Pairs of a block in the order of their first appearance, with the number of its documents that hold each."""

    def __init__(self):
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)  # sorted pairs and their places
        self.docs = np.zeros(0, np.int64)

    def add(self, found: Segments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, places, times) of the distinct pairs of each document."""
        unique, inverse = np.unique(found.pairs, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        place = np.empty(len(unique), np.int64)
        place[~new] = self.place[at[~new]]
        place[new] = len(self.known) + np.arange(new.sum())
        self.place = np.insert(self.place, at[new], place[new])
        self.known = np.insert(self.known, at[new], unique[new])
        key, times = np.unique(found.owner * (len(self.known) + 1) + place[inverse], return_counts=True)
        owner, places = np.divmod(key, len(self.known) + 1)
        self.docs = np.concatenate([self.docs, np.zeros(len(self.known) - len(self.docs), np.int64)]) + np.bincount(places, minlength=len(self.known))
        return owner, places, times

    def in_order(self) -> np.ndarray:
        out = np.empty(len(self.known), np.int64)
        out[self.place] = self.known
        return out


def _lists(values: np.ndarray, owner: np.ndarray, rows: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _short(docs: DataFrame, shipped: tuple[V.Shipped, V.Shipped], block_pairs: int) -> DataFrame:
    """A row per text with its counts, digest and places in the dictionary of its block, and a row per block with the dictionary."""
    names = [x.split()[0] for x in SHORT.split(", ")]

    def closing(block: int, pairs: Dictionary) -> pa.RecordBatch:
        row = dict.fromkeys(names) | {"block": block, "pairs": pairs.in_order(), "n_docs": pairs.docs}
        return pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([
        ("block", pa.int64()), ("doc_id", pa.int64()), *[(x, pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")], ("digest", pa.string()),
        ("place", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int32())),
    ])

    def run(batches):
        e, block, pairs = encoders(*[x.content.value for x in shipped]), TaskContext.get().partitionId() << 32, Dictionary()
        size = 0
        for b in slices(batches, size=SLICE, rows=2048):
            texts = b.column("text").to_pylist()
            filled = [i for i, t in enumerate(texts) if t]
            ids = dict(zip(filled, e.encode([" " + texts[i] for i in filled]), strict=True))
            none = np.zeros(0, np.int64)
            rows = [ids.get(i) or (none, none) for i in range(len(texts))]
            found = segments([a for a, _ in rows], [b for _, b in rows], e.a_size, e.b_size)
            owner, places, times = pairs.add(found)
            empty = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(rows), pa.int64()), b.column("doc_id"), pa.array([len(a) for a, _ in rows], pa.int64()), pa.array([len(b) for _, b in rows], pa.int64()),
                pa.array(found.n_groups, pa.int64()), pa.array(found.n_links, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.texts]),
                _lists(places, owner, len(rows), pa.int32()), _lists(times, owner, len(rows), pa.int32()), empty.cast(pa.list_(pa.int64())), empty.cast(pa.list_(pa.int32())),
            ], names)
            size += sum(len(t) for t in texts if t)
            if len(pairs.known) >= block_pairs or size >= BLOCK_BYTES:
                yield closing(block, pairs)
                block, pairs, size = block + 1, Dictionary(), 0
        if len(pairs.known):
            yield closing(block, pairs)

    return docs.mapInArrow(run, SHORT)


def ranges(text: str, chunk: int = CHUNK) -> list[tuple[int, int, int, int, str, bool, bool]]:
    """(number, first byte, last byte, byte of the window, window, first, last): the byte ranges of space + text and what to encode for each."""
    whole = " " + text
    borders, safe = [0], [(0, 0)]  # in characters; the safe places around each border
    for at in range(chunk, len(whole), chunk):
        before = V.lone_space_before(whole, borders[-1] + 1, at + 1)
        if before > 0:
            borders.append(at)
            safe.append((before, V.lone_space_after(whole, at + 1)))
    borders.append(len(whole))
    safe.append((len(whole), len(whole)))
    out, done, byte = [], 0, 0
    for k in range(len(borders) - 1):
        start = safe[k][0]
        byte += len(whole[done:start].encode())
        done = start
        low = byte + len(whole[start:borders[k]].encode())
        high = byte + len(whole[start:borders[k + 1]].encode())
        out.append((k, low, high, byte, whole[start:safe[k + 1][1]], k == 0, k == len(borders) - 2))
    return out


def _ranges(docs: DataFrame, chunk: int) -> DataFrame:
    def run(batches):
        schema = _arrow(RANGE)
        for b in slices(batches):
            for k1, k2, text in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "text")], strict=True):
                for r in ranges(text, chunk):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (k1, k2, *r), strict=True))], schema)

    return docs.select(*KEY, "text").mapInArrow(run, RANGE)


def fragment(a: Tokens, b: Tokens, part: int, low: int, high: int, first: bool) -> tuple[Fragment, np.ndarray, np.ndarray]:
    """The fragment of the tokens that end in (low, high], still without its closed groups, whose ids of both sides come with it."""
    a, b = (t.where((t.ends > low) & (t.ends <= high)) for t in (a, b))
    common = np.intersect1d(a.ends, b.ends)
    begin = 0 if first else common[0] if len(common) else None
    if begin is None:
        return Fragment(False, -1, (a, b), (NONE, NONE), (len(a.ids), len(b.ids), 0, 0)), NONE.ids, NONE.ids
    end = common[-1] if len(common) else begin
    return (
        Fragment(True, part, *[tuple(t.where(mask(t.ends)) for t in (a, b)) for mask in (lambda x: x <= begin, lambda x: x > end)], (len(a.ids), len(b.ids), 0, 0)),
        *[t.ids[(t.ends > begin) & (t.ends <= end)] for t in (a, b)],
    )


def _row(k1: int, k2: int, part: int, f: Fragment) -> dict:
    out = {"k1": k1, "k2": k2, "part": part, "valid": f.valid, "cut": f.cut, "first_cut": f.first_cut, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), f.counts, strict=True))}
    for side, tokens in (("pre", f.prefix), ("suf", f.suffix)):
        for name, t in zip("ab", tokens, strict=True):
            out |= {f"{side}_{name}": t.ids.tolist(), f"{side}_{name}_end": t.ends.tolist()}
    return out | {"border_part": [x[0] for x in f.borders], "border_text": [x[1] for x in f.borders], "border_pairs": [x[2] for x in f.borders]}


def _fragment(r) -> Fragment:
    tokens = {f"{s}_{n}": Tokens(np.array(r[f"{s}_{n}"], np.int64), np.array(r[f"{s}_{n}_end"], np.int64)) for s in ("pre", "suf") for n in "ab"}
    borders = tuple((int(p), t, [int(x) for x in pairs]) for p, t, pairs in zip(r["border_part"], r["border_text"], r["border_pairs"], strict=True))
    counts = tuple(int(r[c]) for c in ("n_a", "n_b", "n_groups", "n_links"))
    return Fragment(bool(r["cut"]), int(r["first_cut"]), (tokens["pre_a"], tokens["pre_b"]), (tokens["suf_a"], tokens["suf_b"]), counts, borders, bool(r["valid"]))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    return pa.schema([(c.split()[0], kind(c.split()[1])) for c in ddl.split(", ")])


def _fragments(parts: DataFrame, shipped: tuple[V.Shipped, V.Shipped]) -> DataFrame:
    """The fragment of every range, the text of its closed groups and their distinct pairs."""
    ddl = f"{FRAGMENT}, text string, pairs array<long>, times array<int>"

    def run(batches):
        e, schema = encoders(*[x.content.value for x in shipped]), _arrow(ddl)
        for b in slices(batches, "window", size=SLICE):
            rows, made, closed = b.to_pylist(), [], []
            for r, ids in zip(rows, e.encode([r["window"] for r in rows]), strict=True):
                if ids is None:
                    made.append(Fragment(valid=False))
                    closed.append((NONE.ids, NONE.ids))
                    continue
                a, b_ = Tokens(ids[0], r["base"] + np.cumsum(e.a_size[ids[0]])), Tokens(ids[1], r["base"] + np.cumsum(e.b_size[ids[1]]))
                f, *inside = fragment(a, b_, r["part"], r["low"], r["high"], r["first"])
                made.append(f)
                closed.append(tuple(inside))
            found = segments([a for a, _ in closed], [b for _, b in closed], e.a_size, e.b_size)
            out = []
            for k, (r, f) in enumerate(zip(rows, made, strict=True)):
                pairs, times = np.unique(found.pairs[found.owner == k], return_counts=True)
                f = f._replace(counts=(*f.counts[:2], int(found.n_groups[k]), int(found.n_links[k])))
                out.append(_row(r["k1"], r["k2"], r["part"], f) | {"text": found.texts[k], "pairs": pairs, "times": times})
            yield pa.RecordBatch.from_pylist(out, schema)

    return parts.mapInArrow(run, ddl)


def reduced(fragments: DataFrame, parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """One fragment for each text: ``fan_in`` neighbours are composed at a time until one is left."""

    def node(keys, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values("part")
        f = functools.reduce(compose, [_fragment(r) for r in ordered.to_dict("records")])
        return pd.DataFrame([_row(keys[0], keys[1], keys[2], f)])

    while parts > 1:
        fragments = save(fragments.groupBy(*KEY, F.expr(f"part div {fan_in}").cast("int").alias("node")).applyInPandas(node, FRAGMENT))
        parts = -(-parts // fan_in)
    return fragments


def _digests(texts: DataFrame) -> DataFrame:
    """SHA-256 of the texts of each key, joined by semicolons in order; a key's texts stream by, none is collected."""

    def run(batches):
        key, state, begun = None, None, False
        for b in batches:
            out = []
            for k1, k2, text in zip(*[b.column(c).to_pylist() for c in (*KEY, "text")], strict=True):
                if key != (k1, k2):
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state, begun = (k1, k2), hashlib.sha256(), False
                if text:
                    state.update((";" + text if begun else text).encode())
                    begun = True
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "digest"), r, strict=True)) for r in out], _arrow("k1 long, k2 long, digest string"))
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "digest"), (*key, state.hexdigest()), strict=True))], _arrow("k1 long, k2 long, digest string"))

    ordered = texts.repartition(*KEY).sortWithinPartitions(*KEY, "part", "order").select(*KEY, "text")
    return ordered.mapInArrow(run, "k1 long, k2 long, digest string")


def _sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``n_best`` and ``count_sum`` of rows by the dictionary of their block, which comes first in the block's rows."""
    kept = _arrow(", ".join(f"{c} {t}" for c, t in rows.select(*columns).dtypes).replace("bigint", "long"))

    def run(batches):
        totals = best = np.zeros(0, np.int64)
        for batch in batches:
            for b in _by_dictionary(batch):
                if b.column("is_dictionary")[0].as_py():
                    totals, best = (b.column(c).flatten().to_numpy() for c in ("totals", "best"))
                    continue
                place, times = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("place", "times"))
                ends = np.concatenate([[0], np.cumsum(b.column("place").value_lengths().fill_null(0).to_numpy())])
                sums = [np.concatenate([[0], np.cumsum(x[place] * times)])[ends] for x in (best, totals)]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in columns], *[pa.array(np.diff(s), pa.int64()) for s in sums]], [*columns, "n_best", "count_sum"]
                )

    ddl = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in kept)
    return rows.repartition("block").sortWithinPartitions("block", F.desc("is_dictionary")).mapInArrow(run, f"{ddl}, n_best long, count_sum long")


def _by_dictionary(batch: pa.RecordBatch):
    marks = batch.column("is_dictionary").to_numpy(zero_copy_only=False)
    start = 0
    for at in [*np.flatnonzero(marks), len(marks)]:
        if at > start:
            yield batch.slice(start, at - start)
        if at < len(marks):
            yield batch.slice(at, 1)
        start = at + 1


def align(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk: int = CHUNK, fan_in: int = FAN_IN, block_pairs: int = BLOCK_PAIRS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text."""
    spark = docs.sparkSession
    shipped = V.Shipped(spark, path_a or V.published(V.BYTE_LEVEL_FILE)), V.Shipped(spark, path_b or V.published(V.PIECE_FILE))
    if not V.cuts_at_spaces(shipped[1].content.value):
        raise ValueError("a piece with a space inside: texts cannot be cut at spaces")
    rows = docs.select("doc_id", "text")
    is_long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = save(_short(rows.filter(~is_long), shipped, block_pairs))

    # long texts: rows with equal id and text are encoded once
    long = rows.filter(is_long).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1), "doc_id")})
    parts = save(_fragments(_ranges(long, chunk).dropDuplicates([*KEY, "part"]), shipped))
    n_parts = parts.agg(F.max("part")).first()[0]
    place, docs_of = short.filter("pairs is not null"), ["pair", "n_docs"]
    entries = place.select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("place", "_e")).select("block", "place", F.col("_e.pairs").alias("pair"), F.col("_e.n_docs").cast("long").alias("n_docs"))
    rows_of = short.filter("pairs is null").select("block", "place", "times", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest")
    held = entries.select(*docs_of)
    if n_parts is not None:
        repeats = long.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("repeats"))
        roots = reduced(parts.select(*[c.split()[0] for c in FRAGMENT.split(", ")]), n_parts + 1, fan_in)
        valid = save(roots.join(repeats, KEY).select(*KEY, "doc_id", "repeats", "valid", "n_a", "n_b", "n_groups", "n_links", "border_part", "border_text", "border_pairs"))
        good = valid.filter("valid")
        border = good.select(*KEY, "repeats", F.explode(F.flatten("border_pairs")).alias("pair"))
        inner = parts.join(good.select(*KEY, "repeats"), KEY)
        spread = inner.select(*KEY, "repeats", F.explode("pairs").alias("pair")).unionByName(border)
        held = held.unionByName(spread.groupBy(*KEY, "pair").agg(F.max("repeats").alias("n_docs")).select(*docs_of))
        # a range is a block of its own with its pairs as dictionary, and so are the border groups of a text
        blocks = inner.select(*KEY, "part", "pairs", "times").unionByName(
            border.groupBy(*KEY, "pair").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pair", "n"))).alias("e"))
            .select(*KEY, F.lit(-1).alias("part"), F.col("e.pair").alias("pairs"), F.col("e.n").alias("times")))
        blocks = save(blocks.filter(F.size("pairs") > 0).select(*KEY, F.xxhash64(*KEY, "part").alias("block"), "pairs", "times"))
        more = blocks.select("block", F.posexplode("pairs").alias("place", "pair")).withColumn("n_docs", F.lit(0).cast("long"))
        entries = entries.withColumn("long", F.lit(False)).unionByName(more.withColumn("long", F.lit(True)))
    else:
        entries = entries.withColumn("long", F.lit(False))

    entries = save(entries)
    # how many dictionaries hold a pair is its weight in the join; a pair's A id has at most as many rows here as B has ids
    weights = entries.groupBy("pair").agg(F.count(F.lit(1)).alias("weight"))
    totals = held.groupBy("pair").agg(F.sum("n_docs").alias("total")).join(weights, "pair")
    best = F.max("total").over(W.partitionBy(F.expr(f"pair div {B_IDS}"))) == F.col("total")
    totals = save(totals.select("pair", "total", "weight", best.cast("long").alias("best")))
    known = join_by_weight(entries, totals, ["pair"], "weight", entries.count())
    tables = known.groupBy("long", "block").agg(F.sort_array(F.collect_list(F.struct("place", "total", "best"))).alias("_e"))
    tables = save(tables.select("long", "block", F.lit(True).alias("is_dictionary"), F.col("_e.total").alias("totals"), F.col("_e.best").alias("best")))

    def with_tables(frame: DataFrame, long_ones: bool) -> DataFrame:
        return frame.withColumn("is_dictionary", F.lit(False)).unionByName(tables.filter(F.col("long") == long_ones).drop("long"), allowMissingColumns=True)

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = _sums(with_tables(rows_of, False), [*columns, "digest"])
    result = out.select(*columns, "n_best", "count_sum", F.col("digest").alias("groups_sha256"))
    if n_parts is None:
        return result
    ordered = blocks.select(*KEY, "block", F.sequence(F.lit(0), F.size("pairs") - 1).alias("place"), "times")
    sums = _sums(with_tables(ordered, True), KEY).groupBy(*KEY).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    texts = inner.select(*KEY, "part", F.lit(1).alias("order"), "text").unionByName(
        good.select(*KEY, F.explode(F.arrays_zip("border_part", "border_text")).alias("e")).select(*KEY, F.col("e.border_part").alias("part"), F.lit(0).alias("order"), F.col("e.border_text").alias("text")))
    full = valid.join(sums, KEY, "left").join(_digests(texts), KEY, "left")
    shown = [F.when(F.col("valid"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in (*columns[1:], "n_best", "count_sum")]
    digest = F.when(F.col("valid"), F.col("digest")).otherwise("").alias("groups_sha256")
    return result.unionByName(full.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("repeats"))), *shown, digest).drop("col"))

"""Byte-pair encoding by dynamic programming over the prefixes of a piece.

For every prefix of a piece exactly one token can be the last one of its encoding: a token that matches a suffix of the
prefix (all such matches come from one automaton pass) and is compatible with the last token of the prefix before it. Two
adjacent tokens are compatible if no merge across their border would have run before the merges that built them. The ids
are read off by following the back-pointers, so the work is linear in the piece and independent of the number of merges.

Texts are cut into pieces by the pattern of the byte-level pre-tokenizer after the added tokens were taken out. Encodings of
pieces are kept per Python worker in a cache with a fixed number of entries; it changes the speed and nothing else.

Defined cases: a null text is encoded as the empty one; empty texts have no ids; very long pieces take no more than linear
time and memory; repeated rows are encoded each; an empty table gives an empty table. All other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terraloom.llm.common import slices
from terraloom.llm.vocabularies import BYTE_LEVEL_FILE, Shipped, published, visible_bytes

# fixed value: the published split pattern of the byte-level pre-tokenizer, white space spelled out as the Unicode property;
# letters and digits stand first, which changes nothing: no other alternative can begin with them
PIECES = (
    r" ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]++"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ASCII_PIECES = r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
CACHE_PIECES = 150_000  # in each of two generations
CACHE_LENGTH = 64  # characters of a piece that is kept
CACHE_PAIRS = 200_000
NEVER = 1 << 40


class Kept(dict):
    """Results of a function, those of the last short arguments kept.

    Two workers of an executor hold one of these each, beside the heap that the shuffles before have filled.
    """

    def __init__(self, fn):
        super().__init__()
        self.fn, self.old = fn, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PrefixEncoder:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        if spec.get("normalizer") or spec["model"].get("dropout") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies without normalisation are supported")
        to_byte = visible_bytes()
        plain = {name: "".join(chr(to_byte[c]) for c in name) for name in spec["model"]["vocab"]}
        self.spelling = {i: plain[name] for name, i in spec["model"]["vocab"].items()}  # bytes as latin-1 characters
        ids = {s: i for i, s in self.spelling.items()}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[plain[left]], ids[plain[right]]
            self.rank[a, b] = k
            made.setdefault(ids[plain[left] + plain[right]], (a, b, k))
        # the nodes on the right and left edge of a token's merge tree, each with the rank of the merge that consumes it
        self.right: dict[int, tuple[tuple[int, int], ...]] = {}
        self.left: dict[int, tuple[tuple[int, int], ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for t, s in self.spelling.items():
            if len(s) == 1:
                self._admit(t, s, (), ())
        for t, (a, b, k) in sorted(made.items(), key=lambda x: x[1][2]):
            if a in self.right and b in self.right and self._border_holds(a, b, k):
                self._admit(t, self.spelling[t], tuple((x, min(n, k)) for x, n in self.right[b]), tuple((x, min(n, k)) for x, n in self.left[a]))
        self.automaton.make_automaton()
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        names = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.bytes = {i: s.encode("latin-1") for i, s in self.spelling.items()} | {i: s.encode() for s, i in self.added.items()}
        self.find, self.find_ascii = regex.compile(PIECES).findall, re.compile(ASCII_PIECES).findall
        self.pairs: dict[int, bool] = {}  # by both ids in one number
        self.pieces = Kept(self._piece)

    def _admit(self, token: int, spelling: str, right: tuple, left: tuple) -> None:
        self.right[token] = ((token, NEVER), *right)
        self.left[token] = ((token, NEVER), *left)
        self.automaton.add_word(spelling, (len(spelling), token))

    def _border_holds(self, a: int, b: int, limit: int) -> bool:
        """No merge across the border of ``a`` and ``b`` runs before ``limit`` or before its parts are consumed inside."""
        for x, x_gone in self.right[a]:
            for y, y_gone in self.left[b]:
                k = self.rank.get((x, y))
                if k is not None and k < limit and k < x_gone and k <= y_gone:
                    return False
        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 24 | b)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 24 | b] = self._border_holds(a, b, NEVER)
        return known

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as UTF-8 bytes in latin-1 characters."""
        last = [-1] * (len(piece) + 1)  # the last token of the encoding of each prefix
        size = [0] * (len(piece) + 1)
        known = self.pairs.get
        for end, (n, token) in self.automaton.iter(piece):
            stop = end + 1
            if last[stop] >= 0:
                continue
            if n == stop:
                last[stop], size[stop] = token, n
                continue
            before = last[stop - n]
            if before >= 0:
                fits = known(before << 24 | token)
                if fits or (fits is None and self.compatible(before, token)):
                    last[stop], size[stop] = token, n
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _piece(self, piece: str) -> str:
        return ",".join(map(str, self.piece_ids(piece.encode("utf-8", "surrogatepass").decode("latin-1"))))

    def joined(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        ids = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                ids.append(str(self.added[part]))
            elif part:
                ids.append(",".join(map(self.pieces.__getitem__, (self.find_ascii if part.isascii() else self.find)(part))))
        return ",".join(ids)

    def coded(self, text: str) -> tuple[str, bytes]:
        """The ids of a text, joined by commas, and the bytes of these ids."""
        joined = self.joined(text)
        return joined, b"".join(map(self.bytes.__getitem__, map(int, joined.split(",")))) if joined else b""

    def encode(self, text: str) -> list[int]:
        ids = self.joined(text)
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        ids, raw = self.coded(text or "")
        decoded = raw.decode("utf-8", "replace").encode()
        return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@functools.lru_cache(maxsize=2)
def encoder(content: bytes) -> PrefixEncoder:
    return PrefixEncoder(content)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids, ids_sha256, decoded_sha256): the ids of every whole text and digests of both directions."""
    shipped = Shipped(docs.sparkSession, path or published(BYTE_LEVEL_FILE))

    def run(batches):
        e = encoder(shipped.content.value)
        for b in slices(batches):
            texts, ids, sums = b.column("text").to_pylist(), [], []
            for text in texts:
                joined, raw = e.coded(text or "")
                ids.append(np.fromstring(joined, dtype=np.int32, sep=",") if joined else np.zeros(0, dtype=np.int32))
                sums.append((hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest()))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids))),
                 pa.array([x[0] for x in sums]), pa.array([x[1] for x in sums])],
                ["doc_id", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, source string, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, without moving the ids out of the workers."""
    shipped = Shipped(docs.sparkSession, path or published(BYTE_LEVEL_FILE))

    def run(batches):
        e = encoder(shipped.content.value)
        for b in slices(batches):
            n, ids, texts = zip(*[e.digest(t) for t in b.column("text").to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

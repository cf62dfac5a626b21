"""Token counts of whole texts, without the tokens.

A function over Arrow batches encodes with the library of the vocabulary file and returns lengths only. Texts longer than
``PART`` characters are cut at safe boundaries, places where the tokens of both sides are the same whether or not the text is
cut there; the parts and the short texts are packed into batches of about ``BATCH`` bytes, so the memory of a call is bounded
by its bytes, not by the number or length of its texts. There is no shuffle: a text is counted where it is read.
Byte-level files never join a visible character to ASCII white space behind it, so a text's count is the sum of those of its words,
each with the white space before it. The library gets a word once; a worker keeps the counts of its last words, two generations of
``KEPT_WORDS`` each.

Safe boundaries of byte-level files, tried in this order from the end of a part backwards:
* before white space that follows something else: no pre-token holds the two;
* behind a letter that no letter follows, or a digit that no digit follows: a pre-token of letters or digits ends there;
* between two characters, no apostrophe among them, whose bytes at the border stand side by side in no token: no merge crosses it.
None lies inside the string of an added token. A longer run without any such place, as one letter repeated, is counted by
dynamic programming over its prefixes, which keeps only as many prefixes as the longest token has bytes.
Piece models are cut at a space between two visible characters, if no piece has a space behind another character.

Defined cases: null and empty texts have no tokens; null ids stay; repeated rows are counted each; an empty table gives an
empty table; all other columns are ignored. The strings of added tokens inside a text count as the library counts them.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from terraloom.llm import bpe_dp, vocabularies as V
from terraloom.llm.common import slices

PART = 32_768  # characters of a part
BATCH = 262_144  # bytes of a batch
KEPT_WORDS = 400_000
KEPT_CHARACTERS = 8 << 20
LIMIT = 1024

BEFORE_SPACE = regex.compile(r"(?<=\S)(?=\s)")
END_OF_RUN = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
ONE_PIECE = regex.compile(r" ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)")


class ByteLevelCounter:
    """Counts of one byte-level JSON file, with its safe boundaries."""

    def __init__(self, content: bytes):
        self.tokenizer = V.byte_level(content, True)
        self.added = V.added_names(content)
        self.joined = V.joined_bytes(content).copy()
        self.joined[ord("'"), :] = self.joined[:, ord("'")] = True  # contractions are split off by what stands around them
        self.content = content
        self.by_words = V.cuts_at_words(content)
        self.kept: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.characters = 0

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_words:
            return self.library(texts)
        if len(self.kept) >= KEPT_WORDS or self.characters >= KEPT_CHARACTERS:
            self.kept, self.old, self.characters = {}, self.kept, 0
        cut = list(map(V.BEFORE_ASCII_SPACE.findall, texts))
        missing = set(itertools.chain.from_iterable(cut)).difference(self.kept)
        new = list(missing.difference(self.old))
        self.characters += sum(map(len, missing))
        self.kept.update((word, self.old[word]) for word in missing.intersection(self.old))
        self.kept.update(zip(new, self.library(new), strict=True))
        return [sum(map(self.kept.__getitem__, words)) for words in cut]

    def library(self, texts: list[str]) -> list[int]:
        return [len(x) if len(t) <= 4 * PART else self.long_run(t) for x, t in zip(
            self.tokenizer.encode_batch_fast([t if len(t) <= 4 * PART else "" for t in texts], add_special_tokens=False), texts, strict=True)]

    def long_run(self, text: str) -> int:
        """Tokens of a run that no boundary cuts; one pre-token is counted over its prefixes, of which only the last few are kept."""
        if not ONE_PIECE.fullmatch(text) or any(name in text for name in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        encoder = bpe_dp.encoder(self.content)
        keep = 1 + max(map(len, V.byte_level_bytes(self.content)))
        last: list[int | None] = [None] * keep
        count, reached = [0] * keep, [0] + [-1] * (keep - 1)
        for end, (n, token) in encoder.automaton.iter(text.encode().decode("latin-1")):
            stop, start = end + 1, end + 1 - n
            at, before = stop % keep, start % keep
            if reached[at] != stop and reached[before] == start and (start == 0 or encoder.compatible(last[before], token)):
                last[at], count[at], reached[at] = token, count[before] + 1, stop
        return count[len(text.encode()) % keep]

    def parts(self, text: str) -> list[str]:
        out, start = [], 0
        while len(text) - start > PART:
            cut = self.boundary(text, start)
            out.append(text[start:cut])
            start = cut
        return [*out, text[start:]] if start < len(text) else out

    def inside_added(self, text: str, at: int) -> bool:
        return any(text.find(name, max(0, at - len(name) + 1), at + len(name) - 1) >= 0 for name in self.added)

    def boundary(self, text: str, start: int) -> int:
        """The last safe boundary of the part that starts at ``start``; without one, the first behind it."""
        stop, first = start + PART, False
        low = start + 1
        while low < len(text):
            for places in (self.matches(BEFORE_SPACE, text, low, stop), self.matches(END_OF_RUN, text, low, stop), self.unjoined(text, low, stop)):
                safe = (p for p in (places if first else reversed(places)) if not self.inside_added(text, p))
                if (found := next(safe, None)) is not None:
                    return found
            low, stop, first = stop + 1, stop + PART, True
        return len(text)

    @staticmethod
    def matches(pattern, text: str, low: int, stop: int) -> list[int]:
        return [m.start() for m in pattern.finditer(text, low - 1, stop + 1) if low <= m.start() <= stop]

    def unjoined(self, text: str, low: int, stop: int) -> list[int]:
        """Places between two characters whose neighbouring bytes stand side by side in no token."""
        raw = np.frombuffer(text[low - 1: stop + 1].encode(), dtype=np.uint8)
        first = (raw & 0xC0) != 0x80  # first bytes of characters
        free = np.zeros(len(raw), dtype=bool)
        free[1:] = first[1:] & ~self.joined[raw[:-1], raw[1:]]
        return (low - 2 + np.cumsum(first)[free]).tolist()


class PieceCounter:
    """Counts of one piece model; a text is cut only at spaces between visible characters."""

    def __init__(self, content: bytes):
        self.model, self.cuts = V.pieces(content), V.cuts_at_spaces(content)

    def count(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))

    def parts(self, text: str) -> list[str]:
        out, start = [], 0
        while self.cuts and len(text) - start > PART:
            cut = V.lone_space_before(text, start + 1, start + PART)
            if cut < 0:
                cut = V.lone_space_after(text, start + PART)
            if cut >= len(text):
                break
            out.append(text[start:cut])
            start = cut + 1  # the model puts a space before every text it is given
        return [*out, text[start:]]


@functools.lru_cache(maxsize=4)
def counter(name: str, content: bytes):
    if name.endswith(".json"):
        return ByteLevelCounter(content)
    if name.endswith(".model"):
        return PieceCounter(content)
    raise ValueError(f"no library for {name}: expected a .json or a .model file")


def packed(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of neighbours of about ``most`` bytes together; one longer than that stands alone."""
    runs, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            runs.append((start, i))
            start, total = i, 0
        total += n
    return [*runs, (start, len(sizes))] if sizes else []


def counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    shipped = V.Shipped(docs.sparkSession, path or V.published(V.BYTE_LEVEL_FILE))

    def run(batches):
        encoder = counter(shipped.name, shipped.content.value)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            parts, owners = [], []
            for i, text in enumerate(texts):
                cut = encoder.parts(text) if len(text) > PART else [text]
                parts += cut
                owners += [i] * len(cut)
            lengths: list[int] = []
            for start, stop in packed([len(p.encode()) if len(p) > PART else len(p) for p in parts], BATCH):
                lengths += encoder.count(parts[start:stop])
            n = np.bincount(owners, weights=lengths, minlength=len(texts)).astype(np.int64)
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

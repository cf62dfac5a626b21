"""Published vocabulary files on executors, and places where a text may be cut without changing any token.

A vocabulary file has a fixed size of a few megabytes. The driver reads it once and broadcasts its bytes, so executors need no
copy of their own; each Python worker builds the library's object from them once.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from pyspark.sql import SparkSession

BYTE_LEVEL_FILE = "byte_bpe_50k.json"
PIECE_FILE = "piece_bpe_32k.model"
MAX_FILE = 64 << 20  # a larger file is no vocabulary and is not broadcast


def published(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Shipped:
    """The bytes of one vocabulary file, broadcast to the executors."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            content = f.read(MAX_FILE + 1)
        if len(content) > MAX_FILE:
            raise ValueError(f"{path} is too large for a vocabulary file")
        self.name, self.content = path, spark.sparkContext.broadcast(content)

    def __getstate__(self):
        return {"name": self.name, "content": self.content}


@functools.lru_cache(maxsize=4)
def byte_level(content: bytes, special: bool):
    """The byte-level tokenizer of a JSON file without truncation and padding; ``special``: strings of added tokens in a text count as those tokens."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = not special
    return tokenizer


@functools.lru_cache(maxsize=4)
def pieces(content: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


def visible_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, mapped back to the byte."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def byte_level_bytes(content: bytes) -> list[bytes]:
    """The bytes of every id of a byte-level JSON file."""
    spec, to_byte = json.loads(content), visible_bytes()
    spelled = {i: bytes(to_byte[c] for c in name) for name, i in spec["model"]["vocab"].items()}
    spelled |= {x["id"]: x["content"].encode() for x in spec["added_tokens"] if x["id"] not in spelled}
    return [spelled.get(i, b"") for i in range(max(spelled) + 1)]


@functools.lru_cache(maxsize=4)
def piece_bytes(content: bytes) -> list[bytes]:
    """The bytes of every id of a piece model: its spelling with the space sign as a space, one byte for a byte piece."""
    model = pieces(content)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(len(model))))]


@functools.lru_cache(maxsize=4)
def added_names(content: bytes) -> list[str]:
    return [x["content"] for x in json.loads(content)["added_tokens"]]


@functools.lru_cache(maxsize=4)
def cuts_at_spaces(content: bytes) -> bool:
    """Whether no piece has a space after another character: then no merge ever crosses from a character to a space behind it."""
    model = pieces(content)
    return not any("▁" in p.lstrip("▁") for p in map(model.id_to_piece, range(len(model))))


@functools.lru_cache(maxsize=4)
def joined_bytes(content: bytes) -> np.ndarray:
    """A 256 x 256 table of the byte pairs that stand side by side in some token."""
    table = np.zeros((256, 256), dtype=bool)
    for token in byte_level_bytes(content):
        for x, y in zip(token, token[1:], strict=False):
            table[x, y] = True
    return table


#: A space between two characters that no library takes for white space.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def lone_space_before(text: str, start: int, stop: int) -> int:
    """The last position in [start, stop) of a space between two visible characters, or -1."""
    at = text.rfind(" ", start, stop)
    while at > start and not LONE_SPACE.match(text, at):
        at = text.rfind(" ", start, at)
    return at if at >= 0 and LONE_SPACE.match(text, at) else -1


def lone_space_after(text: str, start: int) -> int:
    """The first position from ``start`` on of a space between two visible characters, or the length of the text."""
    found = LONE_SPACE.search(text, start)
    return found.start() if found else len(text)


#: Cuts before ASCII white space that follows a visible character: no pre-token of a byte-level file holds the two.
BEFORE_ASCII_SPACE = re.compile(r"\s*\S+(?:(?![\t-\r ])\s+\S+)*+(?:\s+\Z)?|\s+")
#: Cuts before a space between two visible characters.
BEFORE_LONE_SPACE = re.compile(r"\s*\S+(?:(?! \S)\s+\S+)*+(?:\s+\Z)?|\s+")


@functools.lru_cache(maxsize=4)
def cuts_at_words(content: bytes) -> bool:
    """Whether a byte-level JSON file splits texts by the published pattern only, so that words may be encoded one by one."""
    spec = json.loads(content)
    split = spec.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    strict = [x for x in spec["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"])]
    return plain and not spec.get("normalizer") and not spec["model"].get("dropout") and not strict

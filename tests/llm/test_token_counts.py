import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from terraloom.llm import token_counts, vocabularies as V

random.seed(5)
LONG = [
    " ".join(random.choice(["alpha", "it's", "naïve", "слово", "語彙", "x1y2", "--", "<|endoftext|>", "\n", "\t ", "  "]) for _ in range(30_000)),
    "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90_000)),
    "".join(random.choice("0123456789abc'!?.,<|>endoftext") for _ in range(90_000)),
    "".join(random.choice(" \n\t\r 　\x1c\x85") for _ in range(80_000)) + "x",
    "<|endoftext|>" * 8_000, "漢字仮名交じり文" * 9_000, "!'s" * 30_000, "'" * 70_000, "=" * 70_000, " " * 70_000 + "y", "\n" * 70_000,
]
SHORT = [(1, None, "a"), (2, "", "a"), (None, "no id", None), (3, "same", "a"), (3, "same", "a"), (4, "a<|endoftext|>b <|endoftext|>", None)]


def library(path):
    if path.endswith(".json"):
        tokenizer = Tokenizer.from_file(path)
        return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(model.encode(t))


@pytest.mark.parametrize("name", [V.BYTE_LEVEL_FILE, V.PIECE_FILE])
def test_counts_equal_the_library_s(spark, docs, name):
    path = V.published(name)
    rows = SHORT + [(10 + i, t, "a") for i, t in enumerate(LONG)]
    got = token_counts.counts(docs(rows), path).collect()
    n = library(path)
    expected = sorted((str(d), len((t or "").encode()), n(t or ""), n(t or "") > 1024) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
    assert token_counts.counts(docs([]), path).collect() == []


def test_parts_are_cut_where_no_token_crosses():
    content = open(V.published(V.BYTE_LEVEL_FILE), "rb").read()
    counter, n = token_counts.ByteLevelCounter(content), library(V.published(V.BYTE_LEVEL_FILE))
    for text in LONG:
        parts = counter.parts(text)
        assert "".join(parts) == text and sum(map(n, parts)) == n(text)
    assert max(map(len, counter.parts(LONG[0]))) <= token_counts.PART + 1


def test_a_run_without_boundary_is_counted_over_its_prefixes():
    content = open(V.published(V.BYTE_LEVEL_FILE), "rb").read()
    counter, n = token_counts.ByteLevelCounter(content), library(V.published(V.BYTE_LEVEL_FILE))
    for run in ("a" * 200_001, " " + "ab" * 80_003, "9" * 150_000, "=" * 140_007, "é" * 140_000):
        assert counter.count([run, "x"]) == [n(run), 1]


def test_the_library_gets_a_word_once():
    content = open(V.published(V.BYTE_LEVEL_FILE), "rb").read()
    counter, n = token_counts.ByteLevelCounter(content), library(V.published(V.BYTE_LEVEL_FILE))
    given, whole = [], counter.library
    counter.library = lambda texts: given.extend(texts) or whole(texts)
    spaces = [chr(c) for c in range(0x3100) if not chr(c).isalnum()]
    texts = ["the cat sat on the mat " * 500, "the mat\t sat " * 300, "".join(f"a{c} b!{c}\n{c}x  " for c in spaces)]
    assert counter.count(texts) == counter.count(texts) == list(map(n, texts))
    assert len(given) == len(set(given)) and sum(map(len, given[:])) < sum(map(len, texts))


def test_counts_hold_when_kept_words_are_replaced(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 5)
    counter, n = token_counts.ByteLevelCounter(open(V.published(V.BYTE_LEVEL_FILE), "rb").read()), library(V.published(V.BYTE_LEVEL_FILE))
    for k in range(20):
        texts = [f"word{k} the cat  w{k % 3}", "the cat\n sat"]
        assert counter.count(texts) == list(map(n, texts))
    assert len(counter.kept) <= 5 + 8

import hashlib
import random
import re

import numpy as np
import pytest

from terraloom.llm import bpe_dp as B, pivotal_mix as M
from terraloom.llm.vocabularies import BYTE_LEVEL_FILE, published

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Shares 5, 2, 1, ... of all words, filled up to three times each source, by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, total = {}, sum(sizes.values())
    open_ = set(names)
    while True:
        left = total - sum(out.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over


def mix_case(rng):
    rows = [(k, "w " * rng.randrange(1, 60), rng.choice(["a", "b", "b", "b", "b", "é", "z", None])) for k in range(400)]
    return [*rows, (900, None, "a"), (901, "", "b"), (902, "x " * 20_000, "b"), (None, "p q", "a"), (0, *rows[0][1:]), (903, "tiny", "tiny"), (904, None, "empty")]


@pytest.mark.parametrize("fan_in", [4096, 8])
def test_mix_meets_targets(docs, fan_in):
    rows = mix_case(random.Random(1))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    got = M.mix(docs(rows), fan_in=fan_in).collect()
    assert len(got) == len(rows)
    taken, biggest = {}, {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in sizes)
    again = M.mix(docs(rows).repartition(5), fan_in=fan_in).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_corpus_has_the_copies(docs):
    rows = mix_case(random.Random(2))
    frame = docs(rows)
    count = {}
    for r in M.mix(frame).collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + r["copies"]
    out = M.apply_mix(frame)
    assert out.schema.names == frame.schema.names
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        assert r["_row"] == f"x{r['doc_id']}"
    assert seen == {k: n for k, n in count.items() if n}
    assert M.mix(docs([])).count() == 0 and M.apply_mix(docs([])).count() == 0


def test_pivotal_rounding_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size, share = rng.integers(1, 50, 30).astype(float), rng.random(30)
    total = np.zeros(30)
    for k in range(4000):
        out = M.settle(size, share, np.random.default_rng(k).random(30))
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((size * out).sum() - (size * share).sum()) < 1e-6
        total += out
    assert np.abs(total / 4000 - share).max() < 0.05


# --- byte pairs ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(published(BYTE_LEVEL_FILE))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def token_texts(rng):
    pool = "aaabbc  \n\n\t  \u0085\u001c\u001fé日本語ß'sтест123٣½\U0001f600�_-=#%!​　ing the"
    out = ["", "a", " ", "\n\n  x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "ab" * 40_000, "'s't're've'm'll'd'S", "I'll we've"]
    for _ in range(600):
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(0, 50))))
        out.append("".join(chr(rng.choice([rng.randrange(32, 0x300), rng.randrange(32, 0xD7FF)])) for _ in range(20)))
        out.append(rng.choice("ab =-0\né") * rng.randint(1, 300))
    return out


def test_encoder_matches_the_library(library):
    encoder = B.PrefixEncoder(open(published(BYTE_LEVEL_FILE), "rb").read())
    for text in token_texts(random.Random(3)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cache_generations_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 5)
    monkeypatch.setattr(B, "CACHE_PAIRS", 7)
    encoder = B.PrefixEncoder(open(published(BYTE_LEVEL_FILE), "rb").read())
    for text in token_texts(random.Random(4))[:200]:
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests_and_ids(docs, library):
    rows = [(k, t) for k, t in enumerate(token_texts(random.Random(5))[:60])] + [(None, None), (3, "again"), (3, "again")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for k, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((k, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), ids))
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [tuple(r) for r in B.digests(docs(rows)).collect()]
    assert sorted(got, key=order) == sorted([w[:4] for w in want], key=order)
    full = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["token_ids"]) for r in B.encode(docs(rows)).collect()]
    assert sorted(full, key=order) == sorted(want, key=order)
    assert B.digests(docs([])).count() == 0 and B.encode(docs([])).count() == 0


def test_thousands_of_repeats_are_mixed_together(docs):
    rows = [(1, "a b c", "x")] * 5_000 + [(k, "a b", "y") for k in range(10, 60)] + [(2, "a", "x")]
    got = [r.asDict() for r in M.mix(docs(rows)).collect()]
    assert len(got) == len(rows)
    for source in "xy":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    copies = [r["copies"] for r in got if r["doc_id"] == 1]
    assert max(copies) - min(copies) <= 1 and max(copies) <= 3
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in M.mix(docs(rows[::-1])).collect())


def test_kept_pieces_are_ids_only_and_bounded(monkeypatch):
    monkeypatch.setattr(B, "CACHE_PIECES", 50)
    encoder = B.PrefixEncoder(open(published(B.BYTE_LEVEL_FILE), "rb").read())
    for k in range(40):
        text = " ".join(f"wörd{k}x{j} the<|endoftext|>" for j in range(9))
        joined, raw = encoder.coded(text)
        assert raw == text.encode() and encoder.encode(text) == list(map(int, joined.split(",")))
    assert encoder.coded("") == ("", b"")
    assert len(encoder.pieces) <= 50 and len(encoder.pieces.old) <= 50 and all(isinstance(x, str) for x in encoder.pieces.values())

import collections
import functools
import hashlib
import random

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from terraloom.llm import token_alignment as T, vocabularies as V

PATHS = V.published(V.BYTE_LEVEL_FILE), V.published(V.PIECE_FILE)


def brute(rows):
    """The contract, text by text, from the libraries alone."""
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    spelled = V.visible_bytes()
    linked, docs, per_doc = [], [], collections.Counter()
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        raw = [bytes(spelled[c] for c in a.id_to_token(i)) for i in ids[0]], [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or b"".join(raw[0]) != whole or b"".join(raw[1]) != whole:
            docs.append((0, 0, 0, ""))
            linked.append([])
            continue
        spans = []
        for side in raw:
            ends = np.cumsum([len(x) for x in side])
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        pairs, j0 = [], 0
        for (s, e), i in zip(spans[0], ids[0], strict=True):
            while spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                pairs.append((i, ids[1][j]))
                j += 1
        cuts = sorted({int(e) for _, e in spans[0]} & {int(e) for _, e in spans[1]})
        groups, at = [], [0, 0]
        for cut in cuts:
            sides = []
            for k in (0, 1):
                start = at[k]
                while at[k] < len(spans[k]) and spans[k][at[k]][1] <= cut:
                    at[k] += 1
                sides.append(",".join(map(str, ids[k][start:at[k]])))
            groups.append("|".join(sides))
        docs.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        linked.append(pairs)
        per_doc.update(set(pairs))
    best = collections.Counter()
    for (x, _), n in per_doc.items():
        best[x] = max(best[x], n)
    return sorted(
        (str(doc_id), *d[:3], len(p), sum(per_doc[q] == best[q[0]] for q in p), sum(per_doc[q] for q in p), d[3])
        for (doc_id, _), d, p in zip(rows, docs, linked, strict=True)
    )


def got(frame):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in frame.collect())


def long_text(rng, words):
    pool = ["alpha", "beta-gamma", "naïve", "слово", "漢字仮名", "x1y2", "--", "it's", "<|endoftext|>", "internationalisation", "  ", "\n", "tokenisers"]
    return " ".join(rng.choice(pool) for _ in range(words))


def test_alignment_equals_brute_force(spark, docs):
    rng = random.Random(4)
    same = long_text(rng, 900)
    rows = [
        (1, None), (2, ""), (3, " "), (4, "a"), (5, "plain words here"), (5, "plain words here"), (None, "no id"), (6, "a▁b is not given back"), (7, "<s> <0x41> <|endoftext|>"),
        (8, "\x00 nul\r\n\ttabs"), (9, "漢" * 400), (10, "x" * 3000), (11, same), (11, same), (12, long_text(rng, 2500)), (13, long_text(rng, 800) + " ▁ " + long_text(rng, 300)),
        (14, " " * 2000), (15, long_text(rng, 300) + "é" * 900 + long_text(rng, 300)), *[(20 + i, long_text(rng, 30)) for i in range(40)],
    ]
    expected = brute(rows)
    assert got(T.align(docs(rows), chunk=256, fan_in=3, block_pairs=50)) == expected
    assert got(T.align(docs(rows))) == expected
    assert T.align(docs([])).collect() == []


def test_composition_is_associative():
    rng, e = random.Random(9), T.Encoders(*[open(p, "rb").read() for p in PATHS])
    for words, chunk in ((60, 32), (200, 100), (90, 17)):
        text = long_text(rng, words)
        made = []
        for part, low, high, base, window, first, last in T.ranges(text, chunk):
            (a, b), = e.encode([window])
            f, *closed = T.fragment(T.Tokens(a, base + np.cumsum(e.a_size[a])), T.Tokens(b, base + np.cumsum(e.b_size[b])), part, low, high, first)
            found = T.segments([closed[0]], [closed[1]], e.a_size, e.b_size)
            made.append(f._replace(counts=(*f.counts[:2], int(found.n_groups[0]), int(found.n_links[0]))))
        whole, = e.encode([" " + text])
        found = T.segments([whole[0]], [whole[1]], e.a_size, e.b_size)
        left = functools.reduce(T.compose, made, T.Fragment())
        right = functools.reduce(lambda g, f: T.compose(f, g), reversed(made), T.Fragment())
        half = T.compose(functools.reduce(T.compose, made[: len(made) // 2]), functools.reduce(T.compose, made[len(made) // 2:]))
        for f in (left, right, half):
            assert f.counts == (len(whole[0]), len(whole[1]), int(found.n_groups[0]), int(found.n_links[0]))
            assert not any(len(t.ids) for t in (*f.prefix, *f.suffix)) and f.borders == left.borders
        assert any(len(f.suffix[0].ids) or len(f.prefix[0].ids) for f in made)


def test_words_are_encoded_once_and_give_the_ids_of_whole_windows(monkeypatch):
    monkeypatch.setattr(T, "KEPT_WORDS", 40)
    e = T.Encoders(*[open(V.published(x), "rb").read() for x in (V.BYTE_LEVEL_FILE, V.PIECE_FILE)])
    given, whole = [], e.whole
    e.whole = lambda windows: given.extend(windows) or whole(windows)
    odd = [" \u0308 x", "a  b", "x \ufb01 \xbd", "a\tb c\n d", "a\x1cb c", "<|endoftext|> <s> </s>", "\u2581a \u2581 b", "\r\n a \n b", "\x00 a", "  two", "tail ", "e \u0301 f"]
    for k in range(12):
        windows = [" " + t for t in (*odd, *[f"the cat{k}{j} sat on the mat" for j in range(6)])]
        for got, expected in zip(e.encode(windows), whole(windows), strict=True):
            assert (got is None) == (expected is None)
            assert got is None or all(x.tolist() == y.tolist() for x, y in zip(got, expected, strict=True))
    assert given.count(" the") == 1 and len(e.known) < 40 + 60

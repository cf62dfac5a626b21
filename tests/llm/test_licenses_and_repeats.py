import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import license_minhash as N, suffix_dedup as S

# --- licenses -----------------------------------------------------------------------------------


def license_rows(rng):
    word = lambda: rng.choice("the license is under that version rights this work of any river released reserved".split())
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k, (_, text, _) in enumerate(N.TEMPLATES):
        rows += [(k * 10, text), (k * 10 + 1, f"{fill(rng.randrange(80))} {text.upper()}. {fill(rng.randrange(80))}")]
        words = text.split()
        rows.append((k * 10 + 2, f"{fill(13)} {' '.join(words[: len(words) // 2])} {fill(1)} {' '.join(words[len(words) // 2 :])} {fill(9)}"))
        rows.append((k * 10 + 3, f"{fill(21)} {' '.join(words[:-1])} {fill(30)}"))
    return [*rows, (9900, None), (9901, ""), (9902, " \n"), (None, "All  rights, reserved!"), (0, rows[0][1]), (9903, fill(30_000) + " all rights reserved"), (9904, "reserved")]


def licenses_by_hand(text):
    """License -> (containment, first window, windows) by sliding over all windows."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if w]
    best = {}
    for name, template, phrases in N.TEMPLATES:
        own = N.words_of(template)
        k, (size, step) = N.shingle_size(len(own)), N.window_shape(len(own))
        need = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
        for start in range(0, max(len(words) - len(own), 0) + 1, step):
            part = words[start : start + size]
            share = len(need & {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}) / len(need)
            if share >= N.CONTAINMENT and all(f" {p} " in f" {' '.join(part)} " for p in phrases):
                best.setdefault(name, []).append((share, start, len(own)))
    return {name: (round(max(f[0] for f in found), 6), min(f[1] for f in found), len({f[1:] for f in found})) for name, found in best.items()}


def test_licenses_match_all_windows(docs):
    rows = license_rows(random.Random(1))
    want = sorted(((k if k is not None else -1), name, *v) for k, t in rows for name, v in licenses_by_hand(t).items())
    got = sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in map(tuple, N.scan(docs(rows)).collect()))
    assert got == want and len(want) > 2 * len(N.TEMPLATES)
    assert N.scan(docs([])).count() == 0


def test_variants_are_told_apart(docs):
    later = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    texts = {
        "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + later.format(3),
        "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License " + later.format(2.1),
        "AGPL-3.0": "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License " + later.format(3).replace("Foundation;", "Foundation,"),
        "GPL-2.0": "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License " + later.format(2),
        "GPL-3.0": "/* this work is licensed under\n * the GNU General Public License, version 3 */",
        "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met: 1. ...",
        "EPL-2.0": "are made available under the terms of the Eclipse Public License 2.0 which", "CC0-1.0": "# CC0 1.0 Universal", "BSD-2-Clause": "// SPDX-License-Identifier: BSD-2-Clause",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    got = {}
    for r in N.scan(docs(list(enumerate(texts.values())))).collect():
        got.setdefault(r["doc_id"], []).append(r["license_id"])
    assert got == {k: [name] for k, name in enumerate(texts)}


def test_needed_words_hold_more_than_a_fifth_of_the_shingles():
    for _, text, _ in N.TEMPLATES:
        words = N.words_of(text)
        size = N.shingle_size(len(words))
        shingles = [set(words[i : i + size]) for i in range(len(words) - size + 1)]
        assert sum(bool(s & N.needed_words(words)) for s in shingles) > 0.2 * len(shingles)


# --- repeated strings -----------------------------------------------------------------------------


def repeats_by_hand(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark, strict=True) if not m)).hexdigest()))
    return out


def repeat_rows(rng):
    letters = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    base = [letters("abcdé ", rng.randint(30, 200)) for _ in range(25)]
    texts = []
    for _ in range(90):
        kind, x = rng.random(), rng.choice(base)
        if kind < 0.2:
            texts.append(x)
        elif kind < 0.5:
            y = list(x)
            for _ in range(rng.randint(1, 6)):
                y[rng.randrange(len(y))] = rng.choice("xyz")
            texts.append("".join(y))
        elif kind < 0.7:
            i = rng.randrange(len(x))
            texts.append(letters("mnop", 30) + x[i : i + rng.randint(10, 60)] + letters("mnop", 30))
        else:
            texts.append(rng.choice(["ab", "a", "abc"]) * rng.randint(5, 60) if kind < 0.8 else letters("qrstuvw", rng.randint(0, 100)))
    rows = list(enumerate([*texts, None, "", "short", letters("abcdefgh", 30_000)]))
    return [*rows, (None, "zz" * 40), (None, None), (3, texts[3])]


@pytest.mark.parametrize("options", [{"length": 20, "lead": 12}, {"length": 20, "lead": 12, "group_rows": 2}, {"length": 24, "lead": 20, "bucket_rows": 10}])
def test_repeats_match_all_windows(docs, options):
    rows = repeat_rows(random.Random(2))
    key = lambda k: -1 if k is None else k
    want = sorted((key(k), *v) for (k, _), v in zip(rows, repeats_by_hand([t for _, t in rows], options["length"]), strict=True))
    got = sorted((key(r[0]), *r[1:]) for r in map(tuple, S.digests(docs(rows), **options).collect()))
    assert got == want and sum(v[2] for v in want) > 1000


def test_no_repeats_and_empty_table(docs):
    assert [tuple(r)[1:4] for r in S.digests(docs([(1, "x" * 399), (2, "y" * 10)])).collect()] == [(399, 0, 0), (10, 0, 0)]
    assert S.digests(docs([])).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]) for r in S.without_repeats(docs([(1, "a" * 400 + "b"), (2, "a" * 400 + "c")])).collect()}
    assert kept == {1: b"b", 2: b"c"}


def test_rows_of_one_frequent_stretch_are_dealt_out(spark, docs, monkeypatch):
    saved, save = [], S.save
    monkeypatch.setattr(S, "save", lambda df: saved.append(df) or save(df))
    own = random.Random(3)
    rows = [(k, "".join(own.choice("abcdefgh") for _ in range(30)) + "z" * 60) for k in range(300)]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spans = S.repeated_spans(S.keyed(docs(rows)), 20, 12)
        for df in (saved[1], spans):  # the rows with a repeated lead, the repeated spans
            counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]
            assert sum(counts) >= 300 * 41 and max(counts) < sum(counts) / 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted((k, *v) for (k, _), v in zip(rows, repeats_by_hand([t for _, t in rows], 20), strict=True))
    assert sorted(map(tuple, S.digests(docs(rows), 20, 12).collect())) == want


def test_anchor_of_equal_windows_is_at_the_same_place(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 100, 700).astype(np.uint8)
    raw[400:560] = raw[100:260]
    a, b, p, *_ = S.anchors(raw, 40, 16)
    assert a[0] == 0 and b[-1] == len(raw) - 40 and (a[1:] == b[:-1] + 1).all() and ((p >= a) & (p >= b) & (p <= a + 24)).all()
    place = {i: int(p[k]) - i for k in range(len(a)) for i in range(a[k], b[k] + 1)}
    assert all(place[100 + i] == place[400 + i] for i in range(120))


def test_multikey_order_sorts():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    assert [tuple(r) for r in words[S.multikey_order(words)].tolist()] == sorted(map(tuple, words.tolist()))


def test_thousands_of_repeats_of_a_row(docs):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared, own, short = words(400), words(200), words(20)
    rows = [(1, shared)] * 5_000 + [(2, own + " " + shared[:1_000]), (3, own), (4, words(150))] + [(5, short)] * 300 + [(None, None)] * 3
    found = {}
    for r in S.digests(docs(rows)).collect():
        found.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"]))
    assert {k: len(v) for k, v in found.items()} == {1: 5_000, 2: 1, 3: 1, 4: 1, 5: 300, None: 3}
    assert set(found[1]) == {(len(shared), len(shared), 1)} and set(found[5]) == {(len(short), 0, 0)} and set(found[None]) == {(0, 0, 0)}
    n = len(own)
    assert found[2] == [(n + 1_001, n + 1_000, 2)] or found[2] == [(n + 1_001, n + 1_001, 1)]
    assert found[3] == [(n, n, 1)] and found[4][0][1:] == (0, 0)

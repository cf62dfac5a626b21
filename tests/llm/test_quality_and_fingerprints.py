import collections
import hashlib
import random
import re

import xxhash

from terraloom.llm import line_frequency as L, simhash_vp as S, spotsigs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\n", "a", "a a a a a a a", "a b c d e a b c d e\nx\nx\n x\n\n", "é日 \x0b ü\x85z\xa0y\n#|#", "lang " * 30_000]


def base_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def test_base_statistics_match_a_plain_count():
    rng = random.Random(1)
    for text in [*ODD, *["".join(rng.choice("ab \n#é") for _ in range(60)) for _ in range(300)]]:
        assert L.profile_text(text)[:5] == base_rules(text)


def line_case(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    fresh = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, f"{fresh(12)}\nRead MORE, page {k % 10}!\n{fresh(15)}", "h") for k in range(40)]
    rows += [(100 + k, f"{fresh(3)}\n" + "\n".join(["Read more page 7"] * 3), "h") for k in range(2)]  # depleted
    copied = f"{fresh(20)}\n{fresh(20)}"
    rows += [(200 + k, copied, "h") for k in range(40)]  # copies are one document
    rows += [(300, f"{fresh(12)}\nRead more page 1\n{fresh(15)}", "other"), (301, f"{fresh(30)}", None), (None, f"{fresh(30)}", None)]
    rows += [(400 + k, t, "h") for k, t in enumerate(ODD)]
    return rows


def normal(line):
    return re.sub(r"[\x00-\x7f]", lambda m: m.group() if m.group().isalnum() else "", re.sub("[0-9]", "0", line.lower()))


def test_frequent_lines_deplete_and_copies_do_not_count(docs):
    rows = line_case(random.Random(3))
    got = {r["doc_id"]: r for r in L.judge(docs(rows), min_docs=10, share=0.01).collect()}
    assert len(got) == len(rows)
    for doc_id, text, source in rows:
        n, _, _, _, repeated = base_rules(text)
        failed = n < 10 or 100 * repeated > 20 * n
        lines = [(normal(x), len(WORD.findall(x))) for x in (text or "").split("\n")]
        gone = sum(k for x, k in lines if source == "h" and x == "readmorepage0")
        assert got[doc_id]["base_failed"] == failed
        assert got[doc_id]["n_removed_words"] == gone
        assert got[doc_id]["kept"] == (not failed and not (gone and (n - gone < 5 or n - gone < 0.3 * n)))
    assert all(got[200 + k]["kept"] for k in range(40))


def test_clean_removes_lines_and_keeps_columns(docs):
    rows = line_case(random.Random(4))
    frame = docs([*rows, rows[0]])
    out = L.clean(frame, min_docs=10, share=0.01)
    assert out.schema == frame.schema
    got = collections.Counter(r["doc_id"] for r in out.collect())
    assert got[0] == 2 and got[100] == 0 and got[None] == 1
    texts = {r["doc_id"]: r for r in out.collect()}
    assert "MORE" not in texts[5]["text"] and texts[5]["n_chars"] == len(texts[5]["text"]) and texts[5]["_row"] == "x5"
    assert "Read more" in texts[300]["text"]


def test_documents_of_a_small_shared_vocabulary_are_told_apart(docs):
    rng = random.Random(12)
    words = [f"word{c}" for c in "abcdefghijkl"]
    fresh = lambda: " ".join(rng.sample(words, len(words)))
    # the same twelve words in every document, in another order
    texts = [f"{fresh()}\nread on\n{fresh()}" for _ in range(30)]
    rare = [f"{fresh()}\nseldom seen\n{fresh()}" for _ in range(10)]
    rows = [(k, t, "h") for k, t in enumerate([*texts, *texts[:15], *rare])]
    rows += [(100 + k, rare[0].upper(), "h") for k in range(5)]  # a copy but for case
    got = {r["doc_id"]: r["n_removed_words"] for r in L.judge(docs(rows), min_docs=10, share=0.01).collect()}
    assert [got[k] for k in sorted(got)] == [2] * 45 + [0] * 15
    share = L.judge(docs(rows), min_docs=10, share=0.74).agg({"n_removed_words": "sum"}).first()[0], L.judge(docs(rows), min_docs=10, share=0.76).agg({"n_removed_words": "sum"}).first()[0]
    assert share == (90, 0)  # 30 of 40 documents


def test_empty_tables(docs):
    assert L.judge(docs([])).count() == 0 and L.clean(docs([])).count() == 0
    assert S.near_duplicates(docs([])).count() == 0 and S.first_of_each(docs([])).count() == 0
    assert P.with_neighbours(docs([])).count() == 0


# --- SimHash -----------------------------------------------------------------------------------


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Smallest index reachable from each entry by links of three bits or fewer."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def near_case(rng, n=160):
    word = lambda: rng.choice("alpha beta gamma delta one two three four red blue green sun moon".split())
    rows = []
    for k in range(n):
        if k and rng.random() < 0.5:
            words = (rows[rng.randrange(k)][1] or "x").split()
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = word()
        else:
            words = [word() for _ in range(rng.choice([1, 2, 5, 60, 200]))]
        rows.append((k, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (1003, "É b C"), (3, rows[3][1])]


def test_components_match_all_pairs(docs):
    rows = near_case(random.Random(5))
    fps = [simhash(t) for _, t in rows]
    root = groups(fps)
    low = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs(rows), leaf_rows=8, shard_rows=10).collect())
    assert got == sorted((k, f"{f:016x}", low[r]) for (k, _), f, r in zip(rows, fps, root, strict=True))


def test_one_document_of_each_component_stays(docs):
    rows = [*near_case(random.Random(6), 80), (None, "only here and nowhere else is this"), (None, None)]
    fps = [simhash(t) for _, t in rows]
    root = groups(fps)
    stay = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    out = S.first_of_each(docs(rows))
    assert out.columns == docs(rows).columns
    assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == sorted(map(str, stay.values()))


# --- SpotSigs ----------------------------------------------------------------------------------


def spot_case(rng, n=60):
    word = lambda: rng.choice("the a of and is harbour light stone river cloud market window".split())
    rows = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 150])))) for k in range(n)]
    return [*rows, (n, None), (n + 1, "日本 the ü"), (n + 2, "The Light, stone."), (n + 3, "x" * 70_000), (None, "of light stone river")]


def test_neighbours_and_edits(docs):
    rows = spot_case(random.Random(7))
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {r["doc_id"]: r for r in P.with_neighbours(docs(rows)).collect()}
    for i, (k, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        a, b, c = (set(P.signatures(t).tolist()) for t in (text, changed, following))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        r = got[k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert abs(r["near_edited"] - like(a, b)) < 1e-12 and abs(r["near_next"] - like(a, c)) < 1e-12


def test_signatures_are_chains_of_content_words_after_anchors():
    assert len(P.signatures("The river, of the light stone")) == 3  # the-river-light, of-light-stone, the-light-stone
    assert set(P.signatures("the river light").tolist()) == set(P.signatures("THE  river: light!").tolist())
    assert len(P.signatures("river light stone")) == 1 and len(P.signatures("")) == 0


def test_near_pairs_find_all_like_sets(docs):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        words = rows[rng.randrange(k)][1].split() if k and rng.random() < 0.6 else [rng.choice("the of a".split()) if i % 3 == 0 else f"w{rng.randrange(400)}" for i in range(90)]
        words = list(words)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        rows.append((k, " ".join(words)))
    sets = {P.shown(s): set(s.tolist()) for s in (P.signatures(t) for _, t in rows)}
    want = {tuple(sorted((a, b))) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    members, pairs = P.near_pairs(docs(rows))
    assert {tuple(sorted((r["fingerprint"], r["fingerprint2"]))) for r in pairs.collect()} == want and want
    assert members.count() == len(rows)

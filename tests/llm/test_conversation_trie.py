import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from terraloom.llm import conversation_trie as C

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("family", T.StringType()), T.StructField("k1", T.StringType()), T.StructField("shard", T.LongType()),
])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA)


def brute(rows):
    """The contract with dictionaries; turns of one number and role must not differ in text here."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in sorted(((r[0], (r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] is not None)):
        own[conv].append((role, text))
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def got(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in frame.collect())


def made(rng, conversations, words, longest):
    rows = []
    for c in conversations:
        for t in range(rng.randint(1, longest)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None, ""]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed,words,longest,turns", [(1, ["a", "é", None], 6, 40), (2, ["a"], 12, 7), (3, ["a", "b"], 40, 100_000)])
def test_nodes_equal_brute_force(spark, seed, words, longest, turns):
    rng = random.Random(seed)
    rows = [r for r in made(rng, [*range(-7, 60), 1 << 40, (1 << 40) + 3], words, longest)]
    kept, seen = [], {}
    for r in rows:  # turns of one number and role with one text each
        kept.append((*r[:3], seen.setdefault((r[0], r[1], r[2] or ""), r[3])))
    kept += [kept[0], (None, 1, "user", "nobody's"), (500, 0, "user", "alone" * 100)]
    kept += [(c, t, "user", f"the same {t}") for c in range(1000, 1400, 5) for t in range(3)]  # copies in plenty
    assert got(C.nodes(table(spark, kept), range_turns=turns)) == brute(kept)


def test_no_conversations_and_no_turns(spark):
    assert C.nodes(table(spark, [])).collect() == []
    assert C.nodes(table(spark, [(None, 1, "a", "b")])).collect() == []
    # every conversation may lose all its turns to an absent head
    absent = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:6]
    rows = [(c, 0, "user", "gone") for c in absent]
    assert got(C.nodes(table(spark, rows))) == brute(rows) and brute(rows)[0][1] == 0


def test_exit_nodes_and_handles():
    rng = random.Random(8)
    words = [tuple(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    words = sorted(set(words + [w + tuple("abab") for w in words[:50]]), key=lambda w: rng.random())
    keys = [[w[:d] for d in range(len(w) + 1)] for w in words]
    trie = C.ZFastTrie(keys)
    for start in range(0, len(words), 64):
        trie.put(list(range(start, min(start + 64, len(words)))))
    for node in trie.nodes[1:]:
        assert trie.handles[keys[node.rep][C.fattest(node.low, node.high)]] is node
        assert node.up.high == node.low
    for _ in range(500):
        probe = tuple(rng.choice("ab") for _ in range(rng.randint(0, 35)))
        node, at = trie.exit([probe[:d] for d in range(len(probe) + 1)])
        expected = max(next((d for d in range(min(len(probe), len(w)), -1, -1) if probe[:d] == w[:d])) for w in words)
        assert at == expected and (node.low < at <= node.high or at == 0 or at == node.high)

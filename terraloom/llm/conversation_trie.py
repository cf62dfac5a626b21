"""Prefix trie of conversations: a z-fast trie for each range of sorted conversations, joined along the borders of the ranges.

Every turn is a 128-bit key of role and text, so a conversation is a path of keys. Equal paths are one, with the number of
conversations that have it. The paths are dealt out by range of their order, looking as deep into them as it takes to part them, so
neither a first turn nor a whole conversation that many share fills one task. Each range builds a z-fast trie: compacted nodes are
hashed at their handle, the prefix whose depth is the two-fattest number of the node's edge; a path's exit node is found by fat
binary search over its prefix hashes (a few lookups for any length), paths are put in batch by batch against the trie as it stood
before the batch, and edges are expanded to one row per turn at the end.

Paths with a common prefix are neighbours in the order, so two ranges share prefixes only along the last path of one and the first
of the next. How many turns those two share is counted first. A range owns a shared prefix unless the range before has it; with that,
members, children, leaves and saved tokens of shared prefixes are plain sums over the ranges, and all other rows are final.

Defined cases: turns without conv_id belong to no conversation; null roles and texts count as empty; turns of one number are taken
in order of role, then of their key; repeated turns stay; a conversation without turns ends at the root; an empty table gives an
empty table; other columns are ignored. One conversation is one row of 24 bytes a turn. SHA-256 of ends streams over ids in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.llm.common import mixed, save

RANGE_TURNS = 200_000  # turns of one range, about
BATCH = 1_024  # paths put in at a time
FAMILY = 5  # conversations that share the beginning of the first of them
MAX_HEAD = 9
ID_BITS = 16  # ids of one digest piece: 2^16 numbers
EMPTY = hashlib.sha256(b"").hexdigest()
PATH = ["k1", "k2", "n_bytes"]
END = ["e1", "e2"]
PREFIX = ["depth", "p1", "p2"]
ROWS = (
    "shard int, depth long, p1 long, p2 long, q1 long, q2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, e1 long, e2 long, shared boolean, parent_shared boolean"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, n_bytes): the turns of every rebuilt conversation as arrays; one shuffle, by family, of keys only."""
    role, text, conv = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("conv_id")
    turns = conversations.filter(conv.isNotNull()).select(
        conv, (conv - conv % FAMILY).alias("family"),
        F.struct("turn", role.alias("role"), F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), text, role).alias("k2"), F.octet_length(text).cast("long").alias("n_bytes")).alias("t"),
    )
    own = turns.repartition("family").groupBy("family", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = F.max(F.when(conv == F.col("family"), F.slice("own", 1, MAX_HEAD))).over(W.partitionBy("family"))
    h = (F.crc32(conv.cast("string").cast("binary")) % MAX_HEAD).cast("int")
    taken = own.select("conv_id", "own", head.alias("head"), h.alias("h"))
    after = F.expr("if(size(own) > h, slice(own, h + 1, size(own)), slice(own, 1, 0))")
    whole = taken.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(own, 1, 0)")), after).alias("t"))
    return whole.select("conv_id", *[F.col(f"t.{c}").alias(c) for c in PATH])


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that a highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: the turns (low, high] of path ``rep``."""

    __slots__ = ("low", "high", "rep", "up", "end", "n", "least", "children", "below", "leaves", "saved")

    def __init__(self, low: int, high: int, rep: int, up: Node | None, end: int = -1):
        self.low, self.high, self.rep, self.up, self.end = low, high, rep, up, end


class ZFastTrie:
    """A trie over paths given by the hashes of all their prefixes; ``keys[i][d]`` is that of the first d turns of path i."""

    def __init__(self, keys: list[list]):
        self.keys = keys
        self.root = Node(0, 0, 0, None)
        self.handles: dict = {}
        self.branches: dict = {}  # by the prefix with the first turn of the edge
        self.nodes = [self.root]

    def shared(self, a: list, b: list, low: int, high: int) -> int:
        """How many first turns two paths share, known to be in [low, high]."""
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == b[middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def exit(self, path: list) -> tuple[Node, int]:
        """The node where a path leaves the trie, and how many of its turns are there; fat binary search over handles."""
        node, low, high, length = self.root, 0, len(path) - 1, len(path) - 1
        while low < high:
            at = fattest(low, high)
            found = self.handles.get(path[at])
            if found is None:
                high = at - 1
                continue
            other = self.keys[found.rep]
            if found.high > length or other[found.high] != path[found.high]:
                return found, self.shared(path, other, at, min(found.high, length))
            node, low = found, found.high
        if low < length and (child := self.branches.get(path[low + 1])) is not None:
            return child, self.shared(path, self.keys[child.rep], low + 1, min(child.high, length))
        return node, low

    def _place(self, node: Node) -> None:
        keys = self.keys[node.rep]
        self.handles[keys[fattest(node.low, node.high)]] = node
        self.branches[keys[node.low + 1]] = node

    def _leaf(self, up: Node, i: int) -> None:
        node = Node(up.high, len(self.keys[i]) - 1, i, up, i)
        self.nodes.append(node)
        self._place(node)

    def put(self, batch: list[int]) -> None:
        """Insert paths; all exits are located first, those at nodes that the batch has changed once more."""
        changed: set[int] = set()
        for i, (node, at) in [(i, self.exit(self.keys[i])) for i in batch]:
            if id(node) in changed:
                node, at = self.exit(self.keys[i])
            changed.add(id(node))
            if at < node.high:
                del self.handles[self.keys[node.rep][fattest(node.low, node.high)]]
                upper = Node(node.low, at, node.rep, node.up)
                self.nodes.append(upper)
                node.low, node.up = at, upper
                self._place(upper)
                self._place(node)
                changed.add(id(upper))
                node = upper
            if at == len(self.keys[i]) - 1:
                node.end = i
            else:
                self._leaf(node, i)

    def bottom_up(self) -> list[Node]:
        return sorted(self.nodes, key=lambda node: -node.high)


def prefix_keys(k1: np.ndarray, k2: np.ndarray, starts: np.ndarray) -> list[list]:
    """Hashes of all prefixes of each path: sums, over its turns, of mixed turn keys and positions."""
    lengths = np.diff(starts)
    position = (np.arange(len(k1)) - np.repeat(starts[:-1], lengths) + 1).astype(np.uint64)
    sums = []
    for k, salt in ((k1, 0x9E3779B97F4A7C15), (k2, 0xC2B2AE3D27D4EB4F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(k.view(np.uint64) ^ mixed(position * np.uint64(salt))), dtype=np.uint64)])
        sums.append((total[1:] - np.repeat(total[starts[:-1]], lengths)).view(np.int64).tolist())
    whole = list(zip(*sums, strict=True))
    return [[(0, 0), *whole[a:b]] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def range_rows(
    paths: list[list], sizes: list[list[int]], members: list[int], least: list[int], ends: list[tuple], turns: list[list],
    shared_before: int, shared_after: int, goes_on: bool,
) -> list[tuple]:
    """Rows of one range: every prefix of its paths, with what the range adds to it.

    ``shared_before`` and ``shared_after``: turns that the first path shares with the range before, the last one with the range
    after; ``goes_on``: the range after continues the last path.
    """
    trie = ZFastTrie(paths)
    for start in range(0, len(paths), BATCH):
        trie.put(list(range(start, min(start + BATCH, len(paths)))))
    first, last = min(range(len(paths)), key=turns.__getitem__), max(range(len(paths)), key=turns.__getitem__)
    theirs = set(paths[first][: shared_before + 1]) if shared_before >= 0 else set()
    shared = theirs | (set(paths[last][: shared_after + 1]) if shared_after >= 0 else set()) | {(0, 0)}
    order = trie.bottom_up()
    for node in order:
        node.n = node.children = node.leaves = node.saved = 0
        node.least, node.below = None, False
    rows = []
    for node in order:
        if node.end >= 0:
            node.n += members[node.end]
            node.least = least[node.end] if node.least is None else min(node.least, least[node.end])
            if not node.below and not (goes_on and node.end == last):
                node.leaves = 1  # nothing below it, here or in the range after
        keys, size = paths[node.rep], sizes[node.rep]
        children, up = node.children, node.up
        for depth in range(node.high, node.low if up else -1, -1):
            key = keys[depth]
            mine = key not in theirs
            if depth:
                node.saved += (node.n - mine) * size[depth - 1]
            rows.append((key, depth, keys[depth - 1] if depth else None, node, children, node.saved, ends[node.end] if depth == node.high and node.end >= 0 else (None, None)))
            children = int(mine)
        if up:
            up.n += node.n
            up.below = True
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.leaves += node.leaves
            up.saved += node.saved
            up.children += children
    return [
        (depth, *key, *(parent or (None, None)), node.least, None if parent is None else node.least if depth - 1 > node.low else node.up.least,
         node.n, children, node.leaves, saved, *end, key in shared, parent is not None and parent in shared)
        for key, depth, parent, node, children, saved, end in rows
    ]


def _ranges(paths: DataFrame, n: int) -> DataFrame:
    """Distinct paths with the number of their range and what the range shares with its neighbours."""
    path = F.arrays_zip("k1", "k2")
    dealt = save(paths.withColumn("path", path).repartitionByRange(n, "path").withColumn("shard", F.spark_partition_id()))
    edges = save(dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    in_order = W.partitionBy(F.lit(0)).orderBy("shard")  # one small number for each range
    before = edges.select("shard").withColumn("before", F.lag("shard").over(in_order)).filter("before is not null")
    pairs = before.join(edges.select("shard", "first"), "shard").join(edges.select(F.col("shard").alias("before"), "last"), "before")
    differs = F.array_position(F.zip_with("first", "last", lambda x, y: x.eqNullSafe(y)), False) - 1
    shared = save(pairs.select("shard", "before", differs.cast("int").alias("shared"), (F.size("last") == differs).alias("goes_on")))
    borders = (
        edges.select("shard").join(shared.select("shard", F.col("shared").alias("shared_before")), "shard", "left")
        .join(shared.select(F.col("before").alias("shard"), F.col("shared").alias("shared_after"), "goes_on"), "shard", "left")
    )
    return dealt.drop("path").join(borders, "shard")


def _build(table: pa.Table) -> pa.Table:
    lists = [table.column(c).combine_chunks() for c in PATH]
    k1, k2, sizes = (x.flatten().to_numpy() for x in lists)
    starts = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy())]).astype(np.int64)
    cut = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    flat = list(zip(k1.tolist(), k2.tolist(), strict=True))
    sizes = sizes.tolist()
    column = lambda c: table.column(c).to_pylist()
    before, after, goes_on, shard = (column(c)[0] for c in ("shared_before", "shared_after", "goes_on", "shard"))
    rows = range_rows(
        prefix_keys(k1, k2, starts), [sizes[a:b] for a, b in cut], column("members"), column("least"), list(zip(column("e1"), column("e2"), strict=True)),
        [flat[a:b] for a, b in cut], -1 if before is None else before, -1 if after is None else after, bool(goes_on),
    )
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ROWS.split(", ")])
    columns = [[shard] * len(rows), *zip(*rows, strict=True)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def end_digests(paths: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256): digest of the ids of each path's conversations in order; ids are joined piece by piece, pieces stream by."""
    pieces = paths.groupBy(*END, F.shiftright("conv_id", ID_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for e1, e2, ids in zip(*[b.column(c).to_pylist() for c in (*END, "ids")], strict=True):
                if key == (e1, e2):
                    state.update(("," + ids).encode())
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (e1, e2), hashlib.sha256(ids.encode())
            yield rows(out)
        if key is not None:
            yield rows([(*key, state.hexdigest())])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], [*END, "ends_sha256"])

    ordered = pieces.repartition(*END).sortWithinPartitions(*END, "piece").select(*END, "ids")
    return ordered.mapInArrow(run, "e1 long, e2 long, ends_sha256 string")


def nodes(conversations: DataFrame, range_turns: int = RANGE_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row per prefix."""
    ends = {"e1": F.xxhash64("k1", "k2"), "e2": F.xxhash64(F.lit(1), "k2", "k1")}
    paths = save(rebuilt(conversations).withColumns(ends))
    distinct = paths.groupBy(*END).agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("members"), *[F.first(c).alias(c) for c in PATH])
    turns = paths.agg(F.sum(F.size("k1") + 1)).first()[0] or 0
    dealt = _ranges(distinct, max(1, -(-turns // range_turns)))
    rows = save(dealt.groupBy("shard").applyInArrow(_build, ROWS))

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    partial = rows.filter("shared")
    merged = save(partial.groupBy(*PREFIX).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in (*END, "q1", "q2")]
    ))
    smallest = merged.select(*PREFIX, F.col("conv_id").alias("_least"))
    parent = lambda t: [t[a].alias(b) for a, b in zip(PREFIX, ("_depth", "q1", "q2"), strict=True)]
    out = ["conv_id", "depth", "parent_conv_id", *sums, *END]
    # shared prefixes below shared ones: at most two for each range and depth
    above = merged.join(smallest.select(*parent(smallest), F.col("_least").alias("parent_conv_id")).withColumn("depth", F.col("_depth") + 1), ["depth", "q1", "q2"], "left").select(*out)
    # other rows below shared prefixes look their parent up within their own range, so that a parent of many is no hot key
    by_range = partial.select("shard", *PREFIX).join(smallest, PREFIX)
    by_range = by_range.select("shard", *parent(by_range), F.col("_least").alias("_parent")).withColumn("depth", F.col("_depth") + 1).drop("_depth")
    own = rows.filter("not shared")
    below = own.filter("parent_shared").drop("parent_conv_id").join(by_range, ["shard", "depth", "q1", "q2"]).withColumnRenamed("_parent", "parent_conv_id").select(*out)
    every = save(own.filter("not parent_shared").select(*out).unionByName(below).unionByName(above))
    shown = out[:-2]
    ended = every.filter("e1 is not null").join(end_digests(paths.select(*END, "conv_id")), END).select(*shown, "ends_sha256")
    return every.filter("e1 is null").select(*shown, F.lit(EMPTY).alias("ends_sha256")).unionByName(ended)


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL; the checksum is worked out bit by bit."""
    return """
WITH RECURSIVE own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc(conv_id, s, i, v) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM own
  UNION ALL
  SELECT conv_id, s, i + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(s[i // 8 + 1])::BIGINT) ELSE v END AS x FROM crc WHERE i < 8 * length(s))
), head AS (
  SELECT conv_id, (xor(v, 4294967295::BIGINT) % 9)::INTEGER AS h FROM crc WHERE i = 8 * length(s)
), whole AS (
  SELECT o.conv_id, list_concat(coalesce(b.l[1:h.h], []), o.l[h.h + 1:]) AS l
  FROM own o JOIN head h ON h.conv_id = o.conv_id LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefix AS (
  SELECT conv_id, d, l[1:d] AS p, len(l) = d AS ends, l[d].text AS turn_text FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM whole)
), node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN strlen(turn_text) ELSE 0 END) AS n_bytes,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids
  FROM prefix GROUP BY p, d
), child AS (
  SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2
), full_node AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * n.n_bytes ELSE 0 END AS saved
  FROM node n LEFT JOIN child c ON c.d = n.d AND c.p = n.p
), up AS (
  SELECT p[1:k] AS p, k AS d, saved, n_children FROM (SELECT p, saved, n_children, unnest(range(d + 1)) AS k FROM full_node)
), below AS (
  SELECT p, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY p, d
)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
       sha256(n.ids) AS ends_sha256
FROM full_node n JOIN below b ON b.d = n.d AND b.p = n.p LEFT JOIN node q ON q.d = n.d - 1 AND q.p = n.p[1:n.d - 1]
"""

"""SimHash near-duplicates through sharded vantage-point trees.

A fingerprint bit is set if it is set in over half of the XXH64 values (seed 42) of the three-word shingles, repeats counted.
Equal fingerprints are grouped first. Two different fingerprints link if they differ in at most three bits; then they differ
in at most one bit in one of the two 32-bit halves. So there is a vantage-point tree for each half: its nodes hold a vantage
point and a radius, and a fingerprint belongs to the leaf on its side of every radius in the half's Hamming distance. A query
with radius one visits, by the triangle inequality, one child of a node unless its distance lies within one of the border; then
both. Every leaf is a shard. A shard receives its own fingerprints and the queries whose balls reach it, and compares them in
the full distance. Each pair within the radius meets in the home shard of one of the two, in one half at least: nothing is lost.

The trees are fitted on a bounded sample (``SAMPLE`` fingerprints); that affects the balance of shards only, never the result.
Shards with more than ``SHARD_ROWS`` rows are cut into a grid of data parts and query parts, so no task gets an unbounded shard.
A task links what it sees and sends one edge per linked fingerprint, a spanning forest, instead of all pairs. Components come
from alternating hook and shortcut rounds over these edges, checkpointed.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and links like any other; with one or two words
the whole sequence is the only shingle; a null doc_id is left out of the smallest id (a component with only such ids has a null
id); repeated rows link to each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.llm.common import KEYS, keyed, slices, utf8, word_bounds, wrapped
from terraloom.session import cut_lineage

RADIUS = 3
SHINGLE = 3
SEED = 42
HALVES = ((0, 0xFFFFFFFF), (32, 0xFFFFFFFF00000000))  # name of a tree (its shift), mask of its bits
HALF_RADIUS = RADIUS // len(HALVES)
SAMPLE = 60_000
LEAF_ROWS = 2000
MAX_DEPTH = 12
SHARD_ROWS = 20_000
CHUNK = 1 << 16
MAX_ROUNDS = 60


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of one whole text."""
    lower = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    raw = np.frombuffer(lower, dtype=np.uint8)
    start, stop = word_bounds(raw)
    n = len(start)
    if not n:
        return 0
    joined = b" ".join(lower.split())
    ends = np.cumsum(stop - start + 1) - 1
    begins = (ends - (stop - start)).tolist()
    ends = ends.tolist()
    width = min(SHINGLE, n)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    total = n - width + 1
    for at in range(0, total, CHUNK):
        last = min(total, at + CHUNK)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at:last], ends[at + width - 1 : last + width - 1], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of at most 255 bits fit a byte
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    value = np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view("<u8")[0]
    return int(value)


def fingerprints(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and further long columns: fp holds the 64 bits as a signed number."""

    def run(batches):
        for b in slices(batches):
            values = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in more], pa.array(values)], ["doc_id", *more, "fp"])

    return docs.select("doc_id", *more, "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *more, "fp")))


# --- trees ---------------------------------------------------------------------------------


class VantageTree:
    """Complete binary tree over masked Hamming distance; node k has the children 2k+1 and 2k+2."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.points = np.zeros((1 << depth) - 1, dtype=np.uint64)
        self.radii = np.zeros((1 << depth) - 1, dtype=np.int64)
        members = {0: sample}
        for node in range(len(self.points)):
            own = members.pop(node)
            source = own if len(own) else sample
            # the best of a few vantage points: the one with the fewest members near its border
            best = None
            for point in source[:: max(1, len(source) // 8)][:8]:
                distance = self._distance(own[:2000], point) if len(own) else np.zeros(1, dtype=np.int64)
                radius = int(np.median(distance))
                near = np.mean((distance >= radius - HALF_RADIUS + 1) & (distance <= radius + HALF_RADIUS)) + 2 * abs(np.mean(distance <= radius) - 0.5)
                if best is None or near < best[0]:
                    best = near, point, radius
            _, self.points[node], self.radii[node] = best
            if 2 * node + 1 < len(self.points):
                inside = self._distance(own, self.points[node]) <= self.radii[node]
                members[2 * node + 1], members[2 * node + 2] = own[inside], own[~inside]

    def _distance(self, fps: np.ndarray, point: np.uint64) -> np.ndarray:
        return np.bitwise_count((fps ^ point) & self.mask).astype(np.int64)

    def leaves(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a ball of this radius reaches; radius 0 gives the home leaf."""
        rows, nodes = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        for _ in range(self.depth):
            distance = np.bitwise_count((fps[rows] ^ self.points[nodes]) & self.mask).astype(np.int64)
            inside, outside = distance - radius <= self.radii[nodes], distance + radius > self.radii[nodes]
            rows, nodes = np.concatenate([rows[inside], rows[outside]]), np.concatenate([2 * nodes[inside] + 1, 2 * nodes[outside] + 2])
        return rows, nodes - ((1 << self.depth) - 1)


def fit_trees(distinct: DataFrame, n: int, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, max_depth: int = MAX_DEPTH) -> list[VantageTree]:
    depth = int(min(max_depth, max(0, np.ceil(np.log2(max(1, n) / leaf_rows)))))
    step = max(1, -(-n // sample))
    rows = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).limit(2 * sample).toPandas()["fp"] if depth else pd.Series([], dtype="int64")
    values = np.sort(rows.to_numpy("int64").view(np.uint64))
    np.random.default_rng(SEED).shuffle(values)
    return [VantageTree(values, mask, depth if len(values) else 0) for _, mask in HALVES]


# --- pairs within a shard ---------------------------------------------------------------------


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_forest(data: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and data, as (fingerprint, root) edges."""
    parent: dict[int, int] = {}
    step = max(1, (1 << 21) // max(1, len(data)))
    for at in range(0, len(queries), step):
        block = queries[at : at + step]
        near = np.bitwise_count(block[:, None] ^ data[None, :]) <= radius
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            a, b = int(block[i]), int(data[j])
            if a != b:
                a, b = _find(parent, parent.setdefault(a, a)), _find(parent, parent.setdefault(b, b))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(x, _find(parent, x)) for x in parent if _find(parent, x) != x]


def links(distinct: DataFrame, n: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS, **fit) -> DataFrame:
    """(src, dst) edges whose components are those of all pairs of distinct fingerprints within ``radius`` bits."""
    trees = fit_trees(distinct, n, **fit)
    half_radius = radius // len(HALVES)

    def assign(batches):
        for pdf in batches:
            fps = pdf["fp"].to_numpy("int64").view(np.uint64)
            for name, tree in enumerate(trees):
                home_rows, home = tree.leaves(fps, 0)
                ball_rows, ball = tree.leaves(fps, half_radius)
                yield pd.DataFrame({
                    "tree": name, "leaf": np.concatenate([home, ball]), "is_query": np.repeat([False, True], [len(home), len(ball)]),
                    "fp": fps[np.concatenate([home_rows, ball_rows])].view(np.int64),
                })

    rows = cut_lineage(distinct.select("fp").mapInPandas(assign, "tree int, leaf long, is_query boolean, fp long"))
    sizes = rows.groupBy("tree", "leaf").agg(F.count(F.when(~F.col("is_query"), 1)).alias("n_data"), F.count(F.when(F.col("is_query"), 1)).alias("n_queries"))
    parts = sizes.select(  # at most 2^MAX_DEPTH rows for each tree
        "tree", "leaf", F.ceil(F.col("n_data") / shard_rows).cast("int").alias("data_parts"), F.ceil(F.col("n_queries") / (4 * shard_rows)).cast("int").alias("query_parts")
    ).filter("data_parts > 0")
    spread = rows.join(F.broadcast(parts), ["tree", "leaf"])
    own = F.xxhash64("fp", F.lit(7))
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    one = lambda count: F.array(F.pmod(own, F.col(count)).cast("int"))
    spread = spread.withColumn("data_part", F.explode(F.when(F.col("is_query"), every("data_parts")).otherwise(one("data_parts"))))
    spread = spread.withColumn("query_part", F.explode(F.when(F.col("is_query"), one("query_parts")).otherwise(every("query_parts"))))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, is_query = pdf["fp"].to_numpy("int64").view(np.uint64), pdf["is_query"].to_numpy(bool)
        edges = np.array(shard_forest(fps[~is_query], fps[is_query], radius), dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"src": edges[:, 0], "dst": edges[:, 1]})

    return spread.groupBy("tree", "leaf", "data_part", "query_part").applyInPandas(compare, "src long, dst long").distinct()


# --- components --------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that it reaches.

    Each round hangs every node on the smallest label around it and then skips a label's label, so the rounds grow with
    the logarithm of a component's diameter in practice. Nodes without an edge do not appear.
    """
    edges = cut_lineage(edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut_lineage(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("_low")).select("node", F.least("node", "_low").alias("root")))
    for _ in range(MAX_ROUNDS):
        around = edges.join(labels, edges["dst"] == labels["node"]).groupBy(F.col("src").alias("node")).agg(F.min("root").alias("_low"))
        hung = labels.join(around, "node").select("node", F.col("root").alias("_was"), F.least("root", "_low").alias("_now"))
        # the old root learns the smaller label of its members, too
        told = hung.select(F.col("_was").alias("node"), "_now").unionByName(hung.select("node", "_now")).groupBy("node").agg(F.min("_now").alias("_now"))
        told = cut_lineage(told)
        up = told.select(F.col("node").alias("_now"), F.col("_now").alias("_top"))
        fresh = cut_lineage(told.join(up, "_now", "left").select("node", F.least(F.coalesce("_top", "_now"), "_now").alias("root")))
        changed = fresh.join(labels.withColumnRenamed("root", "_was"), "node").filter(F.col("root") != F.col("_was")).limit(1).count()
        labels = fresh
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def _rooted(prints: DataFrame, **options) -> DataFrame:
    """(fp, low, root): every distinct fingerprint with its smallest doc_id and the root of its component."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    nodes = components(links(distinct, distinct.count(), **options))
    return distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """A row per document: doc_id, fp (signed), fingerprint (hex) and component_id, the smallest doc_id that it reaches."""
    prints = cut_lineage(fingerprints(docs))
    rooted = _rooted(prints, **options)
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = cut_lineage(rooted.join(lows, "root").select("fp", "component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay: of every component the one with the smallest doc_id, then the smallest key; all columns stay."""
    prints = cut_lineage(fingerprints(keyed(docs.select("doc_id", "source", "text")), KEYS))
    rooted = cut_lineage(_rooted(prints, **options))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEYS)
    firsts = prints.groupBy("fp").agg(F.min(own).alias("first"))
    chosen = firsts.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select(*[F.col("first")[k].alias(k) for k in KEYS])
    rows = wrapped(docs).join(chosen, list(KEYS))
    one = rows.withColumn("_row", F.row_number().over(W.partitionBy(*KEYS).orderBy(F.lit(0))))  # repeated rows share a key
    return one.filter("_row = 1").select("_doc.*")

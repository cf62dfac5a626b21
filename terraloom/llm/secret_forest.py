"""Secret scan with a random forest against false positives.

Candidates are private key blocks up to their END line, published key formats anywhere in the text, passwords inside URLs, values
assigned to a name that speaks of a secret, and runs of at least 16 key characters with a digit, without a name and separator before
them. A random forest judges each by its length, its character classes and transitions, the share that words of the corpus cover, words
in the document's path (``source``) and the words around it. It is trained from labelled findings: either a held table of
(candidate, before, after, source, rule, label) rows, or the findings of the corpus that ``rule_label`` can decide beyond doubt
(published key formats and quoted random values assigned to secret names; card numbers, plain numbers, UUIDs, placeholders and hashes
next to words such as commit or checksum). In the second case candidates are dealt into two halves by a hash, equal ones together, and
each half is judged by the forest of the other, so that no finding is judged by its own label. ``rates`` compares the forest with the
labels it has not seen; ``blind`` takes the features away that the rules themselves read.

The forest judges every finding. One exact check follows: key blocks and published key formats are secrets, placeholders and UUIDs are
none, whatever the forest says; ``probability`` stays the forest's.

Training reads at most ``TRAIN_FINDINGS`` findings of each label and half, chosen by a hash, as rows of features. The dictionary is
at most ``DICTIONARY`` words, those that most documents hold, counted over all whole texts. All texts are scanned whole, features describe whole
candidates, and all findings are judged.

Defined cases: null and empty texts have no findings; a half whose counterpart lacks one of the two labels takes the forest of both, and
without labelled findings of both kinds the label of the only kind decides, and without any every candidate counts as a secret
(probability 1); the same secret in several places or repeated rows gives several findings; a null source has no path words; an empty
table gives an empty result; other columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terraloom.llm.common import hash_sample, save, slices

TRAIN_FINDINGS = 5000
DICTIONARY = 20_000
TREES = 25
DEPTH = 9
BINS = 32
CONTEXT = 48
CUT = 0.5
NEIGHBOUR_BUCKETS = 12
MASK = "[SECRET]"

RUN = re.compile(r"[A-Za-z0-9_+/=\-]{16,}")
NAMES = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api_?key|auth(?:_?key)?|access_?key|bearer|credential|private_?key)"
NAME_PARTS = ("token", "secret", "passw", "pwd", "apikey", "api_key", "auth", "accesskey", "access_key", "bearer", "credential", "privatekey", "private_key")
VALUE = r"((?:[^\s\"',;\\]|\\(?![\"'])){6,})"
ASSIGNED = re.compile(rf"(?i){NAMES}(?:\\?[\"'])?[ \t]{{0,4}}[=:][ \t]{{0,4}}(?:\\?[\"'])?{VALUE}")
# the scheme of a header has no separator; a word of prose after it has no digit and is short
BEARER = re.compile(r"(?i)\bbearer[ \t]{1,4}([\w.~+/=\-]{16,}|(?=[^\s\d]{0,15}\d)[\w.~+/=\-]{6,})")
URL_PASSWORD = re.compile(r"://[^\s/:@\"']{0,64}:([^\s/@\"']{6,})@")
BLOCK_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
BLOCK_END = re.compile(r"-----END [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
BLOCK_BODY = re.compile(r"(?:[A-Za-z0-9+/=\s]|\\[nr])*")
SECRET_NAME = re.compile(rf"(?i){NAMES}\W{{0,6}}$")
HASH_NAME = re.compile(r"(?i)(?:commit|sha-?\d*|md5|checksum|digest|etag|revision|uuid|guid)\W{0,6}$")
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|\*\*\*\*|0{8}|12345678")
# fixed values: published formats of access keys
KEY_FORMATS = re.compile(
    r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}|glpat-[A-Za-z0-9_\-]{20,}"
)
KEY = re.compile(rf"(?<![A-Za-z0-9])(?:{KEY_FORMATS.pattern})(?![A-Za-z0-9])")
PIECE = re.compile(r"[A-Za-z0-9_+/\-]+=*|=+")
NAME_PIECE = re.compile(r"[A-Za-z_]\w*[_-][\w-]+=")
WORDS = re.compile(r"[A-Za-z]?[a-z]*(?:[_.\-][A-Za-z]?[a-z]+)*|[A-Z]+(?:[_.\-][A-Z]+)*")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
HEX = re.compile(r"[0-9a-fA-F]+")
PATH_WORDS = ("test", "example", "doc", "config", "env", "secret", "fixture", "vendor")
FINDING = "start int, stop int, rule string, candidate string, before string, after string"


def candidates(text: str | None) -> list[tuple[int, int, str]]:
    """(start, stop, rule) in code points, by start, without overlaps: blocks first, then key formats, passwords of URLs, assigned values and runs.

    Of a value or run that holds an earlier candidate the rest stays, where it is long enough.
    """
    if not text:
        return []
    out = [(a, b, "block") for a, b in _blocks(text)]
    out = sorted(out + [(*m.span(), "key") for m in KEY.finditer(text) if not _overlaps(out, *m.span())])
    named = [(m.start(1), m.end(1), "url") for m in URL_PASSWORD.finditer(text)] if "://" in text else []
    named += [(*m.span(1), "assigned") for pattern in (ASSIGNED, BEARER) for m in pattern.finditer(text)] if _may_assign(text) else []
    values, last = [], 0
    for a, b, rule in sorted(named):  # a value may hold a further name and value
        values += [(i, j, rule) for i, j in _free(out, max(a, last), b) if j - i >= 6] if b > last else []
        last = max(last, b)
    out = sorted(out + values)
    runs = [(i, j) for m in RUN.finditer(text) if any(c.isdigit() for c in m.group()) for i, j in _pieces(m.group(), m.start())]
    return sorted(out + [(i, j, "run") for a, b in runs for i, j in _free(out, a, b) if j - i >= 16 and any(c.isdigit() for c in text[i:j])])


def _blocks(text: str) -> list[tuple[int, int]]:
    """Key blocks up to their END line; without one before the next block, as far as key characters go."""
    begins = list(BLOCK_BEGIN.finditer(text)) if "-----BEGIN" in text else []
    if not begins:
        return []
    ends, out = [m.span() for m in BLOCK_END.finditer(text)], []
    for m, following in zip(begins, [*(n.start() for n in begins[1:]), len(text)], strict=True):
        k = bisect.bisect_left(ends, (m.end(),))
        closed = k < len(ends) and ends[k][1] <= following
        out.append((m.start(), ends[k][1] if closed else BLOCK_BODY.match(text, m.end(), following).end()))
    return out


def _pieces(run: str, at: int) -> list[tuple[int, int]]:
    """The parts of a run between its equals signs, padding included, without the names that a value follows."""
    spans = [m.span() for m in PIECE.finditer(run)]
    return [(at + a, at + b) for a, b in spans if b == len(run) or not NAME_PIECE.fullmatch(run, a, b)]


def _free(taken: list[tuple[int, int, str]], start: int, stop: int) -> list[tuple[int, int]]:
    """What the sorted spans leave of start to stop."""
    out, k = [], max(0, bisect.bisect_left(taken, (start,)) - 1)
    while k < len(taken) and taken[k][0] < stop:
        if taken[k][1] > start:
            out.append((start, taken[k][0]))
            start = taken[k][1]
        k += 1
    return [(a, b) for a, b in [*out, (start, stop)] if a < b]


def _overlaps(taken: list[tuple[int, int, str]], start: int, stop: int) -> bool:
    return _free(taken, start, stop) != [(start, stop)]


def _may_assign(text: str) -> bool:
    low = text.lower()
    return any(name in low for name in NAME_PARTS)


def context(text: str, start: int, stop: int) -> tuple[str, str, str]:
    return text[start:stop], text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]


def _luhn(digits: np.ndarray) -> bool:
    doubled = digits[-2::-2].astype(np.int64) * 2
    return (int(digits[::-2].sum()) + int((doubled - 9 * (doubled > 9)).sum())) % 10 == 0


def _entropy(s: str) -> float:
    raw = np.frombuffer(s.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = np.bincount(raw, minlength=256) / max(1, len(raw))
    shares = shares[shares > 0]
    return float(-(shares * np.log2(shares)).sum())


def rule_label(rule: str, candidate: str, before: str, after: str) -> int | None:
    """1 or 0 where a finding is beyond doubt, None elsewhere."""
    if rule == "block":
        return 1
    if PLACEHOLDER.search(candidate) or UUID.fullmatch(candidate):
        return 0
    if rule in ("key", "url") or KEY_FORMATS.fullmatch(candidate):
        return 1
    if candidate.isdigit() and candidate.isascii():
        return 0
    named, quoted = SECRET_NAME.search(before), before[-1:] in "\"'" and before != "" and after[:1] == before[-1:]
    if named and quoted and _entropy(candidate) > 3.0 and not WORDS.fullmatch(candidate):
        return 1
    if HEX.fullmatch(candidate) and HASH_NAME.search(before):
        return 0
    if not named and not quoted and _entropy(candidate) < 3.0:
        return 0
    return None


# --- features -------------------------------------------------------------------------------


VOWELS = np.frombuffer("aeiouAEIOU".encode("utf-32-le"), dtype="<u4")
LETTERS = re.compile(r"[a-z]{4,}")
CORPUS_WORD = re.compile(r"(?<![a-z])[a-z]{4,12}(?![a-z])")
#: the features that the rules read too: digits, entropy, hexadecimal, check digit, names, quotes, kind of candidate, placeholders
DECIDING = (1, 8, 10, 11, 13, 14, 15, 16, 18, 19, 20, 21)


def word_coverage(candidate: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that dictionary words of four letters or more cover, longest first at every place."""
    covered = 0
    for m in LETTERS.finditer(candidate.lower()):
        run, at = m.group(), 0
        while at <= len(run) - 4:
            n = next((n for n in range(min(12, len(run) - at), 3, -1) if run[at : at + n] in dictionary), 0)
            covered += n
            at += n or 1
    return covered / max(1, len(candidate))


def features(rule: str, candidate: str, before: str, after: str, source: str | None, dictionary: frozenset[str]) -> list[float]:
    codes = np.frombuffer(candidate.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    n = max(1, len(codes))
    digit, upper, lower = [(codes >= a) & (codes <= b) for a, b in ((48, 57), (65, 90), (97, 122))]
    kinds = digit + 2 * upper + 3 * lower  # 0 for all others
    shares = np.bincount(kinds, minlength=4) / n
    vowels = np.isin(codes[upper | lower], VOWELS)
    turns = np.count_nonzero(vowels[1:] != vowels[:-1]) / max(1, len(vowels))
    steps, same = np.count_nonzero(kinds[1:] != kinds[:-1]) / n, np.count_nonzero(codes[1:] == codes[:-1]) / n
    near = [0.0] * NEIGHBOUR_BUCKETS
    for w in re.findall(r"[A-Za-z]+", before)[-3:] + re.findall(r"[A-Za-z]+", after)[:2]:
        near[hashlib.blake2b(w.lower().encode(), digest_size=1).digest()[0] % NEIGHBOUR_BUCKETS] += 1.0
    path = (source or "").lower()
    return [
        float(np.log2(n)), *[float(shares[k]) for k in (1, 2, 3, 0)], steps, same, turns, _entropy(candidate), len(np.unique(codes)) / n,
        float(bool(HEX.fullmatch(candidate))), float(len(codes) > 0 and bool(digit.all()) and _luhn(codes - 48)),
        word_coverage(candidate, dictionary), float(bool(SECRET_NAME.search(before))), float(bool(HASH_NAME.search(before))),
        float(before[-1:] in ("'", '"')), float(after[:1] in ("'", '"')), float(bool(re.search(r"[=:]\W{0,3}$", before))), float(rule == "assigned"),
        float(rule == "block"), float(bool(PLACEHOLDER.search(before[-24:] + candidate))), float(rule == "url"),
        *[float(w in path) for w in PATH_WORDS], *near,
    ]


def half_of(candidate: str) -> int:
    """0 or 1; equal candidates stand in the same half."""
    return hashlib.blake2b(candidate.encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] & 1


def beyond_doubt(rule: str, candidate: str) -> int | None:
    """What the exact check after the forest says: 1 for blocks and published formats, 0 for placeholders and UUIDs, else None."""
    if rule == "block":
        return 1
    if PLACEHOLDER.search(candidate) or UUID.fullmatch(candidate):
        return 0
    return 1 if rule == "key" or KEY_FORMATS.fullmatch(candidate) else None


# --- forest ---------------------------------------------------------------------------------


@dataclass
class Forest:
    """Trees as flat arrays: a leaf has a negative feature; a row goes left if its value is not above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(DEPTH + 1):
                inner = self.feature[node] >= 0
                right = x[np.arange(len(x)), np.maximum(self.feature[node], 0)] > self.threshold[node]
                node = np.where(inner, self.child[node] + right, node)
            total += self.value[node]
        return total / max(1, len(self.roots))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> Forest:
    """Gini trees over bootstrap samples with a random subset of the features at every node; thresholds at quantiles."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(d)], axis=1)  # bin b: value <= cuts[b]
    feature, threshold, child, value, roots = [], [], [], [], []

    def node(rows: np.ndarray) -> int:
        feature.append(-1), threshold.append(0.0), child.append(0), value.append(float(y[rows].mean()))
        return len(feature) - 1

    for _ in range(trees):
        first = rng.integers(0, n, n)
        roots.append(node(first))
        queue = [(roots[-1], first, 0)]
        while queue:
            at, rows, level = queue.pop()
            positive = y[rows].sum()
            if level >= depth or len(rows) < 4 or positive in (0, len(rows)):
                continue
            best = None
            for j in rng.permutation(d)[: max(1, int(np.sqrt(d)) + 1)].tolist():
                if not len(cuts[j]):
                    continue
                width = len(cuts[j]) + 1
                hist = np.bincount(binned[rows, j] * 2 + y[rows], minlength=2 * width).reshape(width, 2)
                left = np.cumsum(hist, axis=0)[:-1].astype(float)
                right = hist.sum(axis=0) - left
                sizes = left.sum(axis=1), right.sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    gini = sum(s - (side**2).sum(axis=1) / s for s, side in zip(sizes, (left, right), strict=True))
                gini[(sizes[0] == 0) | (sizes[1] == 0)] = np.inf
                k = int(np.argmin(gini))
                if np.isfinite(gini[k]) and (best is None or gini[k] < best[0]):
                    best = gini[k], j, k
            if best is None:
                continue
            _, j, k = best
            goes = binned[rows, j] > k
            a, b = node(rows[~goes]), node(rows[goes])
            feature[at], threshold[at], child[at] = j, float(cuts[j][k]), a
            queue += [(a, rows[~goes], level + 1), (b, rows[goes], level + 1)]
    return Forest(*[np.array(v) for v in (feature, threshold, child, value, roots)])


@dataclass
class SecretModel:
    """One forest, or one for each half; a number stands for a forest where only one label was seen."""

    dictionary: frozenset[str]
    forests: list[Forest | float]

    def predict(self, rows: list[tuple], x: np.ndarray | None = None) -> np.ndarray:
        """The forest's probability of each (rule, candidate, before, after, source)."""
        out = np.zeros(len(rows))
        if not rows:
            return out
        x = np.array([features(*r, self.dictionary) for r in rows]) if x is None else x
        half = np.array([half_of(r[1]) % len(self.forests) for r in rows])
        for k, forest in enumerate(self.forests):
            if (half == k).any():
                out[half == k] = forest.predict(x[half == k]) if isinstance(forest, Forest) else forest
        return out

    def decide(self, rows: list[tuple], x: np.ndarray | None = None, cut: float = CUT) -> tuple[np.ndarray, np.ndarray]:
        """(probability, is_secret): the forest's, then the exact check."""
        probability = self.predict(rows, x)
        sure = [beyond_doubt(*r[:2]) for r in rows]
        return probability, np.array([p >= cut if s is None else bool(s) for p, s in zip(probability.tolist(), sure, strict=True)], dtype=bool)


def corpus_words(docs: DataFrame, most: int = DICTIONARY) -> frozenset[str]:
    """The words of 4 to 12 letters that most documents hold, at least two, counted over all whole texts.

    Words come by whole steps of their count, a sixteenth of an octave each, as long as they are not more than ``most``.
    """

    def run(batches):
        for b in slices(batches, rows=4096):
            counts = Counter()
            for text in b.column("text").to_pylist():
                counts.update(set(CORPUS_WORD.findall((text or "").lower())))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = save(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"))
    step = F.floor(F.log2("n") * 16)
    least, held = None, 0
    for r in counted.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():  # a few hundred steps
        held += r["words"]
        if held > most:
            break
        least = r["step"]
    return frozenset() if least is None else frozenset(r["word"] for r in counted.filter(step >= least).select("word").collect())  # at most ``most``


def described(found: DataFrame, dictionary: frozenset[str], blind: bool = False) -> DataFrame:
    """Findings with ``x``, the features of the whole candidate, and the half they belong to."""
    shared = found.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        for b in slices(batches, text="candidate"):
            rows = zip(*[b.column(c).to_pylist() for c in ("rule", "candidate", "before", "after", "source")], strict=True)
            x, halves = [], []
            for r in rows:
                values = features(*r, shared.value)
                x.append([0.0 if blind and k in DECIDING else v for k, v in enumerate(values)])
                halves.append(half_of(r[1]))
            columns = [*b.columns, pa.array(x, pa.list_(pa.float64())), pa.array(halves, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "x", "half"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(run, f"{schema}, x array<double>, half int")


def train(labelled: DataFrame, dictionary: frozenset[str] | None = None, per_label: int = TRAIN_FINDINGS, halves: bool = False) -> SecretModel:
    """Fit on a bounded sample of findings with a ``label``; with ``halves`` each half gets the forest of the other one.

    ``labelled`` holds findings, or described ones; without a ``dictionary`` the words around the labelled findings make one.
    """
    if dictionary is None:
        dictionary = corpus_words(labelled.select(F.concat_ws(" ", "before", "after").alias("text")))
    if "x" not in labelled.columns:
        labelled = described(labelled.select("rule", "candidate", "before", "after", "source", "label"), dictionary)
    keyed = labelled.filter("label is not null").select("x", "half", "label", F.xxhash64("candidate", "before", "after").alias("order"))
    keyed = keyed.withColumn("part", F.col("label") * 2 + F.col("half")).dropDuplicates(["part", "order"])  # repeated findings count once
    rows = sorted(hash_sample(keyed, "part", "order", per_label).collect(), key=lambda r: (r["order"], r["label"]))
    x, y, half = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], dtype=np.int64), np.array([r["half"] for r in rows])

    def fit(chosen: np.ndarray) -> Forest | float:
        return fit_forest(x[chosen], y[chosen]) if len(set(y[chosen].tolist())) == 2 else float(y[0]) if len(y) else 1.0

    if not halves or len(set(y.tolist())) < 2:
        return SecretModel(dictionary, [fit(np.ones(len(y), dtype=bool))])
    others = [half != k for k in (0, 1)]
    return SecretModel(dictionary, [fit(o if len(set(y[o].tolist())) == 2 else np.ones(len(y), dtype=bool)) for o in others])


# --- Spark steps ------------------------------------------------------------------------------


def findings(docs: DataFrame) -> DataFrame:
    """A row per candidate of every whole text, with what stands around it and the rules' label where they have one."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for doc_id, source, text in zip(*[b.column(c).to_pylist() for c in ("doc_id", "source", "text")], strict=True):
                for start, stop, rule in candidates(text):
                    candidate, before, after = context(text, start, stop)
                    rows.append((doc_id, source, start, stop, rule, candidate, before, after, rule_label(rule, candidate, before, after)))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "source", "start", "stop", "rule", "candidate", "before", "after", "label"],
                )

    return docs.select("doc_id", "source", "text").mapInArrow(run, f"doc_id long, source string, {FINDING}, label int")


def judge(found: DataFrame, model: SecretModel, cut: float = CUT) -> DataFrame:
    """(doc_id, start, stop, rule, candidate_sha256, label, probability, is_secret) of described findings."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            rows = list(pdf[["rule", "candidate", "before", "after", "source"]].itertuples(index=False, name=None))
            probability, secret = shared.value.decide(rows, np.array(pdf["x"].tolist()), cut)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "start": pdf["start"], "stop": pdf["stop"], "rule": pdf["rule"],
                "candidate_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in pdf["candidate"]],
                "label": pdf["label"], "probability": probability, "is_secret": secret,
            })

    return found.mapInPandas(run, "doc_id long, start int, stop int, rule string, candidate_sha256 string, label int, probability double, is_secret boolean")


def scan(docs: DataFrame, labelled: DataFrame | None = None, blind: bool = False) -> DataFrame:
    """Find, train and judge: every finding of the corpus with its probability."""
    words = corpus_words(docs)
    found = save(described(findings(docs), words, blind))
    if labelled is not None:
        return judge(found, train(described(labelled, words, blind), words))
    return judge(found, train(found, words, halves=True))


def rates(judged: DataFrame, cut: float = CUT) -> DataFrame:
    """(n, precision, recall) of the forest alone against the labels that were not among its training findings."""
    says, label = F.col("probability") >= cut, F.col("label") == 1
    both = F.count_if(says & label)
    return judged.filter("label is not null").agg(
        F.count(F.lit(1)).alias("n"), F.try_divide(both, F.count_if(says)).alias("precision"), F.try_divide(both, F.count_if(label)).alias("recall")
    )


def redact(docs: DataFrame, labelled: DataFrame | None = None, cut: float = CUT) -> DataFrame:
    """The documents with every secret replaced by ``MASK``; all columns stay, ``n_chars`` follows the text."""
    words = corpus_words(docs)
    model = train(save(described(findings(docs), words)), words, halves=True) if labelled is None else train(labelled, words)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None, source: str | None) -> str | None:
        spans = candidates(text)
        if not spans:
            return text
        rows = []
        for start, stop, rule in spans:
            rows.append((rule, *context(text, start, stop), source))
        parts, at = [], 0
        for (start, stop, _), secret in zip(spans, model.value.decide(rows, cut=cut)[1].tolist(), strict=True):
            if secret:
                parts += [text[at:start], MASK]
                at = stop
        return "".join([*parts, text[at:]])

    def run(batches):
        for b in slices(batches):
            names = b.schema.names
            texts = [clean(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("source").to_pylist(), strict=True)]
            columns = {n: b.column(n) for n in names}
            columns["text"] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)

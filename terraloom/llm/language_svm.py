"""Language identification by hierarchical discrimination with linear support vector machines.

A first layer of one-versus-one machines tells language families apart; inside the chosen family another layer of one-versus-one
machines, trained on that family's languages only, separates the related ones by votes and margins. Features are hashed byte
n-grams of one to four bytes of the lower-case text, digits and signs dropped, as square roots of their shares.

Training uses a bounded sample: at most ``PER_LANGUAGE`` documents of each language, chosen by a hash of the text; every language is
learned. No layer has more than ``FAN`` classes: of more, those with similar texts are grouped in layers between, so the number of
machines grows with the languages, not with their square. Prediction reads every whole text and nothing but the text.

Defined cases: a null text and a text without a letter are ``und`` with score 0; if there is nothing to learn from, every text
is ``und``; with one learned language every text with a letter is of that language with score 1; a language code that no family
lists is a family of its own; repeated rows get equal predictions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from terraloom.functions.skew import join_checked
from terraloom.llm.common import held_out, save, slices
from terraloom.session import cut_lineage

BUCKETS = 1 << 12
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 400
FAN = 16
EACH = 8  # documents of a language in the layers above its own, at least
STEPS = 200
PENALTY = 1e-4
# fixed values: families of common languages by ISO 639-1 code
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk",
    "indo-aryan": "hi bn ur mr gu pa ne",
    "semitic": "ar he am mt",
    "celtic": "ga cy gd br",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
LETTER = re.compile(r"[^\W\d_]")
_DROP = bytes(b for b in range(128) if not chr(b).isalpha() and not chr(b).isspace())
_SPACES = bytes(32 if chr(b).isspace() and b < 128 else b for b in range(256))


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def features(text: str | None) -> np.ndarray | None:
    """Weights of the hashed n-grams of one whole text with unit length; None without a letter."""
    if not text or not LETTER.search(text):
        return None
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACES, _DROP) + b" ", dtype=np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    value = np.zeros(len(raw), dtype=np.uint32)
    for order in ORDERS:
        if len(raw) < order:
            break
        value = value[: len(raw) - order + 1] * np.uint32(0x01000193) + raw[order - 1 :] + np.uint32(1)
        bucket = (value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        counts += np.bincount(bucket, minlength=BUCKETS)
    vector = np.sqrt(counts)
    return (vector / np.linalg.norm(vector)).astype(np.float32)


def train_machine(positive: np.ndarray, negative: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """A linear machine with squared hinge loss, classes weighted alike, by accelerated gradient steps; the last weight is the bias."""
    x = np.vstack([positive, negative]).astype(np.float64)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
    weight = np.repeat([0.5 / max(1, len(positive)), 0.5 / max(1, len(negative))], [len(positive), len(negative)])
    rate = 1.0 / (2.0 * 2.0 + penalty)  # rows have a squared length of two
    w, ahead, momentum = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - y * (x @ ahead))
        gradient = penalty * ahead - 2.0 * (x.T @ (weight * slack * y))
        fresh = ahead - rate * gradient
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = fresh + (momentum - 1) / following * (fresh - w)
        w, momentum = fresh, following
    return w


@dataclass
class Layer:
    """One-versus-one machines of some classes; a class is a language, or the name of the layer below it."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fit(cls, rows: dict[str, np.ndarray]) -> Layer:
        layer = cls(sorted(rows))
        layer.pairs = [(i, j) for i in range(len(layer.classes)) for j in range(i + 1, len(layer.classes))]
        if layer.pairs:
            layer.weights = np.stack([train_machine(rows[layer.classes[i]], rows[layer.classes[j]]) for i, j in layer.pairs]).astype(np.float32)
        return layer

    def choose(self, vector: np.ndarray) -> tuple[str, float]:
        """The class with most votes, margins deciding ties, and how sure the machines that concern it are."""
        if not self.pairs:
            return self.classes[0], 1.0
        margin = self.weights[:, :-1] @ vector + self.weights[:, -1]
        votes = np.zeros(len(self.classes))
        for (i, j), m in zip(self.pairs, margin.tolist(), strict=True):
            votes[i if m >= 0 else j] += 1
            votes[i] += np.tanh(m) / (4 * len(self.pairs))
            votes[j] -= np.tanh(m) / (4 * len(self.pairs))
        best = int(np.argmax(votes))
        own = [m if i == best else -m for (i, j), m in zip(self.pairs, margin.tolist(), strict=True) if best in (i, j)]
        return self.classes[best], float(1.0 / (1.0 + np.exp(-2.0 * min(own))))


def _parted(names: list[str], centres: np.ndarray, fan: int) -> list[list[int]]:
    """Names in groups of at most ``fan`` neighbours: halves along the direction in which their centres differ most."""
    parts, done = [list(range(len(names)))], []
    while parts:
        part = parts.pop()
        if len(part) <= fan:
            done.append(part)
            continue
        spread = centres[part] - centres[part].mean(axis=0)
        direction = np.linalg.svd(spread, full_matrices=False)[2][0]
        direction *= np.sign(direction[np.argmax(np.abs(direction))])
        order = sorted(part, key=lambda i: (float(centres[i] @ direction), names[i]))
        parts += [order[: len(order) // 2], order[len(order) // 2 :]]
    return sorted(done, key=lambda part: min(names[i] for i in part))


def arrange(centres: dict[str, np.ndarray], fan: int = FAN) -> dict[str, dict[str, list[str]]]:
    """layer -> class -> the languages below it. The layer ``""`` is the top one; a class that is itself a layer goes on there.

    Languages of a family are one class above. Where a family, or the list of families, has more than ``fan`` members, those with
    similar texts are put into groups, and groups into groups, until no layer has more; every language is learned.
    """
    layers: dict[str, dict[str, list[str]]] = {}

    def build(name: str, below: dict[str, list[str]]) -> None:
        k = 0
        while len(below) > fan:
            names = sorted(below)
            middle = np.stack([np.mean([centres[lang] for lang in below[n]], axis=0) for n in names])
            k += 1
            groups = {}
            for g, part in enumerate(_parted(names, middle, fan)):
                if len(part) == 1:
                    groups[names[part[0]]] = below[names[part[0]]]
                else:
                    label = f"{name}/{k}.{g}"
                    layers[label] = {names[i]: below[names[i]] for i in part}
                    groups[label] = sorted(lang for i in part for lang in below[names[i]])
            below = groups
        layers[name] = below

    families: dict[str, list[str]] = {}
    for lang in sorted(centres):
        families.setdefault(family(lang), []).append(lang)
    top = {}
    for name, langs in families.items():
        if len(langs) == 1:
            top[langs[0]] = langs
        else:
            build(f"family {name}", {lang: [lang] for lang in langs})
            top[f"family {name}"] = langs
    build("", top)
    return layers


@dataclass
class LanguageModel:
    layers: dict[str, Layer]

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = features(text)
        if vector is None or not self.layers.get("", Layer([])).classes:
            return "und", 0.0
        name, sure = "", 1.0
        while name in self.layers:
            name, surer = self.layers[name].choose(vector)
            sure *= surer
        return name, sure


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, fan: int = FAN) -> LanguageModel:
    """Fit on a bounded sample of (text, lang) of every language; features and machines are worked out on the executors.

    The driver gets one centre for each language and the finished machines: about ``fan`` / 2 a language. A task that fits a layer
    gets at most ``fan`` classes of 2 * ``per_language`` rows, or of ``EACH`` rows for each of their languages.
    """
    known = labelled.select("text", "lang").filter("text is not null and lang is not null").withColumn("order", F.xxhash64("text"))
    # the order is compared first, so that only the chosen texts travel; copies of a text count once
    keys = cut_lineage(known.select("lang", "order").distinct())
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # hashes lie evenly: under this bound lie about four times the wanted ones, and only those are ranked
    bound = F.when(F.col("n") <= 4 * per_language, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * 4 * per_language / F.col("n")).cast("bigint"))
    low = join_checked(keys, sizes.select("lang", bound.alias("bound")), ["lang"]).filter("order <= bound")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("order"))
    chosen = low.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "order", "rank")
    rows = join_checked(known, chosen, ["lang", "order"]).dropDuplicates(["lang", "order"])

    def run(batches):
        for b in slices(batches):
            vectors = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("lang"), b.column("rank"), pa.array([None if v is None else v.tobytes() for v in vectors], pa.binary())], ["lang", "rank", "vector"]
            )

    vectors = save(rows.select("lang", "rank", "text").mapInArrow(run, "lang string, rank int, vector binary").filter("vector is not null"))

    def centre(rows: pd.DataFrame) -> pd.DataFrame:
        mean = np.mean([np.frombuffer(v, np.float32) for v in rows.sort_values("rank")["vector"]], axis=0)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "vector": [mean.astype(np.float32).tobytes()]})

    centres = {r["lang"]: np.frombuffer(r["vector"], np.float32) for r in vectors.groupBy("lang").applyInPandas(centre, "lang string, vector binary").collect()}
    if not centres:
        return LanguageModel({})
    layers = arrange(centres, fan)
    places = [
        (name, label, lang, max(EACH, 2 * per_language // len(langs))) for name, classes in layers.items() for label, langs in classes.items() for lang in langs
    ]
    spark = labelled.sparkSession
    wanted = join_checked(vectors, spark.createDataFrame(places, "layer string, class string, lang string, most int"), ["lang"])
    wanted = wanted.filter(F.col("rank") <= F.col("most"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        found = {label: np.stack([np.frombuffer(v, np.float32) for v in part.sort_values(["rank", "lang"])["vector"]]) for label, part in rows.groupby("class")}
        layer = Layer.fit(found)
        weights = b"" if layer.weights is None else layer.weights.tobytes()
        return pd.DataFrame({"layer": [rows["layer"].iloc[0]], "classes": [layer.classes], "weights": [weights]})

    fitted = {}
    for r in wanted.groupBy("layer").applyInPandas(fit, "layer string, classes array<string>, weights binary").collect():
        n = len(r["classes"])
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
        fitted[r["layer"]] = Layer(list(r["classes"]), pairs, np.frombuffer(r["weights"], np.float32).reshape(len(pairs), -1) if pairs else None)
    return LanguageModel(fitted)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            langs, scores = zip(*[shared.value.predict(t) for t in b.column("text").to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out, predict all."""
    return predict(docs, train(docs.filter(~held_out())))

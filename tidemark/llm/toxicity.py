"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over word and word-prefix features. While it is fitted, every
training text that names an identity term is also seen with the term swapped for
every other of its group, and squared changes of its log-odds are penalised, so a
neutral mention of a group does not move the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, cut

#: Groups of identity terms that may be swapped for one another.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "european", "american", "chinese", "mexican", "indian"),
    ("immigrants", "citizens", "refugees"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
#: The classifier is fitted on at most this many labelled rows, taken in the order of a hash of their ids.
MAX_SAMPLE = 10_000
#: It knows the identity terms and every feature with this chi-squared, in so many texts at least.
MIN_CHI2 = 12.0
MIN_DOCS = 2
PREFIXES = (4, 5, 6)
RIDGE = 1e-4
SWAP_PENALTY = 1.0
STEPS = 400
THRESHOLD = 0.3
#: Rows whose crc32(id as text) leaves this remainder are held out.
FOLDS, HELD_OUT = 4, 2
_CACHE = 500_000

_WORD = re.compile(r"[^\W_]+")
_GROUP = {t: g for g in IDENTITY for t in g}


def words_of(raw: bytes) -> set[str]:
    return set(_WORD.findall(raw.decode("utf-8", "replace").lower()))


def features_of(word: str) -> list[str]:
    """The word itself and its prefixes; identity terms have no prefixes."""
    if word in _GROUP:
        return [word]
    return [word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k)]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, the number of toxic and other texts with each feature."""
    counts = (Counter(), Counter())
    for b in batches:
        for toxic, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            counts[toxic].update({f for w in words_of(raw) for f in features_of(w)})
    names = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in (counts[1], counts[0]))], names=["f", "a", "b"]
        )


def _ids(words: set[str], vocab: dict[str, int]) -> list[int]:
    return sorted({vocab[f] for w in words for f in features_of(w) if f in vocab})


def swaps(words: set[str]) -> Iterator[tuple[set[str], str]]:
    """(terms of a group that a text names, the term that takes their place),
    for each group and each of its terms but the sole one named."""
    for group in dict.fromkeys(_GROUP[w] for w in sorted(words & _GROUP.keys())):
        named = words & set(group)
        for term in group:
            if named != {term}:
                yield named, term


def _encode(vocab: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, toxic, given, swapped): the features of a text, and for each swap
        those that it loses, and, below zero, those that it gains, from -1 on."""
        for b in batches:
            given, swapped = [], []
            for raw in b.column(2).to_pylist():
                words = words_of(raw)
                given.append(_ids(words, vocab))
                swapped.append([sorted([vocab[w] for w in named - {t}] + [-1 - vocab[t]] * (t not in named)) for named, t in swaps(words)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(given, kind), pa.array(swapped, pa.list_(kind))], names=["key", "toxic", "given", "swapped"])

    return run


@dataclass
class Sparse:
    """A matrix of n rows and ``width`` columns by its entries."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    n: int
    width: int

    @staticmethod
    def of(rows: list[Iterable[int]], width: int) -> Sparse:
        """Ones at the columns listed; -1 at column c where -1 - c is listed."""
        sizes = [len(r) for r in rows]
        flat = np.array([c for r in rows for c in r], np.int64)
        return Sparse(np.repeat(np.arange(len(rows)), sizes), np.where(flat < 0, -1 - flat, flat), np.where(flat < 0, -1.0, 1.0), len(rows), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], minlength=self.width)


def loss_and_gradient(x: Sparse, y: np.ndarray, swap: Sparse, w: np.ndarray, bias: float, ridge: float, penalty: float) -> tuple[float, np.ndarray]:
    """Mean log-loss + ridge/2 |w|^2 + penalty/2 times the mean squared change of
    the log-odds under a swap, and its gradient, the bias last."""
    z = x.times(w) + bias
    miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
    loss = float(np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * (w @ w))
    grad = x.transposed_times(miss) / x.n + ridge * w
    if swap.n:
        moved = swap.times(w)
        loss += float(penalty / 2 * np.mean(moved * moved))
        grad += penalty * swap.transposed_times(moved) / swap.n
    return loss, np.r_[grad, miss.mean()]


def fit_logistic(x: Sparse, y: np.ndarray, swap: Sparse, ridge: float = RIDGE, penalty: float = SWAP_PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of the least loss. Adam with fixed steps from zero, so
    equal rows give equal weights."""
    w, bias = np.zeros(x.width), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        _, g = loss_and_gradient(x, y, swap, w, bias, ridge, penalty)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", max_sample: int = MAX_SAMPLE, penalty: float = SWAP_PENALTY) -> dict:
    """{"weights": {feature: weight}, "bias": b} from the labelled rows that are
    not held out, ``max_sample`` of them at most; nothing else is bounded. Null
    labels and ids are left out; one id with several labels counts as toxic if
    any says so; copies of a text count once, null texts are empty. Without
    labelled rows the bias is 0 chance; with one class alone, that class's. Jobs
    run while the model is made: the sample is written, its features are counted
    in Spark, and the fit itself is the driver's."""
    known = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull())
    known = known.where(F.crc32(F.col(id).cast("string")) % FOLDS != HELD_OUT)
    known = known.groupBy(F.col(id).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    sample = known.orderBy(F.xxhash64("key"), "key").limit(max_sample)
    rows = docs.select(F.col(id).alias("key"), body(text).alias("raw")).join(F.broadcast(sample), "key").select("key", "toxic", "raw")
    rows = cut(rows.withColumn("sum", F.md5("raw")), "labelled")
    once = rows.groupBy("sum").agg(F.min("key").alias("key"), F.max("toxic").alias("toxic"))  # a copy teaches nothing new
    rows = rows.drop("toxic").join(F.broadcast(once), ["sum", "key"]).dropDuplicates(["sum"]).select("key", "toxic", "raw")
    n, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or n_toxic in (0, n):
        return {"weights": {}, "bias": 50.0 if n and n_toxic else -50.0}
    a, b = F.col("a"), F.col("b")
    c, d = n_toxic - a, n - n_toxic - b
    chi2 = F.pow(a * d - b * c, 2) / ((a + b) * (c + d) + F.lit(1e-9)) * (n / (n_toxic * (n - n_toxic)))
    counts = rows.mapInArrow(_document_counts, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    best = counts.where((a + b >= MIN_DOCS) & (chi2 >= MIN_CHI2)).orderBy("f")
    names = [r["f"] for r in best.select("f").collect()]  # of the sample's words, so bounded with it
    vocab = {f: i for i, f in enumerate(dict.fromkeys([*names, *_GROUP]))}
    kind = docs.schema[id].dataType.simpleString()
    coded = rows.mapInArrow(_encode(vocab), f"key {kind}, toxic int, given array<int>, swapped array<array<int>>").collect()
    coded.sort(key=lambda r: (r["key"], r["given"]))
    x = Sparse.of([r["given"] for r in coded], len(vocab))
    swap = Sparse.of([s for r in coded for s in r["swapped"]], len(vocab))
    w, bias = fit_logistic(x, np.array([r["toxic"] for r in coded], float), swap, penalty=penalty)
    return {"weights": {f: float(w[i]) for f, i in vocab.items() if w[i]}, "bias": float(bias)}


def _scorer(model: dict):
    weights, bias = model["weights"], model["bias"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            scores = []
            for raw in b.column(b.num_columns - 1).to_pylist():
                found: set[str] = set()
                for w in words_of(raw):
                    hit = known.get(w)
                    if hit is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        hit = known[w] = tuple(f for f in features_of(w) if f in weights)
                    if hit:
                        found.update(hit)
                z = bias + sum(weights[f] for f in sorted(found))
                scores.append(1 / (1 + np.exp(-min(50.0, max(-50.0, z)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: dict, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row. Null and empty texts get
    the score of no features; a very long text is one row's work; a null id is
    not held out; repeated rows score alike; an empty table gives none; only the
    text enters the score. Narrow."""
    held = F.coalesce(F.crc32(F.col(id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    src = docs.select(F.col(id).alias("id"), held.alias("held_out"), body(text).alias("raw"))
    out = src.mapInArrow(_scorer(model), f"id {docs.schema[id].dataType.simpleString()}, held_out boolean, score double")
    return out.select(F.col("id").alias(id), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

"""Embedding texts in batches by a model that each worker loads once.

A model is a class with ``load()``, which gives a function from a list of texts to
a matrix of one row a text. The stand-in here is random indexing fitted in Spark:
each word of the corpus gets a sparse vector of signs by its hash, weighed by how
rare the word is; a text is the unit sum over its words.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

DIMENSIONS = 64
#: Signs of a word's vector, texts that go to the model at once, words whose weight is given to the model by name.
SIGNS = 4
BATCH = 256
MOST_WORDS = 50_000
_WORD = re.compile(r"\w+")
#: Vectors of words that a loaded model remembers.
_REMEMBERED = 100_000

Embed = Callable[[list[str]], np.ndarray]
#: Models that this worker has loaded.
_LOADED: OrderedDict[object, Embed] = OrderedDict()


def loaded(model) -> Embed:
    """The model's function, loaded the first time that this process asks for it."""
    if model not in _LOADED:
        _LOADED[model] = model.load()
    return _LOADED[model]


@dataclass(frozen=True)
class RandomIndexing:
    """``weights``: (word, weight) of the commonest words, sorted; ``other`` that
    of the rest."""

    weights: tuple[tuple[str, float], ...] = ()
    other: float = 1.0
    dimensions: int = DIMENSIONS
    signs: int = SIGNS
    seed: int = 0

    def load(self) -> Embed:
        weight, known = dict(self.weights), {}

        def vector(word: str) -> np.ndarray:
            if word not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                v = np.zeros(self.dimensions)
                for i in range(self.signs):
                    h = xxhash.xxh64_intdigest(f"{i}:{word}", self.seed)
                    v[(h >> 1) % self.dimensions] += 1.0 if h & 1 else -1.0
                known[word] = v * weight.get(word, self.other)
            return known[word]

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.dimensions))
            for row, text in zip(out, texts, strict=True):
                for word in _WORD.findall(text.lower()):
                    row += vector(word)
                norm = np.sqrt(row @ row)
                row /= norm or 1.0
            return out

        return embed


def fit(rows: DataFrame, text: str, dimensions: int = DIMENSIONS, most_words: int = MOST_WORDS) -> RandomIndexing:
    """Weights log((n + 1) / (texts with the word + 1)), counted over all rows; the
    commonest ``most_words`` are given by name, rarer ones all weigh as the rarest
    of these. Null texts count as texts without words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    n = rows.count()
    counts = rows.select(F.explode(F.array_distinct(found)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    top = counts.orderBy(F.desc("df"), "word").limit(most_words).collect()
    weights = tuple(sorted((r["word"], float(np.log((n + 1) / (r["df"] + 1)))) for r in top))
    return RandomIndexing(weights, max((w for _, w in weights), default=1.0), dimensions)


def embed(model, text: str | Column, batch: int = BATCH) -> Column:
    """Each text's vector (array of floats) by ``model``, null for a null text. The
    model travels once a task and is loaded once a worker process; texts go to it
    ``batch`` at a time, so a vector must not depend on the others of its batch."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = loaded(model)
        for part in parts:
            given = part.notna().to_numpy()
            texts = part[given].tolist()
            vectors = [v for lo in range(0, len(texts), batch) for v in call(texts[lo : lo + batch]).astype(np.float32).tolist()]
            out = np.full(len(part), None, object)
            for at, v in zip(np.flatnonzero(given), vectors, strict=True):
                out[at] = v
            yield pd.Series(out)

    return run(F.col(text) if isinstance(text, str) else text)

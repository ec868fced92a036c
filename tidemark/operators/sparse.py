"""Bags of words and the nearest of them by cosine, through an inverted index.

Rows are dealt to shards of bounded rows by a hash of their id, so that a word's
postings, however common it is, are spread over all shards. A shard keeps each
word's postings in order of impact. A query takes them block by block, always from
the list that can add most, and stops as soon as no row that it has not met can
reach its k-th score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard, queries that meet it at once, postings that are taken at once.
SHARD_ROWS = 2_048
TILE_QUERIES = 512
BLOCK = 64
DIGITS = 6


def bags(rows: DataFrame, key: str, text: str | Column) -> DataFrame:
    """(key, word, x): each word of a row's text, in lower case, with its count
    over the norm of all counts. ``key`` tells rows apart. Null texts and texts
    without words give none; time grows with the number of words. Texts are
    shuffled once, by their key, and words not at all."""
    said = rows.select(key, F.lower(F.col(text) if isinstance(text, str) else text).alias("_text")).repartition(key)
    found = F.regexp_extract_all("_text", F.lit(r"(?U)\w+"), F.lit(0))
    counts = said.select(key, F.explode(found).alias("word")).groupBy(key, "word").agg(F.count("*").cast("double").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "word", (F.col("n") / norm).alias("x"))


class Shard:
    """The postings of a shard's rows: by word in order of impact, and in order of
    rows for looking up a row's weight."""

    def __init__(self, row: np.ndarray, word: np.ndarray, x: np.ndarray) -> None:
        by_impact, by_row = np.lexsort((row, -x, word)), np.lexsort((row, word))
        ends = np.searchsorted(word[by_row], np.arange(word.max() + 2 if len(word) else 1))
        self.ends, self.rows, self.impact = ends, row[by_impact], x[by_impact]
        self.placed, self.weight = row[by_row], x[by_row]
        self.read = 0

    def scores(self, words: list[int], y: list[float], rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for w, v in zip(words, y, strict=True):
            lo, hi = self.ends[w], self.ends[w + 1]
            at = np.minimum(np.searchsorted(self.placed[lo:hi], rows), hi - lo - 1) + lo
            out += np.where(self.placed[at] == rows, v * self.weight[at], 0.0)
        return out

    def best(self, words: list[int], y: list[float], rank: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(score, row) of the k best, ties by ``rank``; rows of score 0 are none."""
        at = [int(self.ends[w]) for w in words]
        top = lambda i: y[i] * self.impact[at[i]] if at[i] < self.ends[words[i] + 1] else 0.0
        seen = np.zeros(len(rank), bool)
        met: list[np.ndarray] = []
        kept: list[tuple[float, int, int]] = []  # the k best: (score, -rank, row)
        queue = [(-top(i), i) for i in range(len(words))]
        heapq.heapify(queue)
        left = -sum(t for t, _ in queue)
        while queue and queue[0][0] < 0:
            if len(kept) == k and left + 10.0**-DIGITS < kept[0][0]:
                break
            was, i = heapq.heappop(queue)
            end = min(at[i] + BLOCK, int(self.ends[words[i] + 1]))
            block = self.rows[at[i] : end]
            self.read += len(block)
            at[i] = end
            now = top(i)
            left += was + now
            heapq.heappush(queue, (-now, i))
            fresh = block[~seen[block]]
            seen[fresh] = True
            met.append(fresh)
            for score, row in zip(np.round(self.scores(words, y, fresh), DIGITS).tolist(), fresh.tolist(), strict=True):
                entry = (score, -int(rank[row]), row)
                if len(kept) < k:
                    heapq.heappush(kept, entry)
                elif entry > kept[0]:
                    heapq.heapreplace(kept, entry)
        return [(s, row) for s, _, row in sorted(kept, reverse=True)]


def _met(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            words = pa.concat_tables([asked.select(["word"]), rows.select(["word"])])["word"].combine_chunks().dictionary_encode()
            code = words.indices.to_numpy()
            nodes = rows["node_id"].combine_chunks().dictionary_encode()
            ids = nodes.dictionary.to_pylist()
            order = sorted(range(len(ids)), key=lambda i: ids[i])
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            shard = Shard(nodes.indices.to_numpy().astype(np.int64), code[asked.num_rows :].astype(np.int64), rows["x"].to_numpy())
            queries: dict = {}
            held = len(shard.ends) - 1
            for q, w, v in zip(asked["query_id"].to_pylist(), code[: asked.num_rows].tolist(), asked["x"].to_pylist(), strict=True):
                if w < held and shard.ends[w + 1] > shard.ends[w]:
                    queries.setdefault(q, []).append((w, v))
            for q, ws in queries.items():
                out += [(q, ids[row], s) for s, row in shard.best([w for w, _ in ws], [v for _, v in ws], rank, k)]
        kinds = (asked.schema.field("query_id").type, rows.schema.field("node_id").type, pa.float64())
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["query_id", "node_id", "score"])

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, n_rows: int | None = None) -> DataFrame:
    """(query_id, node_id, score, rank): the k rows with the highest cosines above
    0 of each query, ties to the smaller node_id; scores are rounded to 6 digits.

    queries: (query_id, word, x), rows: (node_id, word, x), both as ``bags`` makes
    them. Ids are not null. Shards and tiles of queries meet pair by pair; only a
    shard's k best a query are shuffled on. Empty sides give nothing. ``n_rows``:
    how many rows there are, where that is known; else all of ``rows`` is made
    once more to count them. It only says how many shards there are.
    """
    n_rows = rows.agg(F.count_distinct("node_id")).first()[0] if n_rows is None else n_rows
    shards = max(1, -(-n_rows // shard_rows))
    tiles = max(1, -(-queries.agg(F.count_distinct("query_id")).first()[0] // TILE_QUERIES))
    dealt = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select("query_id", "word", "x", dealt("query_id", tiles, "tile"), every(shards, "shard"))
    # words that no query has weigh nothing here
    held = rows.join(queries.select("word").distinct(), "word", "left_semi").select("node_id", "word", "x", dealt("node_id", shards, "shard"), every(tiles, "tile"))
    kinds = [f"{c} {f.schema[c].dataType.simpleString()}" for f, c in ((queries, "query_id"), (rows, "node_id"))]
    found = asked.groupBy("shard", "tile").cogroup(held.groupBy("shard", "tile")).applyInArrow(_met(k), f"{', '.join(kinds)}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Exact nearest neighbours and the retrieval pipeline over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import state
from tidemark.operators.matching import overlaps
from tidemark.plans.blocks import by_block
from tidemark.plans.lineage import cut

TOP_K = 8
FINAL_K = 5
RERANK_THRESHOLD = 0.7
ENTITY_K = 3
#: Scores, rows by queries, that a task has in memory at once.
CELLS = 1 << 20


def top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, by: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(query_id, node_id, *by, score, rank): for each query the k corpus rows of
    the highest cosine, in each group of ``by``. Scores are rounded, ties go to
    the smaller node_id.

    queries: (query_id, query_vec); corpus: (node_id, vec, *by). A zero vector
    has cosine 0, a null one is left out, one of another length raises. Corpus
    rows meet blocks of queries of bounded size, an Arrow batch at a time by one
    matrix product, of at most CELLS scores at once. Only a batch's best k rows a
    query and group are shuffled, without those that k earlier ones of the task
    beat, so only scores as good as the k-th so far are rounded and ordered.
    """
    kinds = ", ".join(f"{c} {t}" for c, t in corpus.select("node_id", *by).dtypes)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {kinds}, score double"

    def meet(block: pa.Table):
        unit = _unit(np.array(block["query_vec"].to_pylist(), np.float64))
        return _best_of_batch(block["query_id"].to_pylist(), unit, k, len(by), digits)

    asked = queries.select("query_id", "query_vec").where("query_vec is not null")
    rows = by_block(asked, corpus.where("vec is not null").select("node_id", *by, "vec"), meet, schema, weight=8 * F.size("query_vec"))
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "node_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=-1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _best_of_batch(ids: list, unit: np.ndarray, k: int, n_by: int, digits: int):
    """A batch's best rows of each query and group, but for those that k rows of
    earlier batches beat."""
    kind = pa.array(ids).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {}  # of each group every query's k best scores so far, the least first
        for b in batches:
            if not b.num_rows or not ids:
                continue
            vecs = b.column(n_by + 1)
            if vecs.flatten().null_count or set(np.asarray(pc.list_value_length(vecs)).tolist()) != {unit.shape[1]}:
                raise ValueError(f"vectors must have {unit.shape[1]} elements, none of them null")
            group = np.zeros(b.num_rows, np.int64)
            for i in range(n_by):
                codes = b.column(1 + i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                group = np.unique(group * (b.num_rows + 1) + codes + 1, return_inverse=True)[1]
            b = b.take(pa.array(np.argsort(group, kind="stable")))  # a group's rows lie together
            ends = np.cumsum(np.bincount(group)).tolist()
            groups = [(tuple(b.column(1 + i)[lo].as_py() for i in range(n_by)), lo, hi) for lo, hi in zip([0, *ends], ends)]
            rows_ = _unit(b.column(n_by + 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
            node = b.column(0).to_numpy(zero_copy_only=False)
            names = ["query_id", *b.schema.names[: n_by + 1], "score"]
            some = max(1, CELLS // b.num_rows)  # queries at once
            for at in range(0, len(ids), some):
                scores = unit[at : at + some] @ rows_.T
                for key, lo, hi in groups:
                    part = scores[:, lo:hi]
                    if key not in tops:
                        if len(tops) * len(ids) * k > 4 * CELLS:
                            tops.clear()  # of many groups, begun anew
                        tops[key] = np.full((len(ids), k), -np.inf)
                    top = tops[key][at : at + some]
                    floor = top[:, 0] - 2 * 10.0**-digits  # of scores that are not rounded yet
                    if hi - lo > k and np.isneginf(floor).any():
                        least = -np.partition(-part, k - 1, axis=1)[:, k - 1] - 2 * 10.0**-digits
                        floor = np.fmax(floor, least)
                    q, row = np.divmod(np.flatnonzero(part >= floor[:, None]), hi - lo)  # ties with the k-th stay in until they are ordered
                    score = np.round(part[q, row], digits) + 0.0
                    row += lo
                    order = np.lexsort((node[row], -score, q))
                    row, q, score = row[order], q[order], score[order]
                    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
                    kept = (nth < k) & (score >= top[q, 0])
                    row, q, score, nth = row[kept], q[kept], score[kept], nth[kept]
                    if not len(q):
                        continue
                    new = np.full(top.shape, -np.inf)
                    new[q, nth] = score
                    top[:] = np.sort(np.concatenate([top, new], axis=1), axis=1)[:, k:]
                    columns = [b.column(i).take(pa.array(row)) for i in range(n_by + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[at + i] for i in q.tolist()], kind), *columns, pa.array(score)], names=names)

    return run


def dual_domain(queries: DataFrame, menu: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """Both domains' k best for each query: (query_id, kind, node_id, score,
    ordinal), menu rows before chunk rows."""
    both = menu.withColumn("kind", F.lit("menu")).unionByName(chunks.withColumn("kind", F.lit("chunk")))
    found = top_k(queries, both, k, ("kind",))
    ordinal = F.when(F.col("kind") == "menu", F.col("rank")).otherwise(F.col("rank") + k)
    return found.select("query_id", "kind", "node_id", "score", ordinal.alias("ordinal"))


def rerank(candidates: DataFrame, scorer: Column, threshold: float = RERANK_THRESHOLD, k: int = FINAL_K) -> DataFrame:
    """The k candidates of each query that score ``threshold`` or more, best
    first; ties stay in candidate order."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "ordinal", "node_id")
    kept = candidates.withColumn("rerank_score", scorer).where(F.col("rerank_score") >= threshold)
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hybrid_search(queries: DataFrame, menu: DataFrame, chunks: DataFrame, expand: Callable[[DataFrame], DataFrame] | None = None, scorer: Column | None = None, threshold: float = RERANK_THRESHOLD, k: int = FINAL_K) -> DataFrame:
    """Dual-domain search, expansion over the graph, reranking and top k."""
    found = dual_domain(queries, menu, chunks).withColumn("via_expansion", F.lit(False))
    if expand is not None:
        found = cut(found, "found")  # read twice, searched once
        found = found.unionByName(expand(found), allowMissingColumns=True)
    return rerank(found, F.coalesce(F.col("score"), F.lit(0.0)) if scorer is None else scorer, threshold, k)


def cached_search(requests: DataFrame, search: Callable[[DataFrame], DataFrame], ttl: float, k: int = 3) -> DataFrame:
    """``search``'s rows for every request, (request_id, t, hit, *rows), as behind
    a cache: requests that are equal after lowering and squeezing of white space
    are searched once, by the first of them, and share what it finds.

    requests: (request_id, query, t in seconds). ``search`` takes (query_id,
    query) and gives rows with a query_id. A request is a hit while what an
    earlier one found is no older than ``ttl``; a hit does not renew it. What is
    found empty is kept like anything else: such a request has one row of nulls.
    """
    keyed = requests.select("request_id", "query", F.col("t").cast("double").alias("t"), text.cache_key(F.col("query"), k).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min_by("query", F.struct("t", "request_id")).alias("query"))
    found = search(first.select(F.col("_key").alias("query_id"), "query")).withColumnRenamed("query_id", "_key")
    hits = state.replay(keyed, ["_key"], ["t", "request_id"], ["t", "_key"], partial(state.LruTtlCache, 1, ttl), "hit boolean, size long")
    return hits.drop("size").join(found, "_key", "left").drop("_key")


def overlap_search(queries: DataFrame, facts: DataFrame, menu: DataFrame, k: int = 3) -> DataFrame:
    """Keyword retrieval: shared words over ten, two more for a menu name inside
    the query; the k best, or one stand-in row for a query without any.

    queries: (query_id, query); facts: (fact_id, fact); menu: (name, price,
    description). Rows are counted where they lie against blocks of queries; only
    a batch's k best are shuffled, and texts are joined to the final ones.
    """
    asked = queries.select("query_id", F.lower("query").alias("low"), text.words(F.col("query")).alias("words"))
    known = facts.select(F.col("fact_id").cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("bonus"), text.words(F.col("fact")).alias("words"))
    items = menu.select(F.col("name").alias("id"), F.lower("name").alias("name"), F.lit(2).alias("bonus"), text.words(F.col("description")).alias("words"))
    every = overlaps(asked, known, k).withColumn("source", F.lit("faq")).unionByName(overlaps(asked, items, k).withColumn("source", F.lit("menu")))
    every = every.groupBy("query_id", "source", "id").agg((F.max("overlap") / F.lit(10.0)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "id")
    best = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    said = F.concat(F.col("name"), F.lit(" ("), F.format_number("price", 0), F.lit("đ) - "), F.col("description"))
    texts = facts.select(F.lit("faq").alias("source"), F.col("fact_id").cast("string").alias("id"), F.col("fact").alias("text"))
    texts = texts.unionByName(menu.select(F.lit("menu").alias("source"), F.col("name").alias("id"), said.alias("text")).distinct())
    # one row for every query, whether anything was found or not
    return queries.select("query_id").join(best.join(texts, ["source", "id"]), "query_id", "left").select(
        "query_id",
        F.coalesce("text", F.lit("(Không tìm thấy thông tin liên quan trong dữ liệu quán.)")).alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.coalesce("rank", F.lit(1)).alias("rank"),
    )

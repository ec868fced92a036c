"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to tiles of about 4,096 rows: by the nearest of at most 256
pivots, and a cell with more rows in parts by hash, so that a cell of many near
copies is many tiles. Each tile becomes one cover tree (the simplified one: the
children of a node lie within a scale of their centres, and those further apart
than it; the scale falls by 1.3 a level), stored as one row of the index.
Queries become trees of the same kind. Every pair of a query tree and a tile is
searched by descending both trees at once: a pair of nodes is pruned when the
largest inner product that its centres, covering radii and norms allow is below
the worst k-th score of the query node's points. Lower bounds of those scores
come from a bounded sample first and rise as points are met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

TOP_K = 5
SCALE = 256
#: Rows of a tree, and points of a node that is not split.
TILE = 4096
LEAF = 16
BASE = 1.3
#: Rows (smallest hashes of their numbers) from which pivots and first bounds are taken, and the most pivots.
SAMPLE = 2048
PIVOTS = 256
#: Points that are multiplied at once: of queries, of candidates.
_QUERIES = 64
_CHUNK = 512
_LOW = np.iinfo(np.int64).min
_TREE = "dim int, tile long, points binary, ids binary, known binary, rows binary, floors binary, nodes binary"


def quantised(vec: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as long, or null for a vector that takes
    no part: null, holding null or non-finite components, or with a squared norm
    of 2^62 or more, whose scores might not fit a long."""
    c = F.col(vec) if isinstance(vec, str) else vec
    wide = F.transform(c, lambda x: F.lit(float(scale)) * x.cast("double"))
    fit = F.forall(wide, lambda x: x.isNotNull() & (F.abs(x) < float(1 << 31)) & ~F.isnan(x))
    whole = F.transform(wide, lambda x: F.floor(x))
    norm = F.aggregate(whole, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(fit, F.when(norm < float(1 << 62), whole))


@dataclass
class Tree:
    """Points in the order of the tree, and its nodes: place of the centre among
    the points, first and last point, first child and number of children, and
    covering radius and largest squared norm."""

    points: np.ndarray
    perm: np.ndarray
    span: np.ndarray  # centre, lo, hi, child, children
    reach: np.ndarray  # radius, norm2

    def __post_init__(self) -> None:
        self.norm2 = (self.points**2).sum(1)
        self.centres = self.points[self.span[:, 0]]
        self.centre2 = self.norm2[self.span[:, 0]]

    def children(self, nodes: np.ndarray) -> np.ndarray:
        first, n = self.span[nodes, 3], self.span[nodes, 4]
        return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def build(points: np.ndarray) -> Tree:
    """The cover tree of a non-empty matrix of whole numbers (as doubles).

    A node's first child has its centre. Further centres are taken farthest first
    until every point is within the scale of one, so they lie further apart than
    it; points go to the nearest. Equal points end in one leaf.
    """
    x2 = (points**2).sum(1)
    away = lambda at, c: np.sqrt(np.maximum(x2[at] + x2[c] - 2 * (points[at] @ points[c]), 0))
    first = int(np.argmin(x2 - 2 * (points @ points.mean(0))))
    everything = np.arange(len(points))
    perm = np.concatenate([[first], np.delete(everything, first)])
    span, reach = [[0, 0, len(points), 0, 0]], [[0.0, 0.0]]
    far = [away(perm, first)]
    for node, (_, lo, hi, _, _) in enumerate(span):  # grows as it is walked: breadth first
        at, near = perm[lo:hi], far[node]
        far[node] = None
        radius = float(near.max())
        reach[node] = [radius, float(x2[at].max())]
        if hi - lo <= LEAF or radius == 0:
            continue
        scale = BASE ** (np.ceil(np.log(radius) / np.log(BASE)) - 1)
        owner, centres = np.zeros(hi - lo, np.int64), [0]
        while near.max() > scale:
            centres.append(int(near.argmax()))
            d = away(at, at[centres[-1]])
            closer = d < near
            closer[centres[-1]] = True
            owner[closer], near = len(centres) - 1, np.minimum(near, d)
        heads = np.ones(hi - lo, np.int8)
        heads[centres] = 0
        order = np.lexsort((heads, owner))
        perm[lo:hi], near = at[order], near[order]
        ends = np.cumsum(np.bincount(owner, minlength=len(centres)))
        span[node][3:] = [len(span), len(centres)]
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            span.append([lo + int(a), lo + int(a), lo + int(b), 0, 0])
            reach.append([0.0, 0.0])
            far.append(near[a:b])
    return Tree(points[perm], perm, np.array(span, np.int64), np.array(reach, np.float64))


class Search:
    """The k best candidates of each query point of one pair of trees."""

    def __init__(self, q: Tree, x: Tree, rank: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int) -> None:
        """rank: the candidates' places among equal scores; own: each query's own
        place among the candidates or -1; floors: scores that the k-th cannot be below."""
        self.q, self.x, self.rank, self.own, self.k = q, x, rank, own, k
        self.tau = floors.copy()
        self.best = [[] for _ in own]  # of (-score, rank, place)
        exact = float(q.norm2.max()) * float(x.norm2.max()) < float(1 << 104)
        self._q, self._x = (q.points, x.points) if exact else (q.points.astype(np.int64), x.points.astype(np.int64))
        self.met = 0
        self._visit(0, np.zeros(1, np.int64))

    def _bounds(self, qn: np.ndarray, xn: np.ndarray) -> np.ndarray:
        """The largest inner product of a point below each of ``qn`` and one below each of ``xn``."""
        q, x = self.q, self.x
        dot = q.centres[qn] @ x.centres[xn].T
        rq, rx = q.reach[qn, 0][:, None], x.reach[xn, 0][None, :]
        nq, nx = q.centre2[qn][:, None], x.centre2[xn][None, :]
        ball = dot + np.sqrt(nq) * rx + np.sqrt(nx) * rq + rq * rx
        gap = np.maximum(np.sqrt(np.maximum(nq + nx - 2 * dot, 0)) * (1 - 1e-9) - rq - rx, 0)
        most = q.reach[qn, 1][:, None] + x.reach[xn, 1][None, :]
        return np.minimum(ball, (most - gap**2) / 2) + 1e-9 * most + 1e-6

    def _worst(self, qn: np.ndarray) -> np.ndarray:
        return np.array([self.tau[lo:hi].min() for lo, hi in self.q.span[qn, 1:3]], np.float64)

    def _visit(self, node: int, cands: np.ndarray) -> None:
        one = np.array([node])
        cands = cands[self._bounds(one, cands)[0] >= self._worst(one)[0]]
        if not len(cands):
            return
        first, n = self.q.span[node, 3:]
        if not n:
            return self._leaves(one, cands)
        large = (self.x.span[cands, 4] > 0) & (self.x.reach[cands, 0] >= self.q.reach[node, 0])
        cands = np.concatenate([cands[~large], self.x.children(cands[large])])
        kids = np.arange(first, first + n)
        leaf = self.q.span[kids, 4] == 0
        small, size = kids[leaf], 0
        part: list[int] = []
        for kid in small:
            part.append(kid)
            size += self.q.span[kid, 2] - self.q.span[kid, 1]
            if size >= _QUERIES:
                self._leaves(np.array(part), cands)
                part, size = [], 0
        if part:
            self._leaves(np.array(part), cands)
        for kid in kids[~leaf]:
            self._visit(int(kid), cands)

    def _leaves(self, qn: np.ndarray, cands: np.ndarray) -> None:
        """Query leaves against candidate nodes: these are split as far as they
        stay in reach, then points are met in order of their nodes' bounds."""
        span = self.x.span
        while True:
            b = self._bounds(qn, cands)
            in_reach = (b >= self._worst(qn)[:, None]).any(0)
            cands, most = cands[in_reach], b.max(0)[in_reach]
            inner = span[cands, 4] > 0
            if not inner.any():
                break
            cands = np.concatenate([cands[~inner], self.x.children(cands[inner])])
        order = np.argsort(-most, kind="stable")
        cands = cands[order]
        b = b[:, in_reach][:, order]
        points = np.concatenate([np.arange(lo, hi) for lo, hi in self.q.span[qn, 1:3]])
        while len(cands):
            sizes = np.cumsum(span[cands, 2] - span[cands, 1])
            n = int(np.searchsorted(sizes, _CHUNK)) + 1
            lo, size = span[cands[:n], 1], span[cands[:n], 2] - span[cands[:n], 1]
            self._meet(points, np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()))
            in_reach = (b[:, n:] >= self._worst(qn)[:, None]).any(0)
            cands, b = cands[n:][in_reach], b[:, n:][:, in_reach]

    def _meet(self, points: np.ndarray, at: np.ndarray) -> None:
        self.met += len(points) * len(at)
        scores = (self._q[points] @ self._x[at].T).astype(np.int64)
        good = (scores >= self.tau[points][:, None]) & (at[None, :] != self.own[points][:, None])
        for r in np.nonzero(good.any(1))[0]:
            p, c = points[r], np.nonzero(good[r])[0]
            s, rank = scores[r, c], self.rank[at[c]]
            if len(c) > self.k:
                top = np.lexsort((rank, -s))[: self.k]
                c, s, rank = c[top], s[top], rank[top]
            found = sorted(self.best[p] + list(zip((-s).tolist(), rank.tolist(), at[c].tolist(), strict=True)))[: self.k]
            self.best[p] = found
            if len(found) == self.k:
                self.tau[p] = max(self.tau[p], -found[-1][0])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _planted(table: pa.Table) -> pa.Table:
    """The rows of a tile as one row: its tree."""
    table = table.combine_chunks()
    n, dim = len(table), table["dim"][0].as_py()
    tree = build(_matrix(table["vec"]) if dim else np.zeros((n, 0)))
    p = tree.perm
    ids = table["id"].to_numpy(zero_copy_only=False) if not table["id"].null_count else table["id"].fill_null(0).to_numpy(zero_copy_only=False)
    known = np.array(table["id"].is_valid().to_numpy(zero_copy_only=False))
    kept = tree.points.astype(np.float32)
    kept = kept if (kept == tree.points).all() else tree.points
    cell = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
    return pa.table({
        "dim": table["dim"][:1], "tile": table["tile"][:1], "points": cell(kept), "ids": cell(ids[p].astype(np.int64)), "known": cell(known[p]),
        "rows": cell(table["row"].to_numpy()[p]), "floors": cell(table["floor"].to_numpy()[p]), "nodes": cell(np.hstack([tree.span.astype(np.float64), tree.reach])),
    })


def _grown(dim: int, row: dict, side: str) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}ids"], np.int64)
    raw = row[f"{side}points"]
    points = np.frombuffer(raw, np.float32 if len(raw) == 4 * dim * len(ids) else np.float64).astype(np.float64).reshape(len(ids), dim)
    nodes = np.frombuffer(row[f"{side}nodes"]).reshape(-1, 7)
    tree = Tree(points, np.arange(len(ids)), nodes[:, :5].astype(np.int64), nodes[:, 5:])
    return tree, ids, np.frombuffer(row[f"{side}known"], bool), np.frombuffer(row[f"{side}rows"], np.int64), np.frombuffer(row[f"{side}floors"], np.int64)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                q, qids, _, qrows, floors = _grown(row["dim"], row, "q_")
                x, ids, known, rows, _ = _grown(row["dim"], row, "")
                rank = np.empty(len(ids), np.int64)
                rank[np.lexsort((rows, ids, ~known))] = np.arange(len(ids))
                order = np.argsort(rows)
                spot = np.minimum(np.searchsorted(rows, qrows, sorter=order), len(rows) - 1)
                own = np.where(rows[order[spot]] == qrows, order[spot], -1)
                best = Search(q, x, rank, own, floors, k).best
                found = [(int(qrows[p]), int(qids[p]), int(ids[at]) if known[at] else None, int(rows[at]), -s) for p, b in enumerate(best) for s, _, at in b]
                cols = list(zip(*found, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["q_row", "query_id", "vec_id", "row", "score"])

    return run


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before."""
    picked = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < most and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _placed(pivots: dict[int, np.ndarray]):
    """The nearest pivot of each vector, 0 where there is none of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            cell = np.zeros(len(batch), np.int32)
            for dim in set(dims.tolist()) & set(pivots):
                at, p = np.nonzero(dims == dim)[0], pivots[dim]
                if dim:
                    m = _matrix(batch["vec"].take(pa.array(at)))
                    cell[at] = ((p**2).sum(1)[None, :] - 2 * (m @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _floored(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """The k-th best score of each query among the sample's rows but its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, rows = batch["dim"].to_numpy(), batch["row"].to_numpy()
            floor = np.full(len(batch), _LOW, np.int64)
            for dim in set(dims.tolist()) & set(sample):
                numbers, vecs = sample[dim]
                if len(numbers) <= k:
                    continue
                for at in np.array_split(np.nonzero(dims == dim)[0], max(1, int((dims == dim).sum()) // 1024)):
                    m = _matrix(batch["vec"].take(pa.array(at))) if dim else np.zeros((len(at), 0))
                    exact = (vecs**2).sum(1).max() * (m**2).sum(1).max(initial=0) < float(1 << 104)
                    scores = (m @ vecs.T if exact else m.astype(np.int64) @ vecs.astype(np.int64).T).astype(np.int64)
                    scores[rows[at][:, None] == numbers[None, :]] = _LOW
                    floor[at] = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = TOP_K, id: str = "vec_id", vec: str = "embedding", scale: int = SCALE, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row for which ``asked`` is true:
    the k highest inner products of its quantised vector with those of all rows
    but its own, ties to the smaller id (null last). ids are longs.

    Vectors that are null, hold null or non-finite components, or have a squared
    norm of 2^62 or more after scaling take no part, as queries or candidates.
    Vectors of different lengths never meet; empty ones have score 0 with each
    other. A repeated row is a candidate of its own and, if asked, a query of its
    own. Where there are fewer than k candidates all are returned; an empty table
    gives none. Other columns are ignored. Very long vectors are rows like others;
    a sample of 2,048 rows goes through the driver. Jobs run while the result is
    built: the vectors, the index and the query trees are written.
    """
    spark = vectors.sparkSession
    whole = quantised(vec, scale)
    src = vectors.select(F.col(id).cast("long").alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), whole.alias("vec")).where("vec is not null")
    src = cut(src.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("vec")}), "vectors")

    picked = src.select("row", "dim", "vec").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()
    total = src.count()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(r)
    sample = {d: (np.array([r["row"] for r in rs], np.int64), np.array([r["vec"] for r in rs], np.float64).reshape(len(rs), d)) for d, rs in by_dim.items()}
    pivots = {d: _pivots(m, min(PIVOTS, max(1, -(-total * len(m) // (len(picked) * tile))))) for d, (_, m) in sample.items()}

    base = src.schema
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base)
    rows = src.mapInArrow(_placed(pivots), f"{kinds}, cell int")
    cells = rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / tile).alias("parts"))
    in_order = Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cut(cells.withColumn("first", F.coalesce(F.sum("parts").over(in_order), F.lit(0))), "cells")
    dealt = rows.join(cells, ["dim", "cell"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")))
    index = cut(dealt.select("dim", "tile", "row", "id", F.lit(0).cast("long").alias("floor"), "vec").groupBy("dim", "tile").applyInArrow(_planted, _TREE), "index")

    queries = src.where("asked").mapInArrow(_floored(sample, k), f"{kinds}, floor long")
    sizes = src.groupBy("dim").agg(F.ceil(F.count(F.when(F.col("asked"), 1)) / tile).alias("parts"))
    sizes = cut(sizes.join(cells.groupBy("dim").agg(F.sum(cells["parts"]).alias("tiles")), "dim"), "sizes")
    queries = queries.join(sizes, "dim").withColumn("tile", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")))
    planted = cut(queries.select("dim", "tile", "row", "id", "floor", "vec").groupBy("dim", "tile").applyInArrow(_planted, _TREE), "queries")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sides = planted.join(sizes.select("dim", "tiles"), "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), *(F.col(c).alias(f"q_{c}") for c in ("points", "ids", "known", "rows", "floors", "nodes")))
    pairs = sides.repartition(parts, "dim", "tile").join(index.repartition(parts, "dim", "tile"), ["dim", "tile"])
    found = pairs.mapInArrow(_searched(k), "q_row long, query_id long, vec_id long, row long, score long")
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

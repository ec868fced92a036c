"""Connected components as iterated joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop


#: Edges that a task joins up at once before the rounds.
_CHUNK = 1 << 20


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest
    node reachable. Self loops give a component of one; null ends are ignored;
    repeated edges count once; no edges give no rows.

    Tasks first join up the edges they hold, a chunk at a time, so that what is
    left are stars, few of them linked across tasks. Then alternating large-star
    and small-star rounds re-hang edges on the smallest neighbour until all are
    stars, in a number of rounds in the order of the squared logarithm of the
    longest path. Minima are taken by partial aggregation, the joins are
    skew-splittable, and each round is written to the shared folder while the
    result is built, so no task holds a component.
    """
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    raw = cut(raw, "edges")
    lone = raw.where("a = b").select(F.col("a").alias("node"))
    kind = raw.schema["a"].dataType.simpleString()
    now = raw.where("a <> b").mapInArrow(_join_up, f"v {kind}, u {kind}").distinct()
    now = cut(now, "round")
    while not _stars(now):
        before, now = now, cut(_small_star(_large_star(now)), "round")
        drop(before)
    hung = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    tops = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    known = hung.unionByName(tops)
    alone = lone.distinct().join(known, "node", "left_anti").select("node", F.col("node").alias("component"))
    return known.unionByName(alone)


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars (v, u): every node of a chunk with the smallest node
    it reaches in the chunk."""
    top: dict = {}

    def find(x):
        while (y := top.setdefault(x, x)) != x:
            top[x] = top[y] = top.setdefault(y, y)  # halves the path
            x = top[x]
        return x

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        hung = [(x, find(x)) for x in list(top)]
        hung = [(x, y) for x, y in hung if x != y]
        top.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in hung], kind), pa.array([y for _, y in hung], kind)], names=["v", "u"])

    n, kind = 0, None
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                top[max(x, y)] = min(x, y)
        n += b.num_rows
        if n >= _CHUNK:
            yield stars(kind)
            n = 0
    if n:
        yield stars(kind)


def _stars(e: DataFrame) -> bool:
    """Every node hangs on one other, and none on a node that hangs itself."""
    ends = e.select(F.col("v").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(e.select(F.col("u").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or (hangs > 0 and holds > 0)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest neighbour or itself."""
    near = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
    least = near.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    # (v, u) with v larger: v is re-hung on the least neighbour of u, and for each u itself nothing else is larger
    return e.join(least, e["u"] == least["x"]).select("v", F.col("m").alias("u")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of them."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    both = e.join(least, "v")
    moved = both.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    own = least.select("v", F.col("m").alias("u"))
    return moved.unionByName(own).distinct()

"""An inverted-file index over vectors, written once and searched many times.

Centroids of directions are fitted on a bounded sample; every row goes to the list
of the centroid of the highest cosine, and the table is written partitioned by
list, a large list as several parts of bounded rows. A search reads the lists that
its queries probe and no others, meets queries and parts in tiles of bounded size,
and ends with exact cosines. With ``exact`` it goes on: a list whose centroid and
angle leave room for a better row than the k-th found is probed as well, so the
result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.vector import CELLS, TOP_K, top_k

#: Rows on which centroids are fitted: those of the smallest hashes of their ids.
SAMPLE = 20_000
MOST_LISTS = 4096
#: Rows of a part of a list, and queries that meet it at once.
PART_ROWS = 8_192
TILE_QUERIES = 1_024
#: Queries that come to one task with a part, on the average, at most.
DEALT_QUERIES = 16_384
#: Rows that are asked for once at the building, and the recall among their neighbours that sets the number of probes.
CALIBRATION = 256
RECALL = 0.94
SEED = 42
#: Angles are rounded; a bound is widened by this much.
_SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Where an index lies: its rows, and a table of at most MOST_LISTS centroids."""

    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        """(node_id, vec, *by, part, list)"""
        return self.spark.read.parquet(f"{self.path}/rows")

    def probes(self) -> int:
        """The lists that a search probes unless told otherwise."""
        return self.spark.read.parquet(f"{self.path}/probes").first()[0]

    def centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lists, unit centres, widest angles, and numbers of parts."""
        found = sorted(self.spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r["list"])
        return (np.array([r["list"] for r in found], np.int64), np.array([r["centre"] for r in found], np.float64), np.array([r["angle"] for r in found], np.float64), np.array([r["parts"] for r in found], np.int64))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=-1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows that have about CELLS elements in all, ``width`` a row."""
    some = max(1, CELLS // max(1, width))
    for b in batches:
        for lo in range(0, b.num_rows, some):
            yield b.slice(lo, some)


def _assigned(centres: np.ndarray):
    """Each row's list, by the highest cosine, and its angle to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, len(centres)):
            if b.num_rows:
                alike = _unit(_matrix(b["vec"])) @ centres.T
                at = alike.argmax(1)
                angle = np.arccos(np.clip(alike[np.arange(len(at)), at], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=[*b.schema.names, "list", "angle"])

    return run


def build(corpus: DataFrame, path: str, lists: int | None = None, by: tuple[str, ...] = (), sample: int = SAMPLE, seed: int = SEED, part_rows: int = PART_ROWS, target: float = RECALL) -> Index:
    """Write the index of ``corpus`` (node_id, vec, *by) to ``path``. ``lists``:
    their number, else the root of the rows' number, MOST_LISTS at most.

    Null vectors are left out; all others must have the same length. A zero vector
    has cosine 0 to everything and goes to the first list. Rows of one list are
    dealt to parts by a hash of their id, so that a list may hold any share of all
    rows; repeated rows are rows of their own. ValueError where no vector is left
    to fit centroids on. The sample is the only thing that one fit has to hold.
    How many lists a search probes is measured: the exact neighbours of 256 rows
    (one scan) must lie in the nearest lists at the rate ``target``.
    """
    spark = corpus.sparkSession
    kept = corpus.where("vec is not null").select("node_id", F.col("vec").cast("array<double>").alias("vec"), *by)
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n = kept.count()
    wanted = max(1, min(MOST_LISTS, lists or round(n**0.5)))
    drawn = kept.where(norm > 0).select("node_id", "vec").orderBy(F.xxhash64("node_id"), "node_id").limit(sample)
    fitted_on = drawn.select(array_to_vector("vec").alias("features")).repartition(8).cache()
    try:
        if fitted_on.isEmpty():
            raise ValueError("no vectors to fit centroids on")
        model = KMeans(k=wanted, maxIter=10, seed=seed, distanceMeasure="cosine").fit(fitted_on)
    finally:
        fitted_on.unpersist()
    centres = _unit(np.array(model.clusterCenters(), np.float64))
    kinds = ", ".join(f"{c} {t}" for c, t in kept.dtypes)
    placed = kept.mapInArrow(_assigned(centres), f"{kinds}, list int, angle double")
    sizes = placed.groupBy("list").agg(F.count("*").alias("rows"), F.max("angle").alias("angle"))
    held = {r["list"]: r for r in sizes.collect()}  # a row a list
    parts = {i: max(1, -(-held[i]["rows"] // part_rows)) if i in held else 0 for i in range(len(centres))}
    table = [(i, centres[i].tolist(), float(held[i]["angle"]), parts[i]) for i in range(len(centres)) if i in held]
    spark.createDataFrame(table, "list int, centre array<double>, angle double, parts int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    dealt = F.array(*(F.lit(parts[i]) for i in range(len(centres))))
    part = F.pmod(F.xxhash64("node_id"), F.greatest(F.lit(1), F.element_at(dealt, F.col("list") + 1))).cast("int")
    rows = placed.drop("angle").withColumn("part", part)
    rows.repartition("list", "part").sortWithinPartitions("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    index = Index(spark, path)
    spark.createDataFrame([(_enough(index, kept, target),)], "probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return index


def _enough(index: Index, kept: DataFrame, target: float) -> int:
    """The least number of probes at which the neighbours of a bounded sample of
    rows are found at the rate ``target``."""
    asked = kept.select(F.col("node_id").alias("query_id"), F.col("vec").alias("query_vec")).orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(CALIBRATION)
    truth = top_k(asked, kept).select("query_id", "node_id")
    near = truth.join(index.rows().select("node_id", "list"), "node_id").join(asked, "query_id").select("query_vec", "list").collect()
    lists, centres, _, _ = index.centres()
    alike = _unit(np.array([r["query_vec"] for r in near], np.float64)) @ centres.T
    own = alike[np.arange(len(near)), np.searchsorted(lists, [r["list"] for r in near])]
    needed = np.sort((alike > own[:, None]).sum(1) + 1)
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)])


def _probing(lists: np.ndarray, centres: np.ndarray, angles: np.ndarray, parts: np.ndarray, probes: int, after: bool):
    """The lists that a query probes and their parts: the ``probes`` nearest or,
    ``after`` those, all others in which a cosine of ``least`` is possible. A query's
    vector goes to each of them, so few queries are looked at together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches, int(parts.sum()) * (centres.shape[1] + 4)):
            alike = _unit(_matrix(b["query_vec"])) @ centres.T
            place = np.empty_like(alike, np.int64)
            np.put_along_axis(place, np.argsort(-alike, axis=1, kind="stable"), np.arange(len(lists))[None, :], 1)
            chosen = place < probes
            if after:
                gap = np.maximum(np.arccos(np.clip(alike, -1, 1)) - angles[None, :], 0)
                least = b["least"].to_numpy(zero_copy_only=False)
                chosen = ~chosen & ~(np.cos(gap) + _SLACK < least[:, None])
            q, at = np.nonzero(chosen)
            q, at, n = np.repeat(q, parts[at]), np.repeat(at, parts[at]), parts[at]
            part = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([b["query_id"].take(pa.array(q)), b["query_vec"].take(pa.array(q)), pa.array(lists[at].astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_id", "query_vec", "list", "part"])

    return run


def _scored(k: int, by: tuple[str, ...], digits: int):
    """The k best rows of a part for each query that probes it."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        asked, rows = asked.combine_chunks(), rows.combine_chunks()
        names = ["query_id", "node_id", *by, "score"]
        picked, scored = [], []
        if asked.num_rows and rows.num_rows:
            unit, node = _unit(_matrix(rows["vec"].combine_chunks())), rows["node_id"].to_numpy()
            group = np.zeros(rows.num_rows, np.int64)
            for c in by:
                codes = rows[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                group = np.unique(group * (rows.num_rows + 1) + codes + 1, return_inverse=True)[1]
            most = max(1, min(TILE_QUERIES, CELLS // rows.num_rows))
            for lo in range(0, asked.num_rows, most):
                some = asked.slice(lo, most)
                scores = np.round(_unit(_matrix(some["query_vec"].combine_chunks())) @ unit.T, digits) + 0.0
                for g in np.unique(group):
                    mine = np.flatnonzero(group == g)
                    part = -scores[:, mine]
                    least = part if len(mine) <= k else np.partition(part, k - 1, axis=1)[:, k - 1 : k]
                    q, r = np.nonzero(part <= least)
                    order = np.lexsort((node[mine[r]], part[q, r], q))
                    q, r = q[order], mine[r[order]]
                    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
                    q, r = q[nth < k], r[nth < k]
                    picked.append((q + lo, r))
                    scored.append(scores[q, r])
        q, r = (np.concatenate([p[i] for p in picked]) if picked else np.zeros(0, np.int64) for i in range(2))
        columns = [asked["query_id"].take(pa.array(q)), *(rows[c].take(pa.array(r)) for c in ("node_id", *by)), pa.chunked_array([pa.array(np.concatenate(scored) if scored else np.zeros(0))])]
        return pa.table(columns, names=names)

    return run


def search(queries: DataFrame, index: Index, k: int = TOP_K, by: tuple[str, ...] = (), probes: int | None = None, exact: bool = False, digits: int = 6) -> DataFrame:
    """(query_id, node_id, *by, score, rank): for each query (query_id,
    query_vec), distinct by id, the k rows of the highest cosine in each group of
    ``by`` among the lists that it probes; scores are rounded, ties go to the
    smaller node_id. ``exact``: among all rows.

    Null query vectors find nothing. A query is dealt to the parts of its lists,
    so a part meets its own queries only, in tiles of bounded size; only a part's
    best k a query are shuffled on. ``exact`` runs the first probe as a job of its own where no
    cache holds it, and is for one group (no ``by``).
    """
    if exact and by:
        raise ValueError("an exact search has no groups")
    lists, centres, angles, parts = index.centres()
    probes = probes or index.probes()
    narrow = queries.schema["query_vec"].dataType.simpleString() == "array<float>"
    vectors = "array<float>" if narrow else "array<double>"
    asked = queries.where("query_vec is not null").select("query_id", F.col("query_vec").cast(vectors).alias("query_vec"))
    tiles = max(1, -(-asked.count() // DEALT_QUERIES))
    kind = asked.schema["query_id"].dataType.simpleString()
    probed = f"query_id {kind}, query_vec {vectors}, list int, part int"
    rows = index.rows().select("node_id", "vec", *by, "list", "part")
    out = ", ".join([f"query_id {kind}", *(f"{c} {t}" for c, t in rows.select("node_id", *by).dtypes), "score double"])
    order = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "node_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def meet(dealt: DataFrame) -> DataFrame:
        met = [r[0] for r in dealt.select("list").distinct().collect()]  # a number a list: only their folders are read
        dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("query_id"), F.lit(tiles)).cast("int"))
        held = rows.where(F.col("list").isin(met)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        tile = dealt.groupBy("list", "part", "tile").cogroup(held.groupBy("list", "part", "tile"))
        return tile.applyInArrow(_scored(k, by, digits), out)

    found = best(meet(asked.mapInArrow(_probing(lists, centres, angles, parts, probes, False), probed)))
    if not exact or probes >= len(lists):
        return found
    least = found.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
    rest = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)) - 10.0**-digits)
    more = meet(rest.mapInArrow(_probing(lists, centres, angles, parts, probes, True), probed))
    return best(found.drop("rank").unionByName(more))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of ``truth`` (query_id, node_id) that ``found`` has."""
    hit = truth.select("query_id", "node_id").join(found.select("query_id", "node_id", F.lit(1).alias("hit")), ["query_id", "node_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]

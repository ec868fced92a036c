"""Query sets of one block and of many against rows, by brute force."""

import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import matching, vector
from tidemark.plans import blocks


@pytest.fixture
def tiled(monkeypatch):
    """Blocks of 3 queries, tiles of 7 rows, batches of 2; nothing else may come to the driver whole."""
    for name, n in (("TILE_ROWS", 7), ("BATCH_ROWS", 2)):
        monkeypatch.setattr(blocks, name, n)
    for module in (vector, matching):
        monkeypatch.setattr(module, "by_block", partial(blocks.by_block, size=3))


def best(asked, rows, k):
    def cos(a, b):
        n = np.sqrt(np.dot(a, a) * np.dot(b, b))
        return round(float(np.dot(a, b) / n), 6) + 0.0 if n else 0.0

    return sorted((q, n, r + 1) for q, a in asked for r, (_, n) in enumerate(sorted((-cos(a, b), n) for n, b in rows)[:k]))


def test_many_blocks_of_vectors(spark, tiled):
    rng = random.Random(7)
    vec = lambda: [float(rng.randrange(-2, 3)) for _ in range(3)]
    asked = [(q, vec()) for q in range(20)]
    rows = [(n, vec()) for n in range(40)] + [(100 + n, [1.0, 2.0, 0.0]) for n in range(30)]  # copies: nearly half of all
    got = vector.top_k(
        spark.createDataFrame([*asked, (99, None)], "query_id long, query_vec array<double>").repartition(3),
        spark.createDataFrame([*rows, (999, None)], "node_id long, vec array<double>").repartition(4), k=4,
    )
    assert sorted((r.query_id, r.node_id, r["rank"]) for r in got.collect()) == best(asked, rows, 4)


def test_many_blocks_stay_off_the_driver(spark, tiled, monkeypatch):
    came = []
    whole = DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: came.append(t := whole(df)) or t)
    monkeypatch.setattr(DataFrame, "collect", lambda df: pytest.fail("collected"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("query_vec"))
    rows = spark.range(30).select(F.col("id").alias("node_id"), F.array(F.lit(1.0), F.col("id") + 1.0).alias("vec"))
    out = vector.top_k(asked, rows, k=2)
    assert out.count() == 100
    assert sum(t.num_rows for t in came) == 0


def test_pairs_are_even(spark):
    """Equal rows, a hot spot for any hash, are dealt out evenly."""
    same = spark.range(1000).select(F.lit("same").alias("x")).coalesce(1)
    n = [r["count"] for r in blocks._dealt(same, "tile", 10, "block", 3).groupBy("tile", "block").count().collect()]
    assert len(n) == 30 and set(n) == {100}


@pytest.mark.parametrize("empty", ["queries", "rows", "both"])
def test_empty_sides(spark, tiled, empty):
    asked = spark.createDataFrame([(q, "a", ["a"]) for q in range(0 if empty != "rows" else 9)], "query_id long, low string, words array<string>")
    rows = spark.createDataFrame([(str(n), "a", 2, ["a"]) for n in range(0 if empty != "queries" else 9)], "id string, name string, bonus int, words array<string>")
    assert matching.overlaps(asked, rows, 2).collect() == []
    assert matching.containing(rows.select(F.col("id").alias("text_id"), F.col("name").alias("text")), asked.select(F.col("query_id").alias("pattern_id"), F.col("low").alias("pattern"))).collect() == []


def test_overlaps_in_tiles_as_in_one_block(spark, tiled, monkeypatch):
    rng = random.Random(8)
    words = lambda: sorted({rng.choice("abcdef") for _ in range(rng.randrange(5))})
    asked = spark.createDataFrame([(q, rng.choice([None, "ab cd", "x"]), words() or None) for q in range(12)], "query_id long, low string, words array<string>")
    rows = spark.createDataFrame([(str(n), rng.choice([None, "ab", "", "x"]), 2, words() or None) for n in range(40)], "id string, name string, bonus int, words array<string>").repartition(5)

    def top(df):
        found = {}
        for r in df.collect():
            found.setdefault(r.query_id, set()).add((-r.overlap, r.id))
        return {q: sorted(s)[:3] for q, s in found.items()}

    many = top(matching.overlaps(asked, rows, 3))
    monkeypatch.setattr(matching, "by_block", blocks.by_block)
    assert many == top(matching.overlaps(asked, rows, 3))


@pytest.mark.parametrize("by", [(), ("kind",)])
def test_scores_at_once_are_bounded(by):
    """A full batch against a full block: never all of their scores in memory."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows, unit = rng.standard_normal((blocks.BATCH_ROWS, 8)), vector._unit(rng.standard_normal((blocks.QUERY_BLOCK, 8)))
    columns = {"node_id": np.arange(len(rows)), **({"kind": np.arange(len(rows)) % 2} if by else {}), "vec": rows.tolist()}
    batch = pa.table(columns).combine_chunks().to_batches()[0]
    tracemalloc.start()
    found = [(q, s) for b in vector._best_of_batch(list(range(len(unit))), unit, 1, len(by), 6)(iter([batch])) for q, s in zip(b["query_id"].to_pylist(), b["score"].to_pylist(), strict=True)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
    best = np.round((vector._unit(rows) @ unit.T).max(axis=0), 6)
    assert all(max(s for s in (t for p, t in found if p == q)) == pytest.approx(best[q]) for q in (0, 777, len(unit) - 1))


def test_equal_names_and_queries_are_met_once(spark, monkeypatch):
    from tidemark.operators import graph

    met = []
    whole = graph.first_names
    monkeypatch.setattr(graph, "first_names", lambda q, n: met.append((q.count(), n.count())) or whole(q, n))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.element_at(F.array(F.lit("Hot"), F.lit("one HOT bolt please"), F.lit("zzz")), (F.col("id") % 3 + 1).cast("int")).alias("query"))
    names = spark.range(500).select(F.element_at(F.array(F.lit("hot bolt"), F.lit("Hot ring"), F.lit("cold")), (F.col("id") % 3 + 1).cast("int")).alias("name"))
    got = graph.lookup_by_name(asked.unionByName(spark.createDataFrame([(900, None)], "query_id long, query string")), names).collect()
    assert sorted((r.query_id, r.query, r.name) for r in got) == [(i, ("Hot", "one HOT bolt please")[i % 3], "Hot ring" if i % 3 == 0 else "hot bolt") for i in range(300) if i % 3 < 2]
    assert met == [(4, 3)]


def test_rows_that_earlier_batches_beat_are_not_sent():
    """Of many batches of one task, each group's best so far bound what the later ones send; ties, zeros and
    vectors with nan included."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    vecs = rng.integers(-2, 3, (4000, 6)).astype(float)  # many equal scores
    vecs[17] = 0
    vecs[::50] = np.nan
    node, kind = rng.permutation(4000), np.where(np.arange(4000) % 3, "a", "b")
    unit = vector._unit(rng.standard_normal((30, 6)))
    table = pa.table({"node_id": node, "kind": kind, "vec": vecs.tolist()})
    sent = [r for b in vector._best_of_batch(list(range(30)), unit, 4, 1, 6)(iter(table.to_batches(max_chunksize=100))) for r in b.to_pylist()]
    scores = np.round(vector._unit(vecs) @ unit.T, 6)
    for q in range(30):
        for g in "ab":
            want = sorted((-scores[i, q] + 0.0, int(node[i])) for i in range(4000) if kind[i] == g and not np.isnan(scores[i, q]))[:4]
            got = sorted((-r["score"] + 0.0, r["node_id"]) for r in sent if (r["query_id"], r["kind"]) == (q, g))[:4]
            assert got == want
    assert len(sent) < 40 * 30 * 2 * 4 / 2


@pytest.mark.parametrize("by", [(), ("kind",)])
def test_a_full_group_of_a_search_is_bounded(spark, monkeypatch, by):
    """A whole block of queries against a whole tile of vectors, as one task of dense_topk (no kinds) and of the
    queries over dual_domain meets them: what it takes beside the tile, in numpy and in Arrow."""
    import tracemalloc

    import pyarrow as pa

    met = []
    monkeypatch.setattr(vector, "by_block", lambda asked, rows, meet, out, **_: met.append(meet) or spark.createDataFrame([], out))
    corpus = spark.createDataFrame([], ", ".join(["node_id long", *(f"{c} string" for c in by), "vec array<float>"]))
    schema = vector.top_k(spark.createDataFrame([], "query_id long, query_vec array<float>"), corpus, by=by).drop("rank").toArrow().schema
    n, wide, rng = blocks.TILE_BYTES // (8 * 64 + 16), 64, np.random.default_rng(9)
    vecs = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), wide).cast(pa.list_(pa.float32()))
    asked_m, held_m = (rng.standard_normal((m, wide), np.float32) for m in (blocks.QUERY_BLOCK, n))
    kind = np.where(np.arange(n) % 3, "chunk", "menu")
    asked = pa.table({"query_id": np.arange(len(asked_m)), "query_vec": vecs(asked_m)})
    held = pa.table({"node_id": np.arange(n), **({"kind": kind} if by else {}), "vec": vecs(held_m)})
    before, arrow = pa.total_allocated_bytes(), []
    watched = lambda block: lambda batches: (arrow.append(pa.total_allocated_bytes()) or b for b in met[0](block)(batches))
    run = blocks._pair(watched, asked.column_names, held.column_names, schema)
    tracemalloc.start()
    found = run(asked, held)
    peak = tracemalloc.get_traced_memory()[1] + max(arrow) - before
    tracemalloc.stop()
    assert peak < 160 << 20
    scores = np.round(vector._unit(held_m.astype(float)) @ vector._unit(asked_m[[0, 999, 1999]].astype(float)).T, 6)
    for i, q in enumerate((0, 999, 1999)):
        rows = found.filter(pa.compute.equal(found["query_id"], q)).to_pylist()
        for g in ("chunk", "menu") if by else (None,):
            mine = np.flatnonzero(kind == g) if by else np.arange(n)
            want = sorted((-s, c) for s, c in zip(scores[mine, i].tolist(), mine.tolist()))[: vector.TOP_K]
            assert sorted((-r["score"], r["node_id"]) for r in rows if not by or r["kind"] == g)[: vector.TOP_K] == want


@pytest.mark.parametrize("name", ["expansion_shared_entity", "expansion_recall", "target_lost", "precision_at_5", "dense_topk"])
def test_queries_in_many_groups_as_in_sql(spark, monkeypatch, tmp_path, name):
    """Blocks of 30 queries, tiles of 500 rows, parts of 100 chunks: on the given table a query set is one block.
    A quarter of the vectors come a second time, so that many scores are equal."""
    from oracle import TESTDATA, compare, connect

    from tidemark.operators import graph
    from tidemark.plans import search_queries

    for module, limit, n in ((blocks, "TILE_ROWS", 500), (blocks, "BATCH_ROWS", 60), (graph, "PART_CHUNKS", 100), (graph, "TILE_QUERIES", 15)):
        monkeypatch.setattr(module, limit, n)
    monkeypatch.setattr(vector, "by_block", partial(blocks.by_block, size=30))
    monkeypatch.setattr(graph, "sharing", partial(graph.sharing, heavy=20))
    groups, pair, sharing = [], blocks._pair, graph._best_sharing
    monkeypatch.setattr(blocks, "_pair", lambda *a: groups.append("vectors") or pair(*a))
    monkeypatch.setattr(graph, "_best_sharing", lambda: groups.append("chunks") or sharing())
    e = spark.read.parquet(f"{TESTDATA}/sf0.1/embeddings.parquet")
    e.unionByName(e.where("vec_id < 500").withColumn("vec_id", F.col("vec_id") + 2000)).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = connect(f"{TESTDATA}/sf0.01")
    con.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    compare(search_queries.R.queries[name](spark, str(tmp_path)), con, search_queries.R.sql[name])
    assert groups == ["vectors", "chunks"] if name.startswith("expansion") else groups == ["vectors"]

"""Bags of words, the index over them, and chunks that share entities, by brute force."""

import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tidemark.operators import graph, sparse


def bag(text):
    n = Counter(re.findall(r"\w+", (text or "").lower()))
    norm = sum(v * v for v in n.values()) ** 0.5
    return {w: v / norm for w, v in n.items()}


def words(rng, n, kinds=60):
    return " ".join(f"w{int(rng.paretovariate(0.8)) % kinds}" for _ in range(n))


def test_bags(spark):
    rows = [(1, "a b A, c"), (2, None), (3, ""), (4, "--"), (5, "chị Chị cà")]
    got = {(r.id, r.word): round(r.x, 9) for r in sparse.bags(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    assert got == {(i, w): round(x, 9) for i, t in rows for w, x in bag(t).items()}


def test_long_texts_take_seconds(spark):
    df = spark.createDataFrame([(i, " ".join(f"x{j}" for j in range(20_000))) for i in range(3)], "id long, text string")
    began = time.monotonic()
    assert sparse.bags(df, "id", "text").count() == 60_000
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("shard_rows", [40, 2048])
def test_sparse_top_k_equals_all_pairs(spark, shard_rows):
    rng = random.Random(7)
    texts = [(i, words(rng, rng.randrange(1, 30))) for i in range(300)] + [(i, "w1 w2") for i in range(300, 330)] + [(400, None)]
    asked = [(i, words(rng, rng.randrange(1, 8))) for i in range(20)] + [(20, "w1"), (21, "nowhere"), (22, None)]
    q = sparse.bags(spark.createDataFrame(asked, "query_id long, text string"), "query_id", "text")
    d = sparse.bags(spark.createDataFrame(texts, "node_id long, text string"), "node_id", "text")
    want = []
    for i, t in asked:
        scores = [(-round(sum(x * bag(u).get(w, 0.0) for w, x in bag(t).items()), 6), j) for j, u in texts]
        want += [(i, j, -s, n + 1) for n, (s, j) in enumerate(sorted(x for x in scores if x[0] < 0)[:4])]
    assert sorted((r.query_id, r.node_id, round(r.score, 6), r["rank"]) for r in sparse.top_k(q, d, 4, shard_rows).collect()) == sorted(want)
    assert sparse.top_k(q.limit(0), d, 4).count() == 0 and sparse.top_k(q, d.limit(0), 4).count() == 0


def test_a_search_stops_early():
    rng = np.random.default_rng(3)
    row, word = np.repeat(np.arange(4000), 5), np.concatenate([rng.choice(40, 5, replace=False) for _ in range(4000)])
    shard = sparse.Shard(row, word, rng.random(20_000) ** 4)
    best = shard.best([1, 2], [0.8, 0.6], np.arange(4000), 5)
    assert len(best) == 5 and shard.read < 0.5 * np.isin(word, [1, 2]).sum()


@pytest.mark.parametrize("heavy", [0, 3, 20, 10_000])
def test_sharing_however_heavy_the_entities(spark, monkeypatch, heavy):
    rng = random.Random(11)
    links = [(c, f"e{int(rng.paretovariate(0.7)) % 50}") for c in range(150) for _ in range(rng.randrange(6))] + [(149, None), (3, "e1"), (3, "e1")]
    seeds = [(q, rng.randrange(150), k) for q in range(12) for k in range(rng.randrange(1, 4))] + [(90, 100_000, 0)]
    of = {}
    for c, e in links:
        if e is not None:
            of.setdefault(c, set()).add(e)
    want = []
    for q in {s[0] for s in seeds}:
        mine = [c for x, c, _ in seeds if x == q]
        shared = {c: {e for e in es for s in mine if s != c and e in of.get(s, ())} for c, es in of.items()}
        best = sorted((-len(es), c) for c, es in shared.items() if es)[: 3 * len(mine)]
        want += [(q, c, -n, i + 1) for i, (n, c) in enumerate(best)]
    monkeypatch.setattr(graph, "PART_CHUNKS", 40)
    monkeypatch.setattr(graph, "TILE_QUERIES", 5)
    got = graph.sharing(spark.createDataFrame(seeds, "query_id long, node_id long, ordinal int"), spark.createDataFrame(links, "chunk_id long, entity string"), heavy=heavy)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_words_are_not_shuffled(spark):
    """Bags take one exchange, of texts; words that no query has do not reach the shards."""
    rows = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "id long, text string")
    made = sparse.bags(rows, "id", "text")
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.id, r.word, round(r.x, 6)) for r in made.collect()) == [(1, "a", 0.894427), (1, "b", 0.447214), (2, "b", 0.707107), (2, "c", 0.707107)]
    asked = sparse.bags(spark.createDataFrame([(2, "b")], "query_id long, text string"), "query_id", "text")
    for n in (None, 3, 5_000):
        found = sparse.top_k(asked, made.withColumnRenamed("id", "node_id"), 2, n_rows=n).collect()
        assert sorted((r.query_id, r.node_id, r.score) for r in found) == [(2, 1, 0.447214), (2, 2, 0.707107)]


def test_a_part_of_a_hub_is_counted_in_bounded_memory():
    """A full tile of queries against a full part of chunks, one query at a time, as by brute force."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, m = 16_384, 1_024
    node = rng.permutation(n) * 3
    has = [sorted({f"a{i % 5}", f"b{i % 7}"}) for i in node.tolist()]
    links = pa.table({"node_id": np.repeat(node, [len(h) for h in has]), "entity": [e for h in has for e in h]})
    asked = [(q, e, int(rng.choice(node)) if rng.random() < 0.5 else None, 3 + q % 20) for q in range(m) for e in rng.choice(["a0", "a3", "b1", "b2", "b6", "none"], 3, replace=False).tolist()]
    asked = [asked[i] for i in rng.permutation(len(asked))]
    table = pa.table(dict(zip(("query_id", "entity", "only_seed", "most"), map(list, zip(*asked)))), schema=pa.schema({"query_id": pa.int64(), "entity": pa.string(), "only_seed": pa.int64(), "most": pa.int64()}))
    tracemalloc.start()
    got = graph._best_sharing()(table, links)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
    found = {}
    for r in got.to_pylist():
        found.setdefault(r["query_id"], []).append((-r["shared"], r["node_id"]))
    for q in range(0, m, 100):
        mine = [(e, only) for p, e, only, _ in asked if p == q]
        count = [(-sum(e in h and only != c for e, only in mine), c) for c, h in zip(node.tolist(), has)]
        assert sorted(found[q]) == sorted(x for x in count if x[0])[: 3 + q % 20]

"""Strings against rows, global order and streams, by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import graph, matching, metrics, vector
from tidemark.plans import order
from tidemark.sources import files
from tidemark.streaming import stateful

WORDS = ["ab", "abc", "b", "bca", "", "c a", "ca", "zz", "Ü"]


def spoken(seed, n):
    rng = random.Random(seed)
    return [None if rng.random() < 0.1 else "".join(rng.choice("abc Ü") for _ in range(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("size", [2000, 3])
def test_containing(spark, monkeypatch, size):
    monkeypatch.setattr(matching.by_block, "__defaults__", (size, None, 16 << 20))
    texts, patterns = list(enumerate(spoken(1, 60))), list(enumerate([*WORDS, "ab", None]))
    got = matching.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(patterns, "pattern_id long, pattern string"))
    want = [(p, t) for p, a in patterns for t, b in texts if a is not None and b is not None and a in b]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_lookup_by_name(spark):
    names, asked = [*spoken(2, 40), "Bca", "bca"], list(enumerate([*WORDS, "x bca y", "none of it", None]))
    got = graph.lookup_by_name(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame([(n,) for n in names], "name string").repartition(3))
    want = []
    for i, q in asked:
        hits = sorted({n for n in names if n is not None and q is not None and (q.lower() in n.lower() or n.lower() in q.lower())}, key=lambda n: (len(n), n))
        want += [(i, q, hits[0])] if hits else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_overlap_search(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("red green blue sour sweet cold".split()) for _ in range(n))
    asked = [(i, line(rng.randrange(5))) for i in range(12)] + [(12, "unknown"), (13, None)]
    facts = [(i, line(rng.randrange(6))) for i in range(50)] + [(50, None)]
    menu = [("red", 1000, "sour sweet"), ("cold blue", 2000, None), ("Green", 3000, "sweet")]
    got = vector.overlap_search(
        spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(facts, "fact_id long, fact string").repartition(4), spark.createDataFrame(menu, "name string, price int, description string")
    )
    want = []
    for i, q in asked:
        mine, found = set((q or "").split()), []
        for f, t in facts:
            n = len(mine & set((t or "").split()))
            found += [(-n / 10, "faq", str(f), t)] if n else []
        for name, price, told in menu:
            n = len(mine & set((told or "").split())) + 2 * (name.lower() in (q or "").lower())
            found += [(-n / 10, "menu", name, None if told is None else f"{name} ({price:,}đ) - {told}")] if n else []
        best = sorted(found, key=lambda r: r[:3])[:3]
        want += [(i, -s, src, k + 1) for k, (s, src, _, _) in enumerate(best)] or [(i, 0.0, "none", 1)]
    assert sorted((r.query_id, r.score, r.source, r["rank"]) for r in got.collect()) == sorted(want)


def test_global_order(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(5), i, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i int, x int").repartition(5)
    ordered = sorted(rows)
    assert sorted((r.g, r.i, r.n) for r in order.numbered(df, ["g", "i"]).collect()) == [(g, i, n) for n, (g, i, _) in enumerate(ordered)]
    sums = {(r.g, r.i): r.s for r in order.running(df, ["g", "i"], {"s": F.col("x")}).collect()}
    assert sums == {(g, i): sum(x for *_, x in ordered[:n]) for n, (g, i, _) in enumerate(ordered)}
    before = {(r.g, r.i): r.p for r in order.previous(df, ["g", "i"], F.col("x"), "p").collect()}
    assert before == {(g, i): ordered[n - 1][2] if n else None for n, (g, i, _) in enumerate(ordered)}
    assert order.numbered(df.limit(0), ["g", "i"]).count() == 0


def test_vectors_of_another_length_are_an_error(spark):
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 1.0])], "node_id long, vec array<double>")
    with pytest.raises(Exception, match="2 elements"):
        vector.top_k(asked, rows).collect()


def test_strict_arrays_fail(spark):
    df = spark.createDataFrame([('x ["a", 1] y',), ("none",)], "c string")
    assert df.where("c <> 'none'").select(text.json_array_strict(F.col("c")).alias("j")).first().j == ['"a"', "1"]
    with pytest.raises(Exception, match="no JSON array"):
        df.select(text.json_array_strict(F.col("c"))).collect()


def test_ranks_of_groups(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), float(rng.randrange(12))) for _ in range(90)]
    got = {r.g: r for r in metrics.ranked(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", {"m": F.floor(F.col("n") / 2)}, ["g"]).collect()}
    for g in (None, "a", "b"):
        mine = sorted(v for k, v in rows if k == g)
        assert (got[g].n, got[g].m) == (len(mine), mine[len(mine) // 2])


def test_pdf_without_its_library_says_so(spark):
    pytest.importorskip("pyspark")
    try:
        import pypdf  # noqa: F401
    except ImportError:
        with pytest.raises(Exception, match="pypdf"):
            files.document_texts(spark.createDataFrame([("a.pdf", bytearray(b"%PDF"))], "path string, content binary")).collect()


def test_sessions_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:10:00"), (9, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stateful.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.user_id, str(r.session_start), r.n) for r in spark.table("closed").collect()) == [(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 02:00:00", 1), (2, "2024-01-01 00:10:00", 1)]

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph, vector


def requests(spark, rows):
    return spark.createDataFrame(rows, "request_id long, query string, t double")


def test_equal_requests_are_searched_once(spark):
    asked = requests(spark, [(1, "Latte  size M", 0.0), (2, "latte size m", 5.0), (3, "latte size M ", 10.1), (4, "tea", 3.0), (5, "TEA", 30.0), (6, None, 0.0)])
    seen = []

    def search(q):
        rows = q.collect()
        seen.extend(r["query"] for r in rows)
        return spark.createDataFrame([(r["query_id"], n) for r in rows if r["query"] and "L" in r["query"] for n in ("a", "b")], "query_id string, found string")

    got = {(r.request_id, r.hit, r.found) for r in vector.cached_search(asked, search, 10.0).collect()}
    assert sorted(seen, key=str) == ["Latte  size M", None, "tea"]
    # the entry of 0.0 is not renewed by the hit at 5.0; what was found empty is a hit too, as long as it is fresh
    assert got == {(1, False, "a"), (1, False, "b"), (2, True, "a"), (2, True, "b"), (3, False, "a"), (3, False, "b"), (4, False, None), (5, False, None), (6, False, None)}


def test_a_search_that_finds_nothing_is_a_hit_too(spark):
    asked = requests(spark, [(1, "x", 0.0), (2, "x", 1.0)])
    nothing = lambda q: q.select("query_id", F.lit("n").alias("found")).limit(0)
    assert sorted((r.request_id, r.hit, r.found) for r in vector.cached_search(asked, nothing, 10.0).collect()) == [(1, False, None), (2, True, None)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (1, "q", "a", "c")]])
def test_faq_chunks_of_odd_rows(spark, rows):
    faq = spark.createDataFrame(rows, "n long, question string, answer string, category string")
    got = sorted((r.chunk_id, r.text) for r in graph.faq_chunks(faq, "n").collect())
    assert got == sorted(("faq:1", " " if q is None else f"{q} {a}") for _, q, a, _ in rows)

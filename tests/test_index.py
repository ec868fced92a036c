"""The inverted-file index against full scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ivf, vector

SF = "/root/testdata/sf0.01"


def frames(spark, points, groups=None, every=7):
    rows = [(i, None if v is None else [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "node_id long, vec array<double>, kind string").repartition(3)
    return df, df.where(F.col("node_id") % every == 0).select(F.col("node_id").alias("query_id"), F.col("vec").alias("query_vec"))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*(cols or ("query_id", "node_id", "score", "rank"))).collect()))


def clustered(n=600, dim=8, hot=0.4):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, dim)) * 3
    at = np.where(rng.random(n) < hot, 0, rng.integers(0, 12, n))
    return list(centres[at] + rng.normal(size=(n, dim)))


def test_exact_search_equals_a_full_scan(spark, tmp_path):
    points = clustered()
    points[3] = points[10] = points[17]  # ties
    points[21], points[28] = np.zeros(8), None
    nodes, asked = frames(spark, points)
    index = ivf.build(nodes, str(tmp_path / "ix"), lists=10, part_rows=50)
    assert rows(ivf.search(asked, index, k=5, exact=True)) == rows(vector.top_k(asked, nodes, 5))
    assert max(index.centres()[3]) > 1  # a large list is several parts


def test_probing_all_lists_in_groups_equals_a_full_scan(spark, tmp_path):
    nodes, asked = frames(spark, clustered())
    index = ivf.build(nodes, str(tmp_path / "ix"), lists=6, by=("kind",))
    cols = ("query_id", "kind", "node_id", "score", "rank")
    assert rows(ivf.search(asked, index, 4, ("kind",), probes=6), *cols) == rows(vector.top_k(asked, nodes, 4, ("kind",)), *cols)
    with pytest.raises(ValueError):
        ivf.search(asked, index, by=("kind",), exact=True)


def test_structure_needs_few_probes_and_reads_few_lists(spark, tmp_path):
    nodes, asked = frames(spark, clustered(), every=60)
    index = ivf.build(nodes, str(tmp_path / "ix"), lists=12)
    found = ivf.search(asked, index, probes=1)
    assert index.probes() <= 3 and ivf.recall(found, vector.top_k(asked, nodes)) >= 0.9
    read = {f.rsplit("list=", 1)[1].split("/")[0] for f in found.inputFiles() if "list=" in f}
    lists, centres, _, _ = index.centres()
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    probed = lists[(unit(np.array([r.query_vec for r in asked.collect()])) @ centres.T).argmax(1)]
    assert len(set(probed)) < len(lists) and read >= set(map(str, probed))


def test_recall_on_the_given_vectors(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    nodes = e.select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))
    asked = nodes.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), F.col("vec").alias("query_vec"))
    index = ivf.build(nodes, str(tmp_path / "ix"))
    assert ivf.recall(ivf.search(asked, index), vector.top_k(asked, nodes)) >= 0.9


def test_nothing_to_index(spark, tmp_path):
    nodes, _ = frames(spark, [None, None])
    with pytest.raises(ValueError):
        ivf.build(nodes, str(tmp_path / "ix"))


@pytest.mark.parametrize("after", [False, True])
def test_queries_are_dealt_in_bounded_batches(after):
    """Queries that probe every list: never all of their copies in one batch."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    n, lists, dim = 500, 400, 64
    asked = {"query_id": np.arange(n), "query_vec": rng.standard_normal((n, dim)).astype(np.float32).tolist(), "least": np.full(n, -1.0)}
    batch = pa.table(asked).combine_chunks().to_batches()[0]
    parts = np.where(np.arange(lists) % 9, 1, 3)
    deal = ivf._probing(np.arange(lists), ivf._unit(rng.standard_normal((lists, dim))), np.full(lists, np.pi), parts, 0 if after else lists, after)
    seen = 0
    for b in deal(iter([batch])):
        assert b.nbytes < 16 << 20
        assert len(set(zip(*(b[c].to_pylist() for c in ("query_id", "list", "part"))))) == b.num_rows
        seen += b.num_rows
    assert seen == n * parts.sum()


def test_a_part_meets_tiles_of_queries(spark, tmp_path, monkeypatch):
    nodes, asked = frames(spark, clustered(), every=2)
    index = ivf.build(nodes, str(tmp_path / "ix"), lists=6)
    asked = asked.withColumn("query_vec", F.col("query_vec").cast("array<float>"))
    whole = vector.top_k(asked, nodes)
    monkeypatch.setattr(ivf, "DEALT_QUERIES", 40)
    scored = ivf._scored

    def few(*args):
        run = scored(*args)

        def checked(asked, rows):
            assert asked.num_rows < 80
            return run(asked, rows)

        return checked

    monkeypatch.setattr(ivf, "_scored", few)
    assert rows(ivf.search(asked, index, probes=6)) == rows(whole)
    assert rows(ivf.search(asked, index, exact=True)) == rows(whole)

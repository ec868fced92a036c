"""A stored keyed table: merges, untouched buckets, repeats, races, new columns."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.sources import keyed


def rows(table, *cols):
    return sorted(map(tuple, table.read().select(*cols).collect()), key=repr)


def test_merges(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    with pytest.raises(ValueError):
        t.read()
    assert t.merge(spark.createDataFrame([(i, f"n{i}", 1.0) for i in range(40)] + [(None, "x", 0.0)], "id long, name string, price double"), batch="a") == 1
    before = t.folders()
    assert t.merge(spark.createDataFrame([(3, 2.0), (3, 5.0), (3, 4.0), (100, 7.0)], "id long, price double"), ["price"], batch="b") == 2
    assert t.merge(spark.createDataFrame([(3, 9.0)], "id long, price double"), batch="b") is None
    want = [(i, f"n{i}", 5.0 if i == 3 else 1.0) for i in range(40)] + [(100, None, 7.0)]
    assert rows(t, "id", "name", "price") == sorted(want, key=repr)
    changed = {b for b, f in t.folders().items() if before.get(b) != f}
    assert 1 <= len(changed) <= 2 and set(before) - changed
    t.merge(spark.createDataFrame([(5, None, "new")], "id long, price double, more string"))
    got = {r.id: r for r in t.read().collect()}
    assert got[5].price is None and got[5].more == "new" and got[5].name == "n5" and got[6].more is None and len(got) == 41
    t.merge(spark.createDataFrame([], "id long, price double"))
    assert len(rows(t, "id")) == 41


def test_edges_stay_and_loads_repeat(spark, tmp_path):
    nodes, edges = keyed.KeyedTable(spark, str(tmp_path / "n"), ["item"], 4), keyed.KeyedTable(spark, str(tmp_path / "e"), ["src", "dst"], 4)
    load = lambda data, batch: keyed.merge_graph(nodes, edges, spark.createDataFrame(data, "item long, price long, category string"), "item", "category", batch)
    load([(1, 10, "tea"), (2, 20, "tea")], "1")
    load([(1, 10, "tea"), (2, 20, "tea")], "1")
    load([(2, 25, "milk"), (3, 30, "milk")], "2")
    assert rows(nodes, "item", "price") == [(1, 10), (2, 25), (3, 30)]
    assert rows(edges, "src", "dst") == [(1, "tea"), (2, "milk"), (2, "tea"), (3, "milk")]


def test_merges_at_once_lose_nothing(spark, tmp_path):
    t = keyed.KeyedTable(spark, str(tmp_path / "t"), ["id"], buckets=2)
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda k: keyed.KeyedTable(spark, t.path, ["id"], 2).merge(spark.createDataFrame([(k * 10 + i, k) for i in range(10)], "id long, by long")), range(3)))
    assert sorted(got) == [1, 2, 3] and len(rows(t, "id", "by")) == 30

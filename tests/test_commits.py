"""Appends with a log: order, resumption, broken and repeated appends."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from tidemark.sources import commits, files
from tidemark.streaming import watch

ROW = "index int, text string"


def labelled(spark, label, n=6, parts=3):
    return spark.createDataFrame([(i, label) for i in range(n)], ROW).repartition(parts)


def latest(spark, path):
    return {r["index"]: r.text for r in files.read_latest(spark, path, ROW, "index").collect()}


def test_the_last_of_many_appends_counts(spark, tmp_path):
    path = str(tmp_path / "r")
    files.write_jsonl(labelled(spark, "a0"), path)
    for k in range(1, 12):
        assert files.write_jsonl(labelled(spark, f"a{k}", 6 if k % 2 else 3), path, append=True) == k + 1
        assert latest(spark, path) == {i: f"a{k}" if k % 2 or i < 3 else f"a{k - 1}" for i in range(6)}
    assert files.read_jsonl(spark, path, ROW).count() == 6 + 6 * 6 + 3 * 5
    files.write_jsonl(labelled(spark, "new", 2), path)
    assert latest(spark, path) == {0: "new", 1: "new"}


def test_rows_of_one_append_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(i % 5, f"n{i:04d}") for i in range(1000)], ROW).repartitionByRange(7, "text").sortWithinPartitions("text")
    files.write_jsonl(rows, path)
    assert latest(spark, path) == {i: f"n{995 + i:04d}" for i in range(5)}


def test_broken_and_repeated_appends(spark, tmp_path):
    path = str(tmp_path / "r")
    files.write_jsonl(labelled(spark, "a"), path, append=True, batch="1")

    def breaks(df, at):
        df.write.json(at)
        raise OSError("lost")

    with pytest.raises(OSError):
        commits.Folder(spark, path).append(labelled(spark, "broken"), breaks, "2")
    assert latest(spark, path) == dict.fromkeys(range(6), "a")
    assert files.write_jsonl(labelled(spark, "b", 2), path, append=True, batch="2") == 2
    assert files.write_jsonl(labelled(spark, "b", 2), path, append=True, batch="2") is None
    assert files.write_jsonl(labelled(spark, "a"), path, append=True, batch="1") is None
    assert latest(spark, path) == {0: "b", 1: "b"} | dict.fromkeys(range(2, 6), "a")
    assert files.read_jsonl(spark, path, ROW).count() == 8


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "r")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: files.write_jsonl(labelled(spark, f"w{k}", 2, 1), path, append=True), range(6)))
        same = list(pool.map(lambda k: files.write_jsonl(labelled(spark, "same", 2, 1), path, append=True, batch="x"), range(4)))
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and sorted(map(str, same)) == ["7", "None", "None", "None"]
    assert latest(spark, path) == {0: "same", 1: "same"} and files.read_jsonl(spark, path, ROW).count() == 14


def test_lines_of_others_come_first_and_bad_ones_are_skipped(spark, tmp_path):
    path = tmp_path / "r"
    path.mkdir()
    (path / "own.jsonl").write_text('{"index": 1, "text": "a"}\n\nnot json\n{"index": 1, "text": "b"}\n{"index": 2, "text": "c"}\n{"text": "no key"}\n')
    assert latest(spark, str(path)) == {1: "b", 2: "c"}
    files.write_jsonl(labelled(spark, "z", 2), str(path), append=True)
    assert latest(spark, str(path)) == {0: "z", 1: "z", 2: "c"}
    assert latest(spark, str(tmp_path / "nowhere")) == {}


def test_a_batch_of_the_watcher_that_runs_twice_is_loaded_once(spark, tmp_path):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), tmp_path / "progress"
    folder.mkdir()
    fail = [True]

    def load(found, kind, batch):
        files.append_parquet(files.document_texts(found), f"{out}/{kind}", batch)
        if fail.pop():
            raise RuntimeError("lost after the load")

    (folder / "a.txt").write_text("one")
    with pytest.raises(Exception, match="lost after the load"):
        watch.watch(spark, str(folder), str(progress), load).awaitTermination(60)
    fail[:] = [False] * 5
    watch.watch(spark, str(folder), str(progress), load).awaitTermination(60)
    (folder / "b.md").write_text("two")
    watch.watch(spark, str(folder), str(progress), load).awaitTermination(60)
    assert sorted(r.text for r in files.read_appended(spark, f"{out}/document").collect()) == ["one", "two"]

"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of lower-cased words. Seeds, the hashes
of five words, are joined between texts and items; pairs with enough of them are
tiled: the longest match of unmarked words is marked, again and again, until none
of five words is left. Running Karp-Rabin hashes find the length of the longest
match by halving and its places by lookup. Tiles may lie in any order, so a
passage with its sentences moved is still covered. A text is contaminated when
tiles cover 0.8 or more of an item's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bit_filter, body, cut, may_hold

MIN_MATCH = 5
COVERAGE = 0.8
#: A seed's texts are dealt to so many groups, so that a frequent one is no single group.
SALTS = 16
#: Items that one text meets in one row; one with more is several rows.
ITEMS_A_ROW = 64
#: Words, and texts, that a task remembers.
_CACHE = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """word -> XXH64, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode())
        return h

    def of(self, raw: bytes) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words_of(raw.decode("utf-8", "replace")))), np.uint64)


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """The Karp-Rabin hash of every k consecutive ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = ids[:n].copy()
    for i in range(1, k):
        h = h * _BASE + ids[i : i + n]
    return h


class _Windows:
    """A sequence whose windows of any length have a hash, from running sums
    that are made once, and that knows which windows hold no marked place."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.marked = ids, np.zeros(n, bool)
        self.total = np.r_[np.uint64(0), np.cumsum(ids * np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), _BASE)])[:n])]
        self.scale = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])

    def free(self, k: int) -> np.ndarray:
        sums = np.r_[0, np.cumsum(self.marked)]
        return np.flatnonzero(sums[k:] == sums[:-k])

    def hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        return (self.total[at + k] - self.total[at]) * self.scale[at]


def _common(a: _Windows, b: _Windows, k: int) -> tuple[np.ndarray, ...]:
    """(places in a, their hashes, places in b, their hashes): free windows of k
    words whose hashes both have. A table of bits leaves out most others first."""
    at_a, at_b = a.free(k), b.free(k)
    ha, hb = a.hashes(at_a, k), b.hashes(at_b, k)
    size = 1 << max(10, (8 * max(len(ha), len(hb))).bit_length())
    for _ in range(2):  # those of a that b may have, then those of b that a may have
        table = np.zeros(size, bool)
        table[_slots(hb, size)] = True
        kept = table[_slots(ha, size)]
        at_a, ha, at_b, hb = at_b, hb, at_a[kept], ha[kept]
    both = np.intersect1d(ha, hb)
    ours, theirs = np.isin(ha, both), np.isin(hb, both)
    return at_a[ours], ha[ours], at_b[theirs], hb[theirs]


def _slots(h: np.ndarray, size: int) -> np.ndarray:
    return ((h * _BASE) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, text start, length), longest first; ties go to
    the earliest place in the item, then in the text. A round costs some passes
    over both sequences, and each has shorter tiles than the one before."""
    a, b = _Windows(item), _Windows(text)
    out: list[tuple[int, int, int]] = []
    top = min(len(item), len(text))
    while top >= least:
        # a match of low words exists, none of over high does: look downwards in growing steps, then halve
        high, step, low, found = top, 1, least - 1, None
        while low < high:
            k = max(low + 1, high - step + 1) if found is None else (low + high + 1) // 2
            got = _common(a, b, k)
            if len(got[0]):
                low, found = k, got
            else:
                high = k - 1
                step *= 2
        if found is None:
            break
        _mark(a, b, low, found, out)
        top = low - 1
    return out


def _mark(a: _Windows, b: _Windows, k: int, common: tuple[np.ndarray, ...], out: list[tuple[int, int, int]]) -> None:
    """Marks the matches of k words in turn. A place once marked stays so: the
    places of a hash in the text are gone through once in all."""
    at_a, ha, at_b, hb = common
    by = np.argsort(hb, kind="stable")
    names, first = np.unique(hb[by], return_index=True)
    stop = np.r_[first[1:], len(by)]
    for i, s in zip(at_a.tolist(), np.searchsorted(names, ha).tolist()):
        if a.marked[i] or a.marked[i + k - 1]:  # tiles marked here are no shorter, so one in the way covers an end
            continue
        while first[s] < stop[s]:
            j = int(at_b[by[first[s]]])
            first[s] += 1
            if not b.marked[j] and not b.marked[j + k - 1] and np.array_equal(a.ids[i : i + k], b.ids[j : j + k]):
                a.marked[i : i + k] = b.marked[j : j + k] = True
                out.append((i, j, k))
                break


def cover(item: np.ndarray, text: np.ndarray, least: int, coverage: float) -> tuple[float, int]:
    """(share of the item's words in tiles, tiles), or nothing of both below
    ``coverage``. Words outside of all seeds lie in no tile and are taken out."""
    ours, theirs = rolling(item, least), rolling(text, least)
    reach = np.zeros(len(item), bool)
    for i in np.flatnonzero(np.isin(ours, theirs)).tolist():
        reach[i : i + least] = True
    if not reach.any() or reach.sum() < coverage * len(item):  # tiles cannot cover more than the seeds do
        return 0.0, 0
    hit = np.r_[0, np.cumsum(np.isin(theirs, ours))]
    n = len(text)
    ends = np.arange(n)
    near = hit[np.minimum(ends + 1, n - least + 1)] > hit[np.maximum(ends - least + 1, 0)]
    at = np.flatnonzero(near)
    breaks = np.flatnonzero(np.diff(at) > 1) + 1
    # a word of no item stands where words were taken out
    short = np.insert(text[at], breaks, np.uint64(0)) if not (item == 0).any() else text
    got = tiles(item, short, least)
    share = sum(k for _, _, k in got) / len(item)
    return (share, len(got)) if share >= coverage else (0.0, 0)


def _items(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ikey, item, k, need, spare, words): seeds have k words; a text that
        covers the item holds ``need + spare`` of its seed places at least."""
        hashes = _Hashes()
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for ikey, item, raw in zip(*(c.to_pylist() for c in b.columns)):
                words = hashes.of(raw)
                if not len(words):
                    continue
                k = min(least, len(words))
                places = max(1, int(np.ceil(coverage * len(words) / k - 1e-9)))  # a tile of n words has n - k + 1
                for c, v in zip(cols, (ikey, item, k, places - places // 2, places // 2, words.tobytes())):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["ikey", "item", "k", "need", "spare", "words"])

    return run


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ikey, need, spare, place, seed) for each place of an item."""
    for b in batches:
        for ikey, k, need, spare, raw in zip(*(c.to_pylist() for c in b.columns)):
            h = _named(rolling(np.frombuffer(raw, np.uint64), k), k)
            same = lambda v, t: pa.array(np.full(len(h), v), t)
            cols = [same(ikey, pa.int64()), same(need, pa.int32()), same(spare, pa.int32()), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["ikey", "need", "spare", "place", "seed"])


def _named(h: np.ndarray, k: int) -> np.ndarray:
    """Seeds of different lengths are different names."""
    return h * np.uint64(2 * k + 1) ^ (h >> np.uint64(29))


def _touched(bits: np.ndarray, widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, words, hits) of the texts that hold a seed in the filter, a
        text once a task."""
        hashes, seen = _Hashes(), set()
        for b in batches:
            keys, words, hits = [], [], []
            for key, raw in zip(*(c.to_pylist() for c in b.columns)):
                if key in seen:
                    continue
                ids, found = hashes.of(raw), []
                for k in widths:
                    h = _named(rolling(ids, k), k)
                    h = h[may_hold(bits, h)]
                    found.append(np.unique(h))
                found = np.concatenate(found) if found else ids[:0]
                if len(found):
                    if len(seen) > _CACHE:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    words.append(ids.tobytes())
                    hits.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.binary()), pa.array(hits, pa.list_(pa.int64()))], names=["key", "words", "hits"])

    return run


def _tiled(least: int, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, item, share, n_tiles) of the pairs that are covered enough."""
        for b in batches:
            rows: list[tuple] = []
            for key, raw, items in zip(*(c.to_pylist() for c in b.columns)):
                text = np.frombuffer(raw, np.uint64)
                for x in items:
                    item = np.frombuffer(x["words"], np.uint64)
                    share, n = cover(item, text, min(least, len(item)), coverage)
                    if n:
                        rows.append((key, x["item"], share, n))
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "item", "share", "n_tiles"])

    return run


def covered(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, min_match: int = MIN_MATCH) -> DataFrame:
    """(key, item_ids, coverage, n_tiles) for every distinct text of ``docs``
    that covers an item; key is the MD5 of its bytes.

    A text goes on if one of its seeds is in a filter of fixed size made from all
    seeds of the benchmark; only such texts are written and joined. An item
    covered to a share c holds c/5 of its seed places in the text at least, so
    its most frequent places, half that many, need not be joined, and pairs with
    too few of the others are left out: no pair is lost by either.

    Null and empty texts cover nothing, null and empty items are covered by none;
    a very long text is one row's work; copies and repeated rows are one text;
    empty tables give none; other columns are ignored.
    """
    bench = benchmark.select(F.col(item_id).cast("long").alias("item"), body(item_text).alias("raw")).distinct()
    bench = bench.select(F.xxhash64("item", "raw").alias("ikey"), "item", "raw")
    items = cut(bench.mapInArrow(_items(min_match, coverage), "ikey long, item long, k int, need int, spare int, words binary"), "items")
    places = cut(items.select("ikey", "k", "need", "spare", "words").mapInArrow(_seeds, "ikey long, need int, spare int, place int, seed long"), "seeds")

    bits = bit_filter(places, "seed")
    widths = sorted(r["k"] for r in items.select("k").distinct().collect())  # min_match at most
    texts = docs.select(F.md5(body(text)).alias("key"), body(text).alias("raw"))
    touched = cut(texts.mapInArrow(_touched(bits, widths), "key string, words binary, hits array<long>"), "touched")

    often = places.groupBy("seed").agg(F.count("*").alias("often"))
    nth = F.row_number().over(Window.partitionBy("ikey").orderBy(F.desc("often"), "place"))
    rare = places.join(often, "seed").withColumn("nth", nth).where(F.col("nth") > F.col("spare"))
    rare = rare.select("seed", "ikey", "need", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = touched.select("key", F.explode("hits").alias("seed")).distinct().withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    pairs = hits.join(rare, ["seed", "salt"]).groupBy("key", "ikey").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("key", "ikey")
    pairs = cut(pairs, "pairs")
    rows_ = pairs.groupBy("key").agg(F.ceil(F.count("*") / ITEMS_A_ROW).alias("rows"))
    dealt = pairs.join(rows_, "key").join(items.select("ikey", "item", "words"), "ikey")
    dealt = dealt.groupBy("key", F.pmod(F.xxhash64("ikey"), F.col("rows")).alias("part")).agg(F.collect_list(F.struct("item", "words")).alias("items"))
    once = touched.select("key", "words").join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    found = once.join(dealt, "key").select("key", "words", "items").mapInArrow(_tiled(min_match, coverage), "key string, item long, share double, n_tiles long")
    return cut(found, "tiled").groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("item_ids"), F.max("share").alias("coverage"), F.sum("n_tiles").alias("n_tiles"))


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, min_match: int = MIN_MATCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, contaminated, item_ids, coverage, n_tiles) for every row of ``docs``,
    or the columns ``keep`` in place of id: the items covered to ``coverage`` or
    more, in order, the largest such share (0 if none) and the number of tiles on
    them.

    Null and empty texts hold nothing; items without a word are never found;
    items of fewer than ``min_match`` words must be found whole; null item ids
    are left out of ``item_ids`` but count; a very long text or item is one
    row's work, in time about in proportion to its length; repeated rows and
    copies are judged once and alike; an empty table of either kind is fine;
    other columns are ignored. Jobs run while the result is built: items, seeds,
    texts with a seed, pairs and tiles are written to the shared folder.
    """
    cols = keep or (id,)
    found = covered(docs, benchmark, text, item_id, item_text, coverage, min_match)
    found = found.select(F.col("key").alias("_key"), F.col("item_ids").alias("_ids"), F.col("coverage").alias("_share"), F.col("n_tiles").alias("_tiles"))
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(cols)), F.md5(body(text)).alias("key"))
    rows = rows.join(found, F.col("key") == F.col("_key"), "left")
    return rows.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(cols)),
        F.col("_key").isNotNull().alias("contaminated"),
        F.coalesce("_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("_share", F.lit(0.0)).alias("coverage"),
        F.coalesce("_tiles", F.lit(0).cast("long")).alias("n_tiles"),
    )

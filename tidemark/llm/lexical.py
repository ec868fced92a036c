"""Ranked lexical search by MaxScore over shards.

Documents are indexed where they lie: a task cuts its rows into shards of bounded
rows and bytes and keeps, for each, the posting lists of the terms that any item
may ask for (a filter of fixed size over their hashes, which lets more through as
it fills, never less). Every shard is one row of the index. Frequencies are summed
over all shards, so weights are those of the whole corpus. Items are dealt to
tiles; each tile meets each shard. There a term's upper bound is the largest score
in its list; lists with the highest bounds are essential and are added up, and as
soon as all other bounds together are below the k-th score, the remaining lists
are probed only for documents that can still qualify.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bit_filter, body, cut, may_hold

TOP_K = 10
#: Fixed values of the score.
WEIGHT_SCALE = 1000
B_PERCENT = 75
TF_SCALE = 1_000_000_000
K_LENGTH = 8
#: A shard ends with the row that makes it this large (rows, bytes of text); a tile of items has about so many items, and terms.
SHARD_ROWS = 8192
SHARD_BYTES = 16 << 20
TILE_ITEMS = 256
TILE_TERMS = 100_000
#: Texts are cut into words in pieces of about so many bytes; so many terms are remembered as asked or not.
_PIECE = 4 << 20
_MEMO = 400_000
#: The copies of a tile among which shards are dealt where both sides are shuffled.
_SALTS = 16

#: Letters, digits and everything outside ASCII make up terms; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SHARD = "shard string, docs array<long>, lens binary, terms array<binary>, sizes array<int>, ords binary, tfs binary"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in order, piece by piece."""
    at = 0
    while len(text) - at > _PIECE:
        folded = text[at : at + _PIECE].translate(_FOLD)
        end = folded.rfind(b" ") + 1
        while not end:  # a term longer than a piece
            folded = text[at : at + 2 * len(folded)].translate(_FOLD)
            end = folded.rfind(b" ") + 1 or (len(folded) if at + len(folded) == len(text) else 0)
        yield folded[:end].split()
        at += end
    yield text[at:].translate(_FOLD).split()


def term_counts(text: bytes) -> Counter:
    found: Counter = Counter()
    for words in _words(text):
        found.update(words)
    return found


class _Asked:
    """Which terms the filter lets through; the last ones met are remembered."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.yes, self.no = bits, set(), set()

    def of(self, words: list[bytes]) -> set[bytes]:
        new = set(words).difference(self.yes, self.no)
        if new:
            if len(self.yes) + len(self.no) > _MEMO:
                self.yes, self.no = set(), set()
                new = set(words)
            terms = list(new)
            ok = may_hold(self.bits, np.array([xxhash.xxh64_intdigest(t, 42) for t in terms], np.uint64))
            self.yes.update(t for t, y in zip(terms, ok, strict=True) if y)
            self.no.update(t for t, y in zip(terms, ok, strict=True) if not y)
        return self.yes


def _shards(bits: np.ndarray | None, most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if bits is None else _Asked(bits)
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        lens: list[int] = []
        lists: dict[bytes, tuple[list, list]] = {}
        size = 0

        def shard() -> pa.RecordBatch:
            terms = sorted(lists)
            flat = lambda k: np.array([v for t in terms for v in lists[t][k]], np.int32 if k == 0 else np.int64).tobytes()
            row = ([f"{part}:{number}"], [ids], [np.array(lens, np.int64).tobytes()], [terms], [[len(lists[t][0]) for t in terms]], [flat(0)], [flat(1)])
            kinds = (pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["shard", "docs", "lens", "terms", "sizes", "ords", "tfs"])

        for batch in batches:
            for id, text in zip(batch["id"].to_pylist(), batch["raw"], strict=True):
                text, n = text.as_py(), 0
                found: Counter = Counter()
                for words in _words(text):
                    n += len(words)
                    found.update(words if asked is None else filter(asked.of(words).__contains__, words))
                for t, tf in found.items():
                    at = lists.setdefault(t, ([], []))
                    at[0].append(len(ids))
                    at[1].append(tf)
                ids.append(id)
                lens.append(n)
                size += len(text)
                if len(ids) >= most_rows or size >= most_bytes:
                    yield shard()
                    number, size = number + 1, 0
                    ids, lens, lists = [], [], {}
        if ids:
            yield shard()

    return run


def index(docs: DataFrame, asked: DataFrame | None = None, id: str = "doc_id", text: str = "text", most_rows: int = SHARD_ROWS, most_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of all rows of ``docs``, a row a shard, written to the shared
    folder: ids, lengths in terms, and posting lists (places in the shard and
    frequencies) by term. With ``asked`` (a column ``term``, binary), lists of
    other terms are left out as far as the filter can tell.

    Null texts have no terms; rows without terms are kept with length 0. Null
    and repeated ids are rows of their own. A text of any length is one row, read
    in pieces; a shard ends with it. An empty table gives no shard.
    """
    bits = None if asked is None else bit_filter(asked.select(F.xxhash64(F.col("term").cast("string")).alias("h")).distinct(), "h")
    return cut(docs.select(F.col(id).cast("long").alias("id"), body(text).alias("raw")).mapInArrow(_shards(bits, most_rows, most_bytes), _SHARD), "shards")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, raw in zip(batch["item_row"].to_pylist(), batch["raw"], strict=True):
            found = term_counts(raw.as_py())
            yield pa.RecordBatch.from_pydict({"item_row": pa.array([row] * len(found), pa.int64()), "term": pa.array(list(found), pa.binary()), "times": pa.array(list(found.values()), pa.int64())})


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray]], rows: int, rank: np.ndarray, k: int, floor: int = 1) -> tuple[list[tuple[int, int]], int]:
    """The (score, place) of the k best of a shard's rows, and how many postings
    were added or probed. lists: (places ascending, scores) of each term; rank:
    the rows' places among equal scores; no row below ``floor`` is needed."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: -int(x[1].max()))
    rest = np.concatenate([np.cumsum([int(x[1].max()) for x in lists][::-1])[::-1], [0]]).astype(np.int64)
    score, bound, i, seen = np.zeros(rows, np.int64), max(1, floor), 0, 0
    while i < len(lists) and rest[i] >= bound:  # essential: a row in none of the lists before could still qualify
        places, values = lists[i]
        score[places] += values
        seen += len(places)
        i += 1
        if rows >= k:
            bound = max(bound, int(np.partition(score, -k)[-k]))
    able = np.nonzero(score + rest[i] >= bound)[0]
    able = able[score[able] > 0]
    for places, values in lists[i:]:
        at = np.minimum(np.searchsorted(places, able), len(places) - 1)
        hit = places[at] == able
        score[able[hit]] += values[at[hit]]
        seen += len(able)
        i += 1
        if len(able) >= k:
            bound = max(bound, int(np.partition(score[able], -k)[-k]))
        able = able[score[able] + rest[i] >= bound]
    order = np.lexsort((rank[able], -score[able]))[:k]
    return [(int(score[a]), int(a)) for a in able[order]], seen


def _ranked(n_docs: int, n_terms: int, k: int):
    """Each item's k best rows of each shard. The k-th score of one shard is a
    floor in the next ones that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, floors = None, {}
        for batch in batches:
            for r in range(len(batch)):
                row = {c: batch[c][r].as_py() for c in batch.schema.names}
                if row["tile"] != tile:
                    tile, floors = row["tile"], {}
                docs, n = row["docs"], np.frombuffer(row["lens"], np.int64)
                ids = np.array([0 if d is None else d for d in docs], np.int64)
                rank = np.empty(len(docs), np.int64)
                rank[np.lexsort((np.arange(len(docs)), ids, np.array([d is None for d in docs], bool)))] = np.arange(len(docs))
                m = 100 - B_PERCENT + (B_PERCENT * n * n_docs) // n_terms
                ords, tfs = np.frombuffer(row["ords"], np.int32), np.frombuffer(row["tfs"], np.int64)
                ends = np.cumsum(row["sizes"], dtype=np.int64)
                where = {t: (int(e) - s, int(e)) for t, s, e in zip(row["terms"], row["sizes"], ends, strict=True)}
                parts: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
                found = []
                for item in row["items"]:
                    lists = []
                    for t in item["terms"]:
                        if (at := where.get(t["term"])) is None:
                            continue
                        if t["term"] not in parts:
                            o, tf = ords[at[0] : at[1]], tfs[at[0] : at[1]]
                            parts[t["term"]] = o, t["w"] * ((TF_SCALE * tf) // (1000 * tf + K_LENGTH * m[o]))
                        o, v = parts[t["term"]]
                        lists.append((o, v if t["times"] == 1 else v * t["times"]))
                    best, _ = best_of_shard(lists, len(docs), rank, k, floors.get(item["item_row"], 1))
                    if len(best) == k:
                        floors[item["item_row"]] = max(floors.get(item["item_row"], 1), best[-1][0])
                    found += [(item["item_row"], item["item_id"], docs[a], a, s) for s, a in best]
                if found:
                    yield pa.RecordBatch.from_pydict(
                        dict(zip(("item_row", "item_id", "doc_id", "place", "score"), (pa.array(c, pa.int64()) for c in zip(*found, strict=True)), strict=True))
                        | {"shard": pa.array([row["shard"]] * len(found))}
                    )

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", **limits: int) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k rows of ``docs`` with the
    highest scores above 0, ties to the smaller id (null last). Ids are longs.

    Null and empty texts match nothing, and items without a term that occurs give
    no rows. Repeated items are ranked each, repeated documents too. Texts of any
    length are taken whole. Empty tables give an empty result; other columns are
    ignored. Jobs run while the result is built: terms, index and tiles are
    written to the shared folder. ``limits``: those of ``index``.
    """
    spark = docs.sparkSession
    asked = cut(items.select(F.monotonically_increasing_id().alias("item_row"), F.col(item).cast("long").alias("item_id"), body(item_text).alias("raw")), "items")
    terms = cut(asked.select("item_row", "raw").mapInArrow(_item_terms, "item_row long, term binary, times long"), "terms")
    shards = index(docs, terms, id, text, **limits)
    lens = shards.select("lens").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = lens[0] or 0, lens[1] or 0
    df = shards.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("sizes").alias("df"))).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weight = F.floor(WEIGHT_SCALE * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = terms.join(df, "term").groupBy("item_row").agg(F.sort_array(F.collect_list(F.struct("term", weight.alias("w"), "times"))).alias("terms"))
    count, every = asked.count(), terms.count()
    tiles = max(1, -(-count // TILE_ITEMS), -(-every // TILE_TERMS))
    tile = F.pmod(F.xxhash64("item_row"), F.lit(tiles)).alias("tile")
    dealt = weighed.join(asked.select("item_row", "item_id"), "item_row").groupBy(tile).agg(F.collect_list(F.struct("item_row", "item_id", "terms")).alias("items"))
    dealt = cut(dealt, "tiles").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(_SALTS)).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    found = met.join(dealt, ["tile", "salt"]).drop("salt").mapInArrow(_ranked(n_docs, max(n_terms, 1), k), "item_row long, item_id long, doc_id long, place long, score long, shard string")
    rank = F.row_number().over(Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item_id").alias(item), "rank", F.col("doc_id").alias(id), "score")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [np.frombuffer(x.as_py(), np.int64) for x in batch["lens"]]
        yield pa.RecordBatch.from_pydict({"docs": pa.array([int((x > 0).sum()) for x in n], pa.int64()), "terms": pa.array([int(x.sum()) for x in n], pa.int64())})

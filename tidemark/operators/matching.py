"""A stated set of strings against all rows: which contain which, and which
share most words. Rows meet the set in blocks of bounded size, and an Arrow batch
sends on what it found, or only its best."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import by_block

#: Rows whose overlaps with a block of queries are counted at once.
_ROWS = 256


def _automaton(strings: list[str]) -> ahocorasick.Automaton | None:
    """Finds the numbers of ``strings``, of which the empty one is left out."""
    found = ahocorasick.Automaton()
    for i, s in enumerate(strings):
        if s:
            found.add_word(s, (*found.get(s, ()), i))
    if not len(found):
        return None
    found.make_automaton()
    return found


def _inside(automaton: ahocorasick.Automaton | None, text: str) -> set[int]:
    return {i for _, numbers in automaton.iter(text) for i in numbers} if automaton is not None else set()


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern_id, text_id) where the text contains the pattern. texts: (text_id,
    text), patterns: (pattern_id, pattern). The empty pattern is in every text;
    null texts and patterns match nothing; the patterns of a block are sought
    together in one pass over each text."""
    kinds = f"pattern_id {patterns.schema['pattern_id'].dataType.simpleString()}, text_id {texts.schema['text_id'].dataType.simpleString()}"

    def meet(block: pa.Table):
        ids, strings = block["pattern_id"].to_pylist(), block["pattern"].to_pylist()
        everywhere = [i for i, s in enumerate(strings) if not s]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(strings)
            for b in batches:
                at, hits = [], []
                for n, text in enumerate(b.column(1).to_pylist()):
                    found = sorted(_inside(automaton, text)) + everywhere
                    at += [n] * len(found)
                    hits += [ids[i] for i in found]
                yield pa.RecordBatch.from_arrays([pa.array(hits, b_type), b.column(0).take(pa.array(at, pa.int64()))], names=["pattern_id", "text_id"])

        b_type = pa.string() if kinds.startswith("pattern_id string") else pa.int64()
        return run

    asked = patterns.where("pattern is not null").select("pattern_id", "pattern")
    return by_block(asked, texts.where("text is not null").select("text_id", "text"), meet, kinds, weight=F.length("pattern"))


def first_names(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name) for each batch of ``names`` (name, low): the first, by
    length then alphabet, whose ``low`` contains the query's or lies in it.
    queries: (query_id, low)."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def meet(block: pa.Table):
        ids, asked = block["query_id"].to_pylist(), block["low"].to_pylist()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries_ = _automaton(asked)
            for b in batches:
                given = sorted(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), key=lambda r: (len(r[0]), r[0]))
                best: dict[int, int] = {q: 0 for q, s in enumerate(asked) if not s} if given else {}
                for n, (_, low) in enumerate(given):
                    for q in _inside(queries_, low):
                        best.setdefault(q, n)
                names_ = _automaton([low for _, low in given])
                empty = next((n for n, (_, low) in enumerate(given) if not low), None)
                for q, s in enumerate(asked):
                    found = min(_inside(names_, s), default=empty)
                    found = found if empty is None or found is None else min(found, empty)
                    if found is not None:
                        best[q] = min(found, best.get(q, found))
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in best], block["query_id"].type), pa.array([given[n][0] for n in best.values()], pa.string())], names=["query_id", "name"])

        return run

    asked = queries.where("low is not null").select("query_id", "low")
    return by_block(asked, names.where("low is not null").select("name", "low"), meet, f"query_id {kind}, name string", weight=F.length("low"))


def overlaps(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, overlap): for each query and batch of ``rows`` the k rows of
    the largest overlap above 0, ties to the smaller id. The overlap is the
    number of common words, plus ``bonus`` where the row's name lies in the query.
    queries: (query_id, low, words), rows: (id, name, bonus, words); a null name
    lies in none. Words are distinct."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def meet(block: pa.Table):
        ids, low, sets = (block[c].to_pylist() for c in ("query_id", "low", "words"))
        vocabulary = sorted({w for s in sets for w in s})
        number = {w: i for i, w in enumerate(vocabulary)}
        has = np.zeros((len(vocabulary) + 1, len(ids)), np.int32)
        for q, s in enumerate(sets):
            has[[number[w] for w in s], q] = 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = pa.array(vocabulary, pa.string())
            for b in batches:
                if not b.num_rows or not ids:
                    continue
                names = b.column(1).to_pylist()
                automaton = _automaton([n or "" for n in names])
                named = [_inside(automaton, s) for s in low] if automaton is not None else [set()] * len(ids)
                score = np.zeros((b.num_rows, len(ids)), np.int32)
                lists = b.column(3)
                known = pc.index_in(lists.flatten(), value_set=words).fill_null(len(vocabulary)).to_numpy(zero_copy_only=False)
                ends = np.cumsum(np.array(pc.fill_null(pc.list_value_length(lists), 0)))
                for i in range(0, b.num_rows, _ROWS):
                    start, stop = (ends[i - 1] if i else 0), ends[min(i + _ROWS, b.num_rows) - 1]
                    owner = np.searchsorted(ends, np.arange(start, stop), side="right")
                    hit = known[start:stop] < len(vocabulary)
                    owner, which = owner[hit], known[start:stop][hit]
                    if len(owner):
                        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                        score[owner[first]] = np.add.reduceat(has[which], first, axis=0)
                bonus = b.column(2).to_numpy(zero_copy_only=False)
                for q, found in enumerate(named):
                    for n in found:
                        score[n, q] += bonus[n]
                row_ids = b.column(0).to_pylist()
                rank = np.empty(b.num_rows, np.int64)
                rank[sorted(range(b.num_rows), key=row_ids.__getitem__)] = np.arange(b.num_rows)
                out: list[list] = [[], [], []]
                for q in range(len(ids)):
                    at = np.flatnonzero(score[:, q] > 0)
                    if len(at) > 4 * k:
                        at = at[score[at, q] >= -np.partition(-score[at, q], k - 1)[k - 1]]
                    at = at[np.lexsort((rank[at], -score[at, q]))][:k]
                    out[0] += [ids[q]] * len(at)
                    out[1] += [row_ids[n] for n in at.tolist()]
                    out[2] += score[at, q].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], names=["query_id", "id", "overlap"])

        return run

    asked = queries.select("query_id", F.coalesce("low", F.lit("")).alias("low"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
    return by_block(asked, rows.select("id", "name", "bonus", "words"), meet, f"query_id {kind}, id string, overlap int", weight=F.length("low"))

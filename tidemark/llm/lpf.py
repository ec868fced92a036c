"""Removing repeated passages with longest-previous-factor arrays.

A window is the ``least`` bytes that start at a position. Every window holds the
least of the hashes of its k-byte substrings, so equal windows hold the same
anchor at the same place, and each window is owned by one anchor. Anchors that
occur once cannot lie in a repeated window; what remains are short segments, the
bytes of the windows that one repeated anchor owns. Segments of an anchor meet
in one task, where their windows are put in suffix order; from the order, the
previous and next smaller positions give each window its longest previous factor,
those for the reverse order of places its longest next one, both capped at the
window's length. A window whose factor has that length is a repeat. Segments
with equal bytes come as two, the first one and another that stands for all
later ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, cut, drop

LEAST = 200
ANCHOR = 32
#: What a task sorts at once: anchors whose segments have more bytes than this are dealt by window instead.
MAX_BYTES = 1 << 20
#: Groups that the places of one window are dealt to.
SALTS = 16
#: A segment has at most this many windows; longer stretches are several segments.
MAX_WINDOWS = 1024
_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_ROWS = 1 << 14
#: Texts are scanned together up to this many bytes, longer ones in pieces; a scan takes about 60 times as much memory.
_CHUNK = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _rolling(a: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k consecutive bytes, by doubling."""
    n = len(a) - k + 1
    out, done, part, size = None, 0, a.astype(np.uint64) + np.uint64(1), 1
    left = k
    while left:
        if left & 1:
            power = np.uint64(pow(_BASE, size, 1 << 64))
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * power + piece
            done += size
        left >>= 1
        if left:
            power = np.uint64(pow(_BASE, size, 1 << 64))
            part = part[:-size] * power + part[size:]
            size *= 2
    return out


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    size, part = 1, h
    while 2 * size <= w:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    n = len(h) - w + 1
    return np.minimum(part[:n], part[w - size : w - size + n])


def _joined(bodies: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of whole texts of about _CHUNK bytes: (first, stop, bytes)."""
    i = 0
    while i < len(bodies):
        j, size = i, 0
        while j < len(bodies) and (j == i or size + len(bodies[j]) <= _CHUNK):
            size += len(bodies[j])
            j += 1
        yield i, j, np.frombuffer(b"".join(bodies[i:j]), np.uint8)
        i = j


def own_anchors(text: np.ndarray, sizes: np.ndarray, least: int, k: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Anchors of several joined texts: (hash, first, last, recurs, text
    number), first and last being the windows that it owns, counted within the
    text, windows across two texts left out. ``recurs`` says that the anchor's
    bytes may start twice inside its stretch, as in a text with a period. Long
    stretches are split."""
    grams = _mix(_rolling(text, k))
    span = least - k + 1
    low = _window_min(grams, span)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    good = np.arange(len(low)) + least <= ends[owner]
    change = np.r_[True, (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (good[1:] != good[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:] - 1, len(low) - 1]
    first, last = first[good[first]], last[good[first]]
    recurs = _places(grams, low, span, first, last) > 1
    pieces = (last - first) // MAX_WINDOWS + 1
    part = np.repeat(np.arange(len(first)), pieces)
    nth = np.arange(len(part)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, last, recurs, h = first[part] + nth * MAX_WINDOWS, np.minimum(last[part], first[part] + (nth + 1) * MAX_WINDOWS - 1), recurs[part], low[first][part]
    own = owner[first]
    return h, first - starts[own], last - starts[own], recurs, own


def _places(grams: np.ndarray, low: np.ndarray, span: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How often each stretch's anchor starts inside the stretch."""
    # a substring is some window's anchor if it equals the largest of the least hashes of the windows around it
    edge = np.zeros(span - 1, np.uint64)
    at = np.flatnonzero(grams == ~_window_min(~np.r_[edge, low, edge], span))
    names, number = np.unique(grams[at], return_inverse=True)
    key = np.sort(number * len(grams) + at)
    mine = np.searchsorted(names, low[first]) * len(grams)
    return np.searchsorted(key, mine + last + span) - np.searchsorted(key, mine + first)


def _pack(first: np.ndarray, last: np.ndarray, recurs: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 12) | ((last - first).astype(np.int64) << 1) | recurs


def _unpack(pos: int) -> tuple[int, int]:
    return pos >> 12, (pos >> 12) + (pos >> 1 & 0x7FF)


def _anchor_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (row, row2, h, pos), one per anchor."""
        for b in batches:
            # a piece has all windows that start in it; an anchor on both sides of a cut has a row on either
            pieces = [(n, at, x[at : at + _CHUNK + least - 1]) for n, x in enumerate(b.column(2).to_pylist()) for at in range(0, max(1, len(x) - least + 1), _CHUNK)]
            bodies = [x for _, _, x in pieces]
            line, offset = (np.array([p[c] for p in pieces], np.int64) for c in range(2))
            row, row2 = b.column(0).to_numpy()[line], b.column(1).to_numpy()[line]
            for i, j, text in _joined(bodies):
                if len(text) < least:
                    continue
                h, first, last, recurs, own = own_anchors(text, np.array([len(x) for x in bodies[i:j]]), least)
                at = offset[i:j][own]
                cols = (row[i:j][own], row2[i:j][own], h.view(np.int64), _pack(first + at, last + at, recurs))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["row", "row2", "h", "pos"])

    return run


def _digest(segment: bytes) -> bytes:
    return hashlib.blake2b(segment, digest_size=16).digest()


def _segments(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per repeated anchor of a text: (row, row2, id, first, last,
        h, dig, seg). A segment's bytes come with its first sight in the task,
        later sights name it by digest."""
        seen: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            line, out = [], [[] for _ in range(5)]
            for n, (z, marks) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist())):
                raw = unpack(z)
                for m in marks:
                    first, last = _unpack(m["pos"])
                    seg = raw[first : last + least]
                    dig = _digest(seg)
                    new = dig not in seen
                    if new:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(dig)
                    line.append(n)
                    for col, v in zip(out, (first, last, m["h"], dig, seg if new else None)):
                        col.append(v)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            keys = [b.column(i).take(pa.array(line, pa.int64())) for i in range(3)]
            yield pa.RecordBatch.from_arrays(keys + [pa.array(c, t) for c, t in zip(out, kinds)], names=["row", "row2", "id", "first", "last", "h", "dig", "seg"])

    return run


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of fixed-width windows (rows of bytes): their suffix array,
    and the common prefix of each with the one before it in that order."""
    width = windows.shape[1]
    flat = np.ascontiguousarray(windows)
    # S strings compare as bytes; their trailing zeros weigh nothing, which equal widths make up for
    order = np.argsort(flat.view(f"S{width}").ravel(), kind="stable")
    lcp = np.zeros(len(order), np.int64)
    for i in range(1, len(order), _ROWS):
        differ = flat[order[i : i + _ROWS]] != flat[order[i - 1 : min(i + _ROWS, len(order)) - 1]]
        lcp[i : i + _ROWS] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For every entry of a suffix order the common prefix with the nearest one
    before it that has a smaller place, 0 if none has. All entries look one
    step back, then leap over what the entry found has leapt over itself."""
    n = len(place)
    at, low = np.arange(n) - 1, lcp.copy()
    left = np.flatnonzero(at >= 0)
    while True:
        left = left[at[left] >= 0]
        left = left[place[at[left]] > place[left]]
        if not len(left):
            return np.where(at >= 0, low, 0)
        over = at[left]
        low[left] = np.minimum(low[left], low[over])
        at[left] = at[over]


def longest_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after): for every position its longest previous factor, the
    longest match with an earlier position, and its longest next factor, that
    with a later one, both as far as ``lcp`` measures.

    Of the positions that are earlier, the two nearest in suffix order, one on
    either side, have the longest prefix in common (previous and next smaller
    positions); of the later ones the two nearest likewise.
    """
    turned = np.r_[0, lcp[:0:-1]] if len(lcp) else lcp  # the common prefix with the one after, from the end
    out = []
    for place in (order, -order):
        found = np.zeros(len(order), np.int64)
        found[order] = np.maximum(_nearest_smaller(place, lcp), _nearest_smaller(place[::-1], turned)[::-1])
        out.append(found)
    return out[0], out[1]


def runs_of(flags: np.ndarray, owner: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, start, stop) of the runs of true values that share an owner."""
    same = owner[1:] == owner[:-1]
    first = np.flatnonzero(flags & np.r_[True, ~(same & flags[:-1])])
    last = np.flatnonzero(flags & np.r_[~(same & flags[1:]), True])
    return owner[first], inside[first], inside[last] + 1


_VERDICT = "dig binary, later boolean, runs array<struct<a:int,b:int>>"


def _judge(least: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (h, dig, seg, n, place) sorted by h and dig, for each segment one
        with its number of places and the first of them, then one with its bytes
        from every task that saw it; at most MAX_BYTES an h. Gives the runs of
        windows of each segment that occur at another place, or with
        ``keep_first`` at an earlier one, for its first place and for the later
        ones. The last anchor of a batch waits for the next batch."""
        held: list[list] = []

        def out(rows: list[list]) -> pa.RecordBatch:
            if keep_first:
                rows = sorted(rows, key=lambda r: (r[0], [(x is not None, x) for x in r[3].values()]))
            entries = [(r, later) for r in rows for later in ((False, True) if r[2] > 1 else (False,))]
            seg, start, stop = match_segments([r[4] for r, _ in entries], least, keep_first)
            pick, at = np.unique(seg, return_index=True)
            runs = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(seg)].astype(np.int32)), runs)
            digs, later = pa.array([entries[i][0][1] for i in pick.tolist()], pa.binary()), pa.array([entries[i][1] for i in pick.tolist()], pa.bool_())
            return pa.RecordBatch.from_arrays([digs, later, lists], names=["dig", "later", "runs"])

        for b in batches:
            rows = held
            for h, dig, seg, n, place in zip(*(c.to_pylist() for c in b.columns)):
                if n is not None:
                    rows.append([h, dig, n, place, None])
                elif rows[-1][4] is None:
                    rows[-1][4] = seg
            stop = len(rows)
            while stop and rows[stop - 1][0] == rows[-1][0]:
                stop -= 1
            if stop:
                for part in _parts(rows[:stop]):
                    yield out(part)
            held = rows[stop:]
        if held:
            yield out(held)

    return run


def _parts(rows: list[list], most: int = 1 << 18) -> Iterator[list[list]]:
    """Whole anchors, about ``most`` bytes at a time."""
    part, size = [], 0
    for i, r in enumerate(rows):
        if part and size >= most and r[0] != rows[i - 1][0]:
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r[4]) * min(r[2], 2)
    if part:
        yield part


def match_segments(segs: list[bytes], least: int, keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, stop) of the runs of windows that also occur in another
    segment given, or at another place of their own, or with ``keep_first`` at
    an earlier one: those whose longest factors reach the whole window."""
    text = np.frombuffer(b"".join(segs), np.uint8)
    sizes = np.array([len(s) for s in segs])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - least + 1
    owner = np.repeat(np.arange(len(segs)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.lib.stride_tricks.sliding_window_view(text, least)[starts[owner] + inside]
    before, after = longest_factors(*suffix_order(windows))
    return runs_of((before if keep_first else np.maximum(before, after)) >= least, owner, inside)


def _explode_windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (dig, i, win) for every window of a segment: win is the digest
        of its bytes."""
        for b in batches:
            for k in range(0, b.num_rows, 256):
                digs, places, wins = [], [], []
                for dig, seg in zip(b.column(0)[k : k + 256].to_pylist(), b.column(1)[k : k + 256].to_pylist()):
                    n = len(seg) - least + 1
                    digs += [dig] * n
                    places += range(n)
                    wins += [_digest(seg[i : i + least]) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(digs, pa.binary()), pa.array(places, pa.int32()), pa.array(wins, pa.binary())], names=["dig", "i", "win"])

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        z = pa.array([pack(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], names=b.schema.names)


def remove_spans(raw: bytes, starts_stops: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """(what is left, the maximal runs taken out)."""
    spans: list[list[int]] = []
    for a, b in sorted(starts_stops):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept), [(a, b) for a, b in spans]


def _cleaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        cols: list[list] = [[] for _ in range(4)]
        for z, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = unpack(z)
            left, runs = remove_spans(raw, [(x["a"], x["b"]) for x in spans or ()])
            for col, v in zip(cols, (len(raw), len(raw) - len(left), [{"start": x, "stop": y} for x, y in runs], left)):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["id", "n_bytes", "n_removed", "spans", "kept"])


def repeats(docs: DataFrame, keep: str = "first", id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept) for every row of ``docs``: the byte
    runs covered by repeated windows of ``least`` bytes, and the bytes left.

    ``keep`` "first" leaves the first place of a window (by id, nulls first,
    then a hash of the row, then position; rows equal in id and text are one
    place) and takes out those after it; "none" takes out every place of a
    window that starts anywhere twice. Matches may lie in one text, overlap
    included, and never cross texts.

    Segments of one anchor that have over MAX_BYTES in all, more than one task
    should sort, are dealt by window: equal windows meet by a digest of their
    bytes and are counted where they are made. Both ways are exact.

    Null and empty texts, and those shorter than ``least``, lose nothing; long
    texts are cut into segments; null ids stay; repeated rows are judged alike;
    an empty table gives none; other columns are ignored. Jobs run while the
    result is built: anchors, segments and verdicts are written.
    """
    kind = docs.schema[id].dataType.simpleString()
    src = docs.select(F.col(id).alias("id"), body(text).alias("raw"))
    tag = lambda salt: F.xxhash64(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("|"), "raw")
    src = src.select("id", tag("a").alias("row"), tag("b").alias("row2"), "raw")

    found = cut(src.where(F.length("raw") >= least).select("row", "row2", "raw").mapInArrow(_anchor_rows(least), "row long, row2 long, h long, pos long"), "anchors")
    weight = F.col("pos").bitwiseAND(F.lit(1)) + 1
    again = found.groupBy("h").agg(F.sum(weight).alias("n")).where("n > 1").select(F.col("h").alias("rh"))
    marks = found.join(again.hint("shuffle_hash"), F.col("h") == F.col("rh")).groupBy("row", "row2").agg(F.collect_set(F.struct("h", "pos")).alias("marks"))
    squeezed = src.select("row", "row2", "id", "raw").mapInArrow(_squeeze, f"row long, row2 long, id {kind}, z binary")
    marked = squeezed.join(marks.hint("shuffle_hash"), ["row", "row2"]).select("row", "row2", "id", "z", "marks")
    segs = cut(marked.mapInArrow(_segments(least), f"row long, row2 long, id {kind}, first int, last int, h long, dig binary, seg binary"), "segments")
    drop(found)

    place = F.struct("id", "row", "row2", "first")
    size = F.max(F.col("last") - F.col("first") + least).alias("size")
    known = cut(segs.groupBy("h", "dig").agg(F.count("*").alias("n"), F.min(place).alias("place"), size), "known")
    # written, so that Spark knows its size when it plans the joins: the bytes of segments are then moved once
    crowded = cut(known.groupBy("h").agg(F.sum(F.col("size") * F.least("n", F.lit(2))).alias("n_bytes")).where(F.col("n_bytes") > MAX_BYTES).select("h"), "crowded")
    bytes_ = segs.where("seg is not null").select("h", "dig", "seg")
    where = F.col("place") if keep == "first" else F.lit(None).cast(known.schema["place"].dataType)
    few = known.select("h", "dig", F.lit(None).cast("binary").alias("seg"), "n", where.alias("place"))
    few = few.unionByName(bytes_, allowMissingColumns=True).join(crowded, "h", "left_anti")
    few = few.repartition("h").sortWithinPartitions("h", "dig", F.col("n").isNull()).select("h", "dig", "seg", "n", "place")
    crowd = bytes_.join(crowded, "h", "left_semi").select("dig", "seg").distinct().join(known.select("dig", "n", "place"), "dig")
    verdicts = cut(few.mapInArrow(_judge(least, keep == "first"), _VERDICT).unionByName(_by_window(crowd, least, keep)), "verdicts")

    places = segs.select("row", "row2", "id", "first", "dig")
    if keep == "first":
        first = known.select(F.col("dig").alias("kd"), "place")
        places = places.join(first, F.col("dig") == F.col("kd")).withColumn("late", ~F.col("place").eqNullSafe(place)).drop("place")
        judged = verdicts.withColumnRenamed("dig", "vd")
        places = places.join(judged, (F.col("dig") == F.col("vd")) & (F.col("late") == F.col("later")))
    else:
        places = places.join(verdicts.where("not later").select(F.col("dig").alias("vd"), "runs"), F.col("dig") == F.col("vd"))
    covered = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).cast("long").alias("a"), (F.col("first") + r["b"] - 1 + least).cast("long").alias("b")))
    spans = places.select("row", "row2", covered.alias("s")).groupBy("row", "row2").agg(F.flatten(F.collect_set("s")).alias("spans"))
    final = squeezed.join(spans.hint("shuffle_hash"), ["row", "row2"], "left").select("id", "z", "spans")
    out = final.mapInArrow(_cleaner, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id)


def _by_window(crowd: DataFrame, least: int, keep: str) -> DataFrame:
    """(dig, later, runs) for segments of crowded anchors, (dig, seg, n, place):
    each window by itself, dealt by a digest of its bytes, so no task gathers an
    anchor's segments and equal windows are counted where they are made."""
    wins = crowd.select("dig", "seg").mapInArrow(_explode_windows(least), "dig binary, i int, win binary")
    wins = wins.join(crowd.select(F.col("dig").alias("kd"), "n", "place"), F.col("dig") == F.col("kd"))
    # a window may be in any share of the segments, so its places are dealt to SALTS groups
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    dealt = (F.col("win") == F.col("lw")) & (F.pmod(F.hash("dig"), F.lit(SALTS)) == F.col("salt"))
    if keep == "first":
        times = F.explode(F.when(F.col("n") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
        wins = wins.withColumn("later", times).select("dig", "later", "i", "win", F.struct("place", "later", "i").alias("at"))
        lead = wins.groupBy("win").agg(F.min("at").alias("lead"), F.count("*").alias("c")).where("c > 1").select(F.col("win").alias("lw"), "lead", salts)
        hit = wins.join(lead, dealt).where(~F.col("at").eqNullSafe(F.col("lead")))
    else:
        twice = wins.groupBy("win").agg(F.sum("n").alias("c")).where("c > 1").select(F.col("win").alias("lw"), salts)
        hit = wins.join(twice, dealt).withColumn("later", F.lit(False))
    marks = hit.groupBy("dig", "later").agg(F.array_sort(F.collect_set("i")).alias("i"))
    starts = F.filter("i", lambda x: ~F.array_contains("i", x - 1))
    stops = F.transform(F.filter("i", lambda x: ~F.array_contains("i", x + 1)), lambda x: x + 1)
    return marks.select("dig", "later", F.arrays_zip(starts.alias("a"), stops.alias("b")).alias("runs"))

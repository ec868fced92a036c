"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits, by majority over the XXH64 of a text's shingles.
Distinct fingerprints meet where they agree on six of eight bytes, which any two
at most two bits apart do. In every such bucket the bits are stored vertically,
one plane a bit over all rows; a plane is compared with itself shifted by d rows,
so one pass updates the distances of all pairs d rows apart in carry-save
counters, and the pass ends as soon as every pair exceeds the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bit_filter, body, cut, may_hold
from tidemark.operators.components import connected_components

BITS = 64
BLOCKS = 8
#: The radius for which the buckets are complete: BLOCKS - RADIUS blocks agree.
RADIUS = 2
SEED = 42
SHINGLE = 3
#: Near copies: words in a shingle, share of shingles in common, bands of minimum hashes and hashes in a band.
NEAR_WIDTH = 5
NEAR_SIMILARITY = 0.8
BANDS, ROWS = 12, 2
# odd, and unrelated to each other: under multiples of one number the same members would be least again and again
_MULTIPLIERS = [np.uint64(xxhash.xxh64_intdigest(b"min-%d" % k, SEED) | 1) for k in range(BANDS * ROWS)]
#: Fingerprints of a crowded bucket that meet in one task, times two.
TILE = 8192
#: Bytes of sets of shingles that meet in one task, times two; a larger set is a tile of its own.
SET_TILE = 4 << 20
_STEP = 1 << 16
#: Texts that a task remembers so as not to send their sets twice.
_SEEN = 200_000


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text: A-Z lowered, words of non-space,
    ``width`` words joined by a space, repeats kept; fewer words are one
    shingle, none give none."""
    words = raw.lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return np.array([digest(join(words), SEED)] if words else [], "<u8")
    return np.array([digest(join(s), SEED) for s in zip(*(islice(words, i, None) for i in range(width)))], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _STEP):
        part = hashes[i : i + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes, width: int = SHINGLE) -> int:
    return majority(shingle_hashes(raw, width))


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint as a signed long) of
    every row; null and empty texts have fingerprint zero."""
    src = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), body(text).alias("raw"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(n)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(b.columns[:n] + [pa.array(fps)], names=b.schema.names[:n] + ["fp"])

    schema = ", ".join([f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["fp long"])
    return src.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "fp")


def _planes(fps: np.ndarray) -> list[int]:
    """Bit planes: integer p holds bit p of row i at its bit i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(r.tobytes(), "little") for r in rows]


def _within(planes: list[int], shift: int, lanes: int, radius: int) -> int:
    """The lanes (rows i) at most ``radius`` bits from row i + shift. The
    counters are bit planes themselves, one a binary digit, added to by
    carry-save steps; they start so high that passing the radius carries out of
    the last one, and such lanes leave at once. With none left the block is
    abandoned."""
    digits = radius.bit_length()
    start = (1 << digits) - 1 - radius
    counter = [lanes if start >> k & 1 else 0 for k in range(digits)]
    for p in planes:
        carry = (p ^ (p >> shift)) & lanes
        for k in range(digits):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
            if not carry:
                break
        else:
            lanes &= ~carry
            if not lanes:
                return 0
    return lanes


def _set_bits(x: int, n: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")[:n])


def _mask(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def link_sorted(runs: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) inside stretches of equal ``runs``: linked rows of a run
    get one root, the smallest fingerprint of theirs. At most one link a row
    comes out, however many pairs are near."""
    root = np.arange(len(fps))
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    size = np.diff(np.r_[first, len(runs)])
    count, size = size, np.repeat(size, size)
    shift, rows = 1, np.flatnonzero(size > 1)
    planes = _planes(fps[rows])
    while shift < len(rows):
        k = runs[rows]
        pair = k[shift:] == k[:-shift]
        if not pair.any():
            break
        near = _within(planes, shift, _mask(pair), radius)
        if near:
            i = _set_bits(near, len(rows))
            _unite(root, rows[i], rows[i + shift])
        shift += 1
        if shift & (shift - 1) == 0:  # drop the runs that are done or one class already
            while (root[root] != root).any():
                root = root[root]
            united = np.repeat(np.minimum.reduceat(root, first) == np.maximum.reduceat(root, first), count)
            left = (size[rows] > shift) & ~united[rows]
            if not left.all():
                rows = rows[left]
                planes = _planes(fps[rows])
    while (root[root] != root).any():
        root = root[root]
    signed = fps.view(np.int64)
    least = signed.copy()
    np.minimum.at(least, root, signed)
    top = least[root]
    linked = np.flatnonzero(top != signed)
    return signed[linked], top[linked]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ra, rb = root[a], root[b]
    differ = np.flatnonzero(ra != rb)
    for x, y in zip(ra[differ].tolist(), rb[differ].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by all columns, the last of them fp, the others naming
        the run: links in each run. A batch's last run waits for the next batch."""
        held: list[np.ndarray] | None = None

        def out(runs: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = link_sorted(runs, f.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["src", "dst"])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.r_[h, c] for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols[:-1]], axis=0)]
            at = int(np.flatnonzero(new)[-1])
            if at:
                yield out(np.cumsum(new)[:at], cols[-1][:at])
            held = [c[at:] for c in cols]
        if held is not None:
            yield out(np.zeros(len(held[-1]), np.int64), held[-1])

    return run


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): links between distinct fingerprints at most RADIUS bits
    apart; every pair within the radius is connected through them, while a
    bucket gives fewer links than it has rows. ``fps`` has the column fp.

    Each fingerprint goes to 28 buckets, one for each choice of six bytes, so a
    bucket never has over 2**16 fingerprints and no bound on it is needed.
    """
    fp = F.col("fp")
    width = BITS // BLOCKS
    masks = []
    for free in combinations(range(BLOCKS), RADIUS):
        m = (1 << BITS) - 1
        for blk in free:
            m ^= ((1 << width) - 1) << (blk * width)
        masks.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    keyed = fps.select(fp, F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("combo", "mask"))
    keyed = keyed.select("combo", fp.bitwiseAND(F.col("mask")).alias("key"), fp)
    dealt = keyed.repartition("combo", "key").sortWithinPartitions("combo", "key", "fp")
    return dealt.mapInArrow(_link_batches(RADIUS), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id, component_fp) for every row of ``docs``:
    fingerprint as 16 hex digits; component_id is the smallest id reachable over
    links of at most two differing bits, component_fp the smallest fingerprint.

    Null and empty texts share fingerprint zero and link like any other. Null
    ids stay, and are never a component_id unless all ids of the component are
    null. Repeated rows and exact copies collapse to one fingerprint before any
    comparison. A very long text is one row's work, its hashes in memory at
    once. An empty table gives none; other columns are ignored. Jobs run while
    the result is built: fingerprints, links and rounds of components are written
    to the shared folder.
    """
    rows = cut(fingerprints(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), ("id",), "text", width), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("id").alias("least"))
    comp = connected_components(cut(links(least.select("fp")), "links"))
    classes = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    top = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(top, "component").select("fp", "component_id", "component")
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return rows.join(named, "fp").select(
        F.col("id").alias(id), hexed("fp").alias("fingerprint"), "component_id", hexed("component").alias("component_fp")
    )


def radius_for(similarity: float) -> int:
    """Bits in which fingerprints of two texts with that share of common
    shingles differ, plus six standard deviations: small sets vary more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(BITS * p + 6 * math.sqrt(BITS * p * (1 - p)))


def _set_of(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; a text without words has the one hash zero."""
    return np.unique(hashes) if len(hashes) else np.zeros(1, "<u8")


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text, node, fp, bytes, keys): text and node are hashes of the text
        and of its set of shingles, fp is the set's fingerprint, repeats not
        counted, as the similarity is that of sets; a key is of a pair of the
        least shingle hashes under two multipliers."""
        for b in batches:
            raws = b.column(1).to_pylist()
            texts, nodes, fps, sizes, keys = [], [], [], [], []
            for raw in raws:
                h = _set_of(shingle_hashes(raw, width))
                least = np.array([(h * m >> np.uint64(11)).min() for m in _MULTIPLIERS], np.uint64)
                texts.append(xxhash.xxh64_intdigest(raw, SEED))
                nodes.append(_node(h))
                fps.append(majority(h))
                sizes.append(h.nbytes)
                keys += [xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) for i in range(0, len(least), ROWS)]
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(raws) + 1, dtype=np.int32) * BANDS), signed(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), signed(texts), signed(nodes), signed(fps), pa.array(sizes, pa.int64()), lists], names=["id", "text", "node", "fp", "bytes", "keys"])

    return run


def _sets(width: int, bits: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, fp, shingles) once a task for each set whose text is in the
        filter: its hashes, sorted. Other texts are not cut into shingles again."""
        texts: set[int] = set()
        seen: set[int] = set()

        def out(found: list[tuple]) -> pa.RecordBatch:
            signed = lambda k: pa.array(np.array([x[k] for x in found], np.uint64).view(np.int64))
            return pa.RecordBatch.from_arrays([signed(0), signed(1), pa.array([x[2] for x in found], pa.binary())], names=["node", "fp", "shingles"])

        for b in batches:
            raws = b.column(0).to_pylist()
            hashes = np.array([xxhash.xxh64_intdigest(raw, SEED) for raw in raws], np.uint64)
            found, size = [], 0
            for n in np.flatnonzero(may_hold(bits, hashes)).tolist():
                if int(hashes[n]) in texts:
                    continue
                if len(texts) > _SEEN:
                    texts.clear()
                    seen.clear()
                texts.add(int(hashes[n]))
                h = _set_of(shingle_hashes(raws[n], width))
                node = _node(h)
                if node in seen:
                    continue
                seen.add(node)
                found.append((node, majority(h), h.tobytes()))
                size += h.nbytes
                if size > SET_TILE:
                    yield out(found)
                    found, size = [], 0
            yield out(found)

    return run


def link_similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the number of the first set of its class, classes being
    joined by pairs of that Jaccard similarity.

    Sets that similar share one of their rarest members: all but a share
    ``similarity`` of a set, and one more (the prefix filter). A set is compared
    with those of other classes that share such a member and are near enough in
    size; members of the largest class need no turn, since every pair that
    leaves it is seen from its other end.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((number, count[number], owner))  # each set's members, rarest first
    starts = np.cumsum(sizes) - sizes
    nth = np.arange(len(flat)) - np.repeat(starts, sizes)
    rare = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    kept = order[nth < np.repeat(rare, sizes)]
    member, holder = number[kept], owner[kept]
    by = np.argsort(member, kind="stable")
    listed, first = holder[by], np.r_[0, np.cumsum(np.bincount(member, minlength=len(count)))]
    ends = np.cumsum(rare)
    label, done = np.arange(n), np.zeros(n, bool)
    while True:
        kinds, counts = np.unique(label, return_counts=True)
        waiting = np.flatnonzero(~done & (label != kinds[counts.argmax()]))
        if not len(waiting):
            return label
        p = waiting[0]
        done[p] = True
        mine = member[ends[p] - rare[p] : ends[p]]
        near = np.unique(np.concatenate([listed[first[m] : first[m + 1]] for m in mine.tolist()]))
        low, high = np.minimum(sizes[near], sizes[p]), np.maximum(sizes[near], sizes[p])
        near = near[(label[near] != label[p]) & (low >= similarity * high - 1e-9)]
        if not len(near):
            continue
        at = np.concatenate([np.arange(starts[q], starts[q] + sizes[q]) for q in near.tolist()])
        own = number[starts[p] : starts[p] + sizes[p]]  # sorted, as sets are
        place = np.minimum(np.searchsorted(own, number[at]), len(own) - 1)
        common = np.bincount(np.repeat(np.arange(len(near)), sizes[near])[own[place] == number[at]], minlength=len(near))
        alike = near[common >= similarity * (sizes[near] + sizes[p] - common)]
        if len(alike):
            joined = np.r_[label[alike], label[p]]
            label[np.isin(label, joined)] = joined.min()


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, a, b, node, shingles) sorted by all but the last:
        links inside each group, which has two tiles of sets at most."""
        now, group = None, {}

        def out() -> pa.RecordBatch:
            nodes = list(group)
            label = link_similar([np.frombuffer(group[x], "<u8") for x in nodes], similarity) if len(nodes) > 1 else np.zeros(len(nodes), np.int64)
            pairs = [(x, nodes[k]) for x, k in zip(nodes, label.tolist()) if x != nodes[k]]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["src", "dst"])

        for batch in batches:
            for c, a, b, node, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if (c, a, b) != now:
                    if len(group) > 1:
                        yield out()
                    now, group = (c, a, b), {}
                group[node] = raw
        if len(group) > 1:
            yield out()

    return run


def _tiled(rows: DataFrame, by: list[str], n: str, item: str, tile: int) -> DataFrame:
    """``rows`` with columns a, b: groups ``by`` of at most ``tile`` in all (items
    or bytes, as in column ``n``) stay whole, larger ones are dealt out so that
    any two items meet under some pair of tiles."""
    rows = rows.withColumn("_t", F.ceil(F.col(n) / tile).cast("long"))
    rows = rows.withColumn("_m", F.pmod(F.xxhash64(item), F.col("_t"))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1)))
    return rows.withColumns({"a": F.least("_m", "_o"), "b": F.greatest("_m", "_o")}).drop("_t", "_m", "_o", n)


def near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(id, component_id, component): classes of texts joined by pairs whose
    sets of ``width``-word shingles have a Jaccard similarity of ``similarity``
    or more; component_id is the smallest id of the class, component its name.

    Texts meet if they agree on one of BANDS pairs of minimum hashes (at 0.8,
    all but five in a million pairs that similar do). Bit-sliced distances
    of their fingerprints within the radius for that similarity (six standard
    deviations above the mean) join them to candidate components,
    in which the similarity of the sets of shingle hashes (64 bits) is then
    checked in full. Only texts in a filter of those that met another are cut
    into shingles again and moved, copies once a task. Crowded
    buckets and components are dealt out in pairs of tiles, bounded by rows and
    by bytes: no task holds one, no pair is left out.

    Null and empty texts are alike; a very long text is one row's work, its set
    a tile of its own; null ids stay, and are a component_id only where all ids
    are null; repeated rows are one text; an empty table gives none; other
    columns are ignored. Jobs run while the result is built: the sketches, links
    and candidate components are written to the shared folder.
    """
    kind = docs.schema[id].dataType.simpleString()
    src = docs.select(F.col(id).alias("id"), body(text).alias("raw"))
    rows = cut(src.mapInArrow(_sketches(width), f"id {kind}, text long, node long, fp long, bytes long, keys array<long>"), "sketches")

    band = rows.select("fp", F.posexplode("keys").alias("band", "key")).distinct()
    met = band.join(band.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), ["band", "key"])
    met = _tiled(met, ["band", "key"], "n", "fp", TILE).select("band", "key", "a", "b", "fp")
    dealt = met.repartition("band", "key", "a", "b").sortWithinPartitions("band", "key", "a", "b", "fp")
    linked = dealt.mapInArrow(_link_batches(radius_for(similarity)), "src long, dst long").distinct()
    candidates = connected_components(cut(linked, "links")).withColumnRenamed("node", "fp")

    nodes = rows.select("node", "fp", "bytes").distinct()
    lone = nodes.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").join(candidates, "fp", "left_anti").select("fp", F.col("fp").alias("component"))
    placed = candidates.unionByName(lone)
    sizes = nodes.join(placed, "fp").groupBy("component").agg(F.count("*").alias("k"), F.sum("bytes").alias("n")).where("k > 1").drop("k")
    placed = cut(placed.join(sizes, "component"), "placed")
    bits = bit_filter(rows.join(placed.select("fp"), "fp", "left_semi"), "text")
    sets = src.select("raw").mapInArrow(_sets(width, bits), "node long, fp long, shingles binary")
    checked = sets.join(placed.hint("shuffle_hash"), "fp").select("component", "n", "node", "shingles")
    checked = _tiled(checked, ["component"], "n", "node", SET_TILE).select("component", "a", "b", "node", "shingles")
    checked = checked.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "node")
    same = connected_components(cut(checked.mapInArrow(_verify(similarity), "src long, dst long").distinct(), "same"))

    least = rows.groupBy("node").agg(F.min("id").alias("least")).join(same, "node", "left")
    least = least.select("node", "least", F.coalesce("component", "node").alias("component"))
    top = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(top, "component").select("node", "component_id", "component")
    return rows.select("id", "node").join(named, "node").select(F.col("id").alias(id), "component_id", "component")

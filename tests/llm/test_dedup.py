import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lpf, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    """{row number: smallest id reachable} by all pairs of fingerprints."""
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, f"{fps[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def key(r):
    return tuple((x is not None, x) for x in r)


def test_simhash_of_odd_rows(odd, empty):
    got = [tuple(r)[:3] for r in simhash.near_duplicates(odd).collect()]
    assert sorted(got, key=key) == sorted(brute_components([(r.doc_id, r.text) for r in odd.collect()]), key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_of_near_copies(spark):
    rng = random.Random(1)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(300)]
        for k in range(12):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(300)] = "changed"
            rows.append((len(rows), " ".join(words)))
    got = [tuple(r)[:3] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def brute_classes(rows, width=5, similarity=0.8):
    """[(id, smallest id of its class)] by all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    return [(d, ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def edited(seed, groups=15, copies=12, words=300):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for k in range(copies):
            w = list(base)
            for _ in range(2 * k % 15):
                w[rng.randrange(words)] = f"x{rng.randrange(9000)}"
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [None, 4])
def test_near_copies_against_all_pairs(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(simhash, "TILE", tile)
        monkeypatch.setattr(simhash, "SET_TILE", tile * 2400)
    rows = edited(11)
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert len({c for _, c in want}) < len(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([0.5, 0.8, 1.0]))
def test_link_similar_against_all_pairs(seed, similarity):
    rng = random.Random(seed)
    bases = [rng.sample(range(400), rng.randrange(1, 40)) for _ in range(4)]
    sets = [sorted({x if rng.random() < 0.93 else rng.randrange(10**6) for x in rng.choice(bases)}) for _ in range(rng.randrange(2, 40))]
    label = simhash.link_similar([np.array(x, "<u8") for x in sets], similarity).tolist()
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(set(a) & set(b))
            if common >= similarity * (len(a) + len(b) - common) and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert label == want


def test_bands_miss_no_more_pairs_than_chance():
    """At a similarity of 0.8 a band of two minima agrees in 0.64 of all pairs, and bands do not hang together."""
    rng = random.Random(8)
    shared = []
    for _ in range(400):
        words = [f"w{rng.getrandbits(40)}" for _ in range(450)]
        texts = [" ".join(words[a : a + 400 + 4]).encode() for a in (0, 44)]
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(texts, pa.binary())], names=["id", "raw"])
        a, b = next(simhash._sketches(5)(iter([batch]))).column("keys").to_pylist()
        shared.append(len(set(a) & set(b)))
    assert min(shared) >= 1
    assert 0.60 * 12 < np.mean(shared) < 0.68 * 12 and 2.0 < np.var(shared) < 3.6  # 12 * 0.64 * 0.36 = 2.8


def with_line(seed, times, change=0, single=100, line=9):
    """A text whose last line stands there several times."""
    rng = random.Random(seed)
    base, last = [f"w{rng.randrange(10**6)}" for _ in range(single)], [f"l{rng.randrange(10**6)}" for _ in range(line)]
    return " ".join([*(["changed"] * change), *base[change:], *last * times])


def test_near_copies_that_repeat_a_line(spark):
    rows = [(2 * g + k, with_line(g, (1, 20)[k])) for g in range(20) for k in range(2)]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert len({c for _, c in want}) == 20
    assert sorted((r.doc_id, r.component_id) for r in got) == want


def test_near_copies_that_repeat_a_line_in_any_partition(spark):
    # texts 0 and 1 of a group have one set of shingles, 2 and 3 are near copies of one of them each
    rows = [(4 * g + k, with_line(g, t, c)) for g in range(10) for k, (t, c) in enumerate([(20, 0), (2, 0), (2, 1), (20, 1)])]
    want = brute_classes(rows)
    assert len({c for _, c in want}) == 10
    for order, parts in ((rows, 1), (rows[::-1], 1), (rows, 8)):
        df = spark.createDataFrame(spark.sparkContext.parallelize(order, parts), "doc_id long, text string")
        assert sorted((r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()) == want


def test_near_copies_of_odd_rows(odd, empty):
    got = [tuple(r)[:2] for r in simhash.near_copies(odd).collect()]
    assert sorted(got, key=key) == sorted(brute_classes([(r.doc_id, r.text) for r in odd.collect()]), key=key)
    assert simhash.near_copies(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 7), st.integers(0, 2**32), st.integers(2, 30))
def test_bit_sliced_distances(radius, seed, n):
    rng = random.Random(seed)
    base = rng.getrandbits(64)
    fps = []
    for _ in range(n):
        x = base
        for _ in range(rng.randrange(radius + 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    planes = simhash._planes(np.array(fps, np.uint64))
    for shift in range(1, n):
        near = simhash._within(planes, shift, (1 << (n - shift)) - 1, radius)
        assert [near >> i & 1 for i in range(n - shift)] == [int((fps[i] ^ fps[i + shift]).bit_count() <= radius) for i in range(n - shift)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=3), st.integers(0, 2**64 - 1), st.integers(2, 40))
def test_links_of_a_run(flips, base, n):
    rng = random.Random(base)
    fps = {base}
    for _ in range(n):
        x = base
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(16)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    src, dst = simhash.link_sorted(np.zeros(len(fps), np.int64), fps)
    root = {int(x): int(x) for x in fps.view(np.int64)} | dict(zip(src.tolist(), dst.tolist()))
    want = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    changed = True
    while changed:  # labels by all pairs
        changed = False
        for a in fps:
            for b in fps:
                i, j = int(a.view(np.int64)), int(b.view(np.int64))
                if (int(a) ^ int(b)).bit_count() <= 2 and want[i] != want[j]:
                    want[i] = want[j] = min(want[i], want[j])
                    changed = True
    assert len({(root[x], want[x]) for x in want}) == len(set(root.values())) == len(set(want.values()))


def brute_removed(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                hit[i : i + least] = b"\1" * least
        out.append(bytes(c for c, h in zip(t, hit) if not h))
    return out


def brute_keep_first(rows, least):
    """rows (id, bytes), distinct ids: what stays if each window's first place does."""
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - least + 1):
            first.setdefault(t[i : i + least], (d, i))
    out = {}
    for d, t in rows:
        hit = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] != (d, i):
                hit[i : i + least] = b"\1" * least
        out[d] = bytes(c for c, h in zip(t, hit) if not h)
    return out


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = [prose(40) + " " + rng.choice(shared)[rng.randrange(40) :] + " " + prose(rng.randrange(60)) for _ in range(60)]
    texts += [texts[0], texts[0], shared[1] + shared[1], "ab" * 400, "a" * 201, "b" * 200, "b" * 199, "", None]
    return texts + [shared[2] + prose(1) for _ in range(90)]  # one anchor with many different segments


@pytest.mark.parametrize("most", [None, 2000])
def test_repeats_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lpf, "MAX_BYTES", most or lpf.MAX_BYTES)
    rows = list(enumerate(passages()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in lpf.repeats(df, keep="none").collect()}
    want = brute_removed([(t or "").encode() for _, t in rows], 200)
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("most", [None, 2000])
def test_repeats_keeping_the_first(spark, monkeypatch, most):
    monkeypatch.setattr(lpf, "MAX_BYTES", most or lpf.MAX_BYTES)
    rows = list(enumerate(passages(4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in lpf.repeats(df, keep="first").collect()}
    assert got == brute_keep_first([(d, (t or "").encode()) for d, t in rows], 200)


def test_repeats_keeping_the_first_of_copies_in_several_tasks(spark):
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    shared = [prose(120) for _ in range(4)]
    rows = list(enumerate([f"{prose(20)} {s}{prose(20)}" for s in shared for _ in range(6)] + [f"{prose(20)} {s[: k * 150]}{prose(20)}" for s in shared for k in (2, 3)]))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.doc_id: bytes(r.kept) for r in lpf.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), keep="first").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert got == brute_keep_first([(d, t.encode()) for d, t in rows], 200)


def test_repeats_of_odd_rows(odd, empty):
    got = lpf.repeats(odd, keep="none").collect()
    assert len(got) == odd.count()
    by = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got)
    assert by[(6, 25003, 25000)] == 1
    assert by[(3, 0, 0)] == 1 and by[(2, 75, 0)] == 2
    assert lpf.repeats(empty, keep="none").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=4, max_size=40), st.text("ab", min_size=4, max_size=40).map(str.encode)), min_size=1, max_size=8), st.integers(2, 9))
def test_windows_in_suffix_order(parts, width):
    data = np.frombuffer(b"".join(parts), np.uint8)
    if len(data) < width:
        return
    wins = np.lib.stride_tricks.sliding_window_view(data, width)
    order, lcp = lpf.suffix_order(wins)
    as_bytes = [bytes(w) for w in wins]
    assert [as_bytes[i] for i in order] == sorted(as_bytes)
    common = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
    before, after = lpf.longest_factors(order, lcp)
    assert before.tolist() == [max((common(w, v) for v in as_bytes[:i]), default=0) for i, w in enumerate(as_bytes)]
    assert after.tolist() == [max((common(w, v) for v in as_bytes[i + 1 :]), default=0) for i, w in enumerate(as_bytes)]


def test_factors_of_one_letter_and_of_random_bytes():
    for data in (bytes(3000), random.Random(1).randbytes(3000), b"ab" * 1500):
        wins = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), 200)
        before, after = lpf.longest_factors(*lpf.suffix_order(wins))
        first, last = {}, {}
        for i in range(len(wins)):
            first.setdefault(data[i : i + 200], i)
            last[data[i : i + 200]] = i
        assert (before == 200).tolist() == [first[data[i : i + 200]] < i for i in range(len(wins))]
        assert (after == 200).tolist() == [last[data[i : i + 200]] > i for i in range(len(wins))]


def test_op2_query_against_brute_force(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seen = {}
    for _, raw in docs:
        for i in range(len(raw) - 199):
            h = hashlib.blake2b(raw[i : i + 200], digest_size=16).digest()
            seen[h] = seen.get(h, 0) + 1
    want = {}
    for doc, raw in docs:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[hashlib.blake2b(raw[i : i + 200], digest_size=16).digest()] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[doc] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_repeats(spark, sf).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


@pytest.mark.parametrize("keep_first", [False, True])
def test_factors_judge_segments_of_equal_bytes(keep_first):
    """A segment at three places and one that holds half of it at an earlier place."""
    rng = random.Random(2)
    one, other = rng.randbytes(260), rng.randbytes(40)
    two = other + one[:220]
    place = lambda i: {"id": i, "row": i, "row2": None, "first": 0}
    known = [(7, b"one", None, 3, place(5)), (7, b"one", one, None, None), (7, b"one", one, None, None), (7, b"two", None, 1, place(None)), (7, b"two", two, None, None)]
    cols = [pa.array(c) for c in zip(*known)]
    batches = [pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in cols], names=["h", "dig", "seg", "n", "place"]) for a, b in ((0, 2), (2, 5))]
    got = {(d, later): [(r["a"], r["b"]) for r in runs] for b in lpf._judge(200, keep_first)(iter(batches)) for d, later, runs in zip(*(c.to_pylist() for c in b.columns))}
    if keep_first:  # two comes first, so what it shares with one goes at one's first place, all of one at the later ones
        assert got == {(b"one", False): [(0, 21)], (b"one", True): [(0, 61)]}
    else:
        assert got == {(b"one", False): [(0, 61)], (b"one", True): [(0, 61)], (b"two", False): [(40, 61)]}


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    """Every window has its anchor, wherever a text is cut; memory does not grow with the text."""
    import tracemalloc

    def owned(chunk, text):
        monkeypatch.setattr(lpf, "_CHUNK", chunk)
        batch = pa.record_batch([pa.array([7]), pa.array([8]), pa.array([text], pa.binary())], names=["row", "row2", "raw"])
        spans = [(h, *lpf._unpack(p)) for b in lpf._anchor_rows(200)(iter([batch])) for h, p in zip(b["h"].to_pylist(), b["pos"].to_pylist(), strict=True)]
        return sorted((w, h) for h, first, last in spans for w in range(first, last + 1))

    some = random.Random(3).randbytes(2_000)
    text = some + b"ab" * 700 + some[300:] + some
    assert owned(999, text) == owned(1 << 20, text) and len(owned(999, text)) == len(text) - 199
    monkeypatch.undo()
    tracemalloc.start()
    for _ in lpf._anchor_rows(200)(iter([pa.record_batch([pa.array([7]), pa.array([8]), pa.array([random.Random(4).randbytes(5 << 20)], pa.binary())], names=["row", "row2", "raw"])])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20

import math
import random
import re
import struct
import time

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, html_render, tokens, toxicity, warc


def test_blocks_and_lists():
    html = "<title>t</title><p>One <b>two<p>three<br>four<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>tail<script>no</script>"
    assert html_render.render(html) == "One two\n\nthree\nfour\n\n- a\n- b\n  3. x\n  4. y\n\ntail"


def test_visibility():
    html = '<div hidden>a</div><div style="display: none">b</div><div style="visibility:hidden">c<i style="visibility:visible">d</i></div><template>e</template><noscript>f</noscript>g'
    assert html_render.render(html) == "d\ng"


def test_table_is_aligned():
    html = "<table><caption>cap</caption><tr><th>name<th>n<tr><td>long name<td>1<tr><td rowspan=2>two<td>22<tr><td>3<tr><td colspan=2>wide<table><tr><td>in<td>ner</table></table>end"
    assert html_render.render(html) == "cap\nname       n\nlong name  1\ntwo        22\n           3\nwide\n\nin  ner\n\nend"


@pytest.mark.parametrize(
    "html, want",
    [
        ("<table><colgroup><col><col><tr><td>x<td>y</table>end", "x  y\n\nend"),
        ("<table><colgroup><col><tbody><tr><td>x</table>", "x"),
        ("<table><colgroup><td>x</table>", "x"),
        ("<table><form action=a><tr><td>x</td></tr></form></table>", "x"),
        ("<table><tr><form><td>x<td>y</form></table>end", "x  y\n\nend"),
        ("<table>note<tr><td>x</table>", "note\n\nx"),
        ("a<table><tr>b<td>x</td>c</tr><p>d</table>", "abc\n\nd\n\nx"),
        ("<table><div>one<tr><td>x<td>y</table>", "one\n\nx  y"),
        ("<table hidden>note<tr><td>x</table>", "note"),
        ("<table><tr><td>x</tr><table><tr><td>y</table>z", "x\n\ny\n\nz"),
        ("<table><tr><td>x<table><tr><td>y</table></table>z", "x\n\ny\n\nz"),
    ],
)
def test_tables_lose_no_text(html, want):
    assert html_render.render(html) == want


def test_raw_end_tags_in_capitals():
    assert html_render.render("\u0130 <SCRIPT>no</SCRIPT>a<style>no</STYLE>b") == "\u0130 ab"


def test_entities_pre_and_broken_markup():
    assert html_render.render("a &amp; b &lt;c&gt; <pre>x\n  y</pre> 1 < 2 <!-- gone --> <![CDATA[z]]> <a href='>'>q</a>") == "a & b <c>\n\nx\n  y\n\n1 < 2 q"
    assert html_render.render("</p></div><td>x<td>y") == "x\ny"
    assert html_render.render("<div>" * 5000 + "deep") == "deep"
    assert html_render.render("<a title='" + "x" * 50_000) != ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab p!-'\"=&;tdr\n", max_size=80))
def test_any_markup_renders(html):
    html_render.render(html)


def test_pages_of_odd_rows(spark):
    rows = [(1, None), (None, "<p>x"), (2, ""), (2, ""), (3, "<p>" + "w " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))
    got = sorted((tuple(r) for r in html_render.extract(df).collect()), key=repr)
    assert got == sorted([(1, ""), (None, "x"), (2, ""), (2, ""), (3, ("w " * 100_000).strip())], key=repr)
    assert html_render.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return tokens.load_pieces()


def brute_count(pieces, word):
    """All segmentations of a short word."""
    low = min(pieces.values()) - 10.0
    best = {0: (0.0, 0)}
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + low * n, -(best[i - 1][1] + n))]
        options += [(best[j][0] + pieces[word[j:i]], -(best[j][1] + 1)) for j in range(i) if word[j:i] in pieces]
        s, k = max(options)
        best[i] = (s, -k)
    return best[len(word)][1]


def test_trie_counts_equal_word_by_word(pieces):
    rng = random.Random(2)
    words = list({"".join(rng.choice("theringsoablé漢😀x") for _ in range(rng.randrange(1, 14))) for _ in range(400)})
    trie = tokens.Trie(pieces)
    for _ in range(2):
        assert [trie.count(w.encode()) for w in words] == [brute_count(pieces, tokens.MARK + w) for w in words]
    # one node a distinct prefix, the score of each computed once
    assert len(trie.best) == len({(tokens.MARK + w)[:i] for w in words for i in range(len(w) + 2)})


@pytest.mark.parametrize("deep", [1, 2, 7, 20])
def test_counts_beyond_the_depth_of_the_trie(pieces, monkeypatch, deep):
    monkeypatch.setattr(tokens, "DEEP", deep)
    rng = random.Random(deep)
    words = ["".join(rng.choice(["the", "ing", "a", "ü", "字", "x", "😀", "tion"]) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    trie = tokens.Trie(pieces)
    assert [trie.count(w.encode()) for w in words * 2] == [brute_count(pieces, tokens.MARK + w) for w in words * 2]


def test_a_megabyte_without_white_space(pieces):
    trie = tokens.Trie(pieces)
    word = "字tokenization的数据" * 60_000
    began = time.monotonic()
    n = trie.count(word.encode())
    assert time.monotonic() - began < 30 and len(trie.best) <= tokens.DEEP + 1 and not trie.terminals
    assert n == trie.count(word.encode()) and 60_000 * 3 < n < len(word.encode())


def test_nodes_are_bounded_inside_a_row(spark, pieces, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_NODES", 300)
    most = []
    insert = tokens.Trie.insert
    monkeypatch.setattr(tokens.Trie, "insert", lambda self, w: (insert(self, w), most.append(len(self.best)))[0])
    trie, words = tokens.Trie(pieces), [f"word{i}" for i in range(2000)]
    assert [trie.count(w.encode()) for w in words] == [brute_count(pieces, tokens.MARK + w) for w in words]
    assert max(most) < 400


def test_counts_equal_a_unigram_tokenizer(pieces):
    from tokenizers import Tokenizer, models

    vocab = sorted(pieces.items(), key=lambda kv: -kv[1])
    t = Tokenizer(models.Unigram([("<unk>", min(pieces.values()) - 100.0), *vocab], 0, False))
    trie = tokens.Trie(pieces)
    for w in "the quick brown international unbelievable a zebra counting tokens is straightforward".split():
        assert len(t.encode(tokens.MARK + w, add_special_tokens=False).ids) == trie.count(w.encode())


def test_token_counts_of_odd_rows(odd, empty, pieces, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_NODES", 20)
    trie = tokens.Trie(pieces)
    count = lambda t: sum(trie.count(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = sorted(((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), count(r.text)) for r in odd.collect()), key=repr)
    assert sorted((tuple(r) for r in tokens.token_counts(odd, pieces).collect()), key=repr) == want
    assert tokens.token_counts(empty, pieces).count() == 0


def labelled(spark, n=400):
    rng = random.Random(7)
    neutral = [f"word{i}" for i in range(150)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(neutral, k=40) + (rng.choices(["scumbag", "scumlike", "worthless"], k=2) if toxic else [])
        if rng.random() < (0.7 if toxic else 0.05):
            words.append(rng.choice(["muslim", "jewish"]))  # a spurious tie to the label
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    held = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(held) > 50 and sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)
    free = toxicity.fit(docs, labels, penalty=0.0)
    pull = lambda m: abs(m["weights"].get("muslim", 0.0)) + abs(m["weights"].get("jewish", 0.0))
    assert pull(model) < pull(free)
    gap = lambda m: abs(m["weights"].get("muslim", 0.0) - m["weights"].get("christian", 0.0))
    assert gap(model) < 0.5 * gap(free)
    assert toxicity.fit(docs, labels) == model


def plain_loss(rows, y, swapped, w, bias, ridge, penalty):
    """The loss in plain Python: rows and swapped rows as sets of features."""
    total = 0.0
    for row, t in zip(rows, y):
        p = 1 / (1 + math.exp(-(bias + sum(w[c] for c in row))))
        total -= math.log(p if t else 1 - p) / len(rows)
    total += ridge / 2 * sum(x * x for x in w)
    return total + penalty / 2 * sum((sum(w[c] for c in a) - sum(w[c] for c in b)) ** 2 for a, b in swapped) / max(1, len(swapped))


def test_loss_gradient_and_optimum():
    rng = random.Random(4)
    rows = [sorted(rng.sample(range(6), rng.randrange(5))) for _ in range(60)]
    y = np.array([float(rng.random() < (0.8 if 0 in r else 0.2)) for r in rows])
    pairs = [({0, 1}, {2}), ({3}, {4}), ({1, 5}, {1, 4})]
    x = toxicity.Sparse.of(rows, 6)
    swap = toxicity.Sparse.of([[*(a - b), *(-1 - c for c in b - a)] for a, b in pairs], 6)
    w, bias = np.array([rng.uniform(-1, 1) for _ in range(6)]), 0.3
    loss, grad = toxicity.loss_and_gradient(x, y, swap, w, bias, 0.01, 2.0)
    assert loss == pytest.approx(plain_loss(rows, y, pairs, w, bias, 0.01, 2.0))
    for i in range(7):
        up, down = np.r_[w, bias], np.r_[w, bias]
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (plain_loss(rows, y, pairs, up[:6], up[6], 0.01, 2.0) - plain_loss(rows, y, pairs, down[:6], down[6], 0.01, 2.0)) / 2e-5
        assert grad[i] == pytest.approx(slope, abs=1e-6)
    w, bias = toxicity.fit_logistic(x, y, swap, 0.01, 2.0, 2000)
    best = plain_loss(rows, y, pairs, w, bias, 0.01, 2.0)
    for _ in range(200):
        assert best <= plain_loss(rows, y, pairs, w + np.array([rng.gauss(0, 0.05) for _ in range(6)]), bias + rng.gauss(0, 0.05), 0.01, 2.0) + 1e-9


def test_every_swap_of_a_group():
    got = {(frozenset(a), t) for a, t in toxicity.swaps({"gay", "women", "prose"})}
    gay = next(g for g in toxicity.IDENTITY if "gay" in g)
    assert got == {(frozenset({"women"}), "men")} | {(frozenset({"gay"}), t) for t in gay if t != "gay"}
    both = {t for a, t in toxicity.swaps({"gay", "straight"}) if a == {"gay", "straight"}}
    assert both == set(gay)


def test_toxicity_ignores_held_out_labels(spark):
    docs, labels = labelled(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    assert toxicity.fit(docs, turned) == toxicity.fit(docs, labels)


def test_toxicity_of_odd_rows(odd, empty, spark):
    docs, labels = labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd.withColumn("score", F.lit(9.0)), model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, none).collect()} == {0}
    assert toxicity.fit(odd, labels)["bias"] is not None


BENCH = [
    (1, "alpha beta gamma delta epsilon. Zeta eta theta iota kappa! Lambda mu nu xi omicron; pi rho sigma tau upsilon."),
    (2, "only four words here"),
    (3, None),
    (4, "..."),
    (5, "one two three four five six seven eight nine ten"),
    (6, "one two three four five six seven eight nine ten"),
]


def brute_coverage(item, text):
    """Greedy tiling by comparing all places, longest first."""
    a, b = decontam.words_of(item or ""), decontam.words_of(text or "")
    if not a:
        return 0.0
    least, fa, fb, cov = min(5, len(a)), [True] * len(a), [True] * len(b), 0
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return cov / len(a)
        fa[i : i + k] = [False] * k
        fb[j : j + k] = [False] * k
        cov += k


def contaminated_docs():
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["one", "two", "alpha", "zz", "yy", "eta"]) for _ in range(n))
    a, b, c = BENCH[0][1].split(". ")[0], BENCH[0][1].split(". ")[1].split("! ")[0], BENCH[0][1].split("! ")[1]
    docs = [noise(30) + " " + BENCH[0][1].upper() + " " + noise(5), f"{c} {noise(9)} {b} and {a}", f"{a} {noise(3)} {b}", noise(60)]
    docs += ["x only, four WORDS here y", "only four words", "six seven eight nine ten one two three four five", "one two three four five six seven eight", None, ""]
    words = BENCH[0][1].split()
    for _ in range(30):
        w = list(words)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = "zz"
        k = rng.randrange(len(w))
        docs.append(noise(4) + " " + " ".join(w[k:] + w[:k]) + " " + noise(4))
    return list(enumerate(docs))


@pytest.mark.parametrize("bits", [1 << 25, 1 << 15])
def test_contamination_against_brute_force(spark, bits, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    monkeypatch.setattr(decontam, "ITEMS_A_ROW", 2)
    rows = contaminated_docs()
    df = spark.createDataFrame([*rows, rows[0], (None, rows[1][1])], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.contamination(df, bench).select("doc_id", "item_ids", "contaminated", F.round("coverage", 9)).collect()), key=repr)
    want = []
    for d, t in [*rows, rows[0], (None, rows[1][1])]:
        cov = {i: brute_coverage(x, t) for i, x in BENCH}
        hit = sorted(i for i, c in cov.items() if c >= 0.8)
        want.append((d, hit, bool(hit), round(max((cov[i] for i in hit), default=0.0), 9)))
    assert got == sorted(want, key=repr)


def test_contamination_of_nothing(odd, empty, spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontam.contamination(empty, bench).count() == 0
    got = decontam.contamination(odd, bench.limit(0)).collect()
    assert len(got) == odd.count() and not any(r.contaminated for r in got)


PAGES = [(3, "u3", "<p>same"), (1, "u1", "<p>same"), (2, None, None), (5, "u5", ""), (4, "u\n4", "é" * 300_000), (7, "u7", "<p>same"), (None, "u", "<p>same"), (None, "v", "alone"), (8, "a", "rep"), (8, "a", "rep"), (9, "b", "rep")]


def brute_warc(rows, least=0):
    import base64
    import hashlib

    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [d for d, _, x in rows if (x or "") == (h or "") and d is not None]
        first = min(same, default=None)
        ref = first if len(raw) >= least and first is not None and first != i else None
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    bundles = warc.write_bundles(df, least)
    got = warc.read_bundles(bundles, payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute_warc(PAGES, least)
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert texts[4] == "é" * 300_000
    ids = [r.record_id for r in got]
    assert len(set(ids)) == len(ids) == len(PAGES)
    refers = [warc.parse_record(rec)[0] for b in bundles.collect() for rec in [zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(b.bundle))] for rec in re.split(rb"(?=WARC/1\.1\r\n)", rec) if rec]
    assert {h["WARC-Refers-To"] for h in refers if h["WARC-Type"] == "revisit"} <= {r.record_id for r in got if r.record_type == "response"}
    some = warc.lookup(bundles, bundles.select(F.inline("index")).where("offset > 0").select("record_id")).collect()
    assert {r.record_id for r in some} <= {r.record_id for r in got} and len(some) >= 1
    assert warc.read_bundles(warc.write_bundles(df.limit(0))).count() == 0


def test_bundle_is_plain_zstandard(monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    b = warc._Bundle()
    recs = [warc.make_record(i, f"u{i}", b"p" * (i * 50), warc.digest32(b"p" * (i * 50)), i * 50, None) for i in range(12)]
    for i, r in enumerate(recs):
        b.add(f"r{i}", r)
    data, index = b.close()
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
    assert whole == b"".join(recs)
    frames = warc.read_seek_table(data)
    assert len(frames) > 3 and sum(c for _, c, _ in frames) + 8 * len(frames) + 17 == len(data)
    for (rid, frame, at, size), rec in zip(index, recs):
        start, c, raw = frames[frame]
        assert zstandard.ZstdDecompressor().decompress(data[start : start + c])[at : at + size] == rec
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=25), st.lists(st.integers(0, 3), max_size=60), st.sampled_from([0.0, 0.8]))
def test_cover_equals_comparing_all_places(item, text, coverage):
    spell = lambda ids: " ".join("abcd"[i] for i in ids)
    want = brute_coverage(spell(item), spell(text))
    hashes = decontam._Hashes()
    got = decontam.cover(hashes.of(spell(item).encode()), hashes.of(spell(text).encode()), min(5, len(item)), coverage)[0]
    assert got == pytest.approx(want if want >= coverage else 0.0)


def test_tiling_repeated_words_takes_no_time():
    rng = random.Random(3)
    for few in (1, 2, 3):
        item, text = (np.array([rng.randrange(1, few + 1) for _ in range(n)], np.uint64) for n in (200, 4000))
        began = time.monotonic()
        assert sum(k for _, _, k in decontam.tiles(item, text, 5)) > 150
        assert time.monotonic() - began < 1
    long = np.array([rng.randrange(10**6) for _ in range(100_000)], np.uint64)
    cut_up = long.copy()
    cut_up[rng.sample(range(100_000), 2_000)] = 1
    began = time.monotonic()
    assert decontam.cover(long, cut_up, 5, 0.8)[0] > 0.9
    assert time.monotonic() - began < 20


def test_rolling_hash_is_local():
    ids = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 5], np.uint64)
    h = decontam.rolling(ids, 5)
    assert h[0] == h[5] and len(set(h.tolist())) == 5

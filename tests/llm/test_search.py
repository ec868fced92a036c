import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import covertree, lexical, merkle


def terms(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def ranked(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, total, df = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // max(total, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_lexical_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "漢字", "A1"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(400)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w3 w3"), (None, None), (500, "")]
    items = [(i, text(rng.randint(1, 12))) for i in range(30)] + [(30, None), (31, "nowhere"), (None, "w1 W1"), (3, "w9"), (3, "w9")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, items)
    for most in (8192, 16):
        assert sorted(map(tuple, lexical.search(d, b, most_rows=most).collect()), key=repr) == want


def test_lexical_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, "quick fox"), (2, "long end")], "item_id long, text string").withColumn("tile", F.lit(1)).withColumn("terms", F.lit(2))
    want = ranked([(r.doc_id, r.text) for r in odd.collect()], [(1, "quick fox"), (2, "long end")])
    assert sorted(map(tuple, lexical.search(odd, items).collect()), key=repr) == want
    assert lexical.search(empty, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0


def test_terms_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "_PIECE", 64)
    for text in ("ab cd " * 200, "x" * 1000, "a" * 500 + " b", "é" * 300 + "-" + "Z" * 40, ""):
        assert [w.decode() for ws in lexical._words(text.encode()) for w in ws] == terms(text)


def test_maxscore_skips_postings_and_keeps_the_best():
    rng = np.random.default_rng(1)
    lists = [(np.sort(rng.choice(5000, n, replace=False)), rng.integers(1, top, n)) for n, top in ((4000, 20), (3000, 30), (40, 9000), (25, 9000))]
    score = np.zeros(5000, np.int64)
    for at, v in lists:
        score[at] += v
    best, seen = lexical.best_of_shard(lists, 5000, np.arange(5000), 10)
    order = np.lexsort((np.arange(5000), -score))[:10]
    assert best == [(int(score[a]), int(a)) for a in order] and seen < 1000


def nearest(rows, k=5):
    whole = [(i, None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for a, (q, u) in enumerate(whole):
        if u is None or q is None or q % 50:
            continue
        found = [(-sum(x * y for x, y in zip(u, v, strict=True)), i is None, i or 0, i) for b, (i, v) in enumerate(whole) if b != a and v is not None and len(v) == len(u)]
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_dual_tree_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 0, 1]) + rng.gauss(0, 0.05) for _ in range(6)]) for i in range(700)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 1.0, -1.0]) for i in range(700, 900)]  # copies: ties by id
    rows += [(50, rows[0][1]), (50, rows[0][1]), (None, rows[0][1]), (901, None), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.inf] + [0.0] * 5), (950, [math.nan] * 6), (1000, [1.0, 2.0]), (1001, [3.0, -1.0]), (1050, []), (1051, []), (1100, [9e30] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, tile int").repartition(3)
    want = nearest([(i, v) for i, v in rows if i != 1100])
    for tile in (4096, 50):
        assert sorted(map(tuple, covertree.top_k(df, F.col("vec_id") % 50 == 0, tile=tile).collect()), key=repr) == want
    assert covertree.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_doubles(spark):
    rows = [(i, [1e6 + 7 * i, -2e6 + i, 3e6]) for i in range(0, 120, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, covertree.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=repr) == nearest(rows)


def test_cover_tree_covers_separates_and_prunes():
    rng = np.random.default_rng(2)
    centres = rng.integers(-2000, 2000, (12, 8))
    points = (centres[rng.integers(0, 12, 3000)] + rng.integers(-20, 20, (3000, 8))).astype(float)
    tree = covertree.build(points)
    assert (tree.points == points[tree.perm]).all() and sorted(tree.perm) == list(range(3000))
    for c, lo, hi, first, n in tree.span:
        d = np.sqrt(((tree.points[lo:hi] - tree.points[c]) ** 2).sum(1))
        radius = tree.reach[np.nonzero((tree.span[:, 1] == lo) & (tree.span[:, 2] == hi))[0][0], 0]
        assert c == lo and d.max() <= radius + 1e-6
        if n:
            kids = tree.span[first : first + n]
            assert kids[0, 1] == lo and kids[-1, 2] == hi and (kids[1:, 1] == kids[:-1, 2]).all() and kids[0, 0] == c
            scale = covertree.BASE ** (np.ceil(np.log(radius) / np.log(covertree.BASE)) - 1)
            heads = tree.points[kids[:, 0]]
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2))[~np.eye(n, dtype=bool)]
            assert (apart > scale).all()
    q = covertree.build(points[:200])
    low = np.full(200, np.iinfo(np.int64).min)
    found = covertree.Search(q, tree, tree.perm, np.full(200, -1), low, 5)
    assert found.met < 0.35 * 200 * 3000
    scores = q.points @ tree.points.T
    for p, best in enumerate(found.best):
        order = np.lexsort((tree.perm, -scores[p]))[:5]
        assert [(-s, r) for s, r, _ in best] == [(int(scores[p, o]), int(tree.perm[o])) for o in order]


def leaf_of(values):
    return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def levels(leaves, fanout=16):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([sha256("".join(out[-1][i : i + fanout]).encode()).hexdigest() for i in range(0, len(out[-1]), fanout)])
    return out


def proved(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> the manifest's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            d, proof = leaf, ""
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                d = leaf_of([*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])])
            for tree, at in ((trees[s], i), (top, k)):
                for level in tree[:-1]:
                    lo = at // 16 * 16
                    left, right = "".join(level[lo:at]), "".join(level[at + 1 : lo + 16])
                    proof, d, at = proof + left + right, sha256((left + d + right).encode()).hexdigest(), at // 16
            out.append((r[0], s, leaf, trees[s][-1][0], top[-1][0], sha256(proof.encode()).hexdigest(), d, d == top[-1][0]))
    return sorted(out, key=repr)


def tampered(df, **more):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(df, now={"text": low}, when=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **more)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_against_brute_force(spark, height):
    rng = random.Random(height)
    rows = [(i, rng.choice(["a", "a", "a", "b", "Ü", None]), None if i % 9 == 0 else "en", i % 5, None if i % 7 == 0 else f"Text {i} ÄB") for i in range(600)]
    rows += [(600 + i, f"s{i:02d}", "de", None, "One Leaf") for i in range(40)] + [rows[5]] * 3 + [(None, "b", None, None, None), (None, None, "x", 1, "Z")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(5)
    got = tampered(df, height=height)
    assert sorted(map(tuple, got.collect()), key=repr) == proved(rows)


def test_manifest_of_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert sorted(map(tuple, tampered(odd).collect()), key=repr) == proved(rows)
    assert merkle.manifest(empty).count() == 0
    one = merkle.manifest(odd.where("doc_id = 8")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha256(b"").hexdigest()

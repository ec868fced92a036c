"""The pipeline against the brute-force versions of its stages, in turn."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_dedup import brute_classes  # noqa: E402
from test_rules import brute_mix  # noqa: E402
from test_text import brute_coverage  # noqa: E402

from tidemark.llm import mixing, quality, secrets  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_quality(rows):
    judged = [(r, quality.judge((r[1] or "").encode())) for r in rows]
    return [(r[0], j[8], *r[2:]) for r, j in judged if j[6]]


def brute_near(rows):
    top = brute_classes([(r[0], r[1]) for r in rows])
    return [r for r, t in zip(rows, top) if t[1] == r[0]]


def test_run_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = brute_near(brute_quality(docs))
    grams = lambda t: {tuple(w[i : i + 5]) for w in [__import__("re").findall(r"\w+", t.lower())] for i in range(len(w) - 4)}
    seeds = [(t, grams(t)) for _, t in bench]
    clean = [r for r in kept if not any(g & grams(r[1]) and brute_coverage(t, r[1]) >= 0.8 for t, g in seeds)]
    assert len(docs) > len(kept) > len(clean)
    want = brute_mix([(r[0], r[1], r[3]) for r in clean], mixing.Mix())
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").sum("served").collect()
    # masking a secret may join or leave words as they are, never split one
    assert {r[0]: r[1] for r in got} == {w[0]: w[4] for w in want if w[4]}


def test_stages_of_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        left = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            assert out.count() <= left.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()


def test_failed_lines_go(spark):
    prose = "\n".join(" ".join(f"word{i}x{k}" for k in range(9)) + "." for i in range(8))
    df = spark.createDataFrame([(1, f"Home | About | Shop\n{prose}\nAll rights reserved.", "en", "s", 9), (2, "Home | About\n" * 40, "en", "s", 9), (3, None, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(dict(corpus_pipeline.STAGES)["quality"](spark, df, SF)) == [(1, prose, "en", "s", len(prose))]


def test_one_of_each_group_stays(spark, odd):
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = rows_of(stage(spark, odd, SF).select("doc_id", "text"))
    assert [g[0] for g in got if g[1] and g[1].startswith("The quick")] == [1]
    assert sum(1 for g in got if g[1] == "no id here, only words") == 1
    assert [g[0] for g in got if not (g[1] or "").strip()] == [3]


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([(1, "x password=hunter22 y", "en", "s", 21), (2, "clean", "en", "s", 5), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = rows_of(dict(corpus_pipeline.STAGES)["secrets"](spark, df, SF))
    assert [(g[0], g[1], g[4]) for g in got] == [(1, "x [SECRET] y", 12), (2, "clean", 5), (3, None, 0)]
    assert secrets.RULES[0].kind == "assign"

import io
import zipfile
from functools import partial
from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import components, datasets, graph, metrics, state, vector
from tidemark.sources import files, sse
from tidemark.streaming import stateful, watch


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 20), (12, 10), (5, None)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect())
    want = {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20} | {i: 100 for i in range(100, 141)}
    assert got == want


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_canonical_names_follow_chains(spark):
    raw = spark.createDataFrame([(0, "trà đào cam sả lạnh to"), (1, "Trà đào cam sả lạnh to!"), (2, "cà phê"), (3, "")], "ordinal int, name string")
    got = dict(graph.canonical_names(raw).collect())
    assert got["Trà đào cam sả lạnh to!"] == "trà đào cam sả lạnh to" and got["cà phê"] == "cà phê" and got[""] == ""


def test_similar_names_equal_all_pairs(spark):
    names = [" ".join(w) for n in (3, 4, 5) for w in combinations("a b c d e f".split(), n)]
    rows = spark.createDataFrame(list(enumerate(names)), "rank int, name string")
    got = {(r.a, r.b) for r in graph.similar_names(rows, 0.75).collect()}
    sets = [set(n.split()) for n in names]
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.75}
    assert got == want


def test_expansion_limit_comes_before_seen(spark):
    seeds = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id long, node_id long, ordinal long")
    edges = spark.createDataFrame([(10, 11), (11, 12)], "src long, dst long")
    links = spark.createDataFrame([(10, "x"), (11, "x"), (12, "x"), (13, "x"), (14, "x")], "chunk_id long, entity string")
    got = graph.expansion(seeds, edges, links, per_seed=1).orderBy("ordinal").collect()
    # the two with most in common are 10 and 11, seeds themselves, so only the neighbour is left
    assert [(r.node_id, r.expansion_type) for r in got] == [(12, "adjacent")]


def test_sections(spark):
    rows = spark.createDataFrame([("## A\nbody\nmore\n## B\n\n## C\nx",)], "text string")
    got = graph.sections(rows).orderBy("pos").collect()
    assert [(r.title, r.section_text) for r in got] == [("## A".removeprefix("## "), "body\nmore"), ("B", ""), ("C", "x")]


def test_split_sizes(spark):
    rows = spark.range(97).select("id", (F.col("id") % 2).alias("g"))
    got = {(r.g, r.split): r["count"] for r in datasets.stratified_split(rows, ["g"], "id").groupBy("g", "split").count().collect()}
    assert got == {(0, "train"): 39, (0, "val"): 4, (0, "test"): 6, (1, "train"): 38, (1, "val"): 4, (1, "test"): 6}


def test_latency_rules(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 41)] + [("b", 1.0), ("b", 9.0)], "g string, v double")
    got = {r.g: r for r in metrics.latency(rows, "v", ["g"]).collect()}
    assert (got["a"].p50, got["a"].p95, got["a"].p95_below, got["a"].p95_or_max) == (21, 39, 38, 39)
    assert (got["b"].p50, got["b"].p95, got["b"].p95_below, got["b"].p95_or_max) == (9, 9, 1, 9)


def test_vector_blocks_agree(spark, monkeypatch):
    rows = spark.range(60).select(F.col("id").alias("node_id"), F.array(F.cos("id"), F.sin("id")).alias("vec"))
    asked = rows.where("node_id % 5 = 0").select(F.col("node_id").alias("query_id"), F.col("vec").alias("query_vec"))
    whole = vector.top_k(asked, rows, 3).collect()
    from tidemark.plans import blocks

    monkeypatch.setattr(vector, "by_block", partial(blocks.by_block, size=4))
    assert sorted(map(tuple, vector.top_k(asked, rows, 3).collect())) == sorted(map(tuple, whole))


def test_files(spark, tmp_path):
    (tmp_path / "menu.csv").write_text('name,price_vnd,category,size,ingredients,description\n"A ""x""",1000,tea,S,i,"two\nlines"\n', encoding="utf-8")
    row = files.read_csv(spark, str(tmp_path / "menu.csv"), files.MENU).first()
    assert (row.name, row.price_vnd, row.description) == ('A "x"', 1000, "two\nlines")
    (tmp_path / "r.jsonl").write_text('{"index": 1, "text": "a"}\n\n{"index": 1, "text": "b"}\n{"index": 2, "text": "c"}\n')
    got = files.read_latest(spark, str(tmp_path / "r.jsonl"), files.REVIEW, "index").orderBy("index").collect()
    assert [(r["index"], r.text) for r in got] == [(1, "b"), (2, "c")]
    (tmp_path / "bad.jsonl").write_text('{"text": "a"}\nnot json\n')
    assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), files.INTENT).count() == 1


def test_documents(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>xin</w:t></w:r><w:r><w:t> chào</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.md").write_text("## T\nx", encoding="utf-8")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "xin chào\n", "b.md": "## T\nx"}


def test_sse(spark):
    raw = spark.createDataFrame([("r", 'event: token\ndata: {"delta": {"content": "a"}}\n\ndata: {"choices": [{"delta": {"content": "b"}}]}\n\ndata: [DONE]\n\ndata: {"delta": {"content": "late"}}\n\n')], "request_id string, body string")
    got = sse.deltas(sse.parse(raw)).orderBy("seq").collect()
    assert [r.token for r in got] == ["a", "b"]


def test_clause_rows(spark):
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(["Hi. ", "there", "! so", " on"])], "request_id string, seq long, token string")
    got = state.clauses(rows).orderBy("request_id", "seq", "sub").collect()
    assert [(r.event, r.data) for r in got] == [("token", "Hi. "), ("clause", "Hi."), ("token", "there"), ("token", "! so"), ("clause", "there!"), ("token", " on"), ("clause", "so on"), (None, "[DONE]")]


def test_limiter_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(u, float(t), i) for i, (u, t) in enumerate([(1, 0), (1, 1), (1, 2), (2, 0), (1, 3), (1, 12), (2, 1)])], "user_id long, t double, event_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    machine = partial(state.RateLimiter, 2, 10.0)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stateful.run_machine(stream, "user_id", ["t", "event_id"], ["t"], machine, "allowed boolean, remaining long")
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = state.replay(rows, ["user_id"], ["t", "event_id"], ["t"], machine, "allowed boolean, remaining long")
    assert sorted(map(tuple, spark.table("limited").collect())) == sorted(map(tuple, batch.collect()))


def test_watch_reads_new_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []

    def load(df, kind, batch):
        seen.extend((kind, r.path.rsplit("/", 1)[1]) for r in df.collect())

    (folder / "menu_1.csv").write_text("x")
    (folder / "notes.md").write_text("y")
    (folder / "skip.bin").write_text("z")
    watch.watch(spark, str(folder), str(tmp_path / "cp"), load).awaitTermination(120)
    (folder / "faq.csv").write_text("w")
    watch.watch(spark, str(folder), str(tmp_path / "cp"), load).awaitTermination(120)
    assert sorted(seen) == [("document", "notes.md"), ("faq", "faq.csv"), ("menu", "menu_1.csv")]


def test_many_documents_a_file(spark, tmp_path, monkeypatch):
    """Bundles: few files for many documents, which come back as they were."""
    monkeypatch.setattr(files, "BUNDLE_BYTES", 4_000)
    hard = ["", None, "a\nb\n", "\x1e", "\x1edocument x\ny", "a\n\x1edocument x\ny\x1e\x1e\n", "é\r\nü", "\n"]
    rows = [(f"n {i}/=\n#%+é", hard[i % len(hard)]) for i in range(400)] + [("", "one"), (None, "two")]
    files.write_documents(spark.createDataFrame(rows, "name string, text string").repartition(3), str(tmp_path / "in"))
    assert 2 <= len(list((tmp_path / "in").glob("*.txt"))) <= 12
    (tmp_path / "in" / "plain.md").write_bytes("x\x1edocument y\n".encode())
    got = [(r.path, r.text) for r in files.read_documents(spark, str(tmp_path / "in")).collect()]
    assert sorted((p.partition("#")[2], t) for p, t in got if "#" in p) == sorted((n or "", (t or "") + "\n") for n, t in rows)
    assert [t for p, t in got if "#" not in p] == ["x\x1edocument y\n"]

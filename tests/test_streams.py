"""State machines on streams against their batch twins: rows in any order and any
micro-batch, late rows, restarts, silence."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.streaming import processors

MINUTE = 60.0


class Feed:
    """Micro-batches as files, read one a batch; ``run`` starts the stream from its
    checkpoint, so that every call is a restart."""

    def __init__(self, spark, tmp_path, schema, stream):
        self.spark, self.at, self.schema, self.stream, self.n = spark, tmp_path, schema, stream, 0
        (tmp_path / "in").mkdir()

    def put(self, rows):
        df = self.spark.createDataFrame(rows, self.schema).withColumn("ts", F.timestamp_micros(((F.col("t") + 1000) * 1_000_000).cast("long"))).coalesce(1)
        df.write.mode("append").parquet(str(self.at / "in"))
        self.n += 1

    def run(self):
        source = self.spark.readStream.schema(f"{self.schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(self.at / "in"))
        with processors.with_store(self.spark):
            q = self.stream(source).writeStream.format("parquet").option("path", str(self.at / "out")).option("checkpointLocation", str(self.at / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(180)
        return self.spark.read.parquet(str(self.at / "out"))


@pytest.fixture
def narrow(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def jumbled(rows, spread, parts, rng):
    """Rows (t first) in ``parts`` batches, none later than ``spread`` after its time."""
    last = max(r[0] for r in rows)
    due = sorted(rows, key=lambda r: r[0] + rng.random() * spread)
    out = [[] for _ in range(parts)]
    for r in due:
        out[min(parts - 1, int(parts * r[0] / (last + 1)))].append(r)
    return out


def same(found, want, *cols):
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert rows(found) == rows(want)


def test_breaker_and_restart(spark, tmp_path, narrow):
    rng = random.Random(1)
    rows = [(float(t), i, rng.choice("ab"), rng.random() < 0.6) for i, t in enumerate(sorted(rng.sample(range(3000), 60)))]
    schema = "t double, id long, user string, failed boolean"
    feed = Feed(spark, tmp_path, schema, lambda s: processors.run_in_order(s, processors.BreakerStream, "user", ["ts", "id"], ["t", "failed"], "ts timestamp, id long, state string, outcome string", "10 minutes", threshold=2, seconds=200.0))
    for batch in jumbled(rows, 300, 3, rng):
        feed.put(batch)
    feed.run()
    feed.put([(1.0, 1000, "a", True)])  # far behind the watermark: late
    feed.put([(9000.0, 1001, "z", False)])
    found = feed.run()
    want = state.replay(spark.createDataFrame(rows, schema), ["user"], ["t", "id"], ["t", "failed"], lambda: state.CircuitBreaker(2, 200.0), "state string, outcome string")
    same(found.where("user <> 'z'"), want, "user", "id", "state", "outcome")


def test_limiter(spark, tmp_path, narrow):
    rng = random.Random(2)
    rows = [(rng.randrange(1000) + i / 1000, i, rng.choice("ab")) for i in range(60)]
    schema = "t double, id long, user string"
    feed = Feed(spark, tmp_path, schema, lambda s: processors.run_in_order(s, processors.LimiterStream, "user", ["ts", "id"], ["t"], "ts timestamp, id long, allowed boolean, remaining long", "20 minutes", most=3, window=60.0))
    rng.shuffle(rows)
    for batch in (rows[:20], rows[20:40], rows[40:], [(9000.0, 1001, "z")]):
        feed.put(batch)
    want = state.replay(spark.createDataFrame(rows, schema), ["user"], ["t", "id"], ["t"], lambda: state.RateLimiter(3, 60.0), "allowed boolean, remaining long")
    same(feed.run().where("user <> 'z'"), want, "user", "id", "allowed", "remaining")


def test_history_and_its_expiry(spark, tmp_path, narrow):
    fold = lambda summary, old: f"{summary}|{len(old)}:{old[0][1][:3]}"  # noqa: E731  a function of this module is not found on workers
    rng = random.Random(3)
    early = [(float(i * 20), i, rng.choice("ab"), "user", "word " * rng.randrange(1, 30)) for i in range(30)]
    later = [(t + 6000, i + 100, u, r, x) for t, i, u, r, x in early]
    schema = "t double, id long, conv string, role string, text string"
    feed = Feed(spark, tmp_path, schema, lambda s: processors.run_in_order(s, processors.HistoryStream, "conv", ["ts", "id"], ["role", "text"], "ts timestamp, id long, held long, tokens long, folded long", "10 minutes", silence=3_600_000, summarise=fold, keep=2, limit=100))
    for batch in (early[15:], early[:15], later[::2], later[1::2], [(20_000.0, 1001, "z", "user", "x")]):
        feed.put(batch)
    runs = [state.replay(spark.createDataFrame(part, schema), ["conv"], ["t", "id"], ["role", "text"], lambda: state.History(fold, 2, 100), "held long, tokens long, folded long") for part in (early, later)]
    same(feed.run().where("conv <> 'z'"), runs[0].unionByName(runs[1]), "conv", "id", "held", "tokens", "folded")


def test_clauses_are_flushed(spark, tmp_path, narrow):
    words = ["Hi. ", "there", "! so", " on", " a. b. c", None, "d\n"]
    rows = [(float(10 * i + k), i, f"r{k}", words[(i + k) % len(words)]) for i in range(12) for k in range(3)]
    schema = "t double, seq long, request_id string, token string"
    feed = Feed(spark, tmp_path, schema, lambda s: processors.run_in_order(s, processors.ClauseStream, "request_id", ["ts", "seq"], ["seq", "token"], "seq long, sub long, event string, data string", "5 minutes", silence=600_000))
    rng = random.Random(4)
    rng.shuffle(rows)
    for batch in (rows[:18], rows[18:], [(3000.0, 0, "z", "x")], [(9000.0, 0, "zz", "y")]):
        feed.put(batch)
    same(feed.run().where("request_id not like 'z%'"), state.clauses(spark.createDataFrame(rows, schema)), "request_id", "seq", "sub", "event", "data")


@pytest.mark.parametrize("name", ["breaker", "limiter"])
def test_events_of_many_files(spark, tmp_path, narrow, name):
    """What comes in at once is one micro-batch, whatever number of files it has."""
    from tidemark import queries

    spark.range(600).select(
        F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(1_700_000_000 + (F.col("id") * 7919) % 1_500_000).alias("ts"),
        F.when(F.col("id") % 5 < 3, "error").otherwise("click").alias("event_type"), F.lit(1.0).alias("value"),
    ).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    found = queries.QUERIES[f"{name}_stream"](spark, str(tmp_path))
    same(found, queries.QUERIES[{"breaker": "circuit_breaker", "limiter": "rate_limiter"}[name]](spark, str(tmp_path)), *found.columns)

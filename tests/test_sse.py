"""Server-sent events: blocks by brute force, streams that stop and go on."""

import random

from pyspark.sql import functions as F

from tidemark.sources import sse


def split(body):
    """(seq, event, data) of a body, line by line."""
    out = []
    for block in (b for b in body.split("\n\n") if b.strip(" ")):
        event = next((x[6:].removeprefix(" ") for x in block.split("\n") if x.startswith("event:")), "")
        data = "\n".join(x[5:].removeprefix(" ") for x in block.split("\n") if x.startswith("data:"))
        out.append((len(out), event or None, data or None))
        if data == sse.DONE:
            break
    return out


def test_bodies_by_brute_force(spark):
    rng = random.Random(1)
    lines = ["event: token", "event:clause", "data: a", "data:b", "data: [DONE]", "data: ", ": comment", "other", "data:  two"]
    bodies = ["\n".join(rng.choice([*lines, ""]) for _ in range(rng.randrange(12))) for _ in range(300)]
    raw = spark.createDataFrame([*enumerate(bodies), (999, None), (998, "")], "request_id long, body string").repartition(3)
    got = sorted((r.request_id, r.seq, r.event, r.data) for r in sse.parse(raw).collect())
    assert got == sorted((i, *row) for i, body in enumerate(bodies) for row in split(body))


def test_a_response_is_one_row_without_a_shuffle(spark):
    raw = spark.createDataFrame([(1, "data: a\n\n")], "request_id long, body string")
    assert "Exchange" not in sse.parse(raw)._jdf.queryExecution().executedPlan().toString()


def test_lines_of_data_come_back(spark):
    rows = [("a\nb\n\nc", "x"), ("one", None), ("\n", "y"), ("", "z"), ("data: d", "e")]
    df = spark.createDataFrame(rows, "data string, event string")
    got = df.select("data", "event", sse.decode(sse.encode(F.col("event"), F.col("data"))).alias("back")).collect()
    assert [(r.back.data, r.back.event) for r in got] == [(d or None, e) for d, e in rows]
    body = df.groupBy(F.lit(1).alias("request_id")).agg(F.array_join(F.collect_list(sse.encode(F.col("event"), F.col("data"))), "").alias("body"))
    assert sorted(str((r.data, r.event)) for r in sse.parse(body).collect()) == sorted(str((d or None, e)) for d, e in rows)


def test_streams_go_on_in_the_middle(spark, tmp_path):
    at = {n: str(tmp_path / n) for n in ("in", "sent", "sender", "receiver", "out")}
    kinds = "request_id string, seq long, event string, data string"
    rows = [(f"r{i % 3}", i, None if i % 5 == 0 else "token", f'{{"delta": {{"content": "t{i}"}}}}' if i != 7 else sse.DONE) for i in range(40)]

    def add(part):
        spark.createDataFrame(part, kinds).repartition(3).write.mode("append").parquet(at["in"])

    def run():
        source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 2).parquet(at["in"])
        sse.send(source, at["sent"], at["sender"]).awaitTermination(120)
        back = sse.receive(spark, at["sent"], files=1)
        q = back.writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["receiver"]).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.read.schema(kinds).parquet(at["out"]).collect()), key=lambda r: r[1])

    add(rows[:15])
    assert run() == rows[:15]
    assert run() == rows[:15]  # nothing new
    add(rows[15:])
    assert run() == rows
    assert sorted(map(tuple, sse.receive(spark, at["sent"], stream=False).collect()), key=lambda r: r[1]) == rows
    tokens = sse.deltas(sse.receive(spark, at["sent"], stream=False)).orderBy("seq").collect()
    assert [r.token for r in tokens] == [f"t{i}" for i in range(40) if i != 7]

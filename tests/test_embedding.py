"""The batch embedder: one load a worker, the same vectors however rows are dealt."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import embedding, vector

TEXTS = ["Cà phê sữa đá", "cà phê", None, "", "a tea of milk", "milk tea, a tea", "--", "word " * 5000]


def vectors(df, model, **more):
    return {r.id: r.v for r in df.select("id", embedding.embed(model, "text", **more).alias("v")).collect()}


def test_vectors_do_not_depend_on_the_partitioning(spark):
    df = spark.createDataFrame([(i, TEXTS[i % len(TEXTS)]) for i in range(80)], "id long, text string")
    model = embedding.fit(df, "text")
    want = vectors(df.coalesce(1), model)
    for parts, batch in ((1, 3), (5, 256), (9, 1)):
        assert vectors(df.repartition(parts), model, batch=batch) == want
    call = model.load()
    assert all(want[i] is None if t is None else want[i] == call([t])[0].astype(np.float32).tolist() for i, t in enumerate(TEXTS))
    assert not any(want[3]) and not any(want[6]) and abs(sum(x * x for x in want[0]) - 1) < 1e-6


def test_a_worker_loads_a_model_once(spark, tmp_path):
    path = str(tmp_path)

    class Counting:
        def __hash__(self):
            return 7

        def __eq__(self, other):
            return type(self).__name__ == type(other).__name__

        def load(self):
            import os
            import uuid

            open(f"{path}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
            return lambda texts: np.array([[float(len(t)), float(os.getpid())] for t in texts])

    df = spark.range(2000).select("id", F.col("id").cast("string").alias("text")).repartition(16)
    got = [tuple(r.v) for _ in range(2) for r in df.select(embedding.embed(Counting(), "text").alias("v")).collect()]
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert len(got) == 4000 and len(loads) == len(set(loads)) and len(loads) < 16


def test_similar_texts_are_near(spark):
    df = spark.createDataFrame(list(enumerate(["green tea with milk", "green tea and milk", "a black cat sleeps", "the black cat sleeps"])), "id long, text string")
    e = df.select(F.col("id").alias("node_id"), embedding.embed(embedding.fit(df, "text"), "text").alias("vec"))
    asked = e.select(F.col("node_id").alias("query_id"), F.col("vec").alias("query_vec"))
    near = {r.query_id: r.node_id for r in vector.top_k(asked, e, 2).where("query_id <> node_id").collect()}
    assert near == {0: 1, 1: 0, 2: 3, 3: 2}

"""Queries of the dialogue flow, label scores and samplers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import dialogue, graph
from tidemark.plans.registry import Registry, table

R = Registry()

_ROUTE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in text.ROUTES) + f" ELSE '{text.DEFAULT_ROUTE}' END"
_VI = ", ".join(f"'{w}'" for w in text.VIETNAMESE_WORDS)
_LANG = f"CASE WHEN regexp_matches(lower(text), '[{text.VIETNAMESE_LETTERS}]') OR list_has_any(regexp_split_to_array(lower(text), '\\s+'), [{_VI}]) THEN 'vi' ELSE 'en' END"


@R.add(
    f"""WITH t AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS n_history FROM conversations),
u AS (SELECT conv_id, turn, text, n_history, {_ROUTE} AS intent, {_LANG} AS language FROM t WHERE role = 'user')
SELECT conv_id, turn, intent, language, n_history, CASE WHEN intent = 'ignore' THEN CASE language WHEN 'vi' THEN '{dialogue.IGNORED['vi']}' ELSE '{dialogue.IGNORED['en']}' END
ELSE '[You are the ' || intent || ' agent.] - ' || intent || ' fact 1' || chr(10) || '- ' || intent || ' fact 2' || chr(10) || text END AS reply FROM u"""
)
def dialogue_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    intents = spark.createDataFrame([(x,) for x in text.LABELS[:3]], "intent string")
    facts = intents.select("intent", F.array(F.concat("intent", F.lit(" fact 1")), F.concat("intent", F.lit(" fact 2"))).alias("facts"))
    systems = intents.select("intent", F.concat(F.lit("You are the "), "intent", F.lit(" agent.\nBe brief.")).alias("system"))
    return dialogue.answer(table(spark, sf_dir, "conversations"), facts, systems)


@R.add(
    """SELECT vec_id, ['order', 'consultant', 'faq', 'ignore'][list_position(g, list_max(g))] AS label FROM (SELECT vec_id, list_transform([1, 2, 3, 4], lambda i: round(list_sum(e[16 * i - 15:16 * i]) / 16 - 0.01 * i, 6)) AS g FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings))"""
)
def label_by_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    parts = F.array(*(F.slice(e, 16 * i + 1, 16) for i in range(4)))
    base = F.array(*(F.lit(0.01 * (i + 1)) for i in range(4)))
    return table(spark, sf_dir, "embeddings").select("vec_id", dialogue.best_label(parts, base, list(text.LABELS)).alias("label"))


@R.add(
    """WITH n AS (SELECT lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS src, p_partkey AS dst FROM part) SELECT src, dst FROM n WHERE src IS NOT NULL ORDER BY md5(dst::varchar || '42'), dst LIMIT 15"""
)
def adjacent_pair_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.next_edges(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_partkey")
    return dialogue.sample(edges, 15, "dst")


@R.add(
    """SELECT * FROM (SELECT 'faq' AS kind, item_id AS id, text AS query FROM benchmark ORDER BY md5(item_id::varchar || '42'), item_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'menu', p_partkey, 'Cho tôi hỏi về món ' || p_name FROM part ORDER BY md5(p_partkey::varchar || '42'), p_partkey LIMIT 10)"""
)
def test_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    faq = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    menu = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return dialogue.question_set(faq, menu, 30)


@R.add("SELECT i, r_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region), range(12) x(i) WHERE i % (SELECT count(*) FROM region) = k")
def cyclic_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repeat_to(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), 12, "r_regionkey").select("i", "r_name")


@R.add("SELECT event_id, event_id % 3 AS attempt, 0.5 * power(2, event_id % 3) + (event_id % 10) / 100.0 AS wait FROM events")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("event_id") % 3
    wait = dialogue.backoff(attempt, 0.5, (F.col("event_id") % 10) / 100)
    return table(spark, sf_dir, "events").select("event_id", attempt.alias("attempt"), wait.alias("wait"))


_PROBED = tuple("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


@R.add(" UNION ALL ".join(f"SELECT '{t}' AS component, CASE WHEN EXISTS (SELECT 1 FROM {t}) THEN 'up' ELSE 'down' END AS status" for t in _PROBED))
def health_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table as a component: up if a row can be read from it."""
    one = lambda t: table(spark, sf_dir, t).limit(1).agg(F.count("*").alias("n")).select(F.lit(t).alias("component"), F.when(F.col("n") > 0, "up").otherwise("down").alias("status"))
    return reduce(DataFrame.unionByName, map(one, _PROBED))


@R.add("SELECT vec_id, CASE WHEN label < 5 THEN 'menu' WHEN label < 8 THEN 'faq' ELSE 'document' END AS source FROM embeddings")
def knowledge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a retrieved row comes from: the menu, or its chunk's own source."""
    kind = F.when(F.col("label") < 5, "menu").otherwise(F.when(F.col("label") < 8, "faq").otherwise("document"))
    return table(spark, sf_dir, "embeddings").select("vec_id", kind.alias("source"))

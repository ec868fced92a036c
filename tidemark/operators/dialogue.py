"""Dialogue turns answered in bulk, and what scores and samples need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text

#: How a turn that needs no agent is answered, by language.
IGNORED = {"vi": text.FALLBACKS["ignore"], "en": "Sorry, I did not catch that."}


def context_lines(items: Column) -> Column:
    """Retrieved texts as a list, one a line."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def echo(system: Column, prompt: Column) -> Column:
    """The stand-in generator: the system prompt's first line, then the prompt."""
    return F.concat(F.lit("["), F.substring_index(system, "\n", 1), F.lit("] "), prompt)


def answer(turns: DataFrame, facts: DataFrame, systems: DataFrame, history: int = 10, key: str = "conv_id", order: str = "turn", user: str = "user") -> DataFrame:
    """(key, order, intent, language, n_history, reply) for every user turn.

    The turn is routed by rule; its history is what came before it; an agent's
    context are the facts of its intent (intent, facts: array) and its system
    prompt (intent, system). Intents without an agent get the canned reply of
    their language. Both tables have one row an intent.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-history, -1)
    asked = turns.withColumn("n_history", F.count("*").over(w)).where(F.col("role") == user)
    asked = asked.withColumns({"intent": text.route(F.col("text")), "language": text.language(F.col("text"))})
    known = asked.join(facts, "intent", "left").join(systems, "intent", "left")
    prompt = F.concat(context_lines(F.coalesce("facts", F.array().cast("array<string>"))), F.lit("\n"), F.col("text"))
    canned = F.when(F.col("language") == "vi", IGNORED["vi"]).otherwise(IGNORED["en"])
    reply = F.when(F.col("system").isNull() | (F.col("intent") == text.DEFAULT_ROUTE), canned).otherwise(echo(F.col("system"), prompt))
    return known.select(key, order, "intent", "language", "n_history", reply.alias("reply"))


def best_label(scores: Column, baseline: Column, labels: list[str]) -> Column:
    """The label whose mean log-probability rises most over its baseline; the
    first of equals. ``scores``: array of arrays of log-probabilities, one a label."""
    mean = F.transform(scores, lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(s), F.lit(1)))
    gain = F.zip_with(mean, baseline, lambda a, b: a - b)
    return F.element_at(F.array(*(F.lit(x) for x in labels)), F.array_position(gain, F.array_max(gain)).cast("int"))


def backoff(attempt: Column, base: float, jitter: Column) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt) + jitter


def sample(rows: DataFrame, n: int, id: str, seed: str = "42") -> DataFrame:
    """``n`` rows in the order of a seeded hash: a sample is what it is for."""
    key = F.md5(F.concat(F.col(id).cast("string"), F.lit(seed)))
    return rows.orderBy(key, id).limit(n)


def repeat_to(rows: DataFrame, n: int, order: str) -> DataFrame:
    """``n`` rows that go round and round a short list in order (benchmarks)."""
    listed = rows.withColumn("_k", F.row_number().over(Window.orderBy(order)) - 1)
    m = max(1, rows.count())
    wanted = rows.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % m).cast("int").alias("_k"))
    return wanted.join(listed, "_k").drop("_k")


def question_set(faq: DataFrame, menu: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """(kind, id, query): two thirds questions, the rest names put into a
    question. faq: (id, question); menu: (id, name)."""
    two = 2 * n // 3
    asked = sample(faq, two, "id", seed).select(F.lit("faq").alias("kind"), "id", F.col("question").alias("query"))
    named = sample(menu, n - two, "id", seed).select(F.lit("menu").alias("kind"), "id", F.concat(F.lit("Cho tôi hỏi về món "), "name").alias("query"))
    return asked.unionByName(named)

"""Queries of as-of and interval joins: events, a month of them, are laid over the
years of the orders, 18 minutes to a day; a user is the customer of that key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import temporal
from tidemark.plans.registry import Registry, table

R = Registry()

#: Days for which an order is open.
OPEN_DAYS = 45
_E = "e AS (SELECT event_id, user_id AS customer, floor((epoch_us(ts) / 1e6 - epoch(TIMESTAMP '2024-01-01')) / 1080)::bigint AS day FROM events)"
_O = "o AS (SELECT o_orderkey AS order_id, o_custkey AS customer, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS day, o_totalprice AS price FROM orders)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("ts").cast("timestamp").cast("double") - F.lit("2024-01-01").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("customer"), F.floor(seconds / 1080).alias("day"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), day.alias("day"), F.col("o_totalprice").alias("price"))


@R.add(f"WITH {_E}, {_O} SELECT event_id, e.customer, e.day, order_id, price FROM e LEFT JOIN o ON o.customer = e.customer AND o.day <= e.day QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o.day DESC, order_id DESC) = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest order of its customer up to its day."""
    return temporal.as_of(_events(spark, sf_dir), _orders(spark, sf_dir), "customer", "day", ["order_id", "price"], tie="order_id")


@R.add(f"WITH {_E}, {_O} SELECT event_id, order_id FROM e LEFT JOIN o ON o.customer = e.customer AND o.day < e.day AND o.day >= e.day - 60 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o.day DESC, order_id DESC) = 1")
def recent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of earlier days only, sixty at most."""
    found = temporal.as_of(_events(spark, sf_dir), _orders(spark, sf_dir), "customer", "day", ["order_id"], tie="order_id", strict=True, within=60.0)
    return found.select("event_id", "order_id")


@R.add(f"WITH {_E}, {_O} SELECT event_id, count(*) AS open_orders, round(sum(price), 2) AS price FROM e JOIN o ON o.customer = e.customer AND o.day <= e.day AND e.day < o.day + {OPEN_DAYS} GROUP BY event_id")
def open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that are open at each event."""
    spans = _orders(spark, sf_dir).select("customer", "price", F.col("day").alias("opened"), (F.col("day") + OPEN_DAYS).alias("closed"))
    met = temporal.in_intervals(_events(spark, sf_dir), spans, "customer", "day", "opened", "closed", OPEN_DAYS)
    return met.groupBy("event_id").agg(F.count("*").alias("open_orders"), F.round(F.sum("price"), 2).alias("price"))


@R.add(f"WITH {_O} SELECT a.order_id, b.order_id AS other_id FROM o a JOIN o b ON a.customer = b.customer AND a.order_id < b.order_id AND a.day < b.day + {OPEN_DAYS} AND b.day < a.day + {OPEN_DAYS}")
def orders_open_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of orders of a customer that are open at the same time."""
    o = _orders(spark, sf_dir)
    side = lambda n: o.select("customer", F.col("order_id").alias(f"id{n}"), F.col("day").alias(f"from{n}"), (F.col("day") + OPEN_DAYS).alias(f"to{n}"))
    met = temporal.overlapping(side(0), side(1), "customer", ("from0", "to0", "from1", "to1"), OPEN_DAYS)
    return met.where("id0 < id1").select(F.col("id0").alias("order_id"), F.col("id1").alias("other_id"))

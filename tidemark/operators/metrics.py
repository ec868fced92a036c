"""Classification, retrieval, latency and cache metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.order import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def per_class(rows: DataFrame, labels: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support) for the labels given, 0 where
    undefined. Counted once by (truth, pred); labels meet those counts."""
    cells = rows.groupBy(truth, pred).agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    joined = names.join(cells, (F.col("label") == F.col(truth)) | (F.col("label") == F.col(pred)), "left")
    is_t, is_p = F.col(truth) == F.col("label"), F.col(pred) == F.col("label")
    c = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    out = joined.groupBy("label").agg(c(is_t & is_p).alias("tp"), c(is_p).alias("predicted"), c(is_t).alias("support"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return out.select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def confusion(rows: DataFrame, labels: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row per true label, one column per predicted one, in fixed order."""
    table = rows.groupBy(truth).pivot(pred, labels).count().fillna(0)
    names = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{truth} string")
    return names.join(table, truth, "left").fillna(0)


def accuracy(rows: DataFrame, by: str | None = None, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(slice, n, accuracy): all rows, and, with ``by``, each of its values."""
    hit = F.avg((F.col(truth) == F.col(pred)).cast("int").cast("double"))
    every = rows.agg(F.count("*").alias("n"), F.coalesce(hit, F.lit(0.0)).alias("accuracy")).select(F.lit("all").alias("slice"), "n", "accuracy")
    if by is None:
        return every
    parts = rows.groupBy(F.col(by).cast("string").alias("slice")).agg(F.count("*").alias("n"), hit.alias("accuracy"))
    return every.unionByName(parts)


def ranked(rows: DataFrame, value: str, at: dict[str, Column], by: list[str]) -> DataFrame:
    """(by, n, *at): for each group the sorted value at zero-based positions given
    as columns of n, the group's size: index rules that no percentile function has.

    Values are counted first (partial aggregation); the counts are summed up over
    all groups and values in ranges, and a position is found by those sums, so no
    task holds a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    summed = running(counts, [*by, value], {"_before": F.col("_c")})
    groups = summed.groupBy(F.struct(*by).alias("_g")).agg(F.sum("_c").alias("n"), F.min("_before").alias("_base"))
    both = summed.join(groups, F.struct(*by).eqNullSafe(F.col("_g"))).withColumn("_upto", F.col("_before") - F.col("_base") + F.col("_c"))
    pick = {k: F.min(F.when(F.col("_upto") > pos, F.col(value))).alias(k) for k, pos in at.items()}
    return both.groupBy(*by).agg(F.max("n").alias("n"), *pick.values())


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, average, p50 at n // 2, p95 at min(int(0.95 n), n - 1), the two other
    p95 rules in use (int(0.95 n) - 1; the first only from 20 values on, else
    the largest), minimum, maximum and true median."""
    n = F.col("n")
    at = F.floor(n * F.lit(0.95)).cast("long")
    usual, middle = F.least(at, n - 1), F.floor(n / 2).cast("long")
    found = ranked(
        rows, value,
        {"p50": middle, "p95": usual, "p95_below": F.greatest(at - 1, F.lit(0)), "p95_or_max": F.when(n >= 20, usual).otherwise(n - 1), "_low": F.floor((n - 1) / 2).cast("long")}, by,
    )
    plain = rows.groupBy(*by).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    # the upper middle is what p50 takes
    return found.join(plain, by).withColumn("median", (F.col("_low") + F.col("p50")) / 2).drop("_low")


def hit_rate(rows: DataFrame, hit: Column, by: list[str], digits: int = 3) -> DataFrame:
    """hits / (hits + misses), rounded, 0 where there was neither."""
    return rows.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses")).withColumn("hit_rate", F.round(ratio(F.col("hits"), F.col("hits") + F.col("misses")), digits))


def lift(base: Column, expanded: Column) -> Column:
    """Relative gain; infinite from nothing, 0 from nothing to nothing."""
    return F.when(base > 0, (expanded - base) / base).when(expanded > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def rollup_status(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """up if all parts are, down if all are, else degraded."""
    up, down = F.bool_and(F.col(status) == "up"), F.bool_and(F.col(status) == "down")
    return rows.groupBy(*by).agg(F.when(up, "up").when(down, "down").otherwise("degraded").alias("status"))


def throughput(rows: DataFrame, amount: str, start: str, end: str, by: list[str]) -> DataFrame:
    """Total amount over the wall time from the first start to the last end."""
    second = lambda c: F.col(c).cast("timestamp").cast("double")
    wall = F.max(second(end)) - F.min(second(start))
    return rows.groupBy(*by).agg(F.sum(amount).alias("total"), wall.alias("wall")).withColumn("throughput", ratio(F.col("total"), F.col("wall")))


def speedup(first: Column, second: Column) -> Column:
    """By how many percent the second is less than the first; 0 from nothing."""
    return F.when(first > 0, (first - second) / first * 100).otherwise(F.lit(0.0))


def soak(rows: DataFrame, by: list[str], outcome: str, level: str, order: Column, most: float) -> DataFrame:
    """Verdicts on a long run: (by, ok, errors, timeouts, peak, no_deadlock,
    no_leak). ``outcome`` is ok, error or timeout; the run hangs if anything timed
    out, and leaks if ``level`` grew by ``most`` or more from its first value to
    its last by ``order``. Fewer than two values leak nothing."""
    has = F.when(F.col(level).isNotNull(), order)
    grown = F.max_by(level, has) - F.min_by(level, has)
    n = lambda kind: F.count_if(F.col(outcome) == kind)
    return rows.groupBy(*by).agg(
        n("ok").alias("ok"), n("error").alias("errors"), n("timeout").alias("timeouts"), F.max(level).alias("peak"),
        (n("timeout") == 0).alias("no_deadlock"), ((F.count(level) < 2) | (grown < most)).alias("no_leak"),
    )


def baseline(scores: DataFrame, label: str, score: str) -> DataFrame:
    """(label, baseline): a label's mean score over all calibration rows."""
    return scores.groupBy(label).agg(F.avg(score).alias("baseline"))


def field_accuracies(rows: DataFrame, fields: dict[str, tuple[Column, Column]], latency: Column | None = None) -> DataFrame:
    """One row: n, for each field the share of rows in which what was extracted
    equals the truth (null equals null), ``all_fields`` for all of them together,
    and the mean latency. Shares are 0 where there are no rows."""
    same = {name: truth.eqNullSafe(found).cast("int") for name, (truth, found) in fields.items()}
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    every = F.least(*same.values()) if len(same) > 1 else next(iter(same.values()))
    out = [F.count("*").alias("n"), *(share(c).alias(name) for name, c in same.items()), share(every).alias("all_fields")]
    return rows.agg(*out, *([F.avg(latency).alias("avg_latency")] if latency is not None else []))

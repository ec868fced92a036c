"""As-of and interval joins. Spark's DataFrames have no as-of join.

As-of: both sides are put in one order by key and time and range-sorted, so that a
key may be spread over any number of tasks. Inside a range a row of the left side
takes the last row of the right side before it; where a range has none before it,
the last of the ranges before is carried over, one row a range.

Intervals: an interval is entered in every bin that it touches, a point falls into
one; they meet by key and bin and are then compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.order import in_order


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: list[str], tie: str | None = None, strict: bool = False, within: float | None = None) -> DataFrame:
    """All rows and columns of ``left``, with the columns ``value`` of the row of
    ``right`` that has the same key and the latest time not after that of the left
    row (``strict``: before it), null where there is none. Both sides name their
    key and time alike.

    Of right rows with equal key and time the one with the largest ``tie`` counts,
    null last; it must be given where such rows may differ. ``within``: seconds
    beyond which a row is too old. Rows of ``left`` whose key or time is null have
    no match; such rows of ``right`` are left out. Repeated rows of ``left`` stay.
    The order is written while the result is built.
    """
    other = [c for c in left.columns if c not in (key, time)]
    null = lambda f: F.lit(None).cast(f.dataType)
    left_part = F.struct(*(F.col(c) for c in other)) if other else F.struct(F.lit(1).alias("_"))
    taken = F.struct(F.col(time).alias("_at"), *(F.col(c) for c in value))
    sides = lambda df, side, own, found, rank: df.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(side).alias("_side"), rank.alias("_rank"), own.alias("_own"), found.alias("_found"))
    own_kind, found_kind = left.select(left_part.alias("x")).schema[0], right.select(taken.alias("x")).schema[0]
    rank = F.col(tie) if tie else F.lit(0)
    no_rank = null(right.select(rank.alias("x")).schema[0])
    # at equal times right rows come first, or last where only earlier ones count
    rows = sides(right.where(F.col(key).isNotNull() & F.col(time).isNotNull()), 2 if strict else 0, null(own_kind), taken, rank)
    rows = rows.unionByName(sides(left, 1, left_part, null(found_kind), no_rank))

    ranged = in_order(rows, ["_key", "_time", "_side", "_rank"])
    # the last right row inside the range, with its key
    held = F.when(F.col("_found").isNotNull(), F.struct("_key", "_found"))
    inside = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0)
    carried = ranged.groupBy("_part").agg(F.max_by(F.struct("_key", "_found"), F.when(F.col("_found").isNotNull(), F.col("_nth"))).alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("_part", F.last("_last", ignorenulls=True).over(before).alias("_prior"))
    met = ranged.withColumn("_here", F.last(held, ignorenulls=True).over(inside)).join(carried, "_part").where("_side = 1")
    last = F.coalesce("_here", "_prior")
    fits = F.col("_key").isNotNull() & F.col("_time").isNotNull() & (last["_key"] == F.col("_key"))
    if within is not None:
        fits = fits & (F.col("_time").cast("double") - last["_found"]["_at"].cast("double") <= within)
    columns = [F.col("_key").alias(key), F.col("_time").alias(time), *(F.col(f"_own.{c}").alias(c) for c in other)]
    return met.select(*columns, *(F.when(fits, last["_found"][c]).alias(c) for c in value))


def in_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Each pair of a point and an interval of the same key with start <= at < end:
    the columns of both, the key once.

    Times are timestamps or numbers; ``width`` is that of a bin, in seconds or
    units, best about the usual length of an interval: one is entered in length /
    width + 1 bins. Rows with a null key or bound meet nothing, nor do intervals
    that end at or before their start. A key is spread over its bins.
    """
    number = lambda c: F.col(c).cast("double")
    bin_ = lambda c: F.floor(c / F.lit(float(width)))
    open_ = intervals.where((F.col(start) < F.col(end)) & F.col(key).isNotNull())
    entered = open_.withColumn("_bin", F.explode(F.sequence(bin_(number(start)), bin_(number(end)))))
    placed = points.where(F.col(at).isNotNull()).withColumn("_bin", bin_(number(at)))
    met = placed.join(entered, [key, "_bin"])
    return met.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin")


def overlapping(a: DataFrame, b: DataFrame, key: str, spans: tuple[str, str, str, str], width: float) -> DataFrame:
    """Each pair of intervals of the same key that share time, once, however many
    bins they share: that of the later start counts. ``spans``: the start and end
    columns of ``a``, then of ``b``. Otherwise as ``in_intervals``."""
    a0, a1, b0, b1 = spans
    number = lambda c: F.col(c).cast("double")
    bin_ = lambda c: F.floor(c / F.lit(float(width)))

    def entered(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.where((F.col(s) < F.col(e)) & F.col(key).isNotNull()).withColumn("_bin", F.explode(F.sequence(bin_(number(s)), bin_(number(e)))))

    def later(x: str, y: str) -> Column:
        return F.greatest(number(x), number(y))

    met = entered(a, a0, a1).join(entered(b, b0, b1), [key, "_bin"])
    return met.where((F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1)) & (F.col("_bin") == bin_(later(a0, b0)))).drop("_bin")

"""Global order without a single task: rows are range-sorted and written, then
numbered and summed within each range, with what comes before it added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut

_SHIFT = 33  # monotonically_increasing_id: partition above, row in it below


def in_order(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """``rows`` range-sorted and written, with _part (the number of the range)
    and _nth (the row's place in it, from 0). ``order`` should be total: how ties
    fall is settled by the writing, once for all later uses."""
    seq = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_seq", seq)
    written = cut(ranges, "ordered")
    low = (1 << _SHIFT) - 1
    return written.withColumns({"_part": F.shiftright("_seq", _SHIFT).cast("int"), "_nth": F.col("_seq").bitwiseAND(F.lit(low))}).drop("_seq")


def _offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What comes before each range: one row a range, summed up in one task."""
    per = rows.groupBy("_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))


def numbered(rows: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """``rows`` with their number in the global order, from 0."""
    ranged = in_order(rows, order)
    at = _offsets(ranged, {"rows": F.lit(1)})
    return ranged.join(at, "_part").withColumn(name, F.col("_off_rows") + F.col("_nth")).drop("_part", "_nth", "_off_rows")


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum over all rows before in the
    global order."""
    ranged = in_order(rows, order)
    inside = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(_offsets(ranged, sums), "_part")
    found = found.withColumns({n: F.col(f"_off_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    return found.drop("_part", "_nth", *(f"_off_{n}" for n in sums))


def previous(rows: DataFrame, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``value`` of the row before in the global order, null for
    the first: a range's first row takes it from the last of the range before."""
    ranged = in_order(rows.withColumn("_value", value), order)
    inside = Window.partitionBy("_part").orderBy("_nth")
    last = ranged.groupBy("_part").agg(F.max_by("_value", "_nth").alias("_last"))
    last = last.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_prior"))
    found = ranged.join(last, "_part").withColumn(name, F.when(F.col("_nth") == 0, F.col("_prior")).otherwise(F.lag("_value").over(inside)))
    return found.drop("_part", "_nth", "_value", "_prior")

"""A stated query set against all rows: one block of bounded size goes to the
rows, a larger set meets them in tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lineage import cut

#: Rows, and bytes or elements of what is weighed, of a query set that a task holds at once.
QUERY_BLOCK = 2_000
BLOCK_WEIGHT = 16 << 20
#: Rows, their bytes, and the rows of an Arrow batch that a block of queries meets in one task.
TILE_ROWS = 200_000
TILE_BYTES = 64 << 20
BATCH_ROWS = 10_000

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def by_block(queries: DataFrame, rows: DataFrame, meet: Callable[[pa.Table], Run], out: str, size: int = QUERY_BLOCK, weight: Column | None = None, most: int = BLOCK_WEIGHT) -> DataFrame:
    """What ``meet(block)`` makes of the batches of ``rows``, as the columns
    ``out``, for blocks that make up ``queries``, each of about ``size`` rows and
    about ``most`` in all of ``weight`` (a row's length).

    A query set of one block goes to the tasks as it is, and rows stay where they
    lie. A larger one never reaches the driver and costs no scan a block: both
    sides are written, dealt into blocks and tiles by where they were written,
    so that equal rows are no hot spot, and each pair of a block and a tile is
    one group of bounded size. Rows are shuffled once a block, queries once a
    tile. An empty query set or table gives no rows.
    """
    n, total = queries.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if weight is None else weight), F.lit(0))).first()
    blocks = max(1, -(-n // size), -(-int(total) // most))
    if blocks == 1:
        return rows.mapInArrow(meet(queries.toArrow()), out)
    queries, rows = cut(queries, "queries"), cut(rows, "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(_bytes(rows)), F.lit(0))).first()
    tiles = max(1, -(-n // TILE_ROWS), -(-int(total) // TILE_BYTES))
    asked = _dealt(queries, "block", blocks, "tile", tiles)
    held = _dealt(rows, "tile", tiles, "block", blocks)
    kinds = rows.sparkSession.createDataFrame([], out).toArrow().schema
    return asked.groupBy("block", "tile").cogroup(held.groupBy("block", "tile")).applyInArrow(_pair(meet, queries.columns, rows.columns, kinds), out)


def _dealt(df: DataFrame, own: str, n: int, other: str, times: int) -> DataFrame:
    """``df``, a written table, in ``n`` even parts, each ``times`` times over."""
    at = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    return df.withColumn(own, at).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def _pair(meet: Callable[[pa.Table], Run], asked_columns: list[str], held_columns: list[str], kinds: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return kinds.empty_table()
        batches = held.select(held_columns).to_batches(max_chunksize=BATCH_ROWS)
        found = [pa.Table.from_batches([b]).cast(kinds) for b in meet(asked.select(asked_columns))(iter(batches))]
        return pa.concat_tables([kinds.empty_table(), *found])

    return run


def _bytes(df: DataFrame) -> Column:
    """About how much memory a row of ``df`` takes."""

    def one(kind: T.DataType, col: Column) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(col), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(col, " ")) + 8 * F.size(col), F.lit(0)) + 8
        if isinstance(kind, T.ArrayType):
            return 8 * F.coalesce(F.size(col), F.lit(0)) + 8
        return F.lit(8)

    return sum((one(f.dataType, F.col(f.name)) for f in df.schema), F.lit(0))

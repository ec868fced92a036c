"""A stored table with keys, merged into by copy-on-write of hash buckets.

Rows lie in buckets by a hash of their key, a folder each. A merge reads the buckets
that its rows touch, writes them anew and puts a snapshot into the log that names
the new folders and, for all other buckets, the old ones. Readers see one snapshot;
a merge that loses the race for its number starts again from the winner's. This is
how nodes and edges of a graph are stored: node properties are set, edges are added
and never go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.commits import LOG, Folder

BUCKETS = 64


class KeyedTable(Folder):
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
        """``buckets`` is settled by the first merge."""
        super().__init__(spark, path)
        self.keys, self.buckets = keys, buckets

    def _snapshot(self) -> tuple[int, dict]:
        log = self.commits()
        return (log[-1].seq, log[-1].more) if log else (0, {"buckets": self.buckets, "schema": None, "folders": {}})

    def _rows(self, state: dict, only: list[int] | None = None) -> DataFrame | None:
        folders = [f for b, f in sorted(state["folders"].items()) if only is None or int(b) in only]
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(state["schema"])).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """All rows of the last snapshot; ValueError where nothing was merged yet."""
        state = self._snapshot()[1]
        if state["schema"] is None:
            raise ValueError(f"nothing is stored at {self.path}")
        found = self._rows(state)
        return self.spark.createDataFrame([], StructType.fromJson(state["schema"])) if found is None else found

    def folders(self) -> dict[int, str]:
        """The folder of each bucket that holds rows."""
        return {int(b): f for b, f in self._snapshot()[1]["folders"].items()}

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def merge(self, rows: DataFrame, order: list[str] | None = None, batch: str | None = None) -> int | None:
        """Store ``rows``: new keys are added, the columns that ``rows`` has are set
        on those that are there, other columns stay. Of rows with the same key the
        largest in ``order`` counts (all columns in turn, where it is not given);
        rows with a null in their key are left out. The number of the snapshot, or
        None where ``batch`` was merged already.

        Null values are values: they are set like others. Columns that are new to
        the table are null in older rows. No rows make a snapshot without change.
        """
        rest = [c for c in rows.columns if c not in self.keys]
        kept = rows.dropna(subset=self.keys)
        if rest:
            best = kept.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*(order or rest))).alias("_new"))
        else:
            best = kept.select(*self.keys).distinct()
        while True:
            seq, state = self._snapshot()
            if batch is not None and any(c.batch == batch for c in self.commits()):
                return None
            n = state["buckets"]
            touched = sorted(r[0] for r in kept.select(self._bucket(n).alias("b")).distinct().collect())  # numbers below n
            held = {f.name: f for f in (StructType.fromJson(state["schema"]) if state["schema"] else StructType([]))}
            schema = StructType([rows.schema[c] for c in self.keys] + [held[c] for c in held if c not in self.keys] + [rows.schema[c] for c in rest if c not in held])
            for f in schema:
                f.nullable = True
            old = self._rows(state, touched)
            columns = [f.name for f in schema if f.name not in self.keys]
            new = best.select(*self.keys, *([F.col("_new")] if rest else []), F.lit(True).alias("_is_new"))
            if old is None:
                both = new.select(*self.keys, *(F.col(f"_new.{c}").alias(c) if c in rest else F.lit(None).cast(schema[c].dataType).alias(c) for c in columns))
            else:
                both = old.join(new, self.keys, "full").select(*self.keys, *(self._set(c, c in rest, c in held).cast(schema[c].dataType).alias(c) for c in columns))
            name = f"data-{uuid.uuid4().hex}"
            placed = both.withColumn("_bucket", self._bucket(n))
            placed.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
            now = dict(state["folders"]) | {str(b): f"{name}/_bucket={b}" for b in touched}
            self._fs.mkdirs(self._at(LOG))
            if self._put(seq + 1, {"folder": name, "batch": batch, "more": {"buckets": n, "schema": schema.jsonValue(), "folders": now}}):
                return seq + 1
            self._fs.delete(self._at(name), True)

    @staticmethod
    def _set(column: str, given: bool, held: bool) -> Column:
        if given and held:
            return F.when(F.col("_is_new"), F.col(f"_new.{column}")).otherwise(F.col(column))
        return F.col(f"_new.{column}") if given else F.col(column)


def merge_graph(nodes: KeyedTable, edges: KeyedTable, rows: DataFrame, node: str, group: str, batch: str | None = None) -> None:
    """One load of items that belong to groups: the items' properties are set, and
    an edge to each group is added; edges of earlier loads stay. A load that broke
    off between the two and is run again under its ``batch`` is completed."""
    nodes.merge(rows.drop(group).dropDuplicates(), batch=batch)
    edges.merge(rows.select(F.col(node).alias("src"), F.col(group).alias("dst")).distinct(), batch=batch)


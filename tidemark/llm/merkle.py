"""A Merkle manifest of a dataset: a tree a source, and one over the sources.

A row's digest (SHA-256 as hexadecimal text) is a leaf. Leaves of a source are put
in the order of their ids by a range sort and dealt to aligned blocks of 4,096.
In a block the digests are one contiguous numpy matrix of 64 bytes a row: each
level is the matrix reshaped by the fanout and hashed row by row, and siblings are
gathered by index arithmetic. Nodes of blocks are the leaves of the next stage,
so no source, however large, is one task. Subroots are the leaves of a last tree
of the same kind. On the way down each block gets the siblings above it, from
which every leaf's proof and its recomputed root follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.plans.order import in_order, numbered

FANOUT = 16
#: Levels inside a block, which so has 16^3 leaves.
LEVELS = 3
_HEX = 64
_UP = "array<struct<siblings:binary,slot:int>>"


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields in turn: ``-`` for null, else the number of UTF-8
    bytes, ``:`` and the value; whole numbers are decimal."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(one(c) for c in fields)).cast("binary"), 256)


def _hash(parts) -> bytes:
    return sha256(parts).hexdigest().encode()


def matrices(leaves: np.ndarray, levels: int | None) -> list[np.ndarray]:
    """The levels of a tree from its leaves (n x 64 bytes) up: ``levels`` more of
    them or, where None, all up to a single node."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        m = out[-1]
        full = len(m) // FANOUT * FANOUT
        runs = m[:full].reshape(-1, FANOUT * _HEX)
        hashed = [_hash(r) for r in runs]
        if full < len(m):
            hashed.append(_hash(m[full:].reshape(-1)))
        out.append(np.frombuffer(b"".join(hashed), np.uint8).reshape(-1, _HEX))
    return out


def siblings(m: np.ndarray) -> list[bytes]:
    """For every node of a level the digests of the others of its run, in order."""
    full = len(m) // FANOUT * FANOUT
    at = np.arange(full)
    others = np.arange(FANOUT - 1)[None, :]
    gathered = m[(at - at % FANOUT)[:, None] + others + (others >= (at % FANOUT)[:, None])].reshape(full, (FANOUT - 1) * _HEX)
    out = [r.tobytes() for r in gathered]
    last = m[full:]
    return out + [np.delete(last, i, 0).tobytes() for i in range(len(last))]


def _levels(n: int, levels: int) -> int | None:
    """A block of a tree of n leaves ends at a level where all blocks have one
    node, the whole tree where it is a single block."""
    return levels if n > FANOUT**levels else None


def _packed(height: int):
    """One row for the rows of a block: its digests in order, its node, and the
    other columns as lists."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        digests = b"".join(table["digest"].to_pylist())
        n = table["n"][0].as_py()
        node = matrices(np.frombuffer(digests, np.uint8).reshape(-1, _HEX), _levels(n, height))[-1].tobytes()
        rest = {c: pa.array([table[c].to_pylist()], pa.list_(table.schema.field(c).type)) for c in table.column_names if c not in ("tree", "block", "n", "pos", "digest")}
        return pa.table({"tree": table["tree"][:1], "block": table["block"][:1], "n": table["n"][:1], "digests": pa.array([digests], pa.binary()), "node": pa.array([node], pa.binary()), **rest})

    return run


def _climb(rows: DataFrame, most: int, name: str, height: int) -> list[DataFrame]:
    """Stages of packed blocks, the bottom one first, from (tree, pos, n, digest,
    more); ``most`` is the largest n. The last stage has one block a tree."""
    stages: list[DataFrame] = []
    block = FANOUT**height
    while True:
        more = [f for f in rows.schema if f.name not in ("tree", "pos", "n", "digest")]
        schema = ", ".join(["tree string", "block long", "n long", "digests binary", "node binary", *(f"{f.name} array<{f.dataType.simpleString()}>" for f in more)])
        blocks = rows.withColumn("digest", F.col("digest").cast("binary")).withColumn("block", F.floor(F.col("pos") / block))
        stages.append(cut(blocks.groupBy("tree", "block").applyInArrow(_packed(height), schema), f"{name}{len(stages)}"))
        if most <= block:
            return stages
        most = -(-most // block)
        rows = stages[-1].select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / block).alias("n"), F.col("node").alias("digest"))


def _paths(block: dict, height: int) -> tuple[list[list[bytes]], int]:
    """The siblings of all nodes of each level below the block's node, and how
    many leaves it has."""
    leaves = np.frombuffer(block["digests"], np.uint8).reshape(-1, _HEX)
    return [siblings(m) for m in matrices(leaves, _levels(block["n"], height))[:-1]], len(leaves)


def _spread(height: int):
    """What lies above each leaf of a block: the block's levels, then what lies
    above the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("up").type
            for block in batch.to_pylist():
                levels, n = _paths(block, height)
                ups = [[{"siblings": s[i // FANOUT**k], "slot": i // FANOUT**k % FANOUT} for k, s in enumerate(levels)] + block["up"] for i in range(n)]
                yield pa.RecordBatch.from_pydict({"tree": [block["tree"]] * n, "block": [block["block"] * FANOUT**height + i for i in range(n)], "up": pa.array(ups, kind)})

    return run


def _descend(stages: list[DataFrame], up: DataFrame, height: int) -> DataFrame:
    """(tree, block, up) for the leaves of the lowest of ``stages``, from those of
    the block of the highest."""
    for stage in reversed(stages):
        up = stage.join(up, ["tree", "block"]).select("tree", "block", "n", "digests", "up").mapInArrow(_spread(height), f"tree string, block long, up {_UP}")
    return up


def _folded(root: bytes, height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("id").type.value_type
            for block in batch.to_pylist():
                levels, n = _paths(block, height)
                above, upper = b"".join(u["siblings"] for u in block["up"]), [(u["siblings"], u["slot"] * _HEX) for u in block["up"]]
                proofs, folded = [], []
                for i in range(n):
                    own = [(s[i // FANOUT**k], i // FANOUT**k % FANOUT * _HEX) for k, s in enumerate(levels)]
                    proofs.append(sha256(b"".join([s for s, _ in own] + [above])).hexdigest())
                    d = block["now"][i]
                    d = block["digests"][i * _HEX : (i + 1) * _HEX] if d is None else d.encode()
                    for s, slot in own + upper:
                        d = _hash(s[:slot] + d + s[slot:])
                    folded.append(d.decode())
                leaves = block["digests"].decode()
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(block["id"], kind), "tree": [block["tree"]] * n, "leaf": [leaves[i * _HEX : (i + 1) * _HEX] for i in range(n)],
                    "subroot": [block["subroot"].decode()] * n, "root": [root.decode()] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [d == root.decode() for d in folded],
                })

    return run


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id", source: str = "source", now: dict[str, Column] | None = None, when: Column | None = None, height: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, source, leaf, subroot, root, proof_sha256
    (of the siblings' digests, from the leaf to the root, left to right),
    folded_root (recomputed from the row as it is ``now`` and the siblings), and
    verified (whether that is the root).

    ``now`` replaces columns in the rows where ``when`` is true: what the check is
    to find. Null fields have a digest like any other value; null sources form one
    tree, the first; null ids come first in theirs, and rows equal in source and
    id are ordered by digest, so that repeated rows are leaves of their own. An
    empty text differs from a null one; a very long one is one row, hashed without
    Python. A lone leaf is its source's subroot, a lone subroot the root. An empty
    table gives none; columns other than ``fields``, id and source are ignored.
    ``height``: levels inside a block. Jobs run while the result is built: the
    order and a packed row a block are written to the shared folder.
    """
    spark = docs.sparkSession
    held = {c: F.col(c) for c in fields}
    other = digest_of([(now or {}).get(c, held[c]) for c in fields])
    changed = F.lit(False) if when is None or not now else F.coalesce(when, F.lit(False))
    tree = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = docs.select(F.col(id).alias("id"), tree.alias("tree"), digest_of(list(held.values())).alias("digest"), F.when(changed, other).alias("now"))
    ranged = in_order(rows, ["tree", "id", "digest"])

    per = ranged.groupBy("_part", "tree").agg(F.count("*").alias("rows"), F.min("_nth").alias("low"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.select("_part", "tree", "low", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n")), "places")
    most = per.agg(F.max("n")).first()[0]
    out_kind = docs.schema[id].dataType.simpleString()
    if most is None:
        none = spark.createDataFrame([], f"{id} {out_kind}, {source} string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
        return none
    placed = ranged.join(per, ["_part", "tree"]).select("tree", (F.col("before") + F.col("_nth") - F.col("low")).alias("pos"), "n", "digest", "id", "now")
    stages = _climb(placed, most, "leaves", height)

    subroots = numbered(stages[-1].select("tree", "node"), ["tree"], "pos")
    count = subroots.count()
    top = _climb(subroots.select(F.lit("").alias("tree"), "pos", F.lit(count).cast("long").alias("n"), F.col("node").alias("digest")), count, "subroots", height)
    root = bytes(top[-1].first()["node"])

    nothing = spark.createDataFrame([("", 0, [])], f"tree string, block long, up {_UP}")
    above = _descend(top, nothing, height).withColumnRenamed("block", "pos").drop("tree")
    above = cut(subroots.join(above, "pos").select("tree", F.lit(0).cast("long").alias("block"), "up", F.col("node").alias("subroot")), "above")
    up = _descend(stages[1:], above.drop("subroot"), height)
    found = stages[0].join(up, ["tree", "block"]).join(above.select("tree", "subroot"), "tree")
    out = found.select("tree", "n", "digests", "id", "now", "up", "subroot").mapInArrow(
        _folded(root, height), f"id {out_kind}, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    named = F.when(F.col("tree") != "n", F.substr("tree", F.lit(2)))
    return out.select(F.col("id").alias(id), named.alias(source), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")

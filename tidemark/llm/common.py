"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import cut, drop, shared_dir

__all__ = ["WORD", "bit_filter", "body", "cut", "drop", "may_hold", "read", "shared_dir", "word_count"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def body(col: str | Column) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def word_count(col: str | Column) -> Column:
    """Number of words of a text, 0 for null, without Python."""
    c = F.col(col) if isinstance(col, str) else col
    plain = F.translate(F.coalesce(c, F.lit("")), "\t\n\u000b\f\r", "     ")
    return F.size(F.array_remove(F.split(plain, " "), "")).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bits of a filter that every task gets (4 MB), whatever it is made from.
FILTER_BITS = 1 << 25
#: The bits of a hash are those that it names from each of these places on.
SHIFTS = (0, 31)
_BUCKET = 1 << 15  # bits of one row of bitmap_construct_agg


def bit_filter(rows: DataFrame, hash: str) -> np.ndarray:
    """A filter of fixed size over a column of hashes (longs), made by partial
    aggregation. A fuller one lets more through, never less."""
    slots = F.explode(F.array(*(F.shiftright(hash, n).bitwiseAND(F.lit(FILTER_BITS - 1)) for n in SHIFTS)))
    slot = F.col("slot")
    parts = rows.select(slots.alias("slot")).groupBy(F.shiftright(slot, 15).alias("bucket")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(_BUCKET - 1))).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in parts.collect():  # FILTER_BITS in all
        bits[r["bucket"] * (_BUCKET // 8) : (r["bucket"] + 1) * (_BUCKET // 8)] = np.frombuffer(r["bits"], np.uint8)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) are in the filter, or look as if they were."""
    found = np.ones(len(hashes), bool)
    for n in SHIFTS:
        slot = (hashes >> np.uint64(n)) & np.uint64(len(bits) * 8 - 1)
        found &= (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found

"""The pipeline's stages: (spark, docs, sf_dir) -> documents that go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, quality, secrets, simhash
from tidemark.llm.common import body, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, their texts without the failed
    lines and n_chars counted anew. The verdict is taken where the row is, so
    nothing is shuffled. Rows with null or empty texts go; a very long text is one
    row's work; repeated rows go or stay together; an empty table gives none."""
    clean = quality.line_first(docs, keep=COLUMNS).where("kept").select(*(c for c in COLUMNS if c != "text"), F.col("clean_text").alias("text"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their
    five-word shingles: that with the smallest id (nulls last); of rows that share
    it, the one with the least hash. Null and empty texts are one group; a very
    long text is one row's work; repeated rows leave one; an empty table gives none."""
    rows = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("h1"), F.xxhash64(F.lit(1), *COLUMNS).alias("h2"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    found = simhash.near_copies(rows.select(place.alias("place"), "text"), id="place")
    first = found.groupBy("component").agg(F.min("place").alias("p")).select("p.h1", "p.h2")
    kept = rows.join(first.hint("shuffle_hash"), ["h1", "h2"])
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("h1"))  # rows equal in everything share a place
    return kept.withColumn("nth", nth).where("nth = 1").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to 0.8 or more. Null and empty
    texts stay; repeated rows go or stay together; without items all stay."""
    found = decontam.covered(docs, read(spark, sf_dir, "benchmark")).select("key")
    rows = docs.select(*COLUMNS, F.md5(body("text")).alias("key"))
    return rows.join(found, "key", "left_anti").select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found in their texts masked. Null and
    empty texts stay as they are; a very long text takes time in proportion to its
    length; copies and repeated rows are scanned once and masked alike; an empty
    table gives none."""
    paths, findings, _ = secrets.scan(docs)
    rows = docs.select(*COLUMNS, secrets.blob_of("text").alias("blob")).join(findings.hint("shuffle_hash"), "blob", "left")
    spans = F.coalesce("spans", F.lit([]).cast(findings.schema["spans"].dataType))
    masked = rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), spans)))
    return masked.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per served copy, sorted by virtual finish time: doc_id,
    source, size, target, pass, v_finish, served (its words in the mix). Null and
    empty texts take no part; null sources are one source; repeated rows are
    served one after another; an empty table gives an empty mix."""
    stream = mixing.mix_stream(mixing.fair_queue(docs))
    return stream.select("doc_id", "source", "size", "target", F.col("pass").cast("long").alias("pass"), F.round("v_finish", 9).alias("v_finish"), "served")

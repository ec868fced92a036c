"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, only where that is unset, a folder of this
    machine (local mode) or of the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tidemark"


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder under the shared one, gone when the application ends."""
    root = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{root}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there,
    a lost executor costs no recomputation, and later plans know its size. The
    table goes when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing will read again."""
    spark = table.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""Watching a folder: new files are read once and handed to the right loader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def route(path: Column) -> Column:
    """menu, faq, document or skip, by the whole path; the order matters."""
    p = F.lower(path)
    kind = F.lower(F.substring_index(path, ".", -1))
    return (
        F.when((kind == "csv") & p.contains("menu"), "menu")
        .when((kind == "csv") & p.contains("faq"), "faq")
        .when(kind.isin("txt", "md", "pdf", "docx"), "document")
        .otherwise("skip")
    )


def watch(spark: SparkSession, folder: str, checkpoint: str, load: Callable[[DataFrame, str, str], object], once: bool = True) -> StreamingQuery:
    """Start a stream over ``folder``: each micro-batch calls ``load(files, kind,
    batch)`` for each kind it holds, files being (path, content). Progress is in
    ``checkpoint``, so a restart goes on after the last batch; one that was loaded
    but not yet marked as done is run again under the same name ``batch``, by
    which a sink with a log (``sources.commits``) knows it."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def batch(df: DataFrame, n: int) -> None:
        routed = df.select("path", "content", route(F.col("path")).alias("kind")).where("kind <> 'skip'")
        for kind in ("menu", "faq", "document"):
            part = routed.where(F.col("kind") == kind)
            if not part.isEmpty():
                load(part.select("path", "content"), kind, f"{checkpoint}/{n}/{kind}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

"""Server-sent events as rows, in batch and as streams.

A response is a body of blocks or, on a stream, its blocks one by one. Streams go
through Spark's file source and sink: the sink's log makes each block count once,
the source's offsets let a restart go on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DONE = "[DONE]"


def decode(block: Column) -> Column:
    """(event, data) of a block: the first event's line and all data lines,
    joined by line breaks; null where there is none, or nothing in it."""
    event = F.regexp_extract(block, "(?m)^event: ?(.*)$", 1)
    data = F.array_join(F.regexp_extract_all(block, F.lit("(?m)^data: ?(.*)$"), F.lit(1)), "\n")
    return F.struct(F.nullif(event, F.lit("")).alias("event"), F.nullif(data, F.lit("")).alias("data"))


def parse(raw: DataFrame, id: str = "request_id", body: str = "body") -> DataFrame:
    """(id, seq, event, data) for each block of a response; blocks are parted by
    blank lines and hold event: and data: lines. Nothing after the sentinel. A
    row is one response, so this is narrow and runs on streams as well."""
    blocks = F.filter(F.split(F.col(body), "\n\n"), lambda x: F.trim(x) != "")
    rows = raw.select(id, F.transform(blocks, decode).alias("blocks"))
    stop = F.array_position(F.transform("blocks", lambda x: F.coalesce(x["data"], F.lit(""))), DONE)
    rows = rows.select(id, F.when(stop > 0, F.slice("blocks", 1, stop.cast("int"))).otherwise(F.col("blocks")).alias("blocks"))
    return rows.select(id, F.posexplode("blocks").alias("seq", "block")).select(id, "seq", "block.event", "block.data")


def send(events: DataFrame, folder: str, checkpoint: str, id: str = "request_id", once: bool = True) -> StreamingQuery:
    """Start a stream that writes ``events`` (id, seq, event, data) to ``folder``
    as blocks, each once, whatever is restarted under the same ``checkpoint``."""
    blocks = events.select(id, "seq", encode(F.col("event"), F.coalesce("data", F.lit(""))).alias("block"))
    writer = blocks.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def receive(spark: SparkSession, folder: str, kinds: str = "request_id string, seq long", stream: bool = True, files: int = 1000) -> DataFrame:
    """(id, seq, event, data) of the blocks that ``send`` wrote, whose first
    columns have ``kinds``; as a stream, at most ``files`` files a batch."""
    schema = f"{kinds}, block string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder) if stream else spark.read.schema(schema).parquet(folder)
    head = raw.columns[:-1]
    return raw.select(*head, decode(F.col("block")).alias("block")).select(*head, "block.event", "block.data")


def deltas(events: DataFrame, id: str = "request_id") -> DataFrame:
    """(id, seq, token) of OpenAI-style data rows; the sentinel is left out
    before anything is parsed as JSON."""
    data = events.where(F.col("data") != DONE)
    token = F.coalesce(F.get_json_object("data", "$.choices[0].delta.content"), F.get_json_object("data", "$.delta.content"))
    return data.select(id, "seq", token.alias("token")).where("token is not null")


def encode(event: Column, data: Column) -> Column:
    """A block: the event's line if there is one, the data's, one for each of its
    lines, a blank line."""
    head = F.when(event.isNotNull(), F.concat(F.lit("event: "), event, F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("data: "), F.replace(data, F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n"))


def consistent(events: DataFrame, id: str = "request_id") -> DataFrame:
    """(id, same): whether tokens and clauses spell the same text, white space aside."""
    spelled = lambda kind: F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("event") == kind, F.struct("seq", "sub", "data")))), lambda x: x["data"]), ""), r"(?U)\s+", "")
    return events.groupBy(id).agg((spelled("token") == spelled("clause")).alias("same"))

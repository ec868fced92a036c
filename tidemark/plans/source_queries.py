"""Queries that write a table with each sink and read it back with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.lineage import scratch
from tidemark.plans.registry import Registry, table
from tidemark.sources import files, keyed
from tidemark.streaming import watch

R = Registry()

_MENU = """SELECT p_name || ' "' || p_partkey || '"' AS name, floor(p_retailprice)::int AS price_vnd, p_type AS category, ['S', 'M', 'L'][1 + p_partkey % 3] AS size, p_brand || ', ' || p_size AS ingredients, p_name || chr(10) || p_type AS description FROM part"""


def _menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.element_at(F.array(F.lit("S"), F.lit("M"), F.lit("L")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(
        F.concat("p_name", F.lit(' "'), F.col("p_partkey").cast("string"), F.lit('"')).alias("name"), F.floor("p_retailprice").cast("int").alias("price_vnd"), F.col("p_type").alias("category"),
        size.alias("size"), F.concat_ws(", ", "p_brand", F.col("p_size").cast("string")).alias("ingredients"), F.concat_ws("\n", "p_name", "p_type").alias("description"),
    )


@R.add(_MENU)
def menu_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, commas and line ends inside of fields."""
    path = scratch(spark, "menu.csv")
    files.write_csv(_menu(spark, sf_dir), path)
    return files.read_csv(spark, path, files.MENU)


@R.add("SELECT p_name AS question, p_type AS answer, p_brand AS category FROM part")
def faq_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "faq.csv")
    files.write_csv(table(spark, sf_dir, "part").select(F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.col("p_brand").alias("category")), path)
    return files.read_csv(spark, path, files.FAQ)


@R.add("SELECT text, role AS subject, 'turn ' || turn AS action, '' AS context FROM conversations UNION ALL SELECT text, role, 'again', '' FROM conversations WHERE turn = 1")
def intent_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, appended to, and with a broken line that the reader leaves out."""
    c, path = table(spark, sf_dir, "conversations"), scratch(spark, "intents.jsonl")
    named = lambda action: (F.col("text"), F.col("role").alias("subject"), action.alias("action"), F.lit("").alias("context"))
    files.write_jsonl(c.select(*named(F.concat(F.lit("turn "), F.col("turn").cast("string")))), path)
    files.write_jsonl(c.where("turn = 1").select(*named(F.lit("again"))), path, append=True)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    return files.read_jsonl(spark, path, files.INTENT)


@R.add("SELECT p_partkey::int AS index, p_name AS text, CASE WHEN p_partkey % 3 = 0 THEN 'third' WHEN p_partkey % 2 = 0 THEN 'again' ELSE 'first' END AS judged_label FROM part")
def reviews_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that was appended to after restarts, by many tasks each time: the
    last record of a key counts. One append has two records of each key, one is
    run twice."""
    p, path = table(spark, sf_dir, "part"), scratch(spark, "reviews.jsonl")
    rows = lambda label, where: p.where(where).select(F.col("p_partkey").cast("int").alias("index"), F.col("p_name").alias("text"), F.lit(label).alias("judged_label"))
    files.write_jsonl(rows("early", "true").unionByName(rows("first", "true")).repartition(4, "index").sortWithinPartitions("index", "judged_label"), path)
    files.write_jsonl(rows("again", "p_partkey % 2 = 0"), path, append=True, batch="second")
    files.write_jsonl(rows("third", "p_partkey % 3 = 0"), path, append=True, batch="third")
    files.write_jsonl(rows("again", "p_partkey % 2 = 0"), path, append=True, batch="second")
    return files.read_latest(spark, path, files.REVIEW, "index").select("index", "text", "judged_label")


@R.add("SELECT r_regionkey::bigint AS region, r_name AS name, n AS nations FROM region JOIN (SELECT n_regionkey, list_sort(list(n_name)) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document a row."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    rows = table(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").cast("long").alias("region"), F.col("r_name").alias("name"), "nations")
    path = scratch(spark, "report.json")
    files.write_report(rows, path)
    return spark.read.schema("region long, name string, nations array<string>").json(path)


_FILES = "SELECT doc_id AS id, '## ' || coalesce(source, '') || chr(10) || coalesce(text, '') || chr(10) AS text FROM documents"


def _texts(spark: SparkSession, sf_dir: str) -> str:
    """A folder with text files of many documents each: a file a document is
    500,000 files at 1 GB, whose making and listing takes longer than all else."""
    path = scratch(spark, "texts")
    body = F.concat(F.lit("## "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("doc_id="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    files.write_documents(table(spark, sf_dir, "documents").select(name.alias("name"), body.alias("text")), path)
    return path


def _id(path: str) -> F.Column:
    return F.nullif(F.regexp_extract(path, r"#doc_id=(-?\d+)$", 1), F.lit("")).cast("long").alias("id")


@R.add(_FILES)
def text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_documents(spark, _texts(spark, sf_dir)).select(_id("path"), "text")


@R.add(_FILES)
def watched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files through a stream that watches their folder, started twice:
    a file is loaded once, and so is a batch that is run again."""
    folder, out, progress = _texts(spark, sf_dir), scratch(spark, "loaded"), scratch(spark, "progress")

    def load(found: DataFrame, kind: str, batch: str) -> None:
        for _ in range(2):
            files.append_parquet(files.document_texts(found), f"{out}/{kind}", batch)

    for _ in range(2):
        watch.watch(spark, folder, progress, load).awaitTermination()
    return files.read_appended(spark, f"{out}/document").select(_id("path"), "text")


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[keyed.KeyedTable, keyed.KeyedTable]:
    """Three loads of items, the second the first one run again, the last with
    other prices and groups for a third of the items."""
    path = scratch(spark, "graph")
    nodes, edges = keyed.KeyedTable(spark, f"{path}/nodes", ["item"]), keyed.KeyedTable(spark, f"{path}/edges", ["src", "dst"])
    p = table(spark, sf_dir, "part")
    first = p.select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"))
    moved = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("item"), (F.col("p_retailprice") * 2).alias("price"), F.lit("moved").alias("category"))
    for rows, batch in ((first, "1"), (first, "1"), (moved, "2")):
        keyed.merge_graph(nodes, edges, rows, "item", "category", batch)
    return nodes, edges


@R.add("SELECT p_partkey AS item, p_name AS name, p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS price FROM part")
def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir)[0].read().select("item", "name", "price")


@R.add("SELECT p_partkey AS src, p_type AS dst FROM part UNION SELECT p_partkey, 'moved' FROM part WHERE p_partkey % 3 = 0")
def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to earlier groups stay."""
    return _loaded(spark, sf_dir)[1].read().select("src", "dst")

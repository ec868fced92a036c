"""Queries of vector search, the property graph and entity resolution. Labels
below five are the menu domain of the vectors, the others the chunk domain;
every vector whose id is divisible by 20 is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import similarity
from tidemark.operators import graph, ivf, matching, metrics, sparse, vector
from tidemark.plans.lineage import cut, scratch
from tidemark.plans.registry import Registry, table

R = Registry()

_COS = "round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6)"
_QV = "(SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0) q"
DUAL_SQL = f"""SELECT query_id, kind, node_id, score, CASE kind WHEN 'menu' THEN k ELSE k + 8 END AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, node_id) AS k FROM
(SELECT q.query_id, CASE WHEN label < 5 THEN 'menu' ELSE 'chunk' END AS kind, e.vec_id AS node_id, {_COS} AS score FROM embeddings e, {_QV})) WHERE k <= 8"""


def _queries(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def _nodes(e: DataFrame, where: str = "true") -> DataFrame:
    return e.where(where).select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("vec"))


@R.add(f"SELECT query_id, node_id, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM (SELECT q.query_id, e.vec_id AS node_id, {_COS} AS score FROM embeddings e, {_QV})) WHERE k <= 8")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.top_k(_queries(e), _nodes(e))


_DENSE_SQL = f"SELECT query_id, node_id, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM (SELECT q.query_id, e.vec_id AS node_id, {_COS} AS score FROM embeddings e, {_QV})) WHERE k <= 8"


@R.add(_DENSE_SQL)
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As dense_topk through an inverted-file index: the lists that a query probes,
    then those that may still hold a better row."""
    e = table(spark, sf_dir, "embeddings")
    found = ivf.search(_queries(e), ivf.build(_nodes(e), scratch(spark, "ivf")), exact=True)
    return found.select("query_id", "node_id", "score", "rank")


@R.add(f"SELECT count(*) AS pairs, true AS passed FROM ({_DENSE_SQL})")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index alone, by the probes measured at its building, finds nine
    in ten of the exact neighbours."""
    e = table(spark, sf_dir, "embeddings")
    found = ivf.search(_queries(e), ivf.build(_nodes(e), scratch(spark, "ivf"))).select("query_id", "node_id", F.lit(1).alias("hit"))
    truth = vector.top_k(_queries(e), _nodes(e)).select("query_id", "node_id")
    both = truth.join(found, ["query_id", "node_id"], "left")
    return both.agg(F.count("*").alias("pairs"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("passed"))


@R.add(DUAL_SQL)
def dual_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.dual_domain(_queries(e), _nodes(e, "label < 5"), _nodes(e, "label >= 5"))


@R.add(f"SELECT query_id, kind, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal, node_id) AS rank FROM ({DUAL_SQL}) WHERE score >= 0.25 QUALIFY rank <= 5")
def late_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector.rerank(dual_domain(spark, sf_dir), F.col("score"), 0.25)
    return out.select("query_id", "kind", "node_id", "score", "rank")


NEXT_SQL = "SELECT src, dst FROM (SELECT lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS src, vec_id AS dst FROM embeddings WHERE label >= 5) WHERE src IS NOT NULL"
LINKS_SQL = "SELECT vec_id AS chunk_id, label || ':' || vec_id % 3 AS entity FROM embeddings WHERE label >= 5 UNION SELECT vec_id, 'm' || vec_id % 11 FROM embeddings WHERE label >= 5"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_edges(table(spark, sf_dir, "embeddings").where("label >= 5"), ["label"], ["vec_id"], "vec_id")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    names = F.array(F.concat_ws(":", F.col("label").cast("string"), (i % 3).cast("string")), F.concat(F.lit("m"), (i % 11).cast("string")))
    return graph.mentions(table(spark, sf_dir, "embeddings").where("label >= 5"), names, id="vec_id")


def _expansion_sql(seeds: str, edges: str, links: str) -> str:
    return f"""WITH seeds AS ({seeds}), edges AS ({edges}), links AS ({links}),
adj AS (SELECT query_id, dst AS node_id, 0 AS stage, ordinal AS o, 0 AS way, NULL::bigint AS shared FROM seeds JOIN edges ON src = node_id UNION ALL SELECT query_id, src, 0, ordinal, 1, NULL FROM seeds JOIN edges ON dst = node_id),
met AS (SELECT s.query_id, b.chunk_id AS node_id, count(DISTINCT b.entity) AS shared FROM seeds s JOIN links a ON a.chunk_id = s.node_id JOIN links b ON b.entity = a.entity AND b.chunk_id <> a.chunk_id GROUP BY ALL),
lim AS (SELECT m.*, row_number() OVER (PARTITION BY m.query_id ORDER BY shared DESC, node_id) AS n FROM met m QUALIFY n <= 3 * (SELECT count(*) FROM seeds s WHERE s.query_id = m.query_id)),
found AS (SELECT * FROM adj UNION ALL SELECT query_id, node_id, 1, n, 0, shared FROM lim),
once AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = f.query_id AND s.node_id = f.node_id) QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY stage, o, way) = 1),
expanded AS (SELECT query_id, node_id, CASE stage WHEN 0 THEN 'adjacent' ELSE 'shared_entity' END AS expansion_type, shared, row_number() OVER (PARTITION BY query_id ORDER BY stage, o, way, node_id) AS ordinal FROM once)"""


_SEEDS = f"SELECT query_id, node_id, ordinal FROM ({DUAL_SQL}) WHERE kind = 'chunk'"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_domain(spark, sf_dir).where("kind = 'chunk'").select("query_id", "node_id", "ordinal")


@R.add(_expansion_sql(_SEEDS, NEXT_SQL, LINKS_SQL) + " SELECT * FROM expanded")
def graph_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.expansion(_seeds(spark, sf_dir), _edges(spark, sf_dir), _links(spark, sf_dir))


@R.add(_expansion_sql(_SEEDS, NEXT_SQL, LINKS_SQL) + " SELECT DISTINCT query_id, node_id, way::int AS way FROM adj")
def expansion_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacent(_seeds(spark, sf_dir), _edges(spark, sf_dir)).select("query_id", "node_id", "way").distinct()


@R.add(_expansion_sql(_SEEDS, NEXT_SQL, LINKS_SQL) + " SELECT query_id, node_id, shared, n FROM lim")
def expansion_shared_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sharing(_seeds(spark, sf_dir), _links(spark, sf_dir))


@R.add(
    _expansion_sql(_SEEDS, NEXT_SQL, LINKS_SQL)
    + f""", cand AS (SELECT query_id, kind, node_id, ordinal, false AS via_expansion FROM ({DUAL_SQL}) UNION ALL SELECT query_id, 'chunk', node_id, ordinal + 16, true FROM expanded)
SELECT query_id, kind, node_id, via_expansion, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, ordinal, node_id) AS rank
FROM (SELECT c.*, {_COS} AS s FROM cand c JOIN {_QV} ON q.query_id = c.query_id JOIN embeddings e ON e.vec_id = c.node_id) WHERE s >= 0.2 QUALIFY rank <= 5"""
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two domains, expansion over the graph, cosine as reranker, top five."""
    e = table(spark, sf_dir, "embeddings")
    queries, edges, links = _queries(e), _edges(spark, sf_dir), _links(spark, sf_dir)

    def expand(found: DataFrame) -> DataFrame:
        seeds = found.where("kind = 'chunk'").select("query_id", "node_id", "ordinal")
        got = graph.expansion(seeds, edges, links)
        return got.select("query_id", F.lit("chunk").alias("kind"), "node_id", (F.col("ordinal") + 16).alias("ordinal"), F.lit(True).alias("via_expansion"))

    first = vector.dual_domain(queries, _nodes(e, "label < 5"), _nodes(e, "label >= 5")).drop("score").withColumn("via_expansion", F.lit(False))
    first = cut(first, "found")  # read twice, searched once
    every = first.unionByName(expand(first)).join(_nodes(e), "node_id").join(queries, "query_id")
    out = vector.rerank(every, F.round(similarity.cosine(F.col("query_vec"), F.col("vec")), 6), 0.2)
    return out.select("query_id", "kind", "node_id", "via_expansion", "rerank_score", "rank")


@R.add(
    f"""SELECT d.query_id, CASE WHEN t.node_id IS NULL THEN 'absent' WHEN t.score < 0.25 THEN 'below threshold' ELSE 'found' END AS fate FROM (SELECT DISTINCT query_id FROM ({DUAL_SQL})) d LEFT JOIN ({DUAL_SQL}) t ON t.query_id = d.query_id AND t.node_id = d.query_id + 1"""
)
def target_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(dual_domain(spark, sf_dir), "found")
    targets = found.select("query_id").distinct().withColumn("node_id", F.col("query_id") + 1)
    fate = F.when(F.col("score").isNull(), "absent").when(F.col("score") < 0.25, "below threshold").otherwise("found")
    return targets.join(found.select("query_id", "node_id", "score"), ["query_id", "node_id"], "left").select("query_id", fate.alias("fate"))


@R.add(f"SELECT avg((same > 0)::int) AS precision_at_5 FROM (SELECT d.query_id, count(*) FILTER (a.label = b.label AND d.node_id <> d.query_id) AS same FROM (SELECT * FROM ({DUAL_SQL}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal, node_id) <= 5) d JOIN embeddings a ON a.vec_id = d.query_id JOIN embeddings b ON b.vec_id = d.node_id GROUP BY d.query_id)")
def precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    best = vector.rerank(dual_domain(spark, sf_dir), F.col("score"), -2.0)
    a = kinds.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la"))
    b = kinds.select(F.col("vec_id").alias("node_id"), F.col("label").alias("lb"))
    hits = best.join(a, "query_id").join(b, "node_id").groupBy("query_id").agg(F.count_if((F.col("la") == F.col("lb")) & (F.col("node_id") != F.col("query_id"))).alias("same"))
    return hits.agg(F.avg((F.col("same") > 0).cast("int")).alias("precision_at_5"))


@R.add("SELECT src, dst FROM (SELECT lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS src, p_partkey AS dst FROM part) WHERE src IS NOT NULL")
def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.next_edges(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], "p_partkey")


@R.add(r"SELECT DISTINCT doc_id AS chunk_id, unnest(regexp_extract_all(text, '(^|[^\p{L}])([A-Z][a-z]{3,})', 2)) AS entity FROM documents")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"(^|[^\p{L}])([A-Z][a-z]{3,})"), F.lit(2))
    return graph.mentions(table(spark, sf_dir, "documents"), found, id="doc_id")


@R.add("SELECT DISTINCT p_name AS item, p_type AS category FROM part")
def belongs_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("item"), F.col("p_type").alias("category")).distinct()


_NAMES_SQL = r"""SELECT name, rank, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(name), '[^\p{L}\p{N}_ ]', '', 'g'), '\s+'), lambda x: x <> '')) AS t
FROM (SELECT p_name || ' ' || p_brand || ' ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' new large fresh' ELSE '' END AS name, min(p_partkey) AS rank FROM part GROUP BY 1)"""
_PAIRS_SQL = f"""SELECT a.rank AS a, b.rank AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS score FROM n a JOIN n b ON a.rank < b.rank AND list_has_any(a.t, b.t)
WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.7"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("p_partkey") % 2 == 0, " new large fresh").otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat(F.concat_ws(" ", "p_name", "p_brand", "p_type"), extra).alias("name"))


@R.add(f"WITH n AS ({_NAMES_SQL}) {_PAIRS_SQL}")
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir).groupBy("name").agg(F.min("ordinal").alias("rank"))
    out = graph.similar_names(names, 0.7)
    return out.withColumn("score", F.round("score", 6))


@R.add(
    f"""WITH RECURSIVE n AS ({_NAMES_SQL}), p AS ({_PAIRS_SQL}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT rank AS x, rank AS y FROM n UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y)
SELECT m.name, c.name AS canonical FROM (SELECT x, min(y) AS top FROM reach GROUP BY x) JOIN n m ON m.rank = x JOIN n c ON c.rank = top"""
)
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical_names(_names(spark, sf_dir), 0.7)


@R.add(
    """SELECT q.p_partkey AS query_id, q.query, n.name FROM (SELECT p_partkey, CASE WHEN p_partkey % 40 = 0 THEN split_part(p_name, ' ', 1) ELSE 'one ' || p_name || ' please' END AS query FROM part WHERE p_partkey % 20 = 0) q JOIN (SELECT DISTINCT p_name AS name FROM part) n ON contains(lower(n.name), lower(q.query)) OR contains(lower(q.query), lower(n.name)) QUALIFY row_number() OVER (PARTITION BY q.p_partkey ORDER BY length(n.name), n.name) = 1"""
)
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    query = F.when(F.col("p_partkey") % 40 == 0, F.substring_index("p_name", " ", 1)).otherwise(F.concat(F.lit("one "), "p_name", F.lit(" please")))
    asked = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), query.alias("query"))
    return graph.lookup_by_name(asked, p.select(F.col("p_name").alias("name")))


_W = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"


@R.add(
    f"""WITH q AS (SELECT item_id AS query_id, text || CASE WHEN item_id % 2 = 0 THEN ' small ring' ELSE '' END AS query FROM benchmark), f AS (SELECT * FROM (SELECT q.query_id, d.text, len(list_intersect({_W.format('q.query')}, {_W.format('d.text')})) / 10.0 AS score, 'faq' AS source, d.doc_id::varchar AS id FROM q, documents d) WHERE score > 0),
i AS (SELECT DISTINCT p_name AS name, p_name || ' (' || format('{{:,}}', length(p_name) * 1000) || 'đ) - ' || p_name || ' The of' AS text, p_name || ' The of' AS description FROM part),
m AS (SELECT * FROM (SELECT q.query_id, i.text, (len(list_intersect({_W.format('q.query')}, {_W.format('i.description')})) + CASE WHEN contains(lower(q.query), lower(i.name)) THEN 2 ELSE 0 END) / 10.0 AS score, 'menu' AS source, i.name AS id FROM q, i) WHERE score > 0),
a AS (SELECT * FROM f UNION ALL SELECT * FROM m), best AS (SELECT query_id, text, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, id) AS rank FROM a QUALIFY rank <= 3)
SELECT * FROM best UNION ALL SELECT query_id, '(Không tìm thấy thông tin liên quan trong dữ liệu quán.)', 0.0, 'none', 1 FROM q WHERE query_id NOT IN (SELECT query_id FROM best)"""
)
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    asked = b.select(F.col("item_id").alias("query_id"), F.concat("text", F.when(F.col("item_id") % 2 == 0, " small ring").otherwise("")).alias("query"))
    facts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id"), F.col("text").alias("fact"))
    menu = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.length("p_name") * 1000).alias("price"), F.concat("p_name", F.lit(" The of")).alias("description")).distinct()
    return vector.overlap_search(asked, facts, menu)


@R.add(
    r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), c AS (SELECT item_id, w, count(*)::double AS n FROM w GROUP BY ALL), v AS (SELECT item_id, w, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS x FROM c)
SELECT v.item_id AS query_id, u.item_id AS node_id, round(sum(v.x * u.x), 6) AS score FROM v JOIN v u ON u.w = v.w WHERE v.item_id % 20 = 0 GROUP BY 1, 2"""
)
def bag_of_words_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth item against all that share a word with it."""
    each = sparse.bags(table(spark, sf_dir, "benchmark"), "item_id", "text")
    asked = each.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "word", F.col("x").alias("y"))
    found = each.join(asked, "word").groupBy("query_id", F.col("item_id").alias("node_id"))
    return found.agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))


_BAG_SQL = r"SELECT {id} AS id, w, n / sqrt(sum(n * n) OVER (PARTITION BY {id})) AS x FROM (SELECT {id}, w, count(*)::double AS n FROM (SELECT {id}, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM {table}) GROUP BY ALL)"


@R.add(
    f"""WITH q AS ({_BAG_SQL.format(id="item_id", table="benchmark")}), d AS ({_BAG_SQL.format(id="doc_id", table="documents")}), s AS (SELECT q.id AS query_id, d.id AS node_id, round(sum(q.x * d.x), 6) AS score FROM q JOIN d ON q.w = d.w GROUP BY 1, 2)
SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id)::int AS rank FROM s WHERE score > 0 QUALIFY rank <= 5"""
)
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents nearest to each item by their words."""
    asked = sparse.bags(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    docs = table(spark, sf_dir, "documents")
    held = sparse.bags(docs, "doc_id", "text").withColumnRenamed("doc_id", "node_id")
    return sparse.top_k(asked, held, 5, n_rows=docs.count())


@R.add("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, left(b.text, 40))")
def answer_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit predicate: the first 40 characters of an item inside a document."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pattern_id"), F.substring("text", 1, 40).alias("pattern"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return matching.containing(docs, items).select(F.col("pattern_id").alias("item_id"), F.col("text_id").alias("doc_id"))


def _recall_sql() -> str:
    return (
        _expansion_sql(_SEEDS, NEXT_SQL, LINKS_SQL)
        + f""", pairs AS (SELECT src AS query_id, dst AS target FROM edges WHERE src % 20 = 0), plain AS (SELECT query_id, node_id FROM ({DUAL_SQL})), wide AS (SELECT query_id, node_id FROM plain UNION SELECT query_id, node_id FROM expanded),
r AS (SELECT count(*) AS n, round(avg((p.node_id IS NOT NULL)::int), 9) AS recall_without, round(avg((w.node_id IS NOT NULL)::int), 9) AS recall_with FROM pairs q LEFT JOIN plain p ON p.query_id = q.query_id AND p.node_id = target LEFT JOIN wide w ON w.query_id = q.query_id AND w.node_id = target)
SELECT n, recall_without, recall_with, round(CASE WHEN recall_without > 0 THEN (recall_with - recall_without) / recall_without WHEN recall_with > 0 THEN 'inf'::double ELSE 0.0 END, 6) AS lift, recall_without > 0 AND (recall_with - recall_without) / recall_without >= 0.15 OR recall_without = 0 AND recall_with > 0 AS passed FROM r"""
    )


@R.add(_recall_sql())
def expansion_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the chunk after a query chunk is found, by vectors alone and with
    what the graph adds to them, and the lift of the latter."""
    every = cut(dual_domain(spark, sf_dir), "found")
    found, edges = every.select("query_id", "node_id"), _edges(spark, sf_dir)
    wide = graph.expansion(every.where("kind = 'chunk'").select("query_id", "node_id", "ordinal"), edges, _links(spark, sf_dir))
    wide = found.unionByName(wide.select("query_id", "node_id")).distinct()
    pairs = edges.where("src % 20 = 0").select(F.col("src").alias("query_id"), F.col("dst").alias("target"))
    hit = lambda ids, name: ids.select("query_id", F.col("node_id").alias("target"), F.lit(1).alias(name))
    both = pairs.join(hit(found, "without"), ["query_id", "target"], "left").join(hit(wide, "with"), ["query_id", "target"], "left")
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(0))), 9)
    r = both.agg(F.count("*").alias("n"), share("without").alias("recall_without"), share("with").alias("recall_with"))
    lift = metrics.lift(F.col("recall_without"), F.col("recall_with"))
    return r.select("n", "recall_without", "recall_with", F.round(lift, 6).alias("lift"), (lift >= 0.15).alias("passed"))


@R.add(
    f"""WITH t AS (SELECT vec_id + 1 AS target, vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0) SELECT query_id, target FROM t WHERE EXISTS (SELECT 1 FROM ({DUAL_SQL}) d WHERE d.query_id = t.query_id AND d.node_id = t.target)"""
)
def targets_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries whose target is among the candidates (semi join)."""
    targets = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("target"))
    found = dual_domain(spark, sf_dir).select("query_id", F.col("node_id").alias("target"))
    return targets.join(found, ["query_id", "target"], "left_semi")


_MENU_SQL = "SELECT p_name AS name, p_retailprice AS price, p_type AS category, coalesce(p_brand, '') AS description FROM part"


def _menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"), F.col("p_brand").alias("description"))


@R.add(_MENU_SQL)
def menu_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.list_items(_menu(spark, sf_dir))


@R.add(f"SELECT * FROM ({_MENU_SQL}) WHERE category = (SELECT min(p_type) FROM part)")
def menu_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu = _menu(spark, sf_dir)
    return graph.list_items(menu, menu.agg(F.min("category")).first()[0])


@R.add(
    """WITH k AS (SELECT n_nationkey AS keyword_id, CASE WHEN n_nationkey % 2 = 0 THEN upper(substr(n_name, 1, 2)) ELSE n_name END AS keyword FROM nation), f AS (SELECT p_partkey, p_name || ' ' || p_type AS q, p_brand FROM part)
SELECT keyword_id, coalesce((SELECT arg_min(p_brand, p_partkey) FROM f WHERE contains(lower(q), lower(keyword))), 'no answer') AS answer FROM k"""
)
def first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 2 == 0, F.upper(F.substring("n_name", 1, 2))).otherwise(F.col("n_name"))
    keywords = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("keyword_id"), name.alias("keyword"))
    faq = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.concat_ws(" ", "p_name", "p_type").alias("question"), F.col("p_brand").alias("answer"))
    return graph.first_answers(keywords, faq, "no answer")


@R.add(
    "SELECT count(*) FILTER (label < 5) AS n_menu, count(*) FILTER (label >= 5) AS n_chunk, count(*) FILTER (label < 5) >= 100 AND count(*) FILTER (label >= 5) >= 50 AS enough FROM embeddings"
)
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    menu, chunk = F.count_if(F.col("label") < 5), F.count_if(F.col("label") >= 5)
    return table(spark, sf_dir, "embeddings").agg(menu.alias("n_menu"), chunk.alias("n_chunk"), ((menu >= 100) & (chunk >= 50)).alias("enough"))


_FAQ_CHUNKS = "SELECT 'faq:' || p_partkey AS chunk_id, p_partkey AS ordinal, p_name || ' ' || p_type AS text, 'faq' AS source, p_brand AS category, p_name AS question, p_type AS answer FROM part"


def _faq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return graph.faq_chunks(p.select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.col("p_brand").alias("category")), "p_partkey")


@R.add(_FAQ_CHUNKS)
def faq_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faq(spark, sf_dir)


@R.add(f"WITH n AS (SELECT lag(chunk_id) OVER (PARTITION BY category ORDER BY ordinal) AS src, chunk_id AS dst FROM ({_FAQ_CHUNKS})) SELECT * FROM n WHERE src IS NOT NULL")
def faq_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a category in the order of the file."""
    return graph.next_edges(_faq(spark, sf_dir), ["category"], ["ordinal"])


@R.add(
    f"""WITH RECURSIVE e AS (SELECT p_partkey AS request_id, p_partkey::double AS t, lower(p_name) AS k, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn FROM part),
r AS (SELECT request_id, t, k, rn, t + 50 AS until, false AS hit FROM e WHERE rn = 1 UNION ALL SELECT e.request_id, e.t, e.k, e.rn, CASE WHEN r.until >= e.t THEN r.until ELSE e.t + 50 END, r.until >= e.t FROM r JOIN e ON e.k = r.k AND e.rn = r.rn + 1),
i AS (SELECT DISTINCT p_name AS name, p_name || ' (' || format('{{:,}}', length(p_name) * 1000) || 'đ) - ' || p_name AS text, p_name AS description FROM part), q AS (SELECT DISTINCT k FROM e),
f AS (SELECT k, text, len(list_intersect({_W.format('k')}, {_W.format('text')})) / 10.0 AS score, 'faq' AS source, ordinal::varchar AS id FROM q, ({_FAQ_CHUNKS})),
m AS (SELECT k, text, (len(list_intersect({_W.format('k')}, {_W.format('description')})) + CASE WHEN contains(k, lower(name)) THEN 2 ELSE 0 END) / 10.0 AS score, 'menu' AS source, name AS id FROM q, i),
b AS (SELECT k, text, score, source, id FROM (SELECT * FROM f UNION ALL SELECT * FROM m) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, source, id) <= 3)
SELECT request_id, t, hit, text, source, score FROM r JOIN b USING (k)"""
)
def cached_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked for a second apart, in capitals every other time, searched once each."""
    p = table(spark, sf_dir, "part")
    asked = p.select(F.col("p_partkey").alias("request_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("query"), F.col("p_partkey").alias("t"))
    facts = _faq(spark, sf_dir).select(F.col("ordinal").alias("fact_id"), F.col("text").alias("fact"))
    menu = p.select(F.col("p_name").alias("name"), (F.length("p_name") * 1000).alias("price"), F.col("p_name").alias("description")).distinct()
    found = vector.cached_search(asked, lambda q: vector.overlap_search(q, facts, menu), 50.0)
    return found.select("request_id", "t", "hit", "text", "source", "score")

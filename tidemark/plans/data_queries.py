"""Queries of dataset cleaning, filling, splitting and of the metrics. Labels
are drawn from documents: four intents by id, a judge by another rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import datasets, graph, metrics
from tidemark.plans.registry import Registry, table

R = Registry()
LABELS = list(text.LABELS)
_L = "['order', 'consultant', 'faq', 'ignore']"

ROUTER_SQL = f"SELECT doc_id AS idx, text, {_L}[1 + doc_id % 4] AS intent, (doc_id % 4)::int AS label, doc_id % 7 = 0 AS is_hard, lang AS language FROM documents"
REVIEW_SQL = f"""SELECT doc_id AS idx, CASE WHEN doc_id % 11 = 0 THEN 'other' ELSE {_L}[1 + (doc_id // 3) % 4] END AS judged, ['high', 'medium', 'low'][1 + doc_id % 3] AS confidence, 0 AS line_no FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, {_L}[1 + (doc_id // 2) % 4], 'high', 1 FROM documents WHERE doc_id % 10 = 0"""
BEST_SQL = f"SELECT idx, arg_max(judged, line_no) AS judged, arg_max(confidence, line_no) AS confidence FROM ({REVIEW_SQL}) GROUP BY idx"
_CHANGE = "judged IN ('order', 'consultant', 'faq', 'ignore') AND judged <> r.intent AND confidence IN ('high', 'medium')"
RELABEL_SQL = f"""SELECT r.idx, CASE WHEN coalesce({_CHANGE}, false) THEN judged ELSE r.intent END AS intent, (CASE WHEN coalesce({_CHANGE}, false) THEN list_position({_L}, judged) - 1 ELSE r.label END)::int AS label,
r.intent AS old_intent, coalesce({_CHANGE}, false) AS changed FROM ({ROUTER_SQL}) r LEFT JOIN ({BEST_SQL}) b ON r.idx = b.idx"""


def _pick(n) -> F.Column:
    return F.element_at(F.array(*(F.lit(x) for x in LABELS)), (n + 1).cast("int"))


def router(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(i.alias("idx"), "text", _pick(i % 4).alias("intent"), (i % 4).cast("int").alias("label"), (i % 7 == 0).alias("is_hard"), F.col("lang").alias("language"))


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    third = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (i % 3 + 1).cast("int"))
    judged = F.when(i % 11 == 0, "other").otherwise(_pick(F.floor(i / 3) % 4))
    first = d.where(i % 5 == 0).select(i.alias("idx"), judged.alias("judged"), third.alias("confidence"), F.lit(0).alias("line_no"))
    return first.unionByName(d.where(i % 10 == 0).select(i.alias("idx"), _pick(F.floor(i / 2) % 4).alias("judged"), F.lit("high").alias("confidence"), F.lit(1).alias("line_no")))


@R.add(RELABEL_SQL)
def relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.relabel(router(spark, sf_dir), review(spark, sf_dir), LABELS)
    return out.select("idx", "intent", "label", "old_intent", "changed")


@R.add(
    f"""SELECT r.idx, CASE WHEN c THEN judged ELSE intent END AS intent, label FROM (SELECT r.*, judged, coalesce(judged <> r.intent AND confidence IN ('high', 'medium') AND is_hard, false) AS c FROM ({ROUTER_SQL}) r LEFT JOIN ({BEST_SQL}) b ON r.idx = b.idx) r"""
)
def relabel_hard_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = datasets.relabel(router(spark, sf_dir), review(spark, sf_dir), LABELS, hard_only=True, check=False)
    return out.select("idx", "intent", "label")


@R.add(f"SELECT l.label, count(r.idx) AS n FROM (SELECT unnest(['order', 'consultant', 'faq', 'ignore', 'unused']) AS label) l LEFT JOIN ({RELABEL_SQL}) r ON r.intent = l.label GROUP BY l.label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.label_counts(relabel(spark, sf_dir), [*LABELS, "unused"])


@R.add(f"SELECT old_intent, intent, count(*) AS n FROM ({RELABEL_SQL}) WHERE changed GROUP BY ALL")
def transition_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.transitions(relabel(spark, sf_dir))


@R.add(
    f"""SELECT idx, CASE WHEN k <= floor(n * 0.8) THEN 'train' WHEN k <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM
(SELECT idx, row_number() OVER (PARTITION BY intent, language, is_hard ORDER BY md5(idx::varchar || '42'), idx) AS k, count(*) OVER (PARTITION BY intent, language, is_hard) AS n FROM ({ROUTER_SQL}))"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.stratified_split(router(spark, sf_dir), ["intent", "language", "is_hard"], "idx").select("idx", "split")


@R.add(
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::varchar || '42'), doc_id) <= greatest(1, floor((SELECT count(*) FROM documents) * 0.15)) THEN 'test' ELSE 'train' END AS split FROM documents"""
)
def global_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.global_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')"


@R.add(
    f"""WITH n AS (SELECT conv_id, turn, role, text, {_NORM} AS norm FROM conversations), have AS (SELECT * FROM n WHERE conv_id % 10 = 0),
fresh AS (SELECT * FROM n WHERE conv_id % 10 <> 0 AND length(text) BETWEEN 2 AND 200 AND norm NOT IN (SELECT norm FROM have)),
once AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY norm ORDER BY conv_id, turn) = 1),
h AS (SELECT role, count(*) AS k FROM have GROUP BY role)
SELECT conv_id, turn, once.role, text FROM once LEFT JOIN h ON h.role = once.role QUALIFY row_number() OVER (PARTITION BY once.role ORDER BY conv_id, turn) <= 40 - coalesce(k, 0)"""
)
def quota_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return datasets.quota_fill(c.where("conv_id % 10 = 0"), c.where("conv_id % 10 <> 0"), ["role"], 40, ["conv_id", "turn"]).select("conv_id", "turn", "role", "text")


@R.add("SELECT p_partkey, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) = 1")
def first_seen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return datasets.first_seen(p, F.lower("p_name"), ["p_partkey"])


@R.add("SELECT p_brand AS answer, arg_min(p_name || ' ' || p_type, {'l': length(p_name || ' ' || p_type), 'k': p_partkey}) AS core FROM part GROUP BY p_brand")
def core_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("answer"), F.concat_ws(" ", "p_name", "p_type").alias("q"), "p_partkey")
    return datasets.core_question(p, "answer", "q", "p_partkey")


_WRAP = [("cho {subj} hỏi ", " ạ?"), ("xin hỏi ", ""), ("", " giúp em với")]
_SUBJ = ["anh", "chị", "em"]


def _sql_pick(what: str, k: int) -> str:
    return f"1 + ('0x' || substr(md5(p_partkey || '|' || i || '|{what}|42'), 1, 7))::bigint % {k}"


@R.add(
    f"""SELECT core_id, i, upper(t[1]) || t[2:] AS text, CASE WHEN d > 4 THEN s ELSE 'khách' END AS subject, p_name AS action, '' AS context FROM (SELECT p_partkey AS core_id, i::int AS i, p_name, s, d,
replace(['cho {{subj}} hỏi ', 'xin hỏi ', ''][w], '{{subj}}', s) || p_name || '?' || [' ạ?', '', ' giúp em với'][w] AS t
FROM (SELECT p_partkey, p_name, i, ['anh', 'chị', 'em'][{_sql_pick('s', 3)}] AS s, {_sql_pick('w', 3)} AS w, {_sql_pick('d', 10)} AS d FROM part, range(5) r(i)))"""
)
def utterance_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("core_id"), F.concat("p_name", F.lit("?")).alias("core"))
    return datasets.utterances(cores, 5, _WRAP, _SUBJ)


def _sql_choice(what: str, choices, id: str, i: str = "i") -> str:
    return f"[{', '.join(repr(x) for x in choices)}][1 + ('0x' || substr(md5({id} || '|' || {i} || '|{what}|42'), 1, 7))::bigint % {len(choices)}]"


@R.add(
    f"""SELECT item_id, i, 'Cho ' || s || ' ' || action || CASE WHEN c <> '' THEN ', ' || c ELSE '' END || x || '.' AS text, s AS subject, action, c AS context FROM (SELECT p_partkey AS item_id, i::int AS i, 'đặt ' || {_sql_choice('q', datasets.QUANTITIES, 'p_partkey')} || ' ly ' || lower(p_name) ||
CASE p_partkey % 3 WHEN 0 THEN ' size M' ELSE '' END AS action, {_sql_choice('s', datasets.ORDER_SUBJECTS, 'p_partkey')} AS s, {_sql_choice('c', datasets.ORDER_CONTEXTS, 'p_partkey')} AS c, {_sql_choice('x', datasets.ORDER_SUFFIXES, 'p_partkey')} AS x FROM part, range(3) r(i))"""
)
def order_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.element_at(F.array(F.lit("M"), F.lit("Freesize"), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return datasets.order_utterances(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item"), size.alias("size")), 3)


_TIMES = ["15 giờ chiều nay", "tối nay", "cuối tuần"]


@R.add(
    f"""SELECT booking_id, upper(t[1]) || t[2:] AS text, subject, action, context FROM (SELECT *, 'Cho ' || subject || ' ' || action || ' vào ' || context || x AS t FROM (SELECT o_orderkey AS booking_id, {_sql_choice('s', datasets.ORDER_SUBJECTS, 'o_orderkey', '0')} AS subject,
{_sql_choice('a', datasets.BOOKINGS, 'o_orderkey', '0')} AS action, {_sql_choice('t', _TIMES, 'o_orderkey', '0')} AS context, {_sql_choice('x', datasets.BOOKING_SUFFIXES, 'o_orderkey', '0')} AS x FROM orders))"""
)
def booking_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.booking_utterances(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("booking_id")), _TIMES)


@R.add(
    """SELECT p_name AS item, CASE WHEN c.canonical IS NULL THEN p_type ELSE c.canonical END AS entity FROM part LEFT JOIN (SELECT DISTINCT p_type AS name, 'tin' AS canonical FROM part WHERE p_type LIKE '%TIN' OR p_type LIKE '%tin%') c ON c.name = p_type GROUP BY 1, 2"""
)
def canonical_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions with the names of a lookup table put in, others as they are."""
    p = table(spark, sf_dir, "part")
    known = p.where(F.col("p_type").like("%TIN") | F.col("p_type").like("%tin%")).select(F.col("p_type").alias("name"), F.lit("tin").alias("canonical")).distinct()
    return graph.mentions(p, F.array("p_type"), known, id="p_name").withColumnRenamed("chunk_id", "item")


@R.add(
    """SELECT p_name AS item, list_sort(list_distinct(list(p_type))) AS categories, count(*) AS n FROM part GROUP BY p_name"""
)
def categories_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("item")).agg(F.array_sort(F.collect_set("p_type")).alias("categories"), F.count("*").alias("n"))


@R.add("SELECT intent, language, is_hard, count(*) AS n FROM (" + ROUTER_SQL + ") GROUP BY ALL")
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return router(spark, sf_dir).groupBy("intent", "language", "is_hard").agg(F.count("*").alias("n"))


@R.add(
    """SELECT user_id, round(a, 6) AS first, round(b, 6) AS second, round(CASE WHEN a > 0 THEN (a - b) / a * 100 ELSE 0.0 END, 6) AS percent, b < a * 0.7 AS passed FROM (SELECT user_id, arg_min(value, {'t': ts, 'i': event_id}) AS a, arg_max(value, {'t': ts, 'i': event_id}) AS b FROM events WHERE value IS NOT NULL GROUP BY user_id)"""
)
def cache_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first value against the last, as a call before and after caching."""
    at = F.struct("ts", "event_id")
    both = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.min_by("value", at).alias("a"), F.max_by("value", at).alias("b"))
    return both.select("user_id", F.round("a", 6).alias("first"), F.round("b", 6).alias("second"), F.round(metrics.speedup(F.col("a"), F.col("b")), 6).alias("percent"), (F.col("b") < F.col("a") * 0.7).alias("passed"))


@R.add(f"SELECT {_L}[1 + (i - 1) % 4] AS label, round(avg(embedding[i]::double), 6) AS baseline FROM embeddings, range(1, 65) r(i) GROUP BY 1")
def label_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of a vector as scores of the four labels in turn."""
    scores = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("at", "score"))
    return metrics.baseline(scores.select(_pick(F.col("at") % 4).alias("label"), F.col("score").cast("double").alias("score")), "label", "score").withColumn("baseline", F.round("baseline", 6))


@R.add(
    """SELECT p_name || ' (Size ' || s.size || ')' AS name, (CASE p_size % 3 WHEN 0 THEN 39000 WHEN 1 THEN 45000 ELSE 49000 END + extra + length(p_name) % 5 * 1000)::int AS price_vnd,
['coffee', 'tea', 'freeze'][1 + p_size % 3] AS category, s.size, p_type AS description FROM part, (VALUES ('S', -4000), ('M', 0), ('L', 6000)) s(size, extra)"""
)
def menu_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("coffee"), F.lit("tea"), F.lit("freeze")), F.col("p_size") % 3 + 1)
    items = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), kind.alias("category"), F.col("p_type").alias("description"))
    return datasets.size_grid(items, {"S": -4000, "M": 0, "L": 6000}, {"coffee": 39000, "tea": 45000, "freeze": 49000})


@R.add(
    """SELECT p_name AS name, arg_max(p_retailprice, {'b': b, 'k': p_partkey}) AS price, arg_max(p_type, {'b': b, 'k': p_partkey}) AS category FROM
(SELECT 0 AS b, p_partkey, p_name, p_retailprice, p_type FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT 1, p_partkey, p_name, p_retailprice * 2, p_type FROM part WHERE p_partkey % 3 = 0) GROUP BY p_name"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"), "p_partkey")
    new = p.where("p_partkey % 3 = 0").withColumn("price", F.col("price") * 2)
    return graph.upsert(p.where("p_partkey % 3 > 0"), new, ["name"], ["p_partkey"]).drop("p_partkey")


@R.add("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unique_violations(table(spark, sf_dir, "part").select("p_name"), "p_name")


PRED_SQL = f"SELECT {_L}[1 + doc_id % 4] AS truth, {_L}[1 + (CASE WHEN doc_id % 9 = 0 THEN doc_id // 5 ELSE doc_id END) % 4] AS pred, doc_id % 7 = 0 AS is_hard FROM documents"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    wrong = F.when(i % 9 == 0, F.floor(i / 5)).otherwise(i)
    return table(spark, sf_dir, "documents").select("doc_id", _pick(i % 4).alias("truth"), _pick(wrong % 4).alias("pred"), (i % 7 == 0).alias("is_hard"))


@R.add(
    f"""SELECT label, CASE WHEN pr = 0 THEN 0.0 ELSE tp / pr END AS precision, CASE WHEN su = 0 THEN 0.0 ELSE tp / su END AS recall,
CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (pr + su) END AS f1, su AS support FROM
(SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (pred = label) AS pr, count(*) FILTER (truth = label) AS su FROM ({PRED_SQL}), (SELECT unnest(['order', 'consultant', 'faq', 'ignore', 'unused']) AS label) GROUP BY label)"""
)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.per_class(predictions(spark, sf_dir), [*LABELS, "unused"])
    return out.select("label", F.round("precision", 12).alias("precision"), F.round("recall", 12).alias("recall"), F.round("f1", 12).alias("f1"), "support")


@R.add(
    f"""SELECT l.truth, {', '.join(f"count(*) FILTER (pred = '{x}') AS {chr(34)}{x}{chr(34)}" for x in LABELS)} FROM (SELECT unnest({_L}) AS truth) l LEFT JOIN ({PRED_SQL}) p ON p.truth = l.truth GROUP BY l.truth"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), LABELS)


@R.add(
    f"""SELECT 'all' AS slice, count(*) AS n, round(avg((truth = pred)::int), 12) AS accuracy FROM ({PRED_SQL}) UNION ALL SELECT is_hard::varchar, count(*), round(avg((truth = pred)::int), 12) FROM ({PRED_SQL}) GROUP BY is_hard"""
)
def accuracy_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(predictions(spark, sf_dir), "is_hard").withColumn("accuracy", F.round("accuracy", 12))


@R.add(f"SELECT doc_id, truth, pred FROM (SELECT doc_id, {_L}[1 + doc_id % 4] AS truth, {_L}[1 + (CASE WHEN doc_id % 9 = 0 THEN doc_id // 5 ELSE doc_id END) % 4] AS pred FROM documents) WHERE truth <> pred ORDER BY doc_id LIMIT 30")
def error_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of 30 rows, as its name says."""
    return predictions(spark, sf_dir).where("truth <> pred").orderBy("doc_id").limit(30).select("doc_id", "truth", "pred")


@R.add(
    """SELECT event_type, len(s) AS n, round(list_avg(s), 9) AS avg, s[1 + len(s) // 2] AS p50, s[1 + least(floor(0.95 * len(s))::bigint, len(s) - 1)] AS p95, s[greatest(floor(0.95 * len(s))::bigint, 1)] AS p95_below,
CASE WHEN len(s) >= 20 THEN s[1 + least(floor(0.95 * len(s))::bigint, len(s) - 1)] ELSE s[len(s)] END AS p95_or_max, s[1] AS min, s[len(s)] AS max, round(list_median(s), 9) AS median
FROM (SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)"""
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.latency(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
    return out.withColumns({"avg": F.round("avg", 9), "median": F.round("median", 9)})


@R.add(
    """SELECT user_id, day, CASE WHEN bool_and(s = 'up') THEN 'up' WHEN bool_and(s = 'down') THEN 'down' ELSE 'degraded' END AS status FROM (SELECT user_id, date_trunc('day', ts)::date AS day, CASE WHEN event_type IN ('error', 'view') THEN 'down' ELSE 'up' END AS s FROM events) GROUP BY user_id, day"""
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of a day as the parts of one service."""
    status = F.when(F.col("event_type").isin("error", "view"), "down").otherwise("up")
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), status.alias("status"))
    return metrics.rollup_status(e, ["user_id", "day"])


@R.add(
    "SELECT event_type, round(sum(value), 6) AS total, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS wall, round(sum(value) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS throughput FROM events GROUP BY event_type"
)
def token_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.throughput(table(spark, sf_dir, "events"), "value", "ts", "ts", ["event_type"])
    return out.withColumns({"total": F.round("total", 6), "throughput": F.round("throughput", 9)})


@R.add(
    """SELECT b, e, CASE WHEN b > 0 THEN round((e - b) / b, 9) WHEN e > 0 THEN 'inf'::double ELSE 0.0 END AS lift FROM (SELECT round(avg((value > 90 AND user_id % 2 = 0)::int), 9) AS b, round(avg((value > 80)::int), 9) AS e FROM events GROUP BY user_id)"""
)
def recall_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    by = e.groupBy("user_id").agg(
        F.round(F.avg(((F.col("value") > 90) & (F.col("user_id") % 2 == 0)).cast("int")), 9).alias("b"), F.round(F.avg((F.col("value") > 80).cast("int")), 9).alias("e")
    )
    return by.select("b", "e", F.round(metrics.lift(F.col("b"), F.col("e")), 9).alias("lift"))


@R.add(
    """SELECT count(*) AS n, round(avg((lang = 'en')::int), 9) AS language, round(avg((n_chars IS NOT DISTINCT FROM length(text))::int), 9) AS length, round(avg((source IS NOT DISTINCT FROM 'src' || doc_id % 3)::int), 9) AS origin,
round(avg((lang = 'en' AND n_chars IS NOT DISTINCT FROM length(text) AND source IS NOT DISTINCT FROM 'src' || doc_id % 3)::int), 9) AS all_fields, round(avg(n_chars), 6) AS avg_latency FROM documents"""
)
def field_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields guessed for each document against those that it has."""
    d = table(spark, sf_dir, "documents")
    fields = {
        "language": (F.col("lang"), F.lit("en")),
        "length": (F.col("n_chars"), F.length("text")),
        "origin": (F.col("source"), F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string"))),
    }
    out = metrics.field_accuracies(d, fields, F.col("n_chars"))
    return out.withColumns({c: F.round(c, 6 if c == "avg_latency" else 9) for c in out.columns if c != "n"})

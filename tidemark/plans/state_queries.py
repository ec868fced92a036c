"""Queries of sessions, histories, state machines and event streams."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import metrics, sessions, state
from tidemark.plans.lineage import scratch
from tidemark.plans.registry import Registry, table
from tidemark.sources import sse
from tidemark.streaming import processors

R = Registry()


@R.add(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionise(table(spark, sf_dir, "events"))


@R.add("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::int AS back FROM conversations QUALIFY back <= 3")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role", "text", "back")


@R.add(
    """SELECT conv_id, turn, coalesce(string_agg(role || ': ' || text, chr(10)) OVER w, '') AS history, count(*) OVER w AS n_history FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""
)
def history_before_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.history_before(table(spark, sf_dir, "conversations"), 4)
    return out.withColumn("n_history", F.col("n_history").cast("long"))


@R.add(
    """SELECT conv_id, turn, 1 + sum(greatest(1, length(text) // 3)) OVER w AS tokens, 1 + sum(greatest(1, length(text) // 3)) OVER w > 143.36 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.token_budget(table(spark, sf_dir, "conversations"), limit=2048, share=0.07)


@R.add("SELECT conv_id, least(count(*), 5) AS n_kept, least(greatest(count(*) - 5, 0), 5) AS n_summarised FROM conversations GROUP BY conv_id")
def history_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.split_history(table(spark, sf_dir, "conversations"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("ts").cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", t.alias("t"))


_E = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@R.add(
    f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, rn, [t] AS hits, true AS allowed, 2 AS remaining FROM e WHERE rn = 1 UNION ALL
SELECT user_id, event_id, rn, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3, greatest(2 - len(k), 0)::int FROM (SELECT e.user_id, e.event_id, e.rn, e.t, list_filter(r.hits, lambda h: h >= e.t - 86400) AS k FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, allowed, remaining::bigint AS remaining FROM r"""
)
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three admitted events a user in any day."""
    out = state.replay(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t"], partial(state.RateLimiter, 3, 86_400.0), "allowed boolean, remaining long")
    return out.select("user_id", "event_id", "allowed", "remaining")


@R.add(
    f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, rn, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fails, NULL::double AS opened, 'CLOSED' AS state, CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'ok' END AS outcome FROM e WHERE rn = 1 UNION ALL
SELECT user_id, event_id, rn, CASE WHEN o IS NOT NULL THEN f WHEN bad THEN f + 1 ELSE 0 END, CASE WHEN o IS NOT NULL THEN o WHEN bad AND f + 1 >= 2 THEN t ELSE NULL END, CASE WHEN o IS NOT NULL THEN 'OPEN' ELSE 'CLOSED' END, CASE WHEN o IS NOT NULL OR bad THEN 'fallback' ELSE 'ok' END
FROM (SELECT e.user_id, e.event_id, e.rn, e.t, e.event_type = 'error' AS bad, CASE WHEN r.opened IS NOT NULL AND e.t - r.opened >= 172800 THEN NULL ELSE r.opened END AS o, CASE WHEN r.opened IS NOT NULL AND e.t - r.opened >= 172800 THEN 0 ELSE r.fails END AS f FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, state, outcome FROM r"""
)
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two errors in a row open a user's circuit for two days."""
    rows = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    out = state.replay(rows, ["user_id"], ["t", "event_id"], ["t", "failed"], partial(state.CircuitBreaker, 2, 172_800.0), "state string, outcome string")
    return out.select("user_id", "event_id", "state", "outcome")


@R.add(
    f"""WITH RECURSIVE {_E}, r AS (SELECT user_id, event_id, rn, [{{'k': event_type, 'x': t + 259200}}] AS c, false AS hit FROM e WHERE rn = 1 UNION ALL
SELECT user_id, event_id, rn, CASE WHEN hit THEN list_append(list_filter(c, lambda z: z.k <> kk), list_filter(c, lambda z: z.k = kk)[1]) ELSE list_append(CASE WHEN len(list_filter(c, lambda z: z.k <> kk)) >= 3 THEN list_filter(c, lambda z: z.k <> kk)[2:] ELSE list_filter(c, lambda z: z.k <> kk) END, {{'k': kk, 'x': t + 259200}}) END, hit
FROM (SELECT e.user_id, e.event_id, e.rn, e.t, e.event_type AS kk, r.c, len(list_filter(r.c, lambda z: z.k = e.event_type AND z.x >= e.t)) > 0 AS hit FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id, hit, len(c) AS size FROM r"""
)
def lru_ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of three keys for three days for each user."""
    out = state.replay(_events(spark, sf_dir), ["user_id"], ["t", "event_id"], ["t", "event_type"], partial(state.LruTtlCache, 3, 259_200.0), "hit boolean, size long")
    return out.select("user_id", "event_id", "hit", "size")


@R.add(f"SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 3) AS hit_rate FROM ({R.sql['lru_ttl_cache']}) GROUP BY user_id")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_rate(lru_ttl_cache(spark, sf_dir), F.col("hit"), ["user_id"])


def _cache_sql(threshold: float, start: float, ttl: float | None, size: int | None, t: str, clear: str = "false") -> str:
    """(label, vec_id, hit, leader, similarity, hits, misses): one request after
    another, the leaders as a list."""
    until = "NULL::double" if ttl is None else f"t + {ttl}"
    live = "held" if ttl is None else "list_filter(held, lambda x: x.until >= t)"
    grown = "list_append(live, {'until': fresh, 'id': vec_id, 'v': v})"
    grown = grown if size is None else f"list_slice({grown}, greatest(1, len(live) + 2 - {size}), len(live) + 1)"
    return f"""WITH RECURSIVE e AS (SELECT label, vec_id, embedding::double[] AS v, {t} AS t, {until.replace("t +", t + " +")} AS fresh, {clear} AS clear, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
r AS (SELECT label, 0::bigint AS rn, 0::bigint AS vec_id, []::STRUCT(until DOUBLE, id BIGINT, v DOUBLE[])[] AS c, false AS hit, 0::bigint AS leader, 0.0::double AS similarity, 0::bigint AS hits, 0::bigint AS misses FROM (SELECT DISTINCT label FROM e) UNION ALL
SELECT label, rn, vec_id, CASE WHEN hit THEN live ELSE {grown} END, hit, CASE WHEN hit THEN live[spot].id ELSE vec_id END, best, n_hits + hit::int, n_misses + (NOT hit)::int FROM
(SELECT *, coalesce(best >= {threshold} AND best > {start}, false) AS hit, list_position(sims, best) AS spot FROM (SELECT *, greatest({start}, coalesce(list_max(sims), {start})) AS best FROM
(SELECT *, list_transform(live, lambda x: list_cosine_similarity(x.v, v)) AS sims FROM (SELECT *, {live} AS live FROM
(SELECT e.label, e.rn, e.vec_id, e.v, e.t, e.fresh, CASE WHEN e.clear THEN [] ELSE r.c END AS held, CASE WHEN e.clear THEN 0 ELSE r.hits END AS n_hits, CASE WHEN e.clear THEN 0 ELSE r.misses END AS n_misses FROM r JOIN e ON e.label = r.label AND e.rn = r.rn + 1))))))"""


_SEMANTIC = "hit boolean, leader long, similarity double"


@R.add(_cache_sql(0.35, -1.0, 600.0, 50, "vec_id::double") + " SELECT label, vec_id, hit, leader, round(similarity, 6) AS similarity FROM r WHERE rn > 0")
def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as requests a second apart, one cache a label."""
    e = table(spark, sf_dir, "embeddings").withColumn("t", F.col("vec_id").cast("double"))
    return state.replay(e, ["label"], ["t", "vec_id"], ["t", "vec_id", "embedding"], partial(state.SemanticCache, 0.35, 600.0, 50), _SEMANTIC).select(
        "label", "vec_id", "hit", "leader", F.round("similarity", 6).alias("similarity")
    )


@R.add(_cache_sql(0.35, -1.0, None, None, "0.0", "vec_id % 100 = 0") + " SELECT label, vec_id, hit, leader FROM r WHERE rn > 0")
def cleared_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without limits, emptied at every hundredth request."""
    e = table(spark, sf_dir, "embeddings").withColumns({"t": F.lit(0.0), "clear": F.col("vec_id") % 100 == 0})
    out = state.replay(e, ["label"], ["vec_id"], ["t", "vec_id", "embedding", "clear"], partial(state.SemanticCache, 0.35, None, None), _SEMANTIC)
    return out.select("label", "vec_id", "hit", "leader")


_ACTION_SQL = _cache_sql(0.3, 0.0, None, None, "0.0")


def agent_template(leader: F.Column) -> F.Column:
    """The stand-in agent: what it answers to the request that leads a class."""
    return F.concat(F.lit("Answer "), leader.cast("string"))


@R.add(_ACTION_SQL + " SELECT label, vec_id, hit, 'Answer ' || leader || CASE WHEN vec_id % 2 = 0 THEN ' (Lưu ý: ' || vec_id || ' ly, hôm nay)' ELSE '' END AS response FROM r WHERE rn > 0")
def action_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action-keyed cache: no expiry, no bound; hits answer with the leader's
    template and the request's own context."""
    e = table(spark, sf_dir, "embeddings").withColumn("t", F.lit(0.0))
    out = state.replay(e, ["label"], ["vec_id"], ["t", "vec_id", "embedding"], partial(state.SemanticCache, 0.3, None, None, 0.0), _SEMANTIC)
    ctx = F.when(F.col("vec_id") % 2 == 0, text.context(F.concat(F.col("vec_id").cast("string"), F.lit(" ly hôm nay")))).otherwise("")
    return out.select("label", "vec_id", "hit", text.paraphrase(agent_template(F.col("leader")), ctx).alias("response"))


@R.add(_ACTION_SQL + " SELECT label, max(hits) AS hits, max(misses) AS misses, round(max(hits) / (max(hits) + max(misses)), 3) AS hit_rate FROM r GROUP BY label")
def action_cache_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hit_rate(action_cache(spark, sf_dir), F.col("hit"), ["label"])


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = c.select(key.alias("request_id"), F.posexplode(F.split("text", " ")).alias("seq", "word"))
    return rows.select("request_id", F.col("seq").cast("long").alias("seq"), F.concat("word", F.lit(" ")).alias("token"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_WORDS = "w AS (SELECT conv_id || ':' || turn AS request_id, string_split(text, ' ') AS l FROM conversations), t AS (SELECT request_id, unnest(range(len(l))) AS seq, l[1 + seq] || ' ' AS token, len(l) AS n FROM w)"
_CLAUSES = rf"""WITH RECURSIVE {_WORDS}, r AS (SELECT request_id, -1::bigint AS seq, '' AS buf, '' AS clause FROM w UNION ALL
SELECT request_id, seq, CASE WHEN k < length(b) THEN substr(b, k + 2) ELSE b END, CASE WHEN k < length(b) THEN {_TRIM.format("substr(b, 1, k + 1)")} ELSE '' END FROM
(SELECT *, length(regexp_extract(b, '^[^.!?;\n]*')) AS k FROM (SELECT t.request_id, t.seq, r.buf || t.token AS b FROM r JOIN t ON t.request_id = r.request_id AND t.seq = r.seq + 1))),
z AS (SELECT r.request_id, r.seq, {_TRIM.format("buf")} AS rest FROM r JOIN t ON t.request_id = r.request_id AND t.seq = r.seq AND t.seq = t.n - 1),
events AS (SELECT request_id, seq, 0::bigint AS sub, 'token' AS event, token AS data FROM t UNION ALL SELECT request_id, seq, 1, 'clause', clause FROM r WHERE clause <> ''
UNION ALL SELECT request_id, seq + 1, 0, 'clause', rest FROM z WHERE rest <> '' UNION ALL SELECT request_id, seq + 2, 0, NULL, '[DONE]' FROM z)"""


@R.add(_CLAUSES + " SELECT * FROM events")
def clause_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.clauses(_tokens(spark, sf_dir))


@R.add(
    _CLAUSES
    + """, stop AS (SELECT DISTINCT request_id, 3 AS brk FROM t WHERE n > 3 AND length(request_id) % 2 = 1)
SELECT request_id, seq, sub, event, data FROM events LEFT JOIN stop USING (request_id) WHERE brk IS NULL OR seq < brk UNION ALL SELECT request_id, brk, 0, 'error', 'gone' FROM stop UNION ALL SELECT request_id, brk + 2, 0, NULL, '[DONE]' FROM stop"""
)
def failing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other request breaks off at its fourth token."""
    bad = F.when((F.col("seq") == 3) & (F.length("request_id") % 2 == 1), "gone")
    return state.clauses(_tokens(spark, sf_dir).withColumn("error", bad), error="error")


@R.add(
    _CLAUSES
    + r""" SELECT request_id, regexp_replace(coalesce(string_agg(data, '' ORDER BY seq, sub) FILTER (event = 'token'), ''), '\s+', '', 'g') = regexp_replace(coalesce(string_agg(data, '' ORDER BY seq, sub) FILTER (event = 'clause'), ''), '\s+', '', 'g') AS same FROM events GROUP BY request_id"""
)
def clause_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sse.consistent(clause_stream(spark, sf_dir))


@R.add(
    """SELECT conv_id || ':' || turn AS request_id, k - 1 AS seq, string_split(text, ' ')[k] || ' ' AS token FROM (SELECT conv_id, turn, text, unnest(range(1, len(string_split(text, ' ')) + 1)) AS k FROM conversations)"""
)
def sse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written as server-sent events and read back."""
    t = _tokens(spark, sf_dir)
    data = F.to_json(F.struct(F.col("request_id").alias("id"), F.struct(F.col("token").alias("content")).alias("delta")))
    blocks = t.select("request_id", "seq", sse.encode(F.lit("token"), data).alias("block"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"])
    body = blocks.groupBy("request_id").agg(F.concat(F.array_join(ordered, ""), F.lit("data: [DONE]\n\n")).alias("body"))
    back = sse.deltas(sse.parse(body))
    return back.select("request_id", F.col("seq").cast("long").alias("seq"), "token")


@R.add(R.sql["sse_round_trip"])
def sse_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens sent as a stream of server-sent events and received as another."""
    folder = scratch(spark, "sse")
    t = _tokens(spark, sf_dir)
    data = F.to_json(F.struct(F.col("request_id").alias("id"), F.struct(F.col("token").alias("content")).alias("delta")))
    rows = t.select("request_id", F.col("seq").cast("long").alias("seq"), F.lit("token").alias("event"), data.alias("data"))
    rows.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    sse.send(source, f"{folder}/sent", f"{folder}/sender").awaitTermination()
    back = sse.deltas(sse.receive(spark, f"{folder}/sent"))
    back.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/receiver").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(back.schema).parquet(f"{folder}/out").select("request_id", "seq", "token")


def _fold(summary: str, turns: list) -> str:
    return f"{summary}[{len(turns)}]"


@R.add(
    """WITH RECURSIVE e AS (SELECT conv_id, turn, greatest(1, length(text) // 3) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
r AS (SELECT DISTINCT conv_id, 0::bigint AS turn, 0::bigint AS rn, []::bigint[] AS l, '' AS s, 0::bigint AS held, 0::bigint AS tokens, 0::bigint AS folded FROM e UNION ALL
SELECT conv_id, turn, rn, kept, said, len(kept), list_sum(kept)::bigint + greatest(1, length(said) // 3), f FROM (SELECT *, CASE WHEN f > 0 THEN list_slice(l, -2, -1) ELSE l END AS kept, CASE WHEN f > 0 THEN s || '[' || f || ']' ELSE s END AS said FROM
(SELECT *, CASE WHEN list_sum(l) + greatest(1, length(s) // 3) > 210 AND len(l) > 2 THEN len(l) - 2 ELSE 0 END AS f FROM (SELECT e.conv_id, e.turn, e.rn, list_slice(list_append(r.l, e.n), -4, -1) AS l, r.s FROM r JOIN e ON e.conv_id = r.conv_id AND e.rn = r.rn + 1))))
SELECT conv_id, turn, held, tokens, folded FROM r WHERE rn > 0"""
)
def auto_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return state.replay(rows, ["conv_id"], ["turn"], ["role", "text"], partial(state.History, _fold, 2, 300), "held long, tokens long, folded long")


@R.add(
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, coalesce(value, 0.0) * 3600 AS service, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT DISTINCT user_id, 0::bigint AS event_id, 0::bigint AS rn, ['-infinity'::double, '-infinity'::double, '-infinity'::double] AS free, true AS served, 0.0::double AS wait FROM e UNION ALL
SELECT user_id, event_id, rn, CASE WHEN start - t > 36000 THEN free ELSE list_transform([1, 2, 3], lambda i: CASE WHEN i = slot THEN start + service ELSE free[i] END) END, start - t <= 36000, CASE WHEN start - t > 36000 THEN 36000 ELSE start - t END FROM
(SELECT *, greatest(t, free[slot]) AS start FROM (SELECT *, list_position(free, list_min(free)) AS slot FROM (SELECT e.user_id, e.event_id, e.rn, e.t, e.service, r.free FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))))
SELECT user_id, event_id, served, round(wait, 3) AS wait FROM r WHERE rn > 0"""
)
def bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as jobs on three servers, a job's value its hours."""
    rows = _events(spark, sf_dir).withColumn("service", F.coalesce(F.col("value"), F.lit(0.0)) * 3600)
    out = state.replay(rows, ["user_id"], ["t", "event_id"], ["t", "service"], partial(state.Queue, 3, 36_000.0), "served boolean, wait double")
    return out.select("user_id", "event_id", "served", F.round("wait", 3).alias("wait"))


_BREAKER = R.sql["circuit_breaker"]


@R.add(
    f"""SELECT b.user_id, b.event_id, b.state, CASE WHEN b.outcome = 'ok' THEN 'reply ' || b.event_id ELSE CASE CASE e.event_type WHEN 'error' THEN 'faq' WHEN 'view' THEN 'order' ELSE e.event_type END
{' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in text.FALLBACKS.items())} ELSE '{text.DEFAULT_FALLBACK}' END END AS reply FROM ({_BREAKER}) b JOIN events e ON e.event_id = b.event_id"""
)
def fallback_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a caller gets behind the breaker: the reply, or, where the call failed
    or was not made, the canned text of its intent."""
    kinds = F.when(F.col("event_type") == "error", "faq").when(F.col("event_type") == "view", "order").otherwise(F.col("event_type"))
    intents = table(spark, sf_dir, "events").select("event_id", kinds.alias("intent"))
    calls = circuit_breaker(spark, sf_dir).join(intents, "event_id")
    reply = F.when(F.col("outcome") == "ok", F.concat(F.lit("reply "), F.col("event_id").cast("string"))).otherwise(text.fallback(F.col("intent")))
    return calls.select("user_id", "event_id", "state", reply.alias("reply"))


@R.add(
    """SELECT user_id, count(*) FILTER (event_type NOT IN ('error', 'view')) AS ok, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'view') AS timeouts, max(value) AS peak,
count(*) FILTER (event_type = 'view') = 0 AS no_deadlock, count(value) < 2 OR arg_max(value, {'t': ts, 'i': event_id}) - arg_min(value, {'t': ts, 'i': event_id}) < 50 AS no_leak FROM events GROUP BY user_id"""
)
def soak_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as a long run: errors by name, views as hangs, values as memory."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "timeout").otherwise("ok")
    return metrics.soak(e.withColumn("outcome", kind), ["user_id"], "outcome", "value", F.struct("ts", "event_id"), 50.0)


@R.add(
    """WITH m AS (SELECT user_id, date_trunc('day', ts) AS day, value, ts FROM events WHERE value IS NOT NULL) SELECT user_id, round(arg_max(value, {'t': ts, 'v': value}) - arg_min(value, {'t': ts, 'v': value}), 6) AS growth, max(value) AS peak FROM m GROUP BY user_id"""
)
def soak_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    at = F.struct("ts", "value")
    return e.groupBy("user_id").agg(F.round(F.max_by("value", at) - F.min_by("value", at), 6).alias("growth"), F.max("value").alias("peak"))


#: Days of events that a micro-batch has, and how late its rows may come.
_BATCH_DAYS = 8
_LATE = "12 hours"


def _arrivals(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events as they come in, one table a micro-batch: a seventh of the rows
    comes up to 10 hours late, so that some come with the rows of the next one;
    the last table only moves the watermark on."""
    e = table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    rows = e.select("user_id", "event_id", t.alias("ts"), t.cast("double").alias("t"), (F.col("event_type") == "error").alias("failed"))
    came = F.col("t") + F.when(F.col("event_id") % 7 == 0, 36_000).otherwise(0)
    start, end = rows.agg(F.min("t"), F.max("t")).first()
    width = _BATCH_DAYS * 86_400
    parts = [rows.where((came >= start + k * width) & (came < start + (k + 1) * width)) for k in range(int((end - start + 36_000) // width) + 1)]
    last = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(end + 10 * width)).alias("ts"), F.lit(end + 10 * width).alias("t"), F.lit(False).alias("failed"))
    return [*parts, last]


def _streamed(spark: SparkSession, sf_dir: str, processor, args: list[str], out: str, **settings) -> DataFrame:
    """A table of any number of files comes in, then the stream is started again
    and takes all of them as one micro-batch: a file by itself would move the
    watermark past rows of the files beside it."""
    folder = scratch(spark, "events")
    for rows in _arrivals(spark, sf_dir):
        rows.write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        made = processors.run_in_order(source, processor, "user_id", ["ts", "event_id"], args, f"ts timestamp, event_id long, {out}", _LATE, **settings)
        with processors.with_store(spark):
            made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").where("user_id is not null").select("user_id", "event_id", *(x.split()[0] for x in out.split(", ")))


@R.add(R.sql["circuit_breaker"])
def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As circuit_breaker on a stream whose rows come out of order."""
    return _streamed(spark, sf_dir, processors.BreakerStream, ["t", "failed"], "state string, outcome string", threshold=2, seconds=172_800.0)


@R.add(R.sql["rate_limiter"])
def limiter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As rate_limiter on a stream whose rows come out of order."""
    return _streamed(spark, sf_dir, processors.LimiterStream, ["t"], "allowed boolean, remaining long", most=3, window=86_400.0)

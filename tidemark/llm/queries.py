"""The numbered queries, their SQL and the pipeline's registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import covertree, decontam, html_render, lexical, lpf, merkle, mixing, quality, secrets, simhash, tokens, toxicity, warc
from tidemark.llm.common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lpf.repeats(read(spark, sf_dir, "documents"), keep="none")
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history comes in two steps: half of the documents under the base rules,
    then all documents under all rules, of which the ledger knows some pairs."""
    docs = read(spark, sf_dir, "documents")
    earlier = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    paths, findings, _ = secrets.increments([(earlier, secrets.BASE_RULES), (docs, secrets.RULES)])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return secrets.by_path(paths, findings).select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("spans")).alias("spans"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.line_first(read(spark, sf_dir, "documents"))
    return found.withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).drop("clean_text")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(read(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = mixing.fair_queue(read(spark, sf_dir, "documents"))
    return queue.select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokens.load_pieces())


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(read(spark, sf_dir, "pages"))
    return warc.read_bundles(bundles).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases A-Z in a fifth of the texts."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(read(spark, sf_dir, "documents"), now={"text": F.translate("text", _UPPER, _LOWER)}, when=tampered)
    return found.drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_repeats": op2_repeats,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_html": op5_html,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_tokens": op9_tokens,
    "op10_warc": op10_warc,
    "op11_lexical": op11_lexical,
    "op12_topk": op12_topk,
    "op13_merkle": op13_merkle,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _spans_sql(rule: secrets.Rule) -> str:
    """(doc_id, start, rank, kind, stop) of one rule: text between matches and
    matches, measured in turn."""
    p = rule.pattern.replace("'", "''")
    rank = secrets.RULES.index(rule)
    lead = f"length(regexp_extract_all(t, '{p}', {rule.lead})[i])" if rule.lead else "0"
    return f"""SELECT row, start, {rank} AS rank, '{rule.kind}' AS kind, start + len AS stop FROM (SELECT row, len, part, sum(gap) OVER w + coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT row, i, length(g[i]) + {lead} AS gap, length(h[i]) - {lead} AS len, length(q[i]) AS part FROM (SELECT row, t, g, h, q, unnest(range(1, len(h) + 1)) AS i FROM
(SELECT row, t, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {rule.group}) AS q FROM d WHERE regexp_matches(t, '{p}')))) WINDOW w AS (PARTITION BY row ORDER BY i)) WHERE part >= {rule.least}"""


_ALL_SPANS = " UNION ALL ".join(map(_spans_sql, secrets.RULES))
_BASE = ", ".join(f"'{r.kind}'" for r in secrets.RULES if r.base)

OP3_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), s AS ({_ALL_SPANS}),
a AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' ORDER BY start, rank) FILTER (kind IN ({_BASE})) AS base, string_agg(kind || ':' || start::bigint || ':' || stop::bigint, ',' ORDER BY start, rank) AS spans FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.row = d.row"""

_SEPARATED = " + ".join(f"(length(l) - length(replace(l, '{s}', '')))" for s in quality.SEPARATORS)
_CLOSERS = quality.CLOSERS.replace("'", "''").replace("]", "\\]")

OP4_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT row, i, x, count(*) OVER (PARTITION BY row, x) AS c FROM (SELECT row, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))),
r AS (SELECT row, count(DISTINCT i + k) AS n FROM g, range(3) o(k) WHERE c > 1 GROUP BY row),
ln AS (SELECT row, k, l, length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT row, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d)),
j AS (SELECT row, k, l, chars, words > 0 AND row_number() OVER (PARTITION BY row, l ORDER BY k) > 1 AS again,
words > 0 AND (len(regexp_extract_all(l, '[#*$%&|<>]')) > {quality.MAX_SYMBOLS_PER_WORD} * words OR len(regexp_extract_all(l, '!')) > {quality.MAX_EXCLAMATIONS_PER_WORD} * words OR {_SEPARATED} >= {quality.MIN_SEPARATORS}
OR (words <= {quality.LABEL_WORDS} AND NOT regexp_matches(regexp_replace(l, '[\x20\x09-\x0D]+$', ''), '[{_CLOSERS}]$')) OR (words <= {quality.LEGAL_WORDS} AND regexp_matches(l, '{quality.LEGAL}')) OR (words <= {quality.INVITATION_WORDS} AND regexp_matches(l, '{quality.INVITATION}'))) AS bad FROM ln),
s AS (SELECT row, sum(chars) AS total, sum(chars) FILTER (NOT again AND NOT bad) AS kept, count(*) FILTER (again) AS dup, count(*) FILTER (again OR bad) AS removed, string_agg(l, chr(10) ORDER BY k) FILTER (NOT again AND NOT bad) AS clean FROM j GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(total, 0)::bigint AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
len(w) < {quality.MIN_WORDS} OR 100 * coalesce(r.n, 0) > {quality.MAX_REPEAT_PERCENT} * len(w) AS base_failed, coalesce(removed, 0) AS n_removed_lines, sha256(coalesce(clean, '')) AS clean_sha256,
NOT (len(w) < {quality.MIN_WORDS} OR 100 * coalesce(r.n, 0) > {quality.MAX_REPEAT_PERCENT} * len(w)) AND coalesce(kept, 0) >= {quality.MIN_KEPT} * total AS kept FROM d LEFT JOIN r ON r.row = d.row LEFT JOIN s ON s.row = d.row"""

OP6_SQL = f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')) AS key FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS k FROM d GROUP BY source),
c AS (SELECT *, {mixing.MAX_REPEAT} * source_size::double AS cap, {list(map(float, mixing.WEIGHTS))}[1 + (k - 1) % {len(mixing.WEIGHTS)}] AS weight FROM s),
l AS (SELECT *, cap / weight AS ratio, ({mixing.SHARE} * (SELECT sum(source_size) FROM s)::double - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, round(CASE WHEN level >= ratio THEN cap ELSE least((SELECT max(level) FROM l WHERE level < ratio) * weight, cap) END, 6) AS target FROM l),
q AS (SELECT row_number() OVER () AS row, d.doc_id, d.source, d.size, t.source_size::bigint AS source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT row, source, size, start + n * source_size AS reached, (start + n * source_size + size)::double / target AS v FROM q, range({mixing.MAX_REPEAT}) r(n) WHERE size > 0),
m AS (SELECT row, least(size, (SELECT sum(floor(target))::bigint FROM t) - coalesce(sum(size) OVER (ORDER BY v, source NULLS FIRST, reached ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS served FROM p)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::bigint AS taken FROM q LEFT JOIN (SELECT row, sum(greatest(0, served)) AS taken FROM m GROUP BY row) x ON x.row = q.row"""

OP10_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, from_hex(sha1(coalesce(html, '')))::bit::varchar AS bits, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::int + 8 * bits[5 * i + 2]::int + 4 * bits[5 * i + 3]::int + 2 * bits[5 * i + 4]::int + bits[5 * i + 5]::int]), '') AS payload_digest,
CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> coalesce(page_id, f - 1) THEN f END AS refers_to FROM p"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::bigint AS terms FROM d WHERE len(w) > 0),
f AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
p AS (SELECT row, doc_id, t, floor({lexical.WEIGHT_SCALE} * ln((2 * docs + 2) / (2 * count(*) OVER (PARTITION BY t) + 1)))::bigint
* (({lexical.TF_SCALE} * tf) // (1000 * tf + {lexical.K_LENGTH} * ({100 - lexical.B_PERCENT} + (({lexical.B_PERCENT} * n * docs) // terms)))) AS v FROM f, s),
q AS (SELECT item, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
r AS (SELECT item, item_id, row, doc_id, sum(c * v)::bigint AS score FROM q JOIN p USING (t) GROUP BY ALL HAVING sum(c * v) > 0)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, row)::integer AS rank FROM r) WHERE rank <= {lexical.TOP_K}"""

OP12_SQL = f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({covertree.SCALE} * x::double)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.row AS q, q.vec_id AS query_id, c.row, c.vec_id, CASE WHEN len(q.v) = len(c.v) THEN list_dot_product(q.v, c.v)::bigint END AS score FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST, row)::integer AS rank FROM p WHERE score IS NOT NULL) WHERE rank <= {covertree.TOP_K}"""


def _levels_sql(tree: str, path: str, levels: int) -> str:
    """CTEs from ``tree``0 (src, p, d) and ``path``0 (row, src, p, proof, folded) to those of level ``levels``."""
    out = []
    for i in range(levels):
        out.append(f"""{tree}{i}s AS MATERIALIZED (SELECT src, p, d, count(*) OVER (PARTITION BY src) AS n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{i} WINDOW w AS (PARTITION BY src, p // {merkle.FANOUT} ORDER BY p)),
{path}{i + 1} AS MATERIALIZED (SELECT row, t.src, t.p // {merkle.FANOUT} AS p, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256(l || folded || r) ELSE folded END AS folded FROM {path}{i} t JOIN {tree}{i}s s ON t.src = s.src AND t.p = s.p),
{tree}{i + 1} AS MATERIALIZED (SELECT src, p // {merkle.FANOUT} AS p, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY p)) ELSE any_value(d) END AS d FROM {tree}{i}s GROUP BY src, p // {merkle.FANOUT})""")
    return ", ".join(out)


_FIELD = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
_LEAF = lambda text: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
#: CRC-32 by its table of 256 entries, over the digits of an id; levels enough for 16^6 leaves a source and 16^4 sources.
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295))"

OP13_SQL = f"""WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), i)) AS t),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, {_LEAF('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS now FROM documents, c),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d),
a0 AS (SELECT src, p, leaf AS d FROM o), b0 AS (SELECT row, src, p, '' AS proof, coalesce(now, leaf) AS folded FROM o), {_levels_sql("a", "b", 6)},
u AS MATERIALIZED (SELECT src AS own, row_number() OVER (ORDER BY encode(src)) - 1 AS p, d FROM a6),
x0 AS (SELECT '' AS src, p, d FROM u), y0 AS (SELECT row, '' AS src, u.p, proof, folded FROM b6 JOIN u ON b6.src = u.own), {_levels_sql("x", "y", 4)}
SELECT doc_id, leaf, u.d AS subroot, x4.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = x4.d AS verified FROM o JOIN y4 ON o.row = y4.row JOIN u ON o.src = u.own, x4"""

#: The others hash with XXH64, tile, sort suffixes, render or fit, which SQL cannot express.
ORACLES: dict[str, str] = {"op3_secrets": OP3_SQL, "op4_quality": OP4_SQL, "op6_mixing": OP6_SQL, "op10_warc": OP10_SQL, "op11_lexical": OP11_SQL, "op12_topk": OP12_SQL, "op13_merkle": OP13_SQL}

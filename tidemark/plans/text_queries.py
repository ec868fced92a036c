"""Queries over the text rules. The driver's tables hold no Vietnamese, so
courtesy phrases, prices and times are put around part names by row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import graph
from tidemark.plans.registry import Registry, table

R = Registry()

#: Question templates, one a part, by key modulo their number.
WORDINGS = (
    "Cho em hỏi: {} vậy ạ?",
    "Xin hỏi {} nhé.",
    "anh/chị ơi, {} cảm ơn shop.",
    "EXCUSE ME, {} giúp mình với",
    "CHO CHỊ HỎI {} ạ",
    "không biết cho hỏi {} (hỏi giúp bạn mình)",
    "{}",
    "mình đặt 2 ly {} lúc 15 giờ chiều nay, sinh nhật 3 người ngày mai",
    "làm ơn cho hỏi {} có giờ mở cửa không",
    "Tư vấn {} size L giá 39.250đ, VAT 10%, còn size xl 49,000 vnd và 1500d",
    "recommend {} and suggest 2 k hôm nay",
    "tôi  Order {}   với bill 12000 đ",
)
_SQL_WORDINGS = "[" + ", ".join("'" + w + "'" for w in WORDINGS) + "]"
QUESTIONS_SQL = f"SELECT p_partkey, replace(({_SQL_WORDINGS})[1 + p_partkey % {len(WORDINGS)}], '{{}}', p_name) AS q FROM part"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    said = F.element_at(F.array(*(F.lit(w) for w in WORDINGS)), (F.pmod("p_partkey", F.lit(len(WORDINGS))) + 1).cast("int"))
    return part.select("p_partkey", F.replace(said, F.lit("{}"), F.col("p_name")).alias("q"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _sql_wrappers() -> str:
    out = _sql_strip("q")
    steps = ["WITH RECURSIVE s0 AS (SELECT p_partkey, q, " + out + " AS t FROM questions)"]
    n = 0
    for _ in range(3):
        for p in (*text.PREFIXES, *text.SUFFIXES):
            steps.append(f"s{n + 1} AS MATERIALIZED (SELECT p_partkey, q, " + _sql_strip(f"regexp_replace(t, '(?i){_re2(p)}', '')") + f" AS t FROM s{n})")
            n += 1
    steps[0] = f"WITH questions AS ({QUESTIONS_SQL}), " + steps[0].removeprefix("WITH RECURSIVE ")
    return ", ".join(steps) + f" SELECT p_partkey, coalesce(nullif(trim(t, ' ,.'), ''), {_sql_strip('q')}) AS core FROM s{n}"


@R.add(_sql_wrappers())
def strip_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("p_partkey", text.strip_wrappers(F.col("q")).alias("core"))


_CTX = _re2(text.CONTEXT.replace(r"k)\b", r"k)($|[^\p{L}\p{N}_])"))


@R.add(
    f"""SELECT p_partkey, coalesce(array_to_string(list_transform(list_sort(list_transform(map_entries(m), lambda e: [lpad(e.value::varchar, 6, '0'), e.key])), lambda e: e[2]), ', '), '') AS ctx
FROM (SELECT p_partkey, map_from_entries(list_transform(list_distinct(w), lambda x: struct_pack(k := x, v := list_position(w, x)))) AS m
FROM (SELECT p_partkey, list_transform(regexp_extract_all(q, '(?i){_CTX}', 0), lambda x: regexp_extract(x, '(?i)^(ngày mai|hôm nay|tối nay|sáng mai|sáng nay|chiều nay|cuối tuần|sinh nhật|\\d+\\s*\\p{{L}}+)')) AS w FROM ({QUESTIONS_SQL})))"""
)
def extract_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("p_partkey", text.context(F.col("q")).alias("ctx"))


@R.add(
    f"""SELECT p_partkey, CASE {' '.join(f"WHEN regexp_matches(lower(q), '(^|[^\\p{{L}}\\p{{N}}_]){s}($|[^\\p{{L}}\\p{{N}}_])') THEN '{s}'" for s in text.SUBJECTS)} ELSE '{text.DEFAULT_SUBJECT}' END AS subject FROM ({QUESTIONS_SQL})"""
)
def guess_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("p_partkey", text.subject(F.col("q")).alias("subject"))


@R.add(
    "SELECT p_partkey, route, CASE route "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.FALLBACKS.items())
    + " END AS reply FROM (SELECT p_partkey, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(q), '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in text.ROUTES)
    + f" ELSE '{text.DEFAULT_ROUTE}' END AS route FROM ({QUESTIONS_SQL}))"
)
def rule_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = questions(spark, sf_dir).select("p_partkey", text.route(F.col("q")).alias("route"))
    return found.select("*", text.fallback(F.col("route")).alias("reply"))


@R.add(
    """SELECT p_partkey, p_name || ' giá ' || CASE WHEN v % 1000 = 0 THEN (v // 1000)::varchar ELSE printf('%.1f', round_even(v / 1000.0, 1)) END || 'k size '
|| ['nhỏ', 'vừa', 'lớn', 'siêu lớn'][1 + p_partkey % 4] || ', thuế' AS spoken FROM (SELECT p_partkey, p_name, floor(p_retailprice)::bigint * 25 AS v FROM part)"""
)
def speakable_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.element_at(F.array(*(F.lit(x) for x in ("S", "M", "l", "XL"))), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    price = F.floor("p_retailprice") * 25
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(price.cast("string"), F.lit("đ"))).otherwise(F.concat(F.replace(F.format_number(price, 0), F.lit(","), F.lit(".")), F.lit(" VND")))
    line = F.concat("p_name", F.lit(" giá "), said, F.lit(" size "), size, F.lit(", VAT"))
    return table(spark, sf_dir, "part").select("p_partkey", text.speakable(line).alias("spoken"))


_VI_WORDS = ", ".join(f"'{w}'" for w in text.VIETNAMESE_WORDS)


@R.add(
    f"""SELECT doc_id, lang, CASE WHEN regexp_matches(lower(text), '[{text.VIETNAMESE_LETTERS}]') OR list_has_any(regexp_split_to_array(lower(text), '\\s+'), [{_VI_WORDS}]) THEN 'vi' ELSE 'en' END AS detected FROM documents"""
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.language(F.col("text")).alias("detected"))


@R.add("SELECT conv_id, turn, greatest(1, length(text) // 3) AS tokens FROM conversations")
def rough_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.rough_tokens(F.col("text")).alias("tokens"))


@R.add(
    r"""SELECT item_id, sha256(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') || '|' || 5) AS key FROM benchmark"""
)
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.cache_key(F.col("text"), 5).alias("key"))


@R.add(
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g') AS norm,
regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[?!.,;:]+$', ''), '^\s+', ''), '\s+$', '') AS answer FROM conversations"""
)
def normalised_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.dedup_key(F.col("text")).alias("norm"), text.answer_key(F.col("text")).alias("answer"))


@R.add(
    r"""WITH RECURSIVE c AS (SELECT doc_id, unnest(l) AS clause, generate_subscripts(l, 1) AS rn FROM (SELECT doc_id,
list_filter(list_transform(string_split(replace(replace(replace(text, chr(10), ' '), ', ', ',' || chr(1)), '. ', '.' || chr(1)), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)),
r AS (SELECT doc_id, rn, clause AS now, 0 AS ordinal FROM c WHERE rn = 1 UNION ALL
SELECT c.doc_id, c.rn, CASE WHEN length(r.now) + length(c.clause) + 1 > 90 THEN c.clause ELSE r.now || ' ' || c.clause END,
CASE WHEN length(r.now) + length(c.clause) + 1 > 90 THEN r.ordinal + 1 ELSE r.ordinal END FROM r JOIN c ON c.doc_id = r.doc_id AND c.rn = r.rn + 1)
SELECT doc_id || ':' || ordinal AS chunk_id, doc_id, ordinal, arg_max(now, rn) AS text FROM r GROUP BY doc_id, ordinal"""
)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.chunk_table(table(spark, sf_dir, "documents"))


@R.add(
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array('## ' || lang || chr(10) || replace(text, chr(10), chr(10) || '## '), '\n?## '), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, pos, regexp_replace(split_part(part, chr(10), 1), '\s+$', '') AS title, CASE WHEN contains(part, chr(10)) THEN regexp_replace(substr(part, instr(part, chr(10)) + 1), '^\s+|\s+$', '', 'g') ELSE '' END AS section_text
FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM s)"""
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("## "), "lang", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return graph.sections(table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))).select("doc_id", "pos", "title", "section_text")


#: Answers by event number modulo their number: fenced, loose, malformed, empty, of other types.
ANSWERS = ('["{} ", 7, "  "]', '```json\n["{} ", 7, "  "]\n```', 'Sure: ["{} ", 7, "  "] done', '["{} ", 7, "  "', "no array, {}", "", '[]', '[["{}"], null, true, " {}"]', '{{"a": ["{}"]}}')
_SQL_ANSWERS = "[" + ", ".join("'" + a.replace("{}", "@").replace("{{", "{").replace("}}", "}") + "'" for a in ANSWERS) + "]"
_ANSWERED = f"SELECT event_id, event_type, event_id % {len(ANSWERS)} AS k, replace(({_SQL_ANSWERS})[1 + event_id % {len(ANSWERS)}], '@', event_type) AS answer FROM events"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*(F.lit(a.replace("{}", "@").replace("{{", "{").replace("}}", "}")) for a in ANSWERS)), (F.col("event_id") % len(ANSWERS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.replace(said, F.lit("@"), F.col("event_type")).alias("answer"))


_INNER = r"regexp_extract(regexp_replace(regexp_replace(answer, '^```(json)?', ''), '```$', ''), '\[.*\]', 0, 's')"


@R.add(
    f"""WITH a AS ({_ANSWERED}), j AS (SELECT event_id, CASE WHEN json_valid(nullif({_INNER}, '')) THEN {_INNER}::json END AS j FROM a)
SELECT event_id, coalesce(list_filter(list_transform(json_extract(j, '$[*]'), lambda x: regexp_replace(CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') WHEN 'NULL' THEN '' ELSE x::varchar END, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), []) AS items FROM j"""
)
def tolerant_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("event_id", text.json_array(F.col("answer")).alias("items"))


@R.add(
    f"""WITH a AS ({_ANSWERED}), j AS (SELECT event_id, CASE WHEN json_valid(nullif({_INNER}, '')) THEN {_INNER}::json END AS j FROM a)
SELECT event_id, coalesce(list_filter(list_transform(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: regexp_replace(json_extract_string(x, '$'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), []) AS items FROM j"""
)
def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("event_id", text.json_strings(F.col("answer")).alias("items"))


@R.add(f"""WITH a AS ({_ANSWERED}) SELECT event_id, CASE WHEN k IN (3, 4, 5) THEN 2 ELSE len(json_extract({_INNER}::json, '$[*]')) END AS n FROM a""")
def strict_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without an array, which would fail the query, are asked for again."""
    again = F.when((F.col("event_id") % len(ANSWERS)).isin(3, 4, 5), '["asked", "again"]').otherwise(F.col("answer"))
    return answers(spark, sf_dir).select("event_id", F.size(text.json_array_strict(again)).cast("long").alias("n"))


@R.add(
    """SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'khách' ELSE event_type END AS subject, CASE event_id % 4 WHEN 0 THEN 'buy ' || user_id WHEN 1 THEN 'Answer: {"subject": "' || event_type || '"}' WHEN 2 THEN 'a {b}' ELSE 'no object' END AS action, CASE event_id % 4 WHEN 2 THEN 'now' ELSE '' END AS context FROM events"""
)
def json_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole objects, ones that lack parts, and none."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    whole = F.concat(F.lit('Answer: {"subject": "'), "event_type", F.lit('", "action": "buy '), F.col("user_id").cast("string"), F.lit('"} ok'))
    part = F.concat(F.lit('Answer: {"subject": "'), "event_type", F.lit('"}'))
    nested = F.concat(F.lit('{"subject": "'), "event_type", F.lit('", "action": "a {b}", "context": "now", "more": [1]}'))
    answer = F.when(k == 0, whole).when(k == 1, part).when(k == 2, nested).otherwise("no object")
    return e.select("event_id", text.json_intent(answer).alias("i")).select("event_id", "i.*")


@R.add("SELECT p_partkey, p_name || '. ' || p_type AS menu, coalesce(p_name, '') || ' ' || p_brand AS faq FROM part")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.embedding_text(F.col("p_name"), F.col("p_type")).alias("menu"), text.embedding_text(F.col("p_name"), F.col("p_brand"), " ").alias("faq"))


@R.add(
    """WITH k AS (SELECT p_partkey, lower(p_name) AS low, lower(split_part(p_name, ' ', 1)) AS a, CASE WHEN p_partkey % 2 = 0 THEN 'ring' ELSE lower(split_part(p_name, ' ', 2)) END AS b, floor(p_retailprice)::bigint AS price FROM part)
SELECT p_partkey, contains(low, a) OR contains(low, b) AS found, contains(low, a) AND contains(low, b) AS grounded, p_partkey % 3 > 0 AS priced FROM k"""
)
def grounding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies held against their keywords and prices; every third names another price."""
    p = table(spark, sf_dir, "part")
    words_ = F.array(F.upper(F.substring_index("p_name", " ", 1)), F.when(F.col("p_partkey") % 2 == 0, F.lit("Ring")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))))
    price = F.floor("p_retailprice").cast("long")
    reply = F.concat(F.lit("Price: "), F.format_number(F.when(F.col("p_partkey") % 3 > 0, price).otherwise(F.lit(7)), 0), F.lit(" now"))
    return p.select("p_partkey", text.has_any(F.col("p_name"), words_).alias("found"), text.has_all(F.col("p_name"), words_).alias("grounded"), text.has_price(reply, price.cast("string")).alias("priced"))


@R.add(r"SELECT p_partkey, len(list_distinct(list_filter(string_split(s, ''), lambda x: x <> ''))) <= 2 OR contains(s, '한') AS odd FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'aaa' WHEN 1 THEN p_name WHEN 2 THEN 'xin 한 chào' ELSE 'ab' END AS s FROM part)")
def gibberish(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "aaa").when(k == 1, F.col("p_name")).when(k == 2, "xin 한 chào").otherwise(" ab ")
    return table(spark, sf_dir, "part").select("p_partkey", text.gibberish(said).alias("odd"))


@R.add(
    """SELECT p_partkey, p_name || ': ' || p_brand || ' (' || floor(p_retailprice)::bigint || 'đ, ' || p_type || ')' AS shown, upper(p_name[1]) || p_name[2:] AS titled, trim(split_part(p_name || ' (Size ' || p_size || ')', '(', 1)) AS head FROM part"""
)
def menu_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    named = F.concat("p_name", F.lit(" (Size "), F.col("p_size").cast("string"), F.lit(")"))
    shown = text.menu_text(F.col("p_name"), F.col("p_brand"), F.floor("p_retailprice"), F.col("p_type"))
    return p.select("p_partkey", shown.alias("shown"), text.capitalised(F.col("p_name")).alias("titled"), text.name_head(named).alias("head"))

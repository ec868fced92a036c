"""Text rules as Column expressions: all of it stays in Catalyst.

Java's regular expressions are ASCII-only by default, so every pattern carries
(?U), or (?iuU) where case is ignored. Null gives null unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Courtesy phrases around a question, taken off in this order.
PREFIXES = (
    r"^(cho\s+(em|anh|chị|tôi|mình)\s+hỏi\s*[:,]?\s*)",
    r"^(anh\s*/?\s*chị\s+ơi,?\s*)",
    r"^(excuse me,?\s*)",
    r"^(mình muốn biết\s*)",
    r"^(xin hỏi\s*)",
    r"^(xin (cho\s+)?(hỏi|biết)\s*)",
    r"^(không biết\s*)",
    r"^(làm ơn cho hỏi\s*)",
    r"^(cho hỏi\s*)",
)
SUFFIXES = (
    r"(\s*vậy ạ\??\s*)$",
    r"(\s*cảm ơn (shop|ạ|nhé)\.?\s*)$",
    r"(\s*\(hỏi giúp bạn mình\)\s*)$",
    r"(\s*giúp (em|mình|tôi) với\.?\s*)$",
    r"(\s*nhé\.?\s*)$",
    r"(\s*ạ\??\s*)$",
)
# Quantities and times that make up a request's context.
CONTEXT = (
    r"(\d+\s*(giờ|h|phút|ngày|tuần|tháng|người|ly|phần|đô|k)\b|"
    r"ngày mai|hôm nay|tối nay|sáng mai|sáng nay|chiều nay|cuối tuần|"
    r"sinh nhật)"
)
# Forms of address by priority, the default, and the letters and words that tell Vietnamese.
SUBJECTS = ("anh", "chị", "em", "mình", "tôi")
DEFAULT_SUBJECT = "khách"
VIETNAMESE_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
VIETNAMESE_WORDS = ("anh", "chi", "em", "toi", "minh", "gia", "quan", "mon", "gio", "cho", "khong")
# Keywords of the rule router, in the order they are tried.
ROUTES = (
    ("faq", ("wifi", "giờ", "mở cửa", "đóng cửa", "địa chỉ", "gửi xe", "hours", "address", "open", "close")),
    ("consultant", ("gợi ý", "tư vấn", "recommend", "suggest", "món nào", "nên uống", "ngon")),
    ("order", ("đặt", "order", "cho tôi", "cho anh", "cho em", "tính tiền", "bill", "thêm", "bớt")),
)
DEFAULT_ROUTE = "ignore"
LABELS = ("order", "consultant", "faq", "ignore")
# Spoken sizes and the fallback sentences by intent.
SIZES = (("S", "nhỏ"), ("M", "vừa"), ("L", "lớn"), ("XL", "siêu lớn"))
CURRENCY = r"(?<!\w)(\d{1,3}(?:[.,]\d{3})+|\d{4,})\s*(?:đ|d|vnđ|vnd)\b"
FALLBACKS = {
    "order": "Dạ hiện hệ thống đang tải cao, anh/chị vui lòng đợi nhân viên xác nhận đơn giúp em nhé ạ.",
    "consultant": "Dạ hiện em chưa tư vấn được ngay do hệ thống đang bận, anh/chị đợi chút hoặc ghé quầy để được tư vấn trực tiếp nhé ạ.",
    "faq": "Dạ hệ thống đang bận, anh/chị vui lòng liên hệ trực tiếp nhân viên quầy để được hỗ trợ nhanh nhất ạ.",
    "ignore": "Dạ em nghe chưa rõ, anh/chị nói lại giúp em nhé.",
}
DEFAULT_FALLBACK = "Dạ hệ thống đang gặp sự cố tạm thời, anh/chị vui lòng thử lại sau ít phút hoặc liên hệ nhân viên quầy giúp em ạ."


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def norm(c: Column) -> Column:
    return strip(squeeze(F.lower(c)))


def cache_key(query: Column, top_k: Column | int) -> Column:
    """SHA-256 of the normalised query, a bar and k."""
    k = F.lit(top_k) if isinstance(top_k, int) else top_k
    return F.sha2(F.concat(squeeze(F.lower(strip(query))), F.lit("|"), k.cast("string")), 256)


def dedup_key(c: Column) -> Column:
    """Lowered, stripped, white space squeezed, and only then without marks, so
    that a mark between spaces leaves two."""
    return F.regexp_replace(squeeze(strip(F.lower(c))), r"(?U)[^\w\s]", "")


def answer_key(c: Column) -> Column:
    """For exact-match scoring: lowered, without closing marks."""
    return strip(F.regexp_replace(F.lower(strip(c)), r"(?U)[?!.,;:]+$", ""))


def tokens(c: Column) -> Column:
    """Distinct lower-case words, everything but word characters and spaces dropped."""
    return F.array_distinct(F.array_remove(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\w ]", ""), r"(?U)\s+"), ""))


def words(c: Column) -> Column:
    """Distinct lower-case pieces between white space."""
    return F.array_distinct(F.array_remove(F.split(F.lower(c), r"(?U)\s+"), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_wrappers(c: Column) -> Column:
    """The core of a question: three rounds of prefixes, then suffixes, each
    with the white space next to it; what is left empty falls back to the
    question. A round that changes nothing leaves a fixed point, so all three may
    always run."""
    steps = [p for _ in range(3) for p in (*(x + r"\s*" for x in PREFIXES), *(r"\s*" + x for x in SUFFIXES))]
    out = reduce(lambda x, p: F.regexp_replace(x, "(?iuU)" + p, ""), steps, strip(F.coalesce(c, F.lit(""))))
    out = F.btrim(out, F.lit(" ,."))
    return F.when(c.isNull(), F.lit(None).cast("string")).when(out == "", strip(c)).otherwise(out)


def context(c: Column) -> Column:
    """Quantities and times named, distinct, in order, comma-joined."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(c, F.lit("(?iuU)" + CONTEXT), F.lit(0))), ", ")


def subject(c: Column) -> Column:
    """The form of address used, by priority, or the default."""
    low = F.lower(F.coalesce(c, F.lit("")))
    first, *rest = SUBJECTS
    when = F.when(low.rlike(rf"(?U)\b{first}\b"), first)
    return reduce(lambda w, s: w.when(low.rlike(rf"(?U)\b{s}\b"), s), rest, when).otherwise(DEFAULT_SUBJECT)


def language(c: Column) -> Column:
    """vi for an accented Vietnamese letter or a common word, else en."""
    known = F.array(*(F.lit(w) for w in VIETNAMESE_WORDS))
    return F.when(c.rlike(f"(?iu)[{VIETNAMESE_LETTERS}]") | F.arrays_overlap(words(c), known), "vi").otherwise("en")


def route(c: Column) -> Column:
    """The intent whose keyword occurs first in the order of ROUTES."""
    low = F.lower(c)
    hit = lambda keys: reduce(lambda a, b: a | b, (low.contains(k) for k in keys))
    (name, keys), *rest = ROUTES
    return reduce(lambda w, r: w.when(hit(r[1]), r[0]), rest, F.when(hit(keys), name)).otherwise(DEFAULT_ROUTE)


def fallback(intent: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in FALLBACKS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, intent), F.lit(DEFAULT_FALLBACK))


def rough_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 3)).cast("long")


def paraphrase(template: Column, ctx: Column) -> Column:
    return F.when(F.length(ctx) > 0, F.concat(template, F.lit(" (Lưu ý: "), ctx, F.lit(")"))).otherwise(template)


def capitalised(c: Column) -> Column:
    """Only the first character changes."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def name_head(c: Column) -> Column:
    """What stands before the first bracket."""
    return strip(F.substring_index(c, "(", 1))


def menu_text(name: Column, description: Column, price: Column, category: Column) -> Column:
    return F.concat(name, F.lit(": "), F.coalesce(description, F.lit("")), F.lit(" ("), price.cast("long").cast("string"), F.lit("đ, "), category, F.lit(")"))


def _spoken_price(hit: Column) -> Column:
    """Thousands as k, with one decimal (half to even) where not whole."""
    value = F.regexp_replace(F.regexp_extract(hit, "(?iuU)^(\\d[\\d.,]*)", 1), "[.,]", "").cast("decimal(38,0)")
    whole = F.concat((value / 1000).cast("decimal(38,0)").cast("string"), F.lit("k"))
    part = F.concat(F.bround(value / F.lit(1000), 1).cast("decimal(38,1)").cast("string"), F.lit("k"))
    return F.when(value.isNull() | (value <= 0), hit).when(value % 1000 == 0, whole).otherwise(part)


def speakable(c: Column) -> Column:
    """Prices, sizes and VAT as they are said. Prices need a computed
    replacement: the text between matches and the matches, rewritten, are
    joined again in turn."""
    pattern = "(?iuU)" + CURRENCY
    hits = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), _spoken_price)
    gaps = F.split(c, pattern, -1)
    woven = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
    out = F.array_join(woven, "")
    for size, spoken in SIZES:
        out = F.regexp_replace(out, rf"(?iuU)\bsize\s+{size}\b", f"size {spoken}")
    return F.when(c.isNull() | (c == ""), c).otherwise(F.regexp_replace(out, r"(?iuU)\bVAT\b", "thuế"))


def chunks(c: Column, max_chars: int = 90) -> Column:
    """Clauses (ended by a comma or stop and a space) merged up to about
    ``max_chars``; a longer clause stays whole."""
    clauses = F.filter(F.transform(F.split(F.regexp_replace(c, "\n", " "), "(?<=[,.]) "), strip), lambda x: x != "")
    zero = F.struct(F.lit([]).cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, clause: Column) -> Column:
        full = (F.length(acc["now"]) + F.length(clause) + 1 > max_chars) & (acc["now"] != "")
        flushed = F.struct(F.array_append(acc["done"], strip(acc["now"])).alias("done"), clause.alias("now"))
        grown = F.struct(acc["done"].alias("done"), strip(F.concat(acc["now"], F.lit(" "), clause)).alias("now"))
        return F.when(full, flushed).otherwise(grown)

    end = lambda acc: F.when(strip(acc["now"]) != "", F.array_append(acc["done"], strip(acc["now"]))).otherwise(acc["done"])
    return F.aggregate(clauses, zero, step, end)


def gibberish(c: Column) -> Column:
    """One of a few CJK or Hangul characters, or two distinct characters at most."""
    few = F.size(F.array_distinct(F.array_remove(F.split(strip(c), ""), ""))) <= 2
    return c.rlike("[中国日本한국]") | few


def embedding_text(head: Column, rest: Column, stop: str = ". ") -> Column:
    """What a row is embedded as: a menu item's name and description with a stop
    between, or with a space a question and its answer. A missing part is empty."""
    return F.concat(F.coalesce(head, F.lit("")), F.lit(stop), F.coalesce(rest, F.lit("")))


def has_any(c: Column, keywords: Column) -> Column:
    """Whether some of an array of keywords lies in the text, both lowered and
    with white space squeezed; false for no keywords."""
    low = squeeze(F.lower(c))
    return F.exists(keywords, lambda k: F.contains(low, squeeze(F.lower(k))))


def has_all(c: Column, keywords: Column) -> Column:
    """The same for all of them; true for no keywords."""
    low = squeeze(F.lower(c))
    return F.forall(keywords, lambda k: F.contains(low, squeeze(F.lower(k))))


def has_price(c: Column, price: Column) -> Column:
    """Whether a price's leading digits stand in the text, points and commas aside."""
    return F.contains(F.translate(c, ".,", ""), price)


def name_price_line(name: Column, price: Column, category: Column) -> Column:
    return F.concat(F.lit("- "), menu_text(name, F.lit(""), price, category))


def _bare(c: Column) -> Column:
    """An answer without code fences around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), "^```(json)?", ""), "```$", ""))


def json_array(c: Column) -> Column:
    """Strings of a JSON array in a model's answer: code fences off, the whole
    text, else its widest bracketed part, else empty; blanks dropped."""
    bare = _bare(c)
    whole = F.from_json(bare, "array<string>", {"mode": "PERMISSIVE"})
    inner = F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), "array<string>", {"mode": "PERMISSIVE"})
    some = F.when(bare.startswith("["), F.coalesce(whole, inner)).otherwise(inner)
    clean = F.filter(F.transform(some, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(clean, F.lit([]).cast("array<string>"))


def _elements(c: Column) -> Column:
    """The widest bracketed part of an answer as JSON values, null if it is none."""
    bare = _bare(c)
    inner = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    return F.try_variant_get(F.try_parse_json(F.when(inner != "", inner).otherwise(bare)), "$", "array<variant>")


def json_array_strict(c: Column) -> Column:
    """The JSON values of the array in an answer as JSON texts; an answer without
    a well-formed array fails the query."""
    found = _elements(c)
    return F.when(c.isNull(), F.lit(None).cast("array<string>")).when(found.isNull(), F.raise_error(F.concat(F.lit("no JSON array in: "), F.substring(c, 1, 100))).cast("array<string>")).otherwise(F.transform(found, lambda x: F.to_json(x)))


def json_strings(c: Column) -> Column:
    """The strings of the array in an answer, stripped, blanks and all that is no
    string left out; empty for an answer without a well-formed array."""
    texts = F.transform(F.filter(_elements(c), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: strip(F.try_variant_get(x, "$", "string")))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def json_intent(c: Column) -> Column:
    """(subject, action, context) of a JSON object in an answer, with defaults:
    the default subject, the text itself, nothing."""
    got = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), "subject string, action string, context string")
    return F.struct(
        F.coalesce(got["subject"], F.lit(DEFAULT_SUBJECT)).alias("subject"), F.coalesce(got["action"], c).alias("action"), F.coalesce(got["context"], F.lit("")).alias("context")
    )

from pyspark.sql import functions as F

from tidemark.functions import similarity, text


def one(spark, fn, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[1] for r in rows.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_strip_wrappers(spark):
    got = one(spark, text.strip_wrappers, "Cho em hỏi: quán mở cửa mấy giờ vậy ạ?", "CHO CHỊ HỎI wifi ạ", "ạ", None, "  giá bao nhiêu, ")
    assert got == ["quán mở cửa mấy giờ", "wifi", "ạ", None, "giá bao nhiêu"]


def test_subject_takes_priority_over_place(spark):
    assert one(spark, text.subject, "em và anh", "Chị ơi", "canh chua", None) == ["anh", "chị", "khách", "khách"]


def test_context_keeps_order_and_drops_repeats(spark):
    assert one(spark, text.context, "2 ly ngày mai, 2 ly lúc 15h", "không") == ["2 ly, ngày mai, 15h", ""]


def test_speakable(spark):
    got = one(spark, text.speakable, "giá 49.000đ size M", "39250 vnd, VAT", "1.500d và 0000đ", "", None, "size xl")
    assert got == ["giá 49k size vừa", "39.2k, thuế", "1.5k và 0000đ", "", None, "size siêu lớn"]


def test_language_and_route(spark):
    assert one(spark, text.language, "Cà phê", "gia bao nhieu", "hello there") == ["vi", "vi", "en"]
    assert one(spark, text.route, "wifi và gợi ý", "ĐẶT bàn", "xyz") == ["faq", "order", "ignore"]


def test_dedup_key_leaves_two_spaces(spark):
    assert one(spark, text.dedup_key, " A , B! ") == ["a  b"]


def brute_chunks(s, most=90):
    out, now = [], ""
    pieces, last = [], 0
    s = s.replace("\n", " ")
    for i in range(1, len(s)):
        if s[i] == " " and s[i - 1] in ",.":
            pieces.append(s[last:i])
            last = i + 1
    for p in [x.strip() for x in [*pieces, s[last:]] if x.strip()]:
        if now and len(now) + len(p) + 1 > most:
            out.append(now)
            now = p
        else:
            now = f"{now} {p}".strip()
    return out + [now] if now else out


def test_chunks(spark):
    samples = ["Một, hai. " * 30, "x" * 200 + ", y", "", "a, b", "\n\n, .", "no stop"]
    assert one(spark, text.chunks, *samples) == [brute_chunks(s) for s in samples]


def test_json(spark):
    got = one(spark, text.json_array, '["a", 2, " "]', '```json\n["b"]\n```', 'so: ["c"] ok', "nothing", None)
    assert got == [["a", "2"], ["b"], ["c"], [], []]
    got = one(spark, text.json_intent, 'x {"action": "buy"} y', "plain")
    assert [tuple(r) for r in got] == [("khách", "buy", ""), ("khách", "plain", "")]


def test_vectors(spark):
    row = spark.sql("select array(3.0f, 4.0f) a, array(0.0f, 0.0f) z, array(4.0f, 3.0f) b")
    got = row.select(similarity.cosine(F.col("a"), F.col("b")), similarity.cosine(F.col("a"), F.col("z"))).first()
    assert round(got[0], 9) == 0.96 and got[1] == 0
    bags = spark.sql("select map('a', 2 / sqrt(5), 'b', 1 / sqrt(5)) x, map('b', 1D) y")
    assert round(bags.select(similarity.sparse_cosine(F.col("x"), F.col("y"))).first()[0], 9) == round(1 / 5**0.5, 9)


def test_gibberish(spark):
    assert one(spark, text.gibberish, "aaab", "hello", "中 hello world") == [True, False, True]

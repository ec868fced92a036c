"""Cleaning, filling and splitting labelled datasets. Random choices are orders
by an MD5 of an id and a seed, the same in every engine and on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.order import numbered


def shuffle_key(id: Column, seed: str) -> Column:
    return F.md5(F.concat(id.cast("string"), F.lit(seed)))


def relabel(rows: DataFrame, review: DataFrame, labels: list[str], confidence: tuple[str, ...] = ("high", "medium"), hard_only: bool = False, check: bool = True) -> DataFrame:
    """``rows`` (idx, intent, label, is_hard) with labels replaced by the last
    review (idx, judged, confidence, line_no) that knows better: judged within
    the taxonomy (if ``check``), different, and confident. With ``hard_only``
    only hard rows change, and their numeric label stays as it was."""
    last = Window.partitionBy("idx").orderBy(F.desc("line_no"))
    best = review.withColumn("k", F.row_number().over(last)).where("k = 1").select("idx", "judged", "confidence")
    known = F.col("judged").isin(labels) if check else F.col("judged").isNotNull()
    change = known & (F.col("judged") != F.col("intent")) & F.col("confidence").isin(*confidence)
    if hard_only:
        change = change & F.coalesce("is_hard", F.lit(False))
    change = F.coalesce(change, F.lit(False))
    number = F.array_position(F.array(*(F.lit(x) for x in labels)), F.col("judged")).cast("int") - 1
    out = rows.join(best, "idx", "left").withColumn("changed", change)
    if not hard_only:
        out = out.withColumn("label", F.when(change, number).otherwise(F.col("label")))
    return out.withColumn("old_intent", F.col("intent")).withColumn("intent", F.when(change, F.col("judged")).otherwise(F.col("intent"))).drop("judged", "confidence")


def label_counts(rows: DataFrame, labels: list[str], label: str = "intent") -> DataFrame:
    """(label, n) with a zero for labels that do not occur."""
    names = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    n = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return names.join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def transitions(rows: DataFrame) -> DataFrame:
    """(old_intent, intent, n) of changed rows."""
    return rows.where("changed").groupBy("old_intent", "intent").agg(F.count("*").alias("n"))


def first_seen(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each key."""
    w = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def quota_fill(have: DataFrame, new: DataFrame, cell: list[str], target: int, order: list[str], body: str = "text") -> DataFrame:
    """Rows of ``new`` that fill each cell up to ``target``: unseen after
    normalisation, 2 to 200 characters long, the first ones by ``order``."""
    n = have.groupBy(*cell).agg(F.count("*").alias("have"))
    fresh = new.where(F.length(body).between(2, 200)).withColumn("norm", text.dedup_key(F.col(body)))
    fresh = fresh.join(have.select(text.dedup_key(F.col(body)).alias("norm")).distinct(), "norm", "left_anti")
    fresh = first_seen(fresh, F.col("norm"), order).join(n, cell, "left")
    w = Window.partitionBy(*cell).orderBy(*order)
    # a cell never takes more than target, so tasks send no more of it than that
    first = fresh.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= target)
    return first.where(F.col("nth") <= target - F.coalesce("have", F.lit(0))).drop("norm", "nth", "have")


def stratified_split(rows: DataFrame, strata: list[str], id: str, seed: str = "42", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Column ``split``: in each stratum, shuffled, floor(train n) rows, then
    floor(val n), the rest test. Rows are numbered over all strata in ranges, so
    a stratum may be any share of them; one row a stratum says where it begins."""
    at = numbered(rows.withColumn("_key", shuffle_key(F.col(id), seed)), [*strata, "_key", id], "_at")
    sizes = at.groupBy(F.struct(*strata).alias("_s")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    r = F.col("_at") - F.col("_first")
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(val))
    out = at.join(sizes, F.struct(*strata).eqNullSafe(F.col("_s")))
    return out.withColumn("split", F.when(r < a, "train").when(r < a + b, "val").otherwise("test")).drop("_key", "_at", "_s", "_n", "_first")


def global_split(rows: DataFrame, id: str, seed: str = "42", share: float = 0.15) -> DataFrame:
    """Column ``split``: the max(1, floor(share n)) rows of the least shuffle
    keys are test. Rows are range-sorted by the key and numbered by range, so no
    task holds the split. They are written in that order while this is built."""
    most = max(1, int(rows.count() * share))
    out = numbered(rows.withColumn("_key", shuffle_key(F.col(id), seed)), ["_key", id], "_at")
    return out.withColumn("split", F.when(F.col("_at") < most, "test").otherwise("train")).drop("_key", "_at")


def core_question(rows: DataFrame, group: str, question: str, order: str) -> DataFrame:
    """(group, core): the shortest question of a group, the first of equals."""
    return rows.groupBy(group).agg(F.min_by(question, F.struct(F.length(question), order)).alias("core"))


# How orders and bookings are worded.
ORDER_SUBJECTS = ("anh", "chị", "em")
QUANTITIES = ("1", "2", "3")
ORDER_CONTEXTS = ("", "", "", "mang đi", "uống tại chỗ", "ít đá", "không đường")
ORDER_SUFFIXES = ("", " nhé", " giúp em với", " ạ")
BOOKINGS = ("đặt bàn tiệc sinh nhật", "đặt bàn cho nhóm 5 người", "đặt bàn trước")
BOOKING_SUFFIXES = (" em nhé", " giúp em với", " nhé")


class _Picks:
    """Choices by hashes of a row's id, its number and what is chosen."""

    def __init__(self, id: str, seed: str) -> None:
        self.id, self.seed = id, seed

    def number(self, what: str, k: int) -> Column:
        """1 to k."""
        of = F.md5(F.concat_ws("|", F.col(self.id).cast("string"), F.col("i").cast("string"), F.lit(what), F.lit(self.seed)))
        return (F.pmod(F.conv(F.substring(of, 1, 7), 16, 10).cast("long"), F.lit(k)) + 1).cast("int")

    def of(self, what: str, choices) -> Column:
        return F.element_at(F.array(*(F.lit(x) for x in choices)), self.number(what, len(choices)))


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def utterances(cores: DataFrame, n: int, wrappers: list[tuple[str, str]], subjects: list[str], seed: str = "42") -> DataFrame:
    """(core_id, i, text, subject, action, context): ``n`` wordings of each core
    (core_id, core), a question or a request for advice. Wrapper and form of
    address are chosen by hashes; the subject is the default in four of ten."""
    rows, pick = _numbered(cores, n), _Picks("core_id", seed)
    said = pick.of("s", subjects)
    before, after = (pick.of("w", [w[k] for w in wrappers]) for k in (0, 1))
    body = F.concat(F.replace(before, F.lit("{subj}"), said), F.col("core"), after)
    subject = F.when(pick.number("d", 10) > 4, said).otherwise(text.DEFAULT_SUBJECT)
    return rows.select("core_id", "i", text.capitalised(body).alias("text"), subject.alias("subject"), text.strip(F.regexp_replace("core", r"\?+$", "")).alias("action"), F.lit("").alias("context"))


def order_utterances(items: DataFrame, n: int, seed: str = "42") -> DataFrame:
    """(item_id, i, text, subject, action, context): ``n`` orders of each item
    (item_id, item, size). The size is said if there is one and it is not the
    free one; the context is labelled only where it is said."""
    rows, pick = _numbered(items, n), _Picks("item_id", seed)
    sized = F.when((F.coalesce("size", F.lit("")) != "") & (F.col("size") != "Freesize"), F.concat(F.lit(" size "), "size")).otherwise("")
    action = F.concat(F.lit("đặt "), pick.of("q", QUANTITIES), F.lit(" ly "), F.lower("item"), sized)
    said, context, after = pick.of("s", ORDER_SUBJECTS), pick.of("c", ORDER_CONTEXTS), pick.of("x", ORDER_SUFFIXES)
    told = F.when(context != "", F.concat(F.lit(", "), context)).otherwise("")
    body = F.concat(F.lit("Cho "), said, F.lit(" "), action, told, after, F.lit("."))
    return rows.select("item_id", "i", body.alias("text"), said.alias("subject"), action.alias("action"), context.alias("context"))


def booking_utterances(ids: DataFrame, times: list[str], seed: str = "42") -> DataFrame:
    """(booking_id, text, subject, action, context): one request for a table for
    each booking_id, its context one of ``times``."""
    rows, pick = ids.select("booking_id", F.lit(0).alias("i")), _Picks("booking_id", seed)
    said, action, when = pick.of("s", ORDER_SUBJECTS), pick.of("a", BOOKINGS), pick.of("t", times)
    body = F.concat(F.lit("Cho "), said, F.lit(" "), action, F.lit(" vào "), when, pick.of("x", BOOKING_SUFFIXES))
    return rows.select("booking_id", text.capitalised(body).alias("text"), said.alias("subject"), action.alias("action"), when.alias("context"))


def size_grid(items: DataFrame, sizes: dict[str, int], base: dict[str, int]) -> DataFrame:
    """Menu rows for every item (name, category, description) in every size:
    base price of the category, the size's surcharge, and a thousand for each
    of the name's letters modulo five."""
    grid = items.select("*", F.explode(F.map_from_arrays(F.array(*(F.lit(s) for s in sizes)), F.array(*(F.lit(p) for p in sizes.values())))).alias("size", "extra"))
    start = F.element_at(F.create_map(*(F.lit(x) for kv in base.items() for x in kv)), F.col("category"))
    price = start + F.col("extra") + F.pmod(F.length("name"), F.lit(5)) * 1000
    return grid.select(F.format_string("%s (Size %s)", "name", "size").alias("name"), price.alias("price_vnd"), "category", "size", "description")

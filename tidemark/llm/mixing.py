"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a seeded hash and queue in that order, up
to ``max_repeat`` passes. A copy's virtual finish time is its source's
cumulative words, its own included, divided by the source's target. Copies are
range-sorted by finish time over all sources, their words summed up in that order,
and what comes after the total budget is cut off; the copy at the cut is served in
part. So each source gets its target but for what is in service at the cut, less
than a document. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, word_count
from tidemark.plans.order import numbered, running

#: The weights that sources take in turn, the share of all words, the most passes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"
#: A source's queue is split by this many leading hex digits of its shuffle key (4096 cells), so a
#: source with a third of all rows is many groups for the running sums.
CELL_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """weights taken in turn by sources in code-point order (null last), the
    budget as a share of all words, the passes allowed, the shuffle's seed."""

    weights: tuple[float, ...] = WEIGHTS
    share: float = SHARE
    max_repeat: int = MAX_REPEAT
    seed: str = SEED


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size).

    Targets share the budget by weight; one above ``max_repeat`` times its
    source stops there and its excess is shared again by weight. Sorted by
    capacity per weight, the capped sources come first, and the level of the
    rest is what remains divided by the weights that remain. Sources are ranked
    and summed up in ranges, so there may be any number of them.
    """
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    s = numbered(sizes, ["skey"], "turn")
    s = s.withColumn("weight", F.element_at(weights, (F.col("turn") % len(mix.weights) + 1).cast("int")))
    s = s.withColumn("cap", mix.max_repeat * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = running(s.drop("turn"), ["ratio", "skey"], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    words, every = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    s = s.withColumn("level", (F.lit(mix.share * float(words)) - F.col("cap_before")) / (F.lit(every) - F.col("weight_before")))
    level = s.agg(F.max(F.when(F.col("level") < F.col("ratio"), F.col("level")))).first()[0]
    target = F.when(F.col("level") >= F.col("ratio"), F.col("cap")).otherwise(F.least(F.lit(level).cast("double") * F.col("weight"), F.col("cap")))
    return s.select("skey", "source_size", F.round(target, 6).alias("target"))


def _queued(docs: DataFrame, mix: Mix, id: str, text: str, source: str) -> DataFrame:
    """Each row with its number, its source's size and target, and ``start``: the
    words that queue before it in its source."""
    skey = F.when(F.col(source).isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    key = F.md5(F.concat_ws(":", F.lit(mix.seed), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("src"), skey.alias("skey"), key.alias("key"), word_count(text).alias("size"))
    rows = cut(rows.withColumn("cell", F.substring("key", 1, CELL_DIGITS)), "sizes")

    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("skey").agg(F.sum("cell_size").alias("source_size")), mix)
    earlier = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("skey", "cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("offset")).join(targets, "skey")

    inside = Window.partitionBy("skey", "cell").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    queued = rows.join(cells, ["skey", "cell"]).select("id", "src", "size", "source_size", "target", start.alias("start"))
    return cut(queued.withColumn("row", F.monotonically_increasing_id()), "queued")


def _copy(n: int):
    """The n-th pass of a row: the words its source has queued before it, when it
    starts and finishes, and its words."""
    at = F.col("start") + n * F.col("source_size")
    time = lambda words: F.try_divide(words.cast("double"), F.col("target"))
    return F.struct(F.lit(n).alias("pass"), at.alias("at"), time(at).alias("v_start"), time(at + F.col("size")).alias("v_finish"), F.col("size").alias("words"))


def fair_queue(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size (words), source_size,
    target, taken, and ``copies``: array of (pass, v_start, v_finish, served) of
    the copies that the mix takes.

    Null and empty texts have size 0 and take nothing; null sources form one
    source, ranked last; a very long text is one row, counted without Python;
    repeated rows queue one after another (order among rows equal in key, id and
    size does not change the result); an empty table gives none; other columns
    of ``docs`` are ignored. Reruns agree, since the order hangs on the id and
    the seed alone. Running sums are taken inside (source, hash cell) groups and
    inside ranges of finish times, then offset by the sums of what lies before.
    Jobs run while the result is built: sizes, queues and the order are written.
    """
    rows = _queued(docs, mix, id, text, source)
    passes = rows.where("size > 0").select("row", "src", F.inline(F.array(*map(_copy, range(mix.max_repeat)))))
    budget = rows.groupBy("src").agg(F.first(F.floor("target")).alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    order = running(passes, ["v_finish", "src", "at"], {"before": F.col("words")})
    served = F.least(F.col("words"), F.lit(budget) - F.col("before"))
    mixed = order.withColumn("served", served).where("served > 0")
    copies = mixed.groupBy("row").agg(F.sum("served").alias("taken"), F.sort_array(F.collect_list(F.struct("pass", "v_start", "v_finish", "served"))).alias("copies"))
    none = F.array().cast("array<struct<pass:int,v_start:double,v_finish:double,served:bigint>>")
    found = rows.join(copies, "row", "left")
    return found.select(F.col("id").alias(id), F.col("src").alias(source), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("copies", none).alias("copies"))


def mix_stream(queue: DataFrame, id: str = "doc_id") -> DataFrame:
    """The mix itself: every served copy of ``queue`` (from fair_queue),
    range-sorted by virtual finish time, then id, then pass. Rows of size 0 are
    not in it; a very long text is one copy like others; null ids come first among equals; repeated rows are copies of
    their own; an empty queue gives none."""
    return (
        queue.select(*(c for c in queue.columns if c != "copies"), F.explode("copies").alias("c"))
        .select("*", F.col("c.pass").alias("pass"), F.col("c.v_finish").alias("v_finish"), F.col("c.served").alias("served"))
        .drop("c")
        .orderBy("v_finish", id, "pass")
    )

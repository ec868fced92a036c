"""Secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. Only
(blob, rule version) pairs that the ledger has not seen are scanned, each once
however many paths hold the blob, and findings join back to all paths.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """A pattern without empty matches. Matches are leftmost and do not
    overlap; then those are dropped whose group ``group`` is shorter than
    ``least``. Where ``lead`` is not 0, that group (what must stand before) is
    matched but is no part of the span. Patterns are for Java and RE2 alike and
    take time in proportion to the text: no match can start inside a run that an
    earlier start has read to its end."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    base: bool = True
    lead: int = 0


#: The base kinds in their listed order, then added ones.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60, False),
    Rule("jwt", 2, r"(^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 2, 30, False, 1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
)


BASE_RULES = tuple(r for r in RULES if r.base)
LEDGER = "blob binary, kind string, version int"


def blob_of(text: str | Column) -> Column:
    """A text's address: the SHA-256 of its UTF-8 bytes, 32 of them."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def unseen(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rep, pairs): the distinct blobs of ``paths`` for which the ledger
    (blob, kind, version) lacks rules, those rules, and one id that has the blob."""
    blobs = paths.groupBy("blob").agg(F.min("id").alias("rep"))
    listed = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    known = ledger.groupBy(F.col("blob").alias("known")).agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
    both = blobs.join(known, F.col("blob") == F.col("known"), "left")
    lacking = F.filter(listed, lambda x: ~F.coalesce(F.array_contains("seen", x), F.lit(False)))
    return both.select("blob", "rep", lacking.alias("pairs")).where(F.size("pairs") > 0)


def _matches(rule: Rule, text: Column) -> Column:
    """Array of (kind, base, i, gap, len, part): per match its number, the code
    points since the last match, its length and that of the rule's group."""
    re_ = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, re_, F.lit(0))
    part = F.regexp_extract_all(text, re_, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits))
    lead = F.regexp_extract_all(text, re_, F.lit(rule.lead)) if rule.lead else None
    zipped = F.arrays_zip(hits.alias("h"), part.alias("p"), gaps.alias("g"), *([] if lead is None else [lead.alias("b")]))
    before = lambda m: F.lit(0) if lead is None else F.length(m["b"])
    return F.transform(
        zipped,
        lambda m, i: F.struct(
            F.lit(rule.kind).alias("kind"), i.alias("i"), (F.length(m["g"]) + before(m)).alias("gap"), (F.length(m["h"]) - before(m)).alias("len"), F.length(m["p"]).alias("part")
        ),
    )


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, findings, ledger): paths is (id, version, blob) for every row, a
    path having as many versions as it has rows; findings is one row per blob in
    which the rules scanned now found any: (blob, spans: array of (start, rank,
    kind, end, base) in order of start, then rule); ledger is the (blob, kind,
    version) pairs scanned now, to be appended to the one given.

    Each unseen blob is scanned once, by the rules that the ledger lacks for it,
    after its text was picked out of all rows that hold it. Null texts are the
    empty blob. A very long text is one row. Null ids are kept (a blob whose ids
    are all null is scanned under the null id). An empty table gives empty
    results; other columns of ``docs`` are ignored. Paths are written to the
    shared folder while the result is built.
    """
    spark = docs.sparkSession
    which = F.lit(None).cast("string") if version is None else F.col(version)
    paths = cut(docs.select(F.col(id).alias("id"), which.alias("version"), blob_of(text).alias("blob")), "paths")
    todo = unseen(paths, empty_ledger(spark) if ledger is None else ledger, rules).withColumnRenamed("blob", "todo_blob")
    name = lambda c: F.coalesce(F.concat(F.lit("i"), F.col(c).cast("string")), F.lit("n"))
    named = docs.select(name(id).alias("name"), blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the list of representatives is the built side, so texts are shuffled once, copies of a blob by their ids;
    # rows equal in both lie together already
    reps = todo.select("todo_blob", name("rep").alias("rep"), "pairs")
    fresh = named.join(reps.hint("shuffle_hash"), (named["blob"] == reps["todo_blob"]) & (named["name"] == reps["rep"]))
    fresh = fresh.select("blob", "name", "text", F.transform("pairs", lambda x: x["kind"]).alias("kinds")).dropDuplicates(["blob", "name"])
    empty = F.lit([]).cast("array<struct<kind:string,i:int,gap:int,len:int,part:int>>")
    found = [F.when(F.array_contains("kinds", r.kind) & F.col("text").rlike(r.pattern), _matches(r, F.col("text"))).otherwise(empty) for r in rules]
    hits = fresh.select("blob", F.concat(*found).alias("m")).where(F.size("m") > 0).select("blob", F.inline("m"))
    upto = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    least = reduce(lambda a, r: a.when(F.col("kind") == r.kind, F.lit(r.least)), rules[1:], F.when(F.col("kind") == rules[0].kind, F.lit(rules[0].least)))
    places = list(enumerate(r.kind for r in RULES)) + [(len(RULES) + i, r.kind) for i, r in enumerate(rules)]
    rank = reduce(lambda a, ik: a.when(F.col("kind") == ik[1], F.lit(ik[0])), places[1:], F.when(F.col("kind") == places[0][1], F.lit(places[0][0])))
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    span = F.struct("start", rank.alias("rank"), "kind", "end", base.alias("base"))
    findings = hits.where(F.col("part") >= least).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    seen = todo.select(F.col("todo_blob").alias("blob"), F.inline("pairs"))
    return paths, findings, seen


def increments(steps: Iterable[tuple[DataFrame, tuple[Rule, ...]]], id: str = "doc_id", text: str = "text", version: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``scan`` gives for a history of (documents, rules), each scanned with
    the ledger of those before: the last one's paths, the findings of all, one
    row per blob, and the whole ledger. A step scans new blobs, and old ones by
    new rules or rule versions only; ledgers and findings are written after each.
    Every step's documents may be any table, empty ones included."""
    ledger = found = paths = None
    for docs, rules in steps:
        paths, now, seen = scan(docs, ledger, rules, id, text, version)
        now, seen = cut(now, "findings"), cut(seen, "ledger")
        ledger = seen if ledger is None else ledger.unionByName(seen)
        found = now if found is None else found.unionByName(now)
    if paths is None:
        raise ValueError("no steps")
    merged = found.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    return paths, merged, ledger


def by_path(paths: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, version, blob, spans) for every version of a path; spans is empty where
    nothing was found."""
    none = F.lit([]).cast(findings.schema["spans"].dataType)
    return paths.join(findings, "blob", "left").select("id", "version", "blob", F.coalesce("spans", none).alias("spans"))


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans become one."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    one = F.lit(mark)

    def step(a, s):
        gap = F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        grown = F.struct(s["end"].cast("long").alias("at"), F.concat(a["out"], gap, one).alias("out"))
        inner = F.struct(F.greatest(a["at"], s["end"].cast("long")).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], grown).otherwise(inner)

    rest = lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int")))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, rest))

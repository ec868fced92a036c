"""Property-graph tables and expansion over them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.components import connected_components
from tidemark.operators.matching import containing, first_names
from tidemark.plans.lineage import cut
from tidemark.plans.order import previous


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``old`` with ``new`` merged in: the last row of a key, by ``order``, wins,
    rows of ``new`` over rows of ``old``."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"), *(F.desc(c) for c in order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_batch")


def unique_violations(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def chunk_table(docs: DataFrame, id: str = "doc_id", body: str = "text", max_chars: int = 90) -> DataFrame:
    """(chunk_id, doc_id, ordinal, text): chunks with ids made of the source's
    id and the ordinal, so loading again changes nothing."""
    cut = docs.select(F.col(id).alias("doc_id"), F.posexplode(text.chunks(F.col(body), max_chars)).alias("ordinal", "text"))
    return cut.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "doc_id", "ordinal", "text")


def faq_chunks(faq: DataFrame, order: str) -> DataFrame:
    """(chunk_id, ordinal, text, source, category, question, answer): a chunk for
    every question, whose text, question and answer, is what gets embedded. Ids
    are made of the column ``order``, which is also the ordinal; a null question
    or answer counts as empty."""
    said = text.embedding_text(F.col("question"), F.col("answer"), " ")
    id = F.concat(F.lit("faq:"), F.col(order).cast("string"))
    return faq.select(id.alias("chunk_id"), F.col(order).alias("ordinal"), said.alias("text"), F.lit("faq").alias("source"), "category", "question", "answer")


def sections(docs: DataFrame, body: str = "text") -> DataFrame:
    """Rows of ``docs`` by '## ' section: columns pos, title, section_text."""
    parts = F.filter(F.transform(F.split(F.col(body), r"\n?## "), text.strip), lambda x: x != "")
    rows = docs.select("*", F.posexplode(parts).alias("pos", "part"))
    cut = F.instr("part", "\n")
    title = F.when(cut > 0, text.strip(F.substring_index("part", "\n", 1))).otherwise(F.col("part"))
    rest = F.when(cut > 0, text.strip(F.substr("part", cut + 1))).otherwise(F.lit(""))
    return rows.select("*", title.alias("title"), rest.alias("section_text")).drop("part")


def next_edges(nodes: DataFrame, group: list[str], order: list[str], id: str = "chunk_id") -> DataFrame:
    """(src, dst) between neighbours of a group in order. All nodes are sorted by
    group and order in ranges, so a group may be any share of them."""
    before = F.struct(F.struct(*group).alias("g"), F.col(id).alias("i"))
    rows = previous(nodes.select(*dict.fromkeys([*group, *order, id])), [*group, *order], before, "_before")
    same = F.struct(*group).eqNullSafe(F.col("_before.g")) & F.col("_before").isNotNull()
    return rows.where(same).select(F.col("_before.i").alias("src"), F.col(id).alias("dst"))


def mentions(nodes: DataFrame, entities: Column, canonical: DataFrame | None = None, id: str = "chunk_id") -> DataFrame:
    """(chunk_id, entity), distinct; entities are replaced by their canonical
    names where ``canonical`` (name, canonical) has them."""
    found = nodes.select(F.col(id).alias("chunk_id"), F.explode(entities).alias("entity"))
    if canonical is not None:
        found = found.join(canonical, found["entity"] == canonical["name"], "left").select("chunk_id", F.coalesce("canonical", "entity").alias("entity"))
    return found.distinct()


#: Tokens that two similar names must share in their prefixes.
SHARED = 3


def _triples(p: Column) -> Column:
    """A hash of every three elements of an array, in order."""
    after = lambda i: F.slice(p, i + 2, F.size(p))
    three = lambda x, y: lambda z: F.xxhash64(x, y, z)
    two = lambda x, i: lambda y, j: F.transform(F.slice(p, i + j + 3, F.size(p)), three(x, y))
    return F.flatten(F.transform(p, lambda x, i: F.flatten(F.transform(after(i), two(x, i)))))


def similar_names(names: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, score) for pairs of ``names`` (rank, name) with token Jaccard at
    least ``threshold``, a before b.

    Prefix filtering: with tokens sorted from rare to common, two sets that
    similar share three of their first |s| - ceil(t |s|) + 3 tokens, and their
    sizes differ by the factor t at most; pairs are made only where both hold.
    Sets of so few tokens that three need not be common meet by one token.
    """
    sets = names.select("rank", "name", text.tokens(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    each = sets.select("rank", F.explode("tokens").alias("token"))
    freq = each.groupBy("token").agg(F.count("*").alias("df"))
    ordered = each.join(freq, "token").groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    size = F.size("o")
    first = lambda k: F.transform(F.slice("o", F.lit(1), (size - F.ceil(F.lit(threshold) * size) + k).cast("int")), lambda x: x["token"])
    small = max(n for n in range(64) if math.ceil(threshold * n) < SHARED)
    keys = F.concat(
        F.when(F.ceil(F.lit(threshold) * size) >= SHARED, _triples(first(SHARED))).otherwise(F.array().cast("array<bigint>")),
        F.when(threshold * size <= small, F.transform(first(1), lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")),
    )
    p = ordered.select("rank", size.alias("n"), F.explode(keys).alias("key"))
    a, b = p.alias("a"), p.alias("b")
    near = (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rank") < F.col("b.rank")) & near).select(F.col("a.rank").alias("a"), F.col("b.rank").alias("b")).distinct()
    s = sets.select("rank", "tokens")
    both = pairs.join(s.select(F.col("rank").alias("a"), F.col("tokens").alias("ta")), "a").join(s.select(F.col("rank").alias("b"), F.col("tokens").alias("tb")), "b")
    return both.select("a", "b", text.jaccard(F.col("ta"), F.col("tb")).alias("score")).where(F.col("score") >= threshold)


def canonical_names(raw: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(name, canonical) from (ordinal, name): similar names, directly or by a
    chain, share the name first seen among them."""
    names = raw.groupBy("name").agg(F.min("ordinal").alias("rank"))
    comp = connected_components(similar_names(names, threshold), "a", "b").select(F.col("node").alias("rank"), "component")
    placed = names.join(comp, "rank", "left").select("name", F.coalesce("component", "rank").alias("top"))
    return placed.join(names.select(F.col("rank").alias("top"), F.col("name").alias("canonical")), "top").select("name", "canonical")


def adjacent(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node_id, seed_ordinal, way): neighbours of seed chunks
    (query_id, node_id, ordinal), those after (0) and before (1)."""
    s = cut(seeds.select("query_id", F.col("node_id").alias("seed"), F.col("ordinal").alias("seed_ordinal")), "seeds")
    after = s.join(edges, s["seed"] == edges["src"]).select("query_id", F.col("dst").alias("node_id"), "seed_ordinal", F.lit(0).alias("way"))
    before = s.join(edges, s["seed"] == edges["dst"]).select("query_id", F.col("src").alias("node_id"), "seed_ordinal", F.lit(1).alias("way"))
    return after.unionByName(before)


#: Chunks that mention an entity beyond which it is not joined but counted where chunks lie; chunks and queries that
#: meet in one task, and how many entities each of them has there at most, taken over all.
HEAVY = 512
PART_CHUNKS = 16_384
TILE_QUERIES = 1_024
LINKS = 32


def _best_sharing():
    """Of a part of the chunks the best of each query: how many of a query's
    entities each chunk has, counted for one query at a time."""

    def run(asked: pa.Table, links: pa.Table) -> pa.Table:
        kinds = (asked.schema.field("query_id").type, links.schema.field("node_id").type, pa.int64())
        out = [[pa.array([], t)] for t in kinds]
        if asked.num_rows and links.num_rows:
            ids, at = np.unique(links["node_id"].to_numpy(), return_inverse=True)
            place = {c: i for i, c in enumerate(ids.tolist())}
            entities = pa.concat_tables([asked.select(["entity"]), links.select(["entity"])])["entity"].combine_chunks().dictionary_encode().indices.to_numpy()
            mine, theirs = entities[: asked.num_rows], entities[asked.num_rows :]
            order = np.lexsort((at, theirs))
            at, theirs = at[order], theirs[order]
            lo, hi = (np.searchsorted(theirs, mine, side) for side in ("left", "right"))
            queries = asked["query_id"].combine_chunks().dictionary_encode()
            code, most, only = queries.indices.to_numpy(), asked["most"].to_numpy(), asked["only_seed"].to_pylist()
            by_query = np.argsort(code, kind="stable")
            for rows in np.split(by_query, np.flatnonzero(np.diff(code[by_query])) + 1):
                shared = np.zeros(len(ids), np.int64)
                for i in rows.tolist():
                    has = at[lo[i] : hi[i]]
                    shared[has] += 1
                    if only[i] in place:  # an entity that only one seed has is not shared with that seed
                        seed = place[only[i]]
                        n = np.searchsorted(has, seed)
                        shared[seed] -= n < len(has) and has[n] == seed
                limit = most[rows[0]]
                above = np.cumsum(np.bincount(shared)[:0:-1])[::-1]  # chunks that share 1 or more, 2 or more, ...
                cut = max(1, int((above >= limit).sum()))
                some = np.flatnonzero(shared > cut)
                some = np.r_[some, np.flatnonzero(shared == cut)[: limit - len(some)]]
                out[0].append(queries.dictionary.take(pa.array(np.full(len(some), code[rows[0]]))))
                out[1].append(pa.array(ids[some], kinds[1]))
                out[2].append(pa.array(shared[some]))
        return pa.table([pa.chunked_array(o, t) for o, t in zip(out, kinds, strict=True)], names=["query_id", "node_id", "shared"]).combine_chunks()

    return run


def sharing(seeds: DataFrame, links: DataFrame, per_seed: int = 3, heavy: int = HEAVY) -> DataFrame:
    """(query_id, node_id, shared, n): chunks that mention what a query's seeds
    mention, by the number of such entities, ``per_seed`` for each seed.

    Chunks that mention none of the asked entities of over ``heavy`` chunks are
    found by a join on the entity. The others, a hub's chunks, stay in parts of
    bounded size that meet tiles of queries, and a part sends on only as many
    chunks of a query as its limit, so a hub gives no pairs of all its chunks.
    Seeds and links are read several times, so they are written once, by jobs that
    run while the result is built.
    """
    s = cut(seeds.select("query_id", F.col("node_id").alias("seed")), "seeds")
    limits = s.groupBy("query_id").agg((F.count("*") * per_seed).alias("most"))
    other = cut(links.select(F.col("chunk_id").alias("node_id"), "entity").where("entity is not null").distinct(), "links")
    mine = s.join(other.withColumnRenamed("node_id", "seed"), "seed").groupBy("query_id", "entity")
    mine = mine.agg(F.count_distinct("seed").alias("seeds"), F.min("seed").alias("seed"))
    mine = cut(mine.select("query_id", "entity", F.when(F.col("seeds") == 1, F.col("seed")).alias("only_seed")), "asked")

    hubs = other.groupBy("entity").agg(F.count("*").alias("chunks")).where(F.col("chunks") > heavy).select("entity")
    asked_hubs = hubs.join(mine.select("entity").distinct(), "entity", "left_semi")
    crowd = other.join(asked_hubs, "entity", "left_semi").select("node_id").distinct()
    rare = other.join(crowd, "node_id", "left_anti").join(hubs, "entity", "left_anti")
    met = mine.join(rare, "entity").where("only_seed is null or only_seed <> node_id").groupBy("query_id", "node_id").agg(F.count("*").alias("shared"))

    parts = max(1, -(-crowd.count() // PART_CHUNKS), -(-other.count() // (PART_CHUNKS * LINKS)))
    tiles = max(1, -(-limits.count() // TILE_QUERIES), -(-mine.count() // (TILE_QUERIES * LINKS)))
    dealt = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = mine.join(limits, "query_id").select("query_id", "entity", "only_seed", "most", dealt("query_id", tiles, "tile"), every(parts, "part"))
    held = other.join(crowd, "node_id", "left_semi").select("node_id", "entity", dealt("node_id", parts, "part"), every(tiles, "tile"))
    kinds = [f"query_id {seeds.schema['query_id'].dataType.simpleString()}", f"node_id {links.schema['chunk_id'].dataType.simpleString()}"]
    asked, held = (df.toDF(*df.columns) for df in (asked, held))  # both come from the links: columns of their own
    best = asked.groupBy("part", "tile").cogroup(held.groupBy("part", "tile")).applyInArrow(_best_sharing(), f"{', '.join(kinds)}, shared long")

    w = Window.partitionBy("query_id").orderBy(F.desc("shared"), "node_id")
    found = met.unionByName(best).withColumn("n", F.row_number().over(w))
    return found.join(limits, "query_id").where("n <= most").select("query_id", "node_id", "shared", "n")


def expansion(seeds: DataFrame, edges: DataFrame, links: DataFrame, per_seed: int = 3) -> DataFrame:
    """(query_id, node_id, expansion_type, shared, ordinal): chunks next to the
    seeds, then chunks that share entities; a chunk found twice counts once, as
    first found, and seeds are left out. The limit on shared ones comes before
    what was seen is left out, so fewer may come back. Seeds are written first."""
    seeds = cut(seeds.select("query_id", "node_id", "ordinal"), "seeds")
    step1 = adjacent(seeds, edges).withColumns({"stage": F.lit(0), "shared": F.lit(None).cast("long")})
    step1 = step1.select("query_id", "node_id", "stage", "seed_ordinal", "way", "shared")
    step2 = sharing(seeds, links, per_seed).select("query_id", "node_id", F.lit(1).alias("stage"), F.col("n").alias("seed_ordinal"), F.lit(0).alias("way"), "shared")
    found = step1.unionByName(step2).join(seeds.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    first = Window.partitionBy("query_id", "node_id").orderBy("stage", "seed_ordinal", "way")
    once = found.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    order = Window.partitionBy("query_id").orderBy("stage", "seed_ordinal", "way", "node_id")
    kind = F.when(F.col("stage") == 0, "adjacent").otherwise("shared_entity")
    return once.select("query_id", "node_id", kind.alias("expansion_type"), "shared", F.row_number().over(order).alias("ordinal"))


def lookup_by_name(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, query, name): the first name, by length then alphabet, that
    contains the query or lies in it, letter case aside. ``queries`` is the
    stated set, dealt out to every task; a task sends its first name a query.
    Equal queries are sought once and equal names looked at once."""
    asked = queries.select(F.lower("query").alias("low")).distinct()
    hit = first_names(asked.select(F.col("low").alias("query_id"), "low"), names.select("name").distinct().select("name", F.lower("name").alias("low")))
    best = hit.groupBy(F.col("query_id").alias("low")).agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("best"))
    return queries.withColumn("low", F.lower("query")).join(best, "low").select("query_id", "query", F.col("best.name").alias("name"))


def list_items(items: DataFrame, category: str | None = None) -> DataFrame:
    """(name, price, category, description) of all items or of one category; a
    missing description is empty."""
    kept = items if category is None else items.where(F.col("category") == category)
    return kept.select("name", "price", "category", F.coalesce("description", F.lit("")).alias("description"))


def first_answers(keywords: DataFrame, faq: DataFrame, default: str) -> DataFrame:
    """(keyword_id, answer): that of the first question, by its ``ordinal``, which
    has the keyword in it, letter case aside, else ``default``. keywords:
    (keyword_id, keyword), faq: (ordinal, question, answer)."""
    found = containing(faq.select(F.col("ordinal").alias("text_id"), F.lower("question").alias("text")), keywords.select(F.col("keyword_id").alias("pattern_id"), F.lower("keyword").alias("pattern")))
    first = found.groupBy(F.col("pattern_id").alias("keyword_id")).agg(F.min("text_id").alias("ordinal"))
    known = first.join(faq.select("ordinal", text.strip(F.col("answer")).alias("answer")), "ordinal").select("keyword_id", "answer")
    return keywords.select("keyword_id").join(known, "keyword_id", "left").select("keyword_id", F.coalesce("answer", F.lit(default)).alias("answer"))

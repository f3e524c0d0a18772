"""Entities and edges: merging, degrees, neighbourhoods, paths, propagation and communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import entity_key
from quillspan.plans.spool import spool

DECAY, HOPS = 0.6, 2


#: Types that say little; one other mention outweighs any number of these.
GENERIC = ("", "entity", "concept", "other", "unknown", "misc")
RESOLVED = 0.92
BLOCK, PREFIX = 2_000, 3


def entities(mentions: DataFrame) -> DataFrame:
    """mentions(name, type, description, chunk_id) -> (type, key, name, aliases, descriptions, chunk_ids, mentions), a row per type and entity key.

    The longest name stands for the entity (ties: the first in order); aliases are its other names, descriptions the
    distinct ones in order, chunk_ids where it is mentioned. Mentions without a name are left out.
    """
    keyed = mentions.withColumn("key", entity_key(F.col("name"))).where("key <> ''")
    by = keyed.groupBy("type", "key").agg(
        F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("n"), F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set(F.when(F.trim("description") != "", F.trim("description")))).alias("descriptions"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.count("*").alias("mentions"))
    return by.select("type", "key", F.col("n.name").alias("name"), F.array_remove("names", F.col("n.name")).alias("aliases"), "descriptions", "chunk_ids", "mentions")


def merged_entities(mentions: DataFrame) -> DataFrame:
    """mentions(name, type, chunk_id) -> one row per (type, entity key): the longest name, the aliases' and chunks' numbers."""
    keyed = mentions.withColumn("key", entity_key(F.col("name"))).where("key <> ''")
    by = keyed.groupBy("type", "key").agg(F.max(F.struct(F.length("name"), "name")).alias("n"), F.countDistinct("name").alias("aliases"), F.countDistinct("chunk_id").alias("chunks"))
    return by.select("type", "key", F.col("n.name").alias("name"), "aliases", "chunks")


def majority_type(mentions: DataFrame) -> DataFrame:
    """mentions(key, type) -> (key, type): the most frequent type, generic ones counting a thousandth; ties go to the first in order."""
    weight = F.when(F.lower(F.trim(F.coalesce("type", F.lit("")))).isin(*GENERIC), 1).otherwise(1000)
    by = mentions.groupBy("key", "type").agg(F.sum(weight).alias("w"))
    return by.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "type")).alias("x")).select("key", "x.type")


def blocks(named: DataFrame) -> DataFrame:
    """named(node, type, key) -> with `block`: type and the key's first letters, one more letter (up to PREFIX) for blocks above BLOCK rows."""
    out = named.withColumn("block", F.concat_ws("|", "type", F.substring("key", 1, 1)))
    for letters in range(2, PREFIX + 1):
        size = out.groupBy("block").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK)
        out = out.join(F.broadcast(size), "block", "left").withColumn("block", F.when(F.col("_n").isNotNull(), F.concat_ws("|", "type", F.substring("key", 1, letters))).otherwise(F.col("block"))).drop("_n")
    return out


def similar_names(named: DataFrame, threshold: float = RESOLVED) -> DataFrame:
    """named(node, type, key, v) -> (a, b, similarity), a < b: pairs of a block with cosine at or above the threshold whose words don't conflict.

    Words conflict where two keys share some and each has others of its own ("north harbor", "south harbor"). A block is
    multiplied in tiles of BLOCK rows, so that none is larger than a task; pairs come out only above the threshold.
    """
    placed = blocks(named).withColumn("tile", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int"))
    size = placed.groupBy("block").agg(F.count("*").alias("_n"))
    tiles = placed.join(size, "block").withColumn("tiles", F.least(F.lit(16), F.ceil(F.col("_n") / BLOCK)).cast("int")).withColumn("tile", F.col("tile") % F.col("tiles"))
    meet = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.concat_ws("|", F.least(t, F.col("tile")), F.greatest(t, F.col("tile"))))
    rows = tiles.select("block", "node", "key", "v", "tile", F.explode(meet).alias("pair"))
    kind = dict(named.dtypes)["node"]

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        x = np.stack(f["v"].to_numpy()).astype(np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        i, j = np.nonzero(np.triu(np.round(x @ x.T, 6) >= threshold, 1))
        same = f["pair"].iloc[0].split("|")
        tile, words, out = f["tile"].to_numpy(), [set(k.split()) for k in f["key"]], []
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if (same[0] == same[1] or tile[a] != tile[b]) and not (words[a] & words[b] and words[a] - words[b] and words[b] - words[a]):
                out.append((f["node"].iloc[a], f["node"].iloc[b], float(np.round(x[a] @ x[b], 6))))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    return rows.groupBy("block", "pair").applyInPandas(run, f"a {kind}, b {kind}, similarity double")


def resolved(named: DataFrame, threshold: float = RESOLVED) -> DataFrame:
    """named(node, type, key, v) -> (node, entity): nodes of equal type and key, then of similar names, under their smallest node."""
    exact = named.withColumn("_first", F.min("node").over(Window.partitionBy("type", "key"))).where("node <> _first").select(F.col("_first").alias("src"), F.col("node").alias("dst"))
    near = similar_names(named, threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    joined = components(exact.unionByName(near))
    return named.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("entity"))


def rewritten(relations: DataFrame, canonical: DataFrame) -> DataFrame:
    """relations(src, dst, type, weight, chunk_id), canonical(node, entity) -> (src, dst, type, weight, chunk_ids) of entities.

    The weight of a relation is its largest within a chunk and summed over chunks; loops are dropped. Ends that aren't
    known stay as they are.
    """
    at = lambda x: canonical.select(F.col("node").alias(x), F.col("entity").alias(f"_{x}"))
    both = relations.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    ends = both.select(F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst"), "type", "weight", "chunk_id").where("src <> dst")
    within = ends.groupBy("src", "dst", "type", "chunk_id").agg(F.max("weight").alias("weight"))
    return within.groupBy("src", "dst", "type").agg(F.round(F.sum("weight"), 6).alias("weight"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def upserted_relations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(src, dst, type, weight, chunk_ids): the incoming weight is added unless all of its chunks are known already; chunks are united."""
    key = ["src", "dst", "type"]
    new = incoming.select(*key, F.col("weight").alias("_w"), F.col("chunk_ids").alias("_c"))
    both = stored.join(new, key, "full_outer")
    fresh = F.size(F.array_except(F.coalesce("_c", F.array().cast("array<string>")), F.coalesce("chunk_ids", F.array().cast("array<string>")))) > 0
    weight = F.coalesce("weight", F.lit(0.0)) + F.when(F.col("weight").isNull() | fresh, F.coalesce("_w", F.lit(0.0))).otherwise(0.0)
    return both.select(*key, F.round(weight, 6).alias("weight"), F.array_sort(F.array_union(F.coalesce("chunk_ids", F.array().cast("array<string>")), F.coalesce("_c", F.array().cast("array<string>")))).alias("chunk_ids"))


def without_chunks(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows(..., chunk_ids) without the chunks gone(chunk_id); rows that nothing supports any more are dropped."""
    flat = rows.withColumn("_row", F.xxhash64(*[F.col(c) for c, t in rows.dtypes if not t.startswith("map")])).withColumn("chunk_id", F.explode("chunk_ids"))
    left = flat.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")
    kept = [c for c in rows.columns if c != "chunk_ids"]
    return left.groupBy("_row", *kept).agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids")).select(*rows.columns)


def mentions_of(found: DataFrame) -> DataFrame:
    """entities(key, chunk_ids) -> (key, chunk_id): which entity is mentioned where."""
    return found.select("key", F.explode(F.array_distinct("chunk_ids")).alias("chunk_id"))


def collapsed_edges(edges: DataFrame) -> DataFrame:
    """edges(src, dst, weight), directed and repeated -> one undirected edge per pair, without loops; negative weights count 0."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.where("src <> dst").groupBy(a.alias("src"), b.alias("dst")).agg(F.round(F.sum(F.greatest("weight", F.lit(0.0))), 6).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): the edges of each node, and that over the highest."""
    by = spool(both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")))
    highest = by.agg(F.max("degree").alias("most"))
    return by.join(F.broadcast(highest)).select("node", "degree", F.round(F.col("degree") / F.col("most"), 6).alias("centrality"))  # one row


def ways_of(edges: DataFrame) -> DataFrame:
    """Edges in both directions as a spooled table, read again at each step. Edges must be collapsed: each pair once."""
    return spool(both_ways(edges))


def neighbors(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(seed, node, hops): every node within so many steps of each seed, at its least number of steps."""
    ways = ways_of(edges).select("src", "dst")
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(ways, front.node == ways.src).select("seed", F.col("dst").alias("node")).distinct()
        front = step.join(seen, ["seed", "node"], "left_anti").withColumn("hops", F.lit(h))
        if h < hops:
            front = spool(front)
        seen = seen.unionByName(front)
    return seen.where("hops > 0")


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, limit: int = 100) -> DataFrame:
    """(seed, src, dst, weight): the heaviest edges among each seed's neighbourhood, the seed included, cut to `limit` a seed (a row budget)."""
    around = spool(neighbors(edges, seeds, hops).select("seed", "node").unionByName(seeds.select("seed", F.col("seed").alias("node"))))
    a, b = around.withColumnRenamed("node", "src"), around.withColumnRenamed("node", "dst")
    inside = edges.join(a, "src").join(b, ["seed", "dst"]).select("seed", "src", "dst", "weight")
    w = Window.partitionBy("seed").orderBy(F.desc("weight"), "src", "dst")
    return inside.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def shortest_paths(edges: DataFrame, starts: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """(start, goal, hops, paths, score): all shortest paths from each start to each end within so many steps.

    Paths are counted and their weights summed instead of written out: a level carries per (start, node) the number of
    shortest paths and the sum of their weights, so its size is nodes, not paths. score is the mean weight per step.
    """
    ways = ways_of(edges)
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(1).cast("bigint").alias("paths"), F.lit(0.0).alias("total"))
    front = seen
    for h in range(1, hops + 1):
        step = front.join(ways, front.node == ways.src).groupBy("start", F.col("dst").alias("node")).agg(F.sum("paths").alias("p"), F.sum(F.col("total") + F.col("paths") * F.col("weight")).alias("total"))
        front = spool(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(h).alias("hops"), F.col("p").alias("paths"), "total"))
        seen = seen.unionByName(front)
    hit = seen.where("hops > 0").join(ends.select(F.col("goal").alias("node")), "node")
    return hit.select("start", F.col("node").alias("goal"), "hops", "paths", F.round(F.col("total") / F.col("paths") / F.col("hops"), 6).alias("score"))


def propagate(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, decay: float = DECAY) -> DataFrame:
    """seeds(node, weight) -> (node, weight): each step hands on decay * weight, and a node keeps the highest it gets."""
    ways = ways_of(edges).select("src", "dst")
    now = seeds.groupBy("node").agg(F.max("weight").alias("weight"))
    for h in range(hops):
        handed = now.join(ways, now.node == ways.src).select(F.col("dst").alias("node"), (F.col("weight") * decay).alias("weight"))
        now = now.unionByName(handed).groupBy("node").agg(F.max("weight").alias("weight"))
        if h + 1 < hops:
            now = spool(now)
    return now.select("node", F.round("weight", 6).alias("weight"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): connected components by the smallest node.

    Alternating large and small stars: every round links each node's neighbours to the smallest one around, which needs a
    number of rounds that grows with the logarithm of the longest path; hot nodes are aggregated, never collected.
    """
    now = spool(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    for _ in range(most_rounds):
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sides.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.unionByName(large.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("v <= u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        nxt = spool(small)
        if nxt.exceptAll(now).isEmpty() and now.exceptAll(nxt).isEmpty():
            break
        now = nxt
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    alone = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.unionByName(alone.select("node", F.col("node").alias("component")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): synchronous label propagation by summed weight, a node's own label with the weight of its strongest edge.

    Ties go to the smallest label, so the result is the same for the same edges. This stands in for modularity
    optimization, of which Spark has no distributed form.
    """
    ways = spool(both_ways(edges))
    own = ways.groupBy(F.col("src").alias("node")).agg(F.max("weight").alias("keep"))
    labels = own.select("node", F.col("node").alias("label"), "keep")
    for _ in range(rounds):
        heard = ways.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
        said = heard.unionByName(labels.select("node", "label", F.col("keep").alias("w"))).groupBy("node", "label").agg(F.round(F.sum("w"), 6).alias("w"))
        best = said.groupBy("node").agg(F.max(F.struct("w", (-F.col("label")).alias("n"))).alias("b")).select("node", (-F.col("b.n")).alias("label"))
        labels = spool(best.join(own, "node"))
    return labels.select("node", "label")


def community_ranks(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members(node, label) -> (label, size, inner_weight, rank): 10 * (half the scaled log of size and half that of weight)."""
    side = lambda x: members.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    inner = edges.join(side("src"), "src").join(side("dst"), "dst").where("l_src = l_dst").groupBy(F.col("l_src").alias("label")).agg(F.sum("weight").alias("inner_weight"))
    by = members.groupBy("label").agg(F.count("*").alias("size")).join(inner, "label", "left").fillna({"inner_weight": 0.0})
    ends = by.agg(*[f(F.log1p(c)).alias(f"{n}_{c}") for c in ("size", "inner_weight") for n, f in (("lo", F.min), ("hi", F.max))])
    scale = lambda c: F.when(F.col(f"hi_{c}") - F.col(f"lo_{c}") > 1e-12, (F.log1p(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(1.0)
    out = by.join(F.broadcast(ends))  # one row
    return out.select("label", "size", F.round("inner_weight", 4).alias("inner_weight"), F.round(10 * (0.5 * scale("size") + 0.5 * scale("inner_weight")), 6).alias("rank"))


def bridges_between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(label_a, label_b, edges, weight): what links different communities."""
    side = lambda x: members.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))
    both = edges.join(side("src"), "src").join(side("dst"), "dst").where("l_src <> l_dst")
    return both.groupBy(F.least("l_src", "l_dst").alias("label_a"), F.greatest("l_src", "l_dst").alias("label_b")).agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


def hierarchy(edges: DataFrame, levels: int = 3, smallest: int = 3, rounds: int = 5) -> DataFrame:
    """(level, node, label): communities, and within each of at least 2 * smallest nodes its own communities, and so on.

    A community is named by its level and its smallest node; those under `smallest` nodes are left out.
    """
    inner, out = edges, None
    for level in range(levels):
        found = label_propagation(inner, rounds)
        small = found.groupBy("label").agg(F.min("node").alias("first"), F.count("*").alias("size")).where(F.col("size") >= smallest)
        named = spool(found.join(small, "label").select(F.lit(level).alias("level"), "node", F.col("first").alias("label"), "size"))
        out = named if out is None else out.unionByName(named)
        open_ = named.where(F.col("size") >= 2 * smallest)
        at = lambda x: open_.select(F.col("node").alias(x), F.col("label").alias(f"l_{x}"))  # noqa: E731, B023
        nxt = spool(inner.join(at("src"), "src").join(at("dst"), "dst").where("l_src = l_dst").select("src", "dst", "weight"))
        if nxt.isEmpty():
            break
        inner = nxt
    return out.drop("size")


def pruned_communities(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Stored communities (level, label, ...) that the current run has too."""
    return stored.join(current.select("level", "label").distinct(), ["level", "label"], "left_semi")


def titles(members: DataFrame) -> DataFrame:
    """members(label, name, type) -> (label, title): the first three names in order, how many more there are, and the type where all share one."""
    by = members.groupBy("label").agg(F.array_sort(F.collect_set("name")).alias("names"), F.collect_set("type").alias("types"))
    more = F.when(F.size("names") > 3, F.concat(F.lit(" (+"), (F.size("names") - 3).cast("string"), F.lit(" more)"))).otherwise("")
    kind = F.when(F.size("types") == 1, F.concat(F.col("types")[0], F.lit(": "))).otherwise("")
    return by.select("label", F.concat(kind, F.array_join(F.slice("names", 1, 3), ", "), more).alias("title"))


# Retrieval over the graph

#: Weights of an entity's, a relation's and a text's signal, and of seeds and graph hits in a merged list.
LOCAL, DRIFT, UNCONFIRMED = (0.40, 0.25, 0.35), (0.45, 0.55), 0.6


def max_scaled(column: str) -> Column:
    """A question's values over their largest; 0 where that isn't above 0."""
    most = F.max(column).over(Window.partitionBy("qid"))
    return F.when(most > 0, F.col(column) / most).otherwise(0.0)


def local_candidates(weights: DataFrame, mentions: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """weights(qid, node, weight), mentions(node, chunk_id), relations(src, dst, weight, chunk_id) -> (qid, chunk_id, entity, relation): a chunk's entity signal is the
    largest weight of its entities, its relation signal the sum of a relation's weight times its better end's; the 3 * limit best go on."""
    entity = weights.join(mentions, "node").groupBy("qid", "chunk_id").agg(F.max("weight").alias("entity"))
    ends = weights.select("qid", F.col("node").alias("src"), F.col("weight").alias("_e")).join(relations, "src").select("qid", "chunk_id", "src", "dst", "weight", "_e")
    ends = ends.unionByName(weights.select("qid", F.col("node").alias("dst"), F.col("weight").alias("_e")).join(relations, "dst").select("qid", "chunk_id", "src", "dst", "weight", "_e"))
    best = ends.groupBy("qid", "chunk_id", "src", "dst", "weight").agg(F.max("_e").alias("_e"))
    relation = best.groupBy("qid", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("_e")), 6).alias("relation"))
    both = entity.join(relation, ["qid", "chunk_id"], "full_outer").fillna(0.0, ["entity", "relation"])
    w = Window.partitionBy("qid").orderBy(F.desc(F.col("entity") + F.col("relation")), "chunk_id")
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3 * limit).drop("_r")


def local_ranks(candidates: DataFrame, similarities: DataFrame | None, limit: int) -> DataFrame:
    """candidates(qid, chunk_id, entity, relation), similarities(qid, chunk_id, similarity) -> (qid, chunk_id, score, rank): the weighted sum of
    the scaled signals; where a question has no similarities the other two weights are scaled up."""
    some = candidates.withColumn("similarity", F.lit(None).cast("double")) if similarities is None else candidates.join(similarities, ["qid", "chunk_id"], "left")
    some = some.withColumn("_has", F.max(F.col("similarity").isNotNull().cast("int")).over(Window.partitionBy("qid"))).withColumn("similarity", F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))))
    e, r, t = LOCAL
    score = (e * max_scaled("entity") + r * max_scaled("relation") + t * max_scaled("similarity")) / F.when(F.col("_has") == 1, e + r + t).otherwise(e + r)
    scored = some.withColumn("score", F.round(score, 6))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit).select("qid", "chunk_id", "score", "rank")


def seed_weights(matched: DataFrame, seeds: DataFrame) -> DataFrame:
    """matched(qid, node, score, chunk_ids), seeds(qid, chunk_ids) -> (qid, node, weight): entities that no seed chunk mentions count UNCONFIRMED of their score."""
    both = matched.join(seeds.select("qid", F.col("chunk_ids").alias("_seeds")), "qid", "left")
    confirmed = F.coalesce(F.arrays_overlap("chunk_ids", "_seeds"), F.lit(False))
    return both.select("qid", "node", F.round(F.when(confirmed, F.col("score")).otherwise(F.col("score") * UNCONFIRMED), 6).alias("weight"))


def drift_merged(seeds: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """seeds(qid, chunk_id, score), hits(qid, chunk_id, score) -> (qid, chunk_id, score, rank): scaled scores, weighted, added where a chunk is in both."""
    one = seeds.select("qid", "chunk_id", (F.lit(DRIFT[0]) * max_scaled("score")).alias("a"))
    two = hits.select("qid", "chunk_id", (F.lit(DRIFT[1]) * max_scaled("score")).alias("b"))
    both = one.join(two, ["qid", "chunk_id"], "full_outer").select("qid", "chunk_id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def question_entities(matched: DataFrame, floor: float = 0.35, most: int = 5) -> DataFrame:
    """matched(qid, key, score): each key at its best, those of at least `floor` of the question's best, `most` of them."""
    best = matched.groupBy("qid", "key").agg(F.max("score").alias("score")).withColumn("_top", F.max("score").over(Window.partitionBy("qid"))).where(F.col("score") >= floor * F.col("_top"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key")) - 1).where(F.col("place") < most).drop("_top")


def path_evidence(paths: DataFrame, path_chunks: DataFrame, limit: int) -> DataFrame:
    """paths(qid, path_id, score, hops), path_chunks(path_id, chunk_id, weight) -> (qid, chunk_id, score, rank): a chunk has its best path's scaled score; a path gives at most 2 * hops chunks."""
    scaled = paths.withColumn("scaled", max_scaled("score"))
    both = scaled.join(path_chunks, "path_id")
    turn = F.row_number().over(Window.partitionBy("qid", "path_id").orderBy(F.desc("weight"), "chunk_id"))
    best = both.withColumn("_r", turn).where(F.col("_r") <= 2 * F.col("hops")).groupBy("qid", "chunk_id").agg(F.round(F.max("scaled"), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < limit)


def verbalized(relations: DataFrame) -> DataFrame:
    """relations(src_name, type, dst_name, weight) -> with `line`: "a -[TYPE]-> b (2.5)"."""
    return relations.withColumn("line", F.format_string("%s -[%s]-> %s (%.1f)", "src_name", "type", "dst_name", "weight"))


def described(found: DataFrame, most: int = 240) -> DataFrame:
    """entities(name, type, descriptions) -> with `line`: the name, its type and its descriptions, clipped."""
    return found.withColumn("line", F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit("): "), F.substring(F.array_join("descriptions", " "), 1, most)))


def absorbed(mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was read from each chunk, tidied: mentions(chunk_id, name, type, description), relations(chunk_id, src, dst, type, weight).

    Names of a chunk that differ by case are one, under the longest form (ties: the first in order), with the longest
    description. Relations take these forms for their ends; those with an end that the chunk doesn't mention are dropped,
    as are loops; of equal ones the heaviest stays.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    keyed = mentions.withColumn("_k", key(F.col("name"))).where("_k <> ''")
    kept = keyed.groupBy("chunk_id", "_k").agg(F.min(F.struct((-F.length("name")).alias("l"), "name", "type")).alias("n"), F.max(F.struct(F.length("description").alias("l"), "description")).alias("d"))
    names = kept.select("chunk_id", "_k", F.col("n.name").alias("name"), F.col("n.type").alias("type"), F.col("d.description").alias("description"))
    end = lambda x: names.select("chunk_id", F.col("_k").alias(f"_{x}"), F.col("name").alias(f"_n{x}"))
    both = relations.withColumn("_a", key(F.col("src"))).withColumn("_b", key(F.col("dst"))).where("_a <> _b").join(end("a"), ["chunk_id", "_a"]).join(end("b"), ["chunk_id", "_b"])
    out = both.groupBy("chunk_id", F.col("_na").alias("src"), F.col("_nb").alias("dst"), "type").agg(F.max("weight").alias("weight"))
    return names.drop("_k"), out


def fulltext_entities(questions: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """questions(qid, text), entities(key, name, descriptions) -> (qid, key, score, rank): BM25 over names and descriptions."""
    from quillspan.operators.retrieval import bm25

    docs = found.select(F.col("key").alias("chunk_id"), F.concat_ws(" ", "name", F.array_join("descriptions", " ")).alias("text"))
    return bm25(questions, docs, k).withColumnRenamed("chunk_id", "key")


def report(title: str, found: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """entities(name, type, descriptions, degree), edges(src_name, type, dst_name, weight) -> (kind, place, line): the lines of a community's report that fit a token budget.

    Entities come first, by degree and name, with two thirds of the budget, then edges by weight; a title opens it. The
    lines are a prefix of each list.
    """
    from quillspan.functions.columns import approximate_tokens

    head = found.sparkSession.createDataFrame([("title", 0, title)], "kind string, place int, line string")
    lines = [("entity", described(found), [F.desc("degree"), F.asc("name")], budget * 2 // 3), ("edge", verbalized(edges), [F.desc("weight"), F.asc("line")], budget - budget * 2 // 3)]
    out = head
    for kind, df, order, part in lines:
        w = Window.partitionBy(F.lit(0)).orderBy(*order)  # a community's rows
        numbered = df.select(F.lit(kind).alias("kind"), F.row_number().over(w).alias("place"), "line", F.sum(approximate_tokens(F.col("line"))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
        out = out.unionByName(numbered.where(F.col("_upto") <= part).drop("_upto"))
    return out

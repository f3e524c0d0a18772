"""Entities, edges and retrieval over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.catalog.registry import EVERY, query
from quillspan.catalog.texts import _KEY
from quillspan.operators import graph
from quillspan.sources.tables import table


def _edges(s, d) -> DataFrame:
    """Customers and the parts they bought, as nodes c * 2 and p * 2 + 1."""
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_quantity").cast("double").alias("weight"))


_EDGES = "e AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sum(w), 6) AS weight FROM (SELECT o_custkey * 2 AS a, l_partkey * 2 + 1 AS b, l_quantity::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY ALL), bw AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


def _collapsed(s, d) -> DataFrame:
    return graph.collapsed_edges(_edges(s, d))


@query(f"WITH {_EDGES} SELECT * FROM e")
def edge_collapse(s, d):
    return _collapsed(s, d)


@query(f"WITH {_EDGES}, g AS (SELECT src AS node, count(*) AS degree FROM bw GROUP BY src) SELECT node, degree, round(degree::DOUBLE / (SELECT max(degree) FROM g), 6) AS centrality FROM g")
def degree_centrality(s, d):
    return graph.degrees(_collapsed(s, d))


def _seeds(s, d, name="seed", every=EVERY) -> DataFrame:
    return table(s, d, "customer").where(f"c_custkey % {every} = 0").select((F.col("c_custkey") * 2).alias(name))


_HOPS = f"{_EDGES}, sd AS (SELECT DISTINCT c_custkey * 2 AS seed FROM customer WHERE c_custkey % {EVERY} = 0), h1 AS (SELECT DISTINCT seed, dst AS node FROM sd JOIN bw ON src = seed), h2 AS (SELECT DISTINCT seed, bw.dst AS node FROM h1 JOIN bw ON bw.src = h1.node)"
_AROUND = "SELECT seed, node, 1 AS hops FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 WHERE node <> seed AND NOT EXISTS (SELECT 1 FROM h1 WHERE h1.seed = h2.seed AND h1.node = h2.node)"


@query(f"WITH {_HOPS} {_AROUND}")
def neighbors_2hop(s, d):
    return graph.neighbors(_collapsed(s, d), _seeds(s, d), 2)


@query(f"WITH {_HOPS}, a AS (SELECT seed, node FROM ({_AROUND}) UNION SELECT seed, seed FROM sd), x AS (SELECT a.seed, e.* FROM e JOIN a ON a.node = e.src JOIN a b ON b.node = e.dst AND b.seed = a.seed) SELECT seed, src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, src, dst) AS r FROM x) WHERE r <= 100")
def subgraph(s, d):
    return graph.subgraph(_collapsed(s, d), _seeds(s, d), 2, 100)


@query(f"WITH {_EDGES}, n0 AS (SELECT c_custkey * 2 AS node, 1.0::DOUBLE AS weight FROM customer WHERE c_custkey % {EVERY} = 0), n1 AS (SELECT node, max(weight) AS weight FROM (SELECT * FROM n0 UNION ALL SELECT dst, weight * 0.6 FROM n0 JOIN (SELECT DISTINCT src, dst FROM bw) ON src = node) GROUP BY node), n2 AS (SELECT node, max(weight) AS weight FROM (SELECT * FROM n1 UNION ALL SELECT dst, weight * 0.6 FROM n1 JOIN (SELECT DISTINCT src, dst FROM bw) ON src = node) GROUP BY node) SELECT node, round(weight, 6) AS weight FROM n2")
def propagate(s, d):
    return graph.propagate(_collapsed(s, d), _seeds(s, d, "node").withColumn("weight", F.lit(1.0)), 2)


@query(f"WITH {_EDGES}, sd AS (SELECT c_custkey * 2 AS n FROM customer WHERE c_custkey % {EVERY} = 0) SELECT a.src AS start, b.dst AS goal, 2 AS hops, count(*) AS paths, round(sum(a.weight + b.weight) / count(*) / 2, 6) AS score FROM bw a JOIN bw b ON a.dst = b.src WHERE a.src IN (SELECT n FROM sd) AND b.dst IN (SELECT n FROM sd) AND a.src <> b.dst GROUP BY ALL")
def shortest_paths(s, d):
    return graph.shortest_paths(_collapsed(s, d), _seeds(s, d, "start"), _seeds(s, d, "goal"), 2)


# Suppliers by nation fall apart into components, which SQL can find by recursion.
@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS a, p_type AS b FROM part WHERE p_size <= 2), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, seen) AS (SELECT a, a FROM w UNION SELECT w.b, r.seen FROM r JOIN w ON w.a = r.node) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def components(s, d):
    return graph.components(table(s, d, "part").where("p_size <= 2").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).distinct())


def _labels_sql(rounds: int) -> str:
    """Synchronous label propagation, a round at a time."""
    out = f"{_EDGES}, keep AS (SELECT src AS node, max(weight) AS keep FROM bw GROUP BY src), l0 AS (SELECT node, node AS label FROM keep)"
    for i in range(rounds):
        out += f", s{i} AS (SELECT node, label, round(sum(w), 6) AS w FROM (SELECT bw.src AS node, label, weight AS w FROM bw JOIN l{i} ON l{i}.node = bw.dst UNION ALL SELECT node, label, keep FROM l{i} JOIN keep USING (node)) GROUP BY ALL), l{i + 1} AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, label) AS r FROM s{i}) WHERE r = 1)"
    return out


@query(f"WITH {_labels_sql(3)} SELECT * FROM l3")
def label_communities(s, d):
    return graph.label_propagation(_collapsed(s, d), 3)


_RANKS = """m AS (SELECT label, count(*) AS size FROM l3 GROUP BY label), iw AS (SELECT a.label, sum(weight) AS inner_weight FROM e JOIN l3 a ON a.node = e.src JOIN l3 b ON b.node = e.dst WHERE a.label = b.label GROUP BY a.label),
x AS (SELECT label, size, coalesce(inner_weight, 0) AS inner_weight, ln(1 + size) AS ls, ln(1 + coalesce(inner_weight, 0)) AS lw FROM m LEFT JOIN iw USING (label)), y AS (SELECT min(ls) AS a, max(ls) AS b, min(lw) AS c, max(lw) AS f FROM x)"""


@query(f"WITH {_labels_sql(3)}, {_RANKS} SELECT label, size, round(inner_weight, 4) AS inner_weight, round(10 * (0.5 * CASE WHEN b - a > 1e-12 THEN (ls - a) / (b - a) ELSE 1 END + 0.5 * CASE WHEN f - c > 1e-12 THEN (lw - c) / (f - c) ELSE 1 END), 6) AS rank FROM x, y")
def community_ranks(s, d):
    edges = _collapsed(s, d)
    return graph.community_ranks(graph.label_propagation(edges, 3), edges)


@query(f"WITH {_labels_sql(3)} SELECT least(a.label, b.label) AS label_a, greatest(a.label, b.label) AS label_b, count(*) AS edges, round(sum(weight), 4) AS weight FROM e JOIN l3 a ON a.node = e.src JOIN l3 b ON b.node = e.dst WHERE a.label <> b.label GROUP BY ALL")
def community_bridges(s, d):
    edges = _collapsed(s, d)
    return graph.bridges_between(edges, graph.label_propagation(edges, 3))


@query()
def community_hierarchy(s, d):
    return graph.hierarchy(_collapsed(s, d), 3, 3, 3)


def _mentions(s, d) -> DataFrame:
    return table(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_type").alias("description"), F.col("p_partkey").cast("string").alias("chunk_id"))


@query(f"SELECT type, key, count(DISTINCT name) AS aliases, count(DISTINCT p_partkey) AS chunks FROM (SELECT p_brand AS type, p_name AS name, p_partkey, CASE WHEN {_KEY % 'p_name'} <> '' THEN {_KEY % 'p_name'} ELSE lower(trim(p_name)) END AS key FROM part) GROUP BY ALL")
def entity_merge(s, d):
    return graph.merged_entities(_mentions(s, d)).select("type", "key", "aliases", "chunks")


@query(f"SELECT type, key, (list_sort(list(name ORDER BY -length(name), name))[1:1])[1] IS NOT NULL AS named, len(list_distinct(list(name))) - 1 AS aliases, len(list_distinct(list(trim(p_type)))) AS descriptions, len(list_distinct(list(p_partkey))) AS chunk_ids, count(*) AS mentions FROM (SELECT p_brand AS type, p_name AS name, p_type, p_partkey, CASE WHEN {_KEY % 'p_name'} <> '' THEN {_KEY % 'p_name'} ELSE lower(trim(p_name)) END AS key FROM part) GROUP BY ALL")
def entity_rows(s, d):
    e = graph.entities(_mentions(s, d))
    size = lambda c: F.size(c).cast("bigint").alias(c)
    return e.select("type", "key", F.col("name").isNotNull().alias("named"), size("aliases"), size("descriptions"), size("chunk_ids"), "mentions")


@query("SELECT key, type FROM (SELECT p_type AS key, p_brand AS type, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_type, p_brand) WHERE r = 1")
def majority_types(s, d):
    return graph.majority_type(table(s, d, "part").select(F.col("p_type").alias("key"), F.col("p_brand").alias("type")))


def _relations(s, d) -> DataFrame:
    l = table(s, d, "lineitem")
    return l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("dst"), F.col("l_returnflag").alias("type"), F.col("l_quantity").alias("weight"), (F.col("l_orderkey") % 1000).cast("string").alias("chunk_id"))


_RELATIONS = "w AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey % 40 AS dst, l_returnflag AS type, (l_orderkey % 1000)::VARCHAR AS chunk_id, max(l_quantity) AS weight FROM lineitem GROUP BY ALL)"


@query(f"WITH {_RELATIONS}, c AS (SELECT CASE WHEN src = 's1' THEN 's2' ELSE src END AS src, dst, type, chunk_id, max(weight) AS weight FROM w GROUP BY ALL) SELECT src, dst, type, round(sum(weight), 6) AS weight, count(DISTINCT chunk_id) AS chunks FROM c GROUP BY src, dst, type")
def relations_rewritten(s, d):
    canonical = s.createDataFrame([("s1", "s2")], "node string, entity string")
    r = graph.rewritten(_relations(s, d), canonical)
    return r.select("src", "dst", "type", "weight", F.size("chunk_ids").cast("bigint").alias("chunks"))


@query(f"WITH {_RELATIONS}, h AS (SELECT *, chunk_id::INT < 500 AS old FROM w), a AS (SELECT src, dst, type, round(sum(weight), 6) AS w, list(DISTINCT chunk_id) AS c FROM h WHERE old GROUP BY ALL), b AS (SELECT src, dst, type, round(sum(weight), 6) AS w, list(DISTINCT chunk_id) AS c FROM h WHERE chunk_id::INT >= 400 GROUP BY ALL) SELECT src, dst, type, round(coalesce(a.w, 0) + CASE WHEN a.w IS NULL OR NOT list_has_all(a.c, b.c) THEN coalesce(b.w, 0) ELSE 0 END, 6) AS weight, len(list_distinct(list_concat(coalesce(a.c, []), coalesce(b.c, [])))) AS chunks FROM a FULL JOIN b USING (src, dst, type)")
def relations_upserted(s, d):
    none = s.createDataFrame([], "node string, entity string")
    all_ = _relations(s, d)
    old, new = (graph.rewritten(all_.where(c), none) for c in ("cast(chunk_id as int) < 500", "cast(chunk_id as int) >= 400"))
    return graph.upserted_relations(old, new).select("src", "dst", "type", "weight", F.size("chunk_ids").cast("bigint").alias("chunks"))


@query(f"WITH {_RELATIONS} SELECT src, dst, type, count(DISTINCT chunk_id) AS chunks FROM w WHERE chunk_id::INT % 3 <> 0 GROUP BY ALL")
def relations_without_chunks(s, d):
    r = graph.rewritten(_relations(s, d), s.createDataFrame([], "node string, entity string"))
    gone = s.range(0, 1000, 3).select(F.col("id").cast("string").alias("chunk_id"))
    return graph.without_chunks(r, gone).select("src", "dst", "type", F.size("chunk_ids").cast("bigint").alias("chunks"))


# Entities by vector: the vectors of `embeddings`, named by their label.
@query(f"""WITH n AS (SELECT vec_id AS node, 'l' || label || ' v' || vec_id % 7 AS key, 'L' || label AS type, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.node AS a, b.node AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM n a JOIN n b ON a.type = b.type AND a.node < b.node WHERE round(list_cosine_similarity(a.v, b.v), 6) >= 0.2 AND (a.key = b.key OR len(list_intersect(string_split(a.key, ' '), string_split(b.key, ' '))) = 0) AND {EVERY} > 0""")
def similar_entities(s, d):
    e = table(s, d, "embeddings")
    named = e.select(F.col("vec_id").alias("node"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("type"), F.concat(F.lit("l"), F.col("label").cast("string"), F.lit(" v"), (F.col("vec_id") % 7).cast("string")).alias("key"), F.col("embedding").alias("v"))
    return graph.similar_names(named, 0.2)


# Retrieval over the graph: customers ask from themselves, chunks are orders.


def _weights(s, d) -> DataFrame:
    near = graph.neighbors(_collapsed(s, d), _seeds(s, d, every=4 * EVERY), 1)
    return near.select(F.col("seed").alias("qid"), "node", F.lit(0.6).alias("weight")).unionByName(_seeds(s, d, "qid", 4 * EVERY).select("qid", F.col("qid").alias("node"), F.lit(1.0).alias("weight")))


def _order_mentions(s, d) -> DataFrame:
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    return o.select((F.col("o_custkey") * 2).alias("node"), F.col("o_orderkey").alias("chunk_id")).unionByName(l.select((F.col("l_partkey") * 2 + 1).alias("node"), F.col("l_orderkey").alias("chunk_id")).distinct())


def _order_relations(s, d) -> DataFrame:
    o, l = table(s, d, "orders"), table(s, d, "lineitem")
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("o_orderkey").alias("chunk_id")).agg(F.max("l_quantity").alias("weight"))


_CAND = f"""{_EDGES}, sd AS (SELECT c_custkey * 2 AS qid FROM customer WHERE c_custkey % {4 * EVERY} = 0), wt AS (SELECT qid, qid AS node, 1.0::DOUBLE AS weight FROM sd UNION ALL SELECT qid, dst, 0.6 FROM sd JOIN bw ON src = qid),
mn AS (SELECT o_custkey * 2 AS node, o_orderkey AS chunk_id FROM orders UNION ALL SELECT DISTINCT l_partkey * 2 + 1, l_orderkey FROM lineitem), rl AS (SELECT o_custkey * 2 AS src, l_partkey * 2 + 1 AS dst, o_orderkey AS chunk_id, max(l_quantity) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
en AS (SELECT qid, chunk_id, max(weight) AS entity FROM wt JOIN mn USING (node) GROUP BY ALL), re AS (SELECT qid, chunk_id, round(sum(weight * e), 6) AS relation FROM (SELECT w.qid, r.chunk_id, r.src, r.dst, r.weight, max(w.weight) AS e FROM wt w JOIN rl r ON r.src = w.node OR r.dst = w.node GROUP BY ALL) GROUP BY ALL),
cd AS (SELECT qid, chunk_id, coalesce(entity, 0) AS entity, coalesce(relation, 0) AS relation FROM en FULL JOIN re USING (qid, chunk_id)), c30 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY entity + relation DESC, chunk_id) AS r FROM cd) WHERE r <= 30)"""


@query(f"WITH {_CAND}, sc AS (SELECT qid, chunk_id, round((0.4 * entity / max(entity) OVER (PARTITION BY qid) + 0.25 * relation / max(relation) OVER (PARTITION BY qid)) / 0.65, 6) AS score FROM c30) SELECT qid, chunk_id, score, CAST(rank - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sc) WHERE rank <= 10")
def graph_local(s, d):
    return graph.local_ranks(graph.local_candidates(_weights(s, d), _order_mentions(s, d), _order_relations(s, d), 10), None, 10)


@query("""WITH a AS (SELECT user_id % 20 AS qid, event_id AS chunk_id, value AS score FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id % 20 AS qid, event_id AS chunk_id, value * 2 AS score FROM events WHERE event_id % 3 = 0),
x AS (SELECT qid, chunk_id, 0.45 * CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0 END AS v FROM a UNION ALL SELECT qid, chunk_id, 0.55 * CASE WHEN max(score) OVER (PARTITION BY qid) > 0 THEN score / max(score) OVER (PARTITION BY qid) ELSE 0 END FROM b),
m AS (SELECT qid, chunk_id, round(sum(v), 6) AS score FROM x GROUP BY ALL) SELECT qid, chunk_id, score, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM m) WHERE r <= 10""")
def graph_drift(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("qid"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return graph.drift_merged(e.where("chunk_id % 2 = 0"), e.where("chunk_id % 3 = 0").withColumn("score", F.col("score") * 2), 10)


@query("WITH b AS (SELECT user_id % 20 AS qid, event_type AS key, max(value) AS score FROM events GROUP BY ALL), x AS (SELECT *, max(score) OVER (PARTITION BY qid) AS t FROM b) SELECT qid, key, score, CAST(r - 1 AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS r FROM x WHERE score >= 0.35 * t) WHERE r <= 3")
def question_entities(s, d):
    return graph.question_entities(table(s, d, "events").select((F.col("user_id") % 20).alias("qid"), F.col("event_type").alias("key"), F.col("value").alias("score")), most=3)


@query(f"WITH {_EDGES}, sd AS (SELECT c_custkey * 2 AS n FROM customer WHERE c_custkey % {EVERY} = 0), p AS (SELECT a.src AS qid, b.dst AS path_id, 2 AS hops, sum(a.weight + b.weight) / count(*) / 2 AS score FROM bw a JOIN bw b ON a.dst = b.src WHERE a.src IN (SELECT n FROM sd) AND b.dst IN (SELECT n FROM sd) AND a.src <> b.dst GROUP BY ALL), q AS (SELECT qid, path_id, hops, round(score, 6) AS score FROM p), z AS (SELECT qid, path_id, hops, score / max(score) OVER (PARTITION BY qid) AS scaled FROM q), c AS (SELECT o_custkey * 2 AS path_id, o_orderkey AS chunk_id, o_totalprice AS weight FROM orders), k AS (SELECT z.qid, z.path_id, hops, scaled, chunk_id, row_number() OVER (PARTITION BY qid, path_id ORDER BY weight DESC, chunk_id) AS r FROM z JOIN c USING (path_id)), m AS (SELECT qid, chunk_id, round(max(scaled), 6) AS score FROM k WHERE r <= 2 * hops GROUP BY ALL) SELECT qid, chunk_id, score, CAST(r - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM m) WHERE r <= 10")
def path_evidence(s, d):
    paths = graph.shortest_paths(_collapsed(s, d), _seeds(s, d, "start"), _seeds(s, d, "goal"), 2).select(F.col("start").alias("qid"), F.col("goal").alias("path_id"), "score", "hops")
    chunks = table(s, d, "orders").select((F.col("o_custkey") * 2).alias("path_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("weight"))
    return graph.path_evidence(paths, chunks, 10)

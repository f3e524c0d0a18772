"""Stores, hierarchies, units made from chunks, and answers before they go out."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog.answers import _pairs
from quillspan.catalog.registry import CHUNKS, DOCS, ORACLES, TOKENS, USABLE, asked, bm25_sql, chunks, query, ranked_sql, texts, vectors
from quillspan.functions.columns import blend, cosine, entity_id, norm, unquoted
from quillspan.functions.tenancy import where_sql
from quillspan.operators import answers, context, evaluation, graph, hierarchy, ingest, rerank, retrieval
from quillspan.plans.registry import Pipeline, standard
from quillspan.plans.spool import new_path
from quillspan.sources.store import Store, described_tables, tables_summary
from quillspan.sources.tables import table

_STORED = "chunk_id string, document_id string, chunk_index int, tenant_id string, created_at timestamp"


@query("SELECT chunk_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, document_id) AS r FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1 AND NOT coalesce(tenant_id = 'tnt-brethoth' AND chunk_index > 2, false)")
def store_round_trip(s, d):
    """Two upserts and a deletion within a tenant, read back."""
    store = Store(s, new_path(s, "store"), "chunk_id", _STORED)
    rows = table(s, d, "chunks").select("chunk_id", "document_id", "chunk_index", "tenant_id", "created_at")
    store.upsert(rows.where("chunk_index % 2 = 0"))
    store.upsert(rows)
    store.delete(F.col("chunk_index") > 2, "tnt-brethoth")
    store.vacuum()
    return store.rows().select("chunk_id", "document_id")


@query("SELECT chunk_id FROM chunks WHERE (tenant_id = 'tnt-brethoth' OR chunk_level = 1) AND NOT coalesce(modality IN ('code', 'image'), false) AND metadata['lang'] = 'en' GROUP BY chunk_id")
def filter_as_sql(s, d):
    table(s, d, "chunks").createOrReplaceTempView("filtered_chunks")
    spec = {"$or": [{"tenant_id": "tnt-brethoth"}, {"chunk_level": 1}], "modality": {"nin": ["code", "image"]}, "lang": "en"}
    text, args = where_sql(spec, columns={"tenant_id", "chunk_level", "modality"})
    return s.sql(f"SELECT DISTINCT chunk_id FROM filtered_chunks WHERE {text}", args)


@query('SELECT \'orders\' AS "table", c AS "column", n AS rows, nulls FROM (SELECT count(*) AS n, count(*) - count(o_orderkey) AS a, count(*) - count(o_custkey) AS b, count(*) - count(o_orderstatus) AS c1, count(*) - count(o_totalprice) AS d, count(*) - count(o_orderdate) AS e, count(*) - count(o_orderpriority) AS f FROM orders), LATERAL (VALUES (\'o_orderkey\', a), (\'o_custkey\', b), (\'o_orderstatus\', c1), (\'o_totalprice\', d), (\'o_orderdate\', e), (\'o_orderpriority\', f)) v(c, nulls)')
def table_summaries(s, d):
    return tables_summary({"orders": table(s, d, "orders")}).select("table", "column", "rows", "nulls")


@query()
def table_descriptions(s, d):
    return described_tables(tables_summary({n: table(s, d, n) for n in ("orders", "lineitem", "customer", "documents")}))


@query()
def cluster_hierarchy(s, d):
    v = F.col("v")
    usable = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0)
    return hierarchy.hierarchy(vectors(s, d).where(usable).select(F.col("chunk_id").alias("node"), "v"), levels=2)


_GOOD = f"WITH {CHUNKS}, u AS (SELECT chunk_id, document_id, chunk_index, embedding::DOUBLE[] AS v FROM ch WHERE {USABLE})"


@query(f"{_GOOD}, x AS (SELECT document_id AS doc, 0 AS span, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM u WHERE chunk_index BETWEEN 0 AND 1), m AS (SELECT doc, span, i, avg(x) AS x FROM x GROUP BY ALL) SELECT doc, span, round(sqrt(sum(x * x)), 5) AS norm FROM m GROUP BY doc, span")
def pooled_spans(s, d):
    v = F.col("embedding")
    u = chunks(s, d, "embedding", "document_id", "chunk_index").where((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))
    toks = u.select(F.col("document_id").alias("doc"), F.col("chunk_index").alias("tok"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    spans = toks.select("doc").distinct().select("doc", F.lit(0).alias("span"), F.lit(0).alias("first"), F.lit(1).alias("last"))
    p = answers.pooled(toks, spans)
    return p.select("doc", "span", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), 5).alias("norm"))


@query(f"{_GOOD} SELECT document_id AS doc, least(count(*), 3) AS kept FROM u GROUP BY document_id")
def pruned_tokens(s, d):
    v = F.col("embedding")
    u = chunks(s, d, "embedding", "document_id", "chunk_index").where((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0))
    toks = u.select(F.col("document_id").alias("doc"), F.col("chunk_index").alias("tok"), v.alias("v"))
    return answers.pruned_tokens(toks, 3).groupBy("doc").agg(F.count("*").alias("kept"))


@query(f"SELECT chunk_id, count(*) AS kept FROM (SELECT chunk_id, gq_id FROM generated_questions WHERE len({TOKENS % 'answer'}) >= 3) GROUP BY chunk_id HAVING count(*) = 1")
def propositions(s, d):
    """Counted for chunks with one proposition of three words or more, where nothing can be folded together."""
    made = table(s, d, "generated_questions").where("answer is not null").select("chunk_id", F.col("gq_id").alias("place"), F.col("answer").alias("proposition"))
    kept = answers.propositions(made).groupBy("chunk_id").agg(F.count("*").alias("kept"))
    from quillspan.functions.columns import tokens

    single = made.where(F.size(tokens(F.col("proposition"))) >= 3).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n = 1")
    return kept.join(single, "chunk_id", "left_semi")


@query()
def answer_spans(s, d):
    g = table(s, d, "generated_questions").select("gq_id", "chunk_id", "answer").join(texts(s, d), "chunk_id")
    return g.select("gq_id", answers.verbatim_span(F.col("answer"), F.col("text")).alias("span")).where("span is not null").select("gq_id", "span.start", "span.end")


@query()
def quotes_present(s, d):
    g = table(s, d, "generated_questions").select("gq_id", "chunk_id", "answer").join(texts(s, d), "chunk_id")
    return g.select("gq_id", answers.quote_present(F.col("answer"), F.col("text")).alias("present"))


@query("SELECT gq_id AS qid, false AS leaks FROM generated_questions WHERE answer IS NOT NULL")
def answer_validation(s, d):
    g = table(s, d, "generated_questions").where("answer is not null").select(F.col("gq_id").alias("qid"), F.concat("answer", F.lit(" [1, 9]")).alias("answer"), F.lit(3).alias("passages"))
    return answers.validated_answers(g).where(F.size("invalid") == 1).select("qid", "leaks")


_CYPHER = ["MATCH (a)-[r]->(b) RETURN a", "MATCH (a) DETACH DELETE a", "CALL db.labels()", "MATCH (a)-[*]->(b) RETURN a", "MATCH (a)-[*1..9]->(b) RETURN a", "MATCH (a)", "MATCH (a) RETURN a; MATCH (b) RETURN b", "MATCH (a {name: 'SET DROP'}) RETURN a // DELETE"]
_SAID = [None, "writes", "calls", "unbounded", "too_far", "no_return", "several", None]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if v is None else repr(v)})" for i, v in enumerate(_SAID)) + ") t(n, verdict)")
def cypher_verdicts(s, d):
    return s.createDataFrame(list(enumerate(_CYPHER)), "n int, statement string").select("n", answers.cypher_verdict(F.col("statement")).alias("verdict"))


@query()
def result_evidence(s, d):
    by = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy("o_orderstatus")
    return answers.result_chunk(by, "How many orders by status?", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")


@query("WITH m AS (SELECT (p_partkey % 50)::VARCHAR AS chunk_id, lower(p_name) AS k FROM part GROUP BY ALL) SELECT chunk_id, count(*) AS entities FROM m GROUP BY chunk_id")
def absorbed_entities(s, d):
    p = table(s, d, "part")
    cased = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    mentions = p.select((F.col("p_partkey") % 50).cast("string").alias("chunk_id"), cased.alias("name"), F.col("p_brand").alias("type"), F.col("p_type").alias("description"))
    relations = mentions.select("chunk_id", F.col("name").alias("src"), F.lit("nobody").alias("dst"), F.lit("T").alias("type"), F.lit(1.0).alias("weight"))
    return graph.absorbed(mentions, relations)[0].groupBy("chunk_id").agg(F.count("*").alias("entities"))


_ENTITIES = "SELECT lower(p_name) AS chunk_id, min(p_name) || ' ' || array_to_string(list_sort(list(DISTINCT p_type)), ' ') AS text FROM part GROUP BY lower(p_name)"


@query(f"WITH {bm25_sql(_ENTITIES, 'SELECT p_partkey AS qid, p_type AS text FROM part WHERE p_partkey % 100 = 0')}, t AS ({ranked_sql('bs', 5)}) SELECT qid, chunk_id AS key, score, rank FROM t")
def entity_search(s, d):
    p = table(s, d, "part")
    found = p.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_name").alias("name"), F.array_sort(F.collect_set("p_type")).alias("descriptions"))
    return graph.fulltext_entities(p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("text")), found, 5)


@query(f"WITH {CHUNKS}, {bm25_sql(DOCS)} {ranked_sql('bs', 5)}")
def pipeline_naive(s, d):
    """The naive pipeline: retrieve, then finish with the first five."""
    pipe: Pipeline = standard("naive", lambda state: {"candidates": retrieval.bm25(state["questions"], texts(s, d), 20)}, finish=lambda state: {"answer": state["candidates"].where("rank < 5")})
    return pipe.run({"questions": asked(s, d)})["answer"]


# Metrics of answers


@query(f"SELECT key, a.f1, b.f1 AS rouge_l, round((a.f1 + b.f1) / 2, 6) AS overlap FROM ({ORACLES['token_f1']}) a JOIN ({ORACLES['rouge_l']}) b USING (key)")
def lexical_overlap(s, d):
    return evaluation.lexical_overlap(_pairs(s, d))


@query(f"SELECT key, round(0.75 * f1 + 0.25 * 0.5, 6) AS correctness FROM ({ORACLES['token_f1']})")
def answer_correctness(s, d):
    return evaluation.answer_correctness(_pairs(s, d).withColumn("similarity", F.lit(0.5)))


@query("SELECT user_id % 20 AS qid, round(count_if(value > 20)::DOUBLE / count(value), 6) AS share FROM events GROUP BY 1")
def supported_share(s, d):
    e = table(s, d, "events")
    return evaluation.supported_share(e.select((F.col("user_id") % 20).alias("qid"), F.col("event_id").alias("claim"), (F.col("value") > 20).alias("supported")))


@query("SELECT a.label AS qid, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS relevance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label")
def answer_relevance(s, d):
    e = table(s, d, "embeddings")
    back = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("back"))
    return evaluation.answer_relevance(e.join(back, "vec_id").select(F.col("label").alias("qid"), F.col("embedding").alias("v"), "back"))


@query("SELECT count(*) AS n FROM (SELECT id FROM eval_cases UNION SELECT gq_id FROM generated_questions) WHERE id IS NOT NULL")
def dataset_extended(s, d):
    """Cases, each id once, and the generated questions that are new."""
    first = evaluation.extended(table(s, d, "eval_cases").where("1 = 0").select("id", "question"), table(s, d, "eval_cases").where("id is not null").select("id", "question"))
    return evaluation.extended(first, table(s, d, "generated_questions").select(F.col("gq_id").alias("id"), "question")).agg(F.count("*").alias("n"))


@query("SELECT 25::BIGINT AS n, 25::BIGINT AS ids")
def dataset_sample(s, d):
    cases = table(s, d, "eval_cases").where("id is not null").dropDuplicates(["id"])
    return evaluation.sampled(cases, 25).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query()
def compression_report(s, d):
    full = retrieval.bm25(asked(s, d), texts(s, d), 10).join(asked(s, d).withColumnRenamed("text", "question"), "qid").join(texts(s, d), "chunk_id")
    return rerank.compression_report(rerank.compress_sentences(full))


@query("SELECT item, CASE WHEN v % 7 = 0 THEN 'contradicted' WHEN v % 5 = 0 THEN 'model_reported_insufficient' WHEN v % 3 = 0 THEN 'ungrounded' WHEN v % 2 = 0 THEN 'fabricated_citations' WHEN v % 11 = 0 THEN 'empty_answer' END AS reason FROM (SELECT event_id AS item, event_id AS v FROM events)")
def abstention_reasons(s, d):
    v = F.col("event_id")
    said = F.when(v % 11 == 0, "").otherwise("yes")
    return table(s, d, "events").select(v.alias("item"), context.abstention_after((v % 7 == 0).cast("int"), v % 5 == 0, v % 3 != 0, (v % 2 == 0).cast("int"), said).alias("reason"))


@query("SELECT doc_id, md5(left(text, 80)) AS h FROM documents")
def first_tokens(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(context.first_tokens(F.col("text"), 20)).alias("h"))


@query(f"WITH {CHUNKS}, p AS (SELECT document_id AS qid, chunk_index AS rank, chunk_id, content AS text FROM ch WHERE chunk_index IS NOT NULL), q AS (SELECT document_id AS qid, chunk_id AS quote_id, left(content, 30) AS quote FROM ch WHERE chunk_level = 0 AND chunk_index <= 1 AND content IS NOT NULL AND regexp_full_match(left(content, 30), '[A-Za-z0-9 ,]{{30}}') AND NOT contains(left(content, 30), '  ') AND NOT starts_with(content, ' ') AND left(content, 30) NOT LIKE '% '), m AS (SELECT q.qid, quote_id, quote, p.chunk_id, row_number() OVER (PARTITION BY q.qid, quote_id ORDER BY p.rank) AS r, count(*) OVER (PARTITION BY q.qid, quote_id, p.rank) AS ties FROM q JOIN p ON p.qid = q.qid AND contains(lower(regexp_replace(p.text, '\\s+', ' ', 'g')), lower(quote))) SELECT quote_id, count(*) AS n FROM m WHERE r = 1 GROUP BY quote_id")
def quote_places(s, d):
    own = chunks(s, d, "document_id", "chunk_index", "chunk_level")
    head = F.substring("content", 1, 30)
    plain = head.rlike("^[A-Za-z0-9 ,]{30}$") & ~F.contains(head, F.lit("  ")) & ~F.startswith("content", F.lit(" ")) & ~head.like("% ")
    q = own.where((F.col("chunk_level") == 0) & (F.col("chunk_index") <= 1) & plain).select(F.col("document_id").alias("qid"), F.col("chunk_id").alias("quote_id"), head.alias("quote"))
    p = own.where("chunk_index is not null").select(F.col("document_id").alias("qid"), F.col("chunk_index").alias("rank"), "chunk_id", F.col("content").alias("text"))
    return context.quote_places(q, p).where("chunk_id is not null").groupBy("quote_id").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT user_id % 20 AS qid, event_type AS hop, event_id AS chunk_id, value AS score, row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY value DESC, event_id) AS turn FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY turn, hop, chunk_id) AS r FROM t) SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS INT) AS rank FROM k WHERE r <= 8")
def hop_round_robin(s, d):
    e = table(s, d, "events").select((F.col("user_id") % 20).alias("qid"), F.col("event_type").alias("hop"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return retrieval.round_robin(e, 8).select("qid", "chunk_id", "rank")


@query("SELECT qid, node, round(CASE WHEN list_has_any(c, s) THEN score ELSE score * 0.6 END, 6) AS weight FROM (SELECT user_id % 20 AS qid, event_id AS node, value AS score, ['e' || event_id % 9] AS c FROM events), (SELECT ['e1', 'e4'] AS s)")
def seed_weights(s, d):
    e = table(s, d, "events")
    matched = e.select((F.col("user_id") % 20).alias("qid"), F.col("event_id").alias("node"), F.col("value").alias("score"), F.array(F.concat(F.lit("e"), (F.col("event_id") % 9).cast("string"))).alias("chunk_ids"))
    seeds = e.select((F.col("user_id") % 20).alias("qid")).distinct().select("qid", F.array(F.lit("e1"), F.lit("e4")).alias("chunk_ids"))
    return graph.seed_weights(matched, seeds)


@query("SELECT lower(p_name) AS key, count(DISTINCT p_partkey % 30) AS chunks FROM part GROUP BY 1")
def entity_mentions(s, d):
    by = table(s, d, "part").groupBy(F.lower("p_name").alias("key")).agg(F.collect_list(F.col("p_partkey") % 30).alias("chunk_ids"))
    return graph.mentions_of(by).groupBy("key").agg(F.count("*").alias("chunks"))


@query("SELECT DISTINCT p_size AS level, p_brand AS label FROM part WHERE p_size < 10")
def communities_pruned(s, d):
    own = table(s, d, "part").select(F.col("p_size").alias("level"), F.col("p_brand").alias("label")).distinct()
    return graph.pruned_communities(own, own.where("level < 10"))


@query("SELECT a.vec_id, round(list_cosine_similarity(list_transform(range(1, 65), lambda i: 0.3 * a.embedding[i]::DOUBLE + 0.7 * b.embedding[i]::DOUBLE / sqrt(list_sum(list_transform(b.embedding::DOUBLE[], lambda x: x * x)))), a.embedding::DOUBLE[]), 5) AS similarity, 1.0 AS norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def blended_vectors(s, d):
    """Query vectors mixed with those of a hypothetical answer."""
    e = table(s, d, "embeddings")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("h")), "vec_id").withColumn("b", blend(F.col("embedding"), F.col("h")))
    return both.select("vec_id", F.round(cosine(F.col("b"), F.col("embedding")), 5).alias("similarity"), F.round(norm(F.col("b")), 5).alias("norm"))


@query(r"SELECT count(DISTINCT lower(trim(p_name))) AS names, count(DISTINCT lower(trim(p_name))) AS ids, true AS bare FROM part")
def entity_ids(s, d):
    p = table(s, d, "part").select("p_name", entity_id(F.col("p_name")).alias("id"), unquoted(F.concat(F.lit(' "'), "p_name", F.lit('" '))).alias("bare"))
    return p.agg(F.countDistinct(F.lower(F.trim("p_name"))).alias("names"), F.countDistinct("id").alias("ids"), F.bool_and(F.col("bare") == F.trim(F.regexp_replace("p_name", r"\s+", " "))).alias("bare"))


@query("SELECT count(DISTINCT (lang, batch_no)) AS scopes FROM documents WHERE lang IS NOT NULL AND batch_no IS NOT NULL")
def cache_scopes(s, d):
    docs = table(s, d, "documents").where("lang is not null and batch_no is not null")
    return docs.select(ingest.scope_key(F.col("lang"), F.col("batch_no"), F.lit("hybrid")).alias("k")).agg(F.countDistinct("k").alias("scopes"))

"""Search, fusion and what is done with fetched lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog.registry import CHUNKS, DENSE, DOCS, EVERY, QVECS, TOKENS, asked, bm25_sql, chunks, query, query_vectors, ranked_sql, texts, vectors
from quillspan.functions.columns import condition, dot, quantize, tokens
from quillspan.operators import rerank, retrieval
from quillspan.sources.tables import table

_BM25 = f"{CHUNKS}, {bm25_sql(DOCS)}"


@query(f"WITH {_BM25} {ranked_sql('bs', 10)}")
def bm25_topk(s, d):
    return retrieval.bm25(asked(s, d), texts(s, d), 10)


_SCOPE = {"chunk_level": 0, "modality": ["text", "Text"]}
_SCOPED = "SELECT chunk_id, content AS text FROM ch WHERE chunk_level = 0 AND modality IN ('text', 'Text') AND tenant_id = 'tnt-brethoth'"


@query(f"WITH {CHUNKS}, {bm25_sql(_SCOPED)} {ranked_sql('bs', 10)}")
def bm25_tenant_filtered(s, d):
    return retrieval.bm25(asked(s, d), retrieval.scoped(texts(s, d, "chunk_level", "modality", "tenant_id"), _SCOPE, "tnt-brethoth"), 10)


@query(f"WITH {CHUNKS}, {DENSE} {ranked_sql('ds', 10)}")
def dense_topk(s, d):
    return retrieval.dense(query_vectors(s, d), vectors(s, d), 10)


@query(f"WITH {CHUNKS}, {DENSE.replace('FROM ch WHERE', 'FROM ch WHERE tenant_id = ' + chr(39) + 'tnt-brethoth' + chr(39) + ' AND')} {ranked_sql('ds', 10)}")
def dense_tenant_filtered(s, d):
    return retrieval.dense(query_vectors(s, d), retrieval.scoped(vectors(s, d, "tenant_id"), None, "tnt-brethoth"), 10)


@query(f"WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 10)}) SELECT * FROM t WHERE score >= 0.5")
def dense_threshold(s, d):
    return retrieval.dense(query_vectors(s, d), vectors(s, d), 10, threshold=0.5)


_VARIANTS = f"SELECT doc_id || '|' || v AS qid, CASE v WHEN 0 THEN title ELSE source END AS text FROM documents, (VALUES (0), (1)) x(v) WHERE doc_id % {EVERY} = 0 AND title IS NOT NULL AND (v = 0 OR (doc_id % {4 * EVERY} = 0 AND source IS NOT NULL))"


@query(f"""WITH {CHUNKS}, {bm25_sql(DOCS, _VARIANTS)}, t AS ({ranked_sql('bs', 50)}), p AS (SELECT split_part(qid, '|', 1)::BIGINT AS qid, split_part(qid, '|', 2) AS leg, chunk_id, score, rank FROM t),
n AS (SELECT split_part(qid, '|', 1)::BIGINT AS qid, count(*) AS n FROM ({_VARIANTS}) GROUP BY 1),
f AS (SELECT qid, chunk_id, CASE WHEN n = 1 THEN max(score) ELSE round(sum(1.0::DOUBLE / (61 + rank)), 6) END AS score FROM p JOIN n USING (qid) GROUP BY qid, chunk_id, n) {ranked_sql('f', 10)}""")
def bm25_variants(s, d):
    docs = table(s, d, "documents").where(f"doc_id % {EVERY} = 0 and title is not null")
    one = docs.select(F.col("doc_id").alias("qid"), F.lit(0).alias("variant"), F.col("title").alias("text"))
    two = docs.where(f"doc_id % {4 * EVERY} = 0 and source is not null").select(F.col("doc_id").alias("qid"), F.lit(1).alias("variant"), F.col("source").alias("text"))
    return retrieval.by_variants(lambda q: retrieval.bm25(q, texts(s, d), 50), one.unionByName(two), 10)


# The two legs of a hybrid search answer the same questions with the same chunks.


def _legs(s, d):
    dense = retrieval.dense(query_vectors(s, d), vectors(s, d), 50)
    lexical = retrieval.bm25(asked(s, d), texts(s, d), 50)
    return dense.select("qid", F.lit("dense").alias("leg"), "chunk_id", "score").unionByName(lexical.select("qid", F.lit("lexical").alias("leg"), "chunk_id", "score"))


_LEGS = f"WITH {_BM25}, {DENSE}, lists AS (SELECT qid, 'dense' AS leg, chunk_id, score, rank FROM ({ranked_sql('ds', 50)}) UNION ALL SELECT qid, 'lexical', chunk_id, score, rank FROM ({ranked_sql('bs', 50)}))"


def _fused(value: str, total: str) -> str:
    return f"{_LEGS}, w AS (SELECT *, {value} AS value FROM (SELECT *, min(score) OVER (PARTITION BY qid, leg) AS lo, max(score) OVER (PARTITION BY qid, leg) AS hi FROM lists)), f AS (SELECT qid, chunk_id, round({total}(value), 6) AS score, min(rank) AS best_rank, count(*) AS legs FROM w GROUP BY qid, chunk_id) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, chunk_id) - 1 AS INT) AS rank FROM f) WHERE rank < 10"


@query(_fused("1.0::DOUBLE / (60 + rank + 1)", "sum"))
def hybrid_rrf(s, d):
    return retrieval.fuse(_legs(s, d), "rrf", k=10)


_MM = "CASE WHEN hi - lo > 1e-12 THEN (score - lo) / (hi - lo) ELSE 1.0 END"


@query(_fused(f"CASE WHEN leg = 'lexical' THEN 0.5 ELSE 1.0 END * {_MM}", "sum"))
def fuse_weighted(s, d):
    return retrieval.fuse(_legs(s, d), "weighted", {"lexical": 0.5}, k=10)


@query(_fused(_MM, "max"))
def fuse_relative(s, d):
    return retrieval.fuse(_legs(s, d), "relative", k=10)


@query(_fused("score", "max"))
def fuse_max(s, d):
    return retrieval.fuse(_legs(s, d), "max", k=10)


@query(f"""{_LEGS}, z AS (SELECT qid, leg, chunk_id, rank, CASE WHEN sd <= 1e-12 THEN 0.0 ELSE (score - mu) / sd END AS z FROM (SELECT *, avg(score) OVER (PARTITION BY qid, leg) AS mu, stddev_pop(score) OVER (PARTITION BY qid, leg) AS sd FROM lists)),
fl AS (SELECT qid, leg, min(z) - 1 AS fl FROM z GROUP BY ALL), ids AS (SELECT DISTINCT qid, chunk_id FROM z),
f AS (SELECT i.qid, i.chunk_id, round(sum(coalesce(z.z, fl.fl)), 6) AS score, min(z.rank) AS best_rank, count(z.z) AS legs FROM ids i JOIN fl ON fl.qid = i.qid LEFT JOIN z ON z.qid = i.qid AND z.leg = fl.leg AND z.chunk_id = i.chunk_id GROUP BY i.qid, i.chunk_id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, chunk_id) - 1 AS INT) AS rank FROM f) WHERE rank < 10""")
def fuse_dbsf(s, d):
    return retrieval.fuse(_legs(s, d), "dbsf", k=10)


@query(f"WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 50)}) SELECT qid, chunk_id, round(CASE WHEN hi - lo > 1e-9 THEN (score - lo) / (hi - lo) ELSE 1.0 END, 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi FROM t) WHERE hi <= 0 OR score >= 0.35 * hi")
def noise_cutoff_minmax(s, d):
    scored = retrieval.normalized(retrieval.dense(query_vectors(s, d), vectors(s, d), 50))
    return retrieval.relative_cutoff(scored).select("qid", "chunk_id", "norm")


@query(f"WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 50)}) SELECT qid, chunk_id, round(CASE WHEN sd > 1e-9 THEN 1 / (1 + exp(-(score - mu) / sd)) ELSE 0.5 END, 6) AS norm FROM (SELECT *, avg(score) OVER (PARTITION BY qid) AS mu, stddev_pop(score) OVER (PARTITION BY qid) AS sd FROM t)")
def scores_logistic(s, d):
    return retrieval.normalized(retrieval.dense(query_vectors(s, d), vectors(s, d), 50), "logistic").select("qid", "chunk_id", "norm")


@query(f"WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 9)}) SELECT qid, chunk_id, CAST(CASE WHEN rank % 2 = 0 THEN rank // 2 ELSE 8 - (rank - 1) // 2 END AS INT) AS place FROM t")
def lost_in_middle(s, d):
    return retrieval.lost_in_middle(retrieval.dense(query_vectors(s, d), vectors(s, d), 9)).select("qid", "chunk_id", "place")


def _fetched(s, d, k=30):
    return retrieval.dense(query_vectors(s, d), vectors(s, d), k).join(chunks(s, d, "embedding").select("chunk_id", F.col("content").alias("text"), F.col("embedding").alias("v")), "chunk_id")


@query()
def mmr_select(s, d):
    return retrieval.mmr(_fetched(s, d, 50), 10)


@query(rf"""WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 30)}), k AS (SELECT t.*, md5(lower(regexp_replace(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'), '^ | $', '', 'g'))) AS key FROM t JOIN ch USING (chunk_id))
SELECT qid, chunk_id, merged FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, chunk_id) AS r, count(*) OVER (PARTITION BY qid, key) AS merged FROM k) WHERE r = 1""")
def exact_dedupe(s, d):
    return retrieval.exact_dedupe(_fetched(s, d)).select("qid", "chunk_id", "merged")


@query()
def noise_filtered(s, d):
    return retrieval.noise_filtered(_fetched(s, d), 10)[0].select("qid", "chunk_id", "score", "rank")


@query()
def noise_counts(s, d):
    return retrieval.noise_filtered(_fetched(s, d), 10)[1]


@query()
def simhashes(s, d):
    return texts(s, d).select("chunk_id", retrieval.simhash(F.col("text")).alias("simhash"))


_TERMS = f"p AS (SELECT chunk_id, unnest({TOKENS % 'content'}) AS term FROM ch), w AS (SELECT chunk_id, term, count(*)::DOUBLE AS weight FROM p GROUP BY ALL), qw AS (SELECT qid, term, count(*)::DOUBLE AS qweight FROM (SELECT doc_id AS qid, unnest({TOKENS % 'title'}) AS term FROM documents WHERE doc_id % {EVERY} = 0) GROUP BY ALL)"


def _terms(s, d):
    return texts(s, d).select("chunk_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").cast("double").alias("weight"))


def _question_terms(s, d):
    return asked(s, d).select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("weight"))


@query(f"WITH {CHUNKS}, {_TERMS}, n AS (SELECT count(DISTINCT chunk_id) AS n FROM w), df AS (SELECT term, count(*) AS df FROM w GROUP BY term), ss AS (SELECT qid, chunk_id, round(sum(qweight * weight * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM qw JOIN w USING (term) JOIN df USING (term), n GROUP BY ALL) {ranked_sql('ss', 10)}")
def sparse_topk(s, d):
    return retrieval.sparse_dot(_question_terms(s, d), retrieval.inverse_frequencies(_terms(s, d)), 10)


@query(f"WITH {CHUNKS}, {_TERMS} SELECT chunk_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, term) AS r FROM w) WHERE r <= 8")
def sparse_pruned(s, d):
    return retrieval.pruned(_terms(s, d), 8)


# Late interaction: an asking document's token vectors are those of its chunks, a candidate's those of its own document.
_TOKS = f"pv AS (SELECT document_id, chunk_index AS tok, embedding::DOUBLE[] AS v FROM ch WHERE embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true)), qt AS (SELECT d.doc_id AS qid, tok, v FROM documents d JOIN pv ON pv.document_id = d.id WHERE d.doc_id % {EVERY} = 0)"


@query(f"""WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 20)}), {_TOKS}, c AS (SELECT DISTINCT qid, document_id AS chunk_id FROM t JOIN ch USING (chunk_id)),
b AS (SELECT c.qid, c.chunk_id, qt.tok, max(list_dot_product(qt.v, pv.v)) AS best FROM c JOIN qt USING (qid) JOIN pv ON pv.document_id = c.chunk_id GROUP BY ALL)
SELECT qid, chunk_id, round(sum(best), 6) AS score FROM b GROUP BY ALL""")
def maxsim_scores(s, d):
    v = F.col("embedding")
    own = chunks(s, d, "embedding", "document_id", "chunk_index").where((F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull())).select(F.col("document_id").alias("chunk_id"), F.col("chunk_index").alias("tok"), v.alias("v"))
    docs = table(s, d, "documents").where(f"doc_id % {EVERY} = 0").select(F.col("doc_id").alias("qid"), F.col("id").alias("chunk_id"))
    near = retrieval.dense(query_vectors(s, d), vectors(s, d), 20).select("qid", "chunk_id").join(chunks(s, d, "document_id"), "chunk_id")
    rows = near.select("qid", F.col("document_id").alias("chunk_id")).distinct().join(own, "chunk_id")
    return retrieval.maxsim(docs.join(own, "chunk_id").select("qid", "tok", "v").distinct(), rows)


@query("SELECT doc_id FROM documents WHERE (lang = 'de' OR lang = 'fr') AND n_chars >= 500 AND n_chars < 2000 AND (source IS NULL OR source <> 'ops-runbooks') AND NOT (batch_no IN (1, 2))")
def filter_dialect(s, d):
    spec = {"lang": ["de", "fr"], "n_chars": {"gte": 500, "lt": 2000}, "source": {"ne": "ops-runbooks"}, "$not": {"batch_no": {"in": [1, 2]}}}
    return table(s, d, "documents").where(condition(spec)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE created_at >= TIMESTAMPTZ '2026-02-01 00:00:00+00' AND created_at < TIMESTAMPTZ '2026-03-01 00:00:00+00'")
def filter_interval(s, d):
    from datetime import UTC, datetime

    return table(s, d, "documents").where(condition({"created_at": {"gte": datetime(2026, 2, 1, tzinfo=UTC), "lt": datetime(2026, 3, 1, tzinfo=UTC)}})).select("doc_id")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings")
def vector_norms(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 5).alias("norm"))


@query("SELECT vec_id, i, q FROM (SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS i, unnest(list_transform(embedding, lambda x: coalesce(round(x::DOUBLE * 127 / nullif(list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))), 0)), 0)::INT)) AS q FROM embeddings)")
def vector_quantized(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode(quantize(F.col("embedding"))).alias("i", "q"))


_ASKED_WORDS = f"list_distinct(list_filter({TOKENS % 'text'}, lambda t: length(t) > 2))"


@query(rf"""WITH {_BM25}, t AS ({ranked_sql('bs', 20)}), x AS (SELECT t.qid, t.chunk_id, t.rank, {_ASKED_WORDS.replace('text', 'title')} AS a, {TOKENS % 'content'} AS b FROM t JOIN documents ON doc_id = qid JOIN ch USING (chunk_id)),
y AS (SELECT qid, chunk_id, rank, CASE WHEN len(a) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(a), 6) END AS score FROM x)
SELECT qid, chunk_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY (rank >= 10)::INT, CASE WHEN rank < 10 THEN -score END NULLS LAST, rank, chunk_id) - 1 AS INT) AS new_rank FROM y""")
def rerank_overlap(s, d):
    fetched = retrieval.bm25(asked(s, d), texts(s, d), 20)
    full = fetched.join(asked(s, d).withColumnRenamed("text", "question"), "qid").join(texts(s, d), "chunk_id")
    scores = full.select("qid", "chunk_id", rerank.overlap_score(F.col("question"), F.col("text")).alias("model_score"))
    return rerank.rescored(fetched, scores, 10).select("qid", "chunk_id", "new_rank")


@query(f"""WITH {_BM25}, {QVECS}, t AS ({ranked_sql('bs', 20)}), x AS (SELECT t.qid, t.chunk_id, t.rank, coalesce(round(CASE WHEN len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true) THEN list_dot_product(qv.v, embedding::DOUBLE[]) / nullif(qv.m * sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 0) END, 6), 0) AS s FROM t JOIN qv USING (qid) JOIN ch USING (chunk_id))
SELECT qid, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS r, count(*) OVER (PARTITION BY qid) AS n FROM x) WHERE r <= ceil(0.5 * n) OR r = 1""")
def compress_by_vector(s, d):
    v = F.when((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull()), F.col("embedding"))
    fetched = retrieval.bm25(asked(s, d), texts(s, d), 20).join(query_vectors(s, d).withColumnRenamed("v", "qv"), "qid").join(chunks(s, d, "embedding").select("chunk_id", v.alias("v")), "chunk_id")
    return rerank.filter_by_vector(fetched).select("qid", "chunk_id")


@query()
def compress_by_sentence(s, d):
    full = retrieval.bm25(asked(s, d), texts(s, d), 10).join(asked(s, d).withColumnRenamed("text", "question"), "qid").join(texts(s, d), "chunk_id")
    return rerank.compress_sentences(full)


@query("SELECT CAST(greatest(0, e - 10) AS INT) AS low, CAST(e AS INT) AS high FROM (SELECT 47 - 5 * i AS e FROM range(0, 10) r(i)) WHERE e > 0 AND (e + 5 > 10)")
def sliding_windows(s, d):
    return s.createDataFrame(rerank.sliding_windows(47, 10, 5), "low int, high int")


def _hybrid(s, d, k=20):
    return retrieval.fuse(_legs(s, d), "rrf", k=k).select("qid", "chunk_id", "score", "rank")


@query()
def hybrid_rerank(s, d):
    """Hybrid search whose first 20 are reranked by the words that they share with the question."""
    found = _hybrid(s, d)
    full = found.join(asked(s, d).withColumnRenamed("text", "question"), "qid").join(texts(s, d), "chunk_id")
    scores = full.select("qid", "chunk_id", rerank.overlap_score(F.col("question"), F.col("text")).alias("model_score"))
    return rerank.rescored(found, scores, 20).where("new_rank < 10").select("qid", "chunk_id", "new_rank")


@query()
def hybrid_compress(s, d):
    """Hybrid search whose passages are cut to the sentences that share most with the question."""
    full = _hybrid(s, d, 10).join(asked(s, d).withColumnRenamed("text", "question"), "qid").join(texts(s, d), "chunk_id")
    return rerank.compress_sentences(full)

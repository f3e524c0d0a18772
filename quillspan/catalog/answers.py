"""Metrics, run comparison, budgets, packing and checks of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog.registry import CHUNKS, DENSE, DOCS, EVERY, TOKENS, asked, bm25_sql, chunks, query, query_vectors, ranked_sql, texts, vectors
from quillspan.operators import context, evaluation, retrieval
from quillspan.plans.once import once
from quillspan.sources.tables import table

# The questions of eval_cases against the chunks that they expect.
_CASES = "ec AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, question NULLS LAST) AS r FROM eval_cases WHERE id IS NOT NULL) WHERE r = 1)"
_EVAL = f"WITH {CHUNKS}, {_CASES}, {bm25_sql(DOCS, 'SELECT id AS qid, question AS text FROM ec')}, t AS ({ranked_sql('bs', 50)}), lab AS (SELECT DISTINCT id AS qid, unnest(expected_chunk_ids) AS doc FROM ec)"


def _cases(s, d):
    return once(table(s, d, "eval_cases"), "id", F.desc_nulls_last("created_at"), F.asc_nulls_last("question"))


def _case_lists(s, d):
    ranked = retrieval.bm25(_cases(s, d).select(F.col("id").alias("qid"), F.col("question").alias("text")), texts(s, d), 50)
    labels = _cases(s, d).select(F.col("id").alias("qid"), F.explode("expected_chunk_ids").alias("doc"), F.lit(1.0).alias("gain")).where("doc is not null")
    return ranked.select("qid", F.col("chunk_id").alias("doc"), "rank"), labels


def _metrics_sql(cuts: tuple[int, ...]) -> str:
    values = ", ".join(f"({k})" for k in cuts)
    return f"""{_EVAL}, n AS (SELECT qid, count(*) AS n FROM lab WHERE doc IS NOT NULL GROUP BY qid), h AS (SELECT t.qid, t.rank + 1 AS place FROM t JOIN lab ON t.qid = lab.qid AND t.chunk_id = lab.doc),
ids AS (SELECT qid FROM t UNION SELECT qid FROM n), k AS (SELECT qid, k FROM ids, (VALUES {values}) v(k)),
g AS (SELECT k.qid, k.k, count(place) AS hits, sum(1 / log2(place + 1)) AS dcg, min(place) AS p FROM k LEFT JOIN h ON h.qid = k.qid AND h.place <= k.k GROUP BY ALL),
ap AS (SELECT qid, k, sum(nth::DOUBLE / place) AS s FROM (SELECT k.qid, k.k, place, row_number() OVER (PARTITION BY k.qid, k.k ORDER BY place) AS nth FROM k JOIN h ON h.qid = k.qid AND h.place <= k.k) GROUP BY ALL),
rr AS (SELECT qid, 1.0::DOUBLE / min(place) AS rr FROM h GROUP BY qid)
SELECT g.qid, g.k, CASE WHEN n IS NOT NULL THEN round(hits::DOUBLE / n, 6) END AS recall, CASE WHEN n IS NOT NULL THEN round(hits::DOUBLE / g.k, 6) END AS precision, CASE WHEN n IS NOT NULL THEN (hits > 0)::INT::DOUBLE END AS hit_rate,
CASE WHEN n IS NOT NULL THEN round(coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 51) r(i) WHERE i <= least(n, g.k)), 6) END AS ndcg, CASE WHEN n IS NOT NULL THEN round(coalesce(s, 0) / least(n, g.k), 6) END AS ap, CASE WHEN n IS NOT NULL THEN round(coalesce(rr, 0), 6) END AS rr
FROM g LEFT JOIN n USING (qid) LEFT JOIN ap ON ap.qid = g.qid AND ap.k = g.k LEFT JOIN rr ON rr.qid = g.qid"""


@query(_metrics_sql(evaluation.CUTS))
def retrieval_metrics(s, d):
    return evaluation.retrieval_metrics(*_case_lists(s, d))


@query(f"SELECT k, count(recall) AS questions, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(hit_rate), 6) AS hit_rate, round(avg(ndcg), 6) AS ndcg, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr FROM ({_metrics_sql((5, 10))}) GROUP BY k")
def mean_metrics(s, d):
    return evaluation.mean_metrics(evaluation.retrieval_metrics(*_case_lists(s, d), (5, 10)))


@query(f"{_EVAL}, f AS (SELECT qid, document_id AS doc, min(rank) AS first FROM t JOIN ch USING (chunk_id) GROUP BY ALL) SELECT qid, doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY first, doc) - 1 AS INT) AS rank FROM f")
def document_grain(s, d):
    return evaluation.at_document_grain(_case_lists(s, d)[0].withColumnRenamed("doc", "chunk_id"), chunks(s, d, "document_id").select("chunk_id", F.col("document_id").alias("doc")))


# Expected answers against generated ones: every case with the generated answers to its chunks.
_PAIRS = f"{_CASES}, p AS (SELECT DISTINCT ec.id || ' ' || g.gq_id AS key, g.answer, ec.expected_answer AS reference FROM (SELECT id, expected_answer, unnest(expected_chunk_ids) AS chunk_id FROM ec) ec JOIN generated_questions g USING (chunk_id))"


def _pairs(s, d):
    cases = _cases(s, d).select("id", "expected_answer", F.explode("expected_chunk_ids").alias("chunk_id"))
    made = table(s, d, "generated_questions").select("gq_id", "chunk_id", "answer")
    return cases.join(made, "chunk_id").select(F.concat_ws(" ", "id", "gq_id").alias("key"), "answer", F.col("expected_answer").alias("reference")).distinct()


_F1 = f"""WITH {_PAIRS}, w AS (SELECT key, coalesce({TOKENS % 'answer'}, []) AS a, coalesce({TOKENS % 'reference'}, []) AS b FROM p), x AS (SELECT key, t, count(*) AS n FROM (SELECT key, unnest(a) AS t FROM w) GROUP BY ALL), y AS (SELECT key, t, count(*) AS n FROM (SELECT key, unnest(b) AS t FROM w) GROUP BY ALL),
s AS (SELECT key, sum(least(x.n, y.n)) AS s FROM x JOIN y USING (key, t) GROUP BY key), f AS (SELECT w.key, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) + len(b) = 0 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(s, 0) / (len(a) + len(b)) END, 6) AS f1 FROM w LEFT JOIN s USING (key))"""


@query(f"{_F1} SELECT key, f1 FROM f")
def token_f1(s, d):
    return evaluation.token_f1(_pairs(s, d))


# The longest common subsequence row by row: each step folds a token of the answer into the row of the table before.
_LCS = """list_reduce(list_prepend(list_transform(range(len(b) + 1), lambda i: 0::BIGINT), list_transform(range(len(a)), lambda i: [(i + 1)::BIGINT])),
  lambda row, t: list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda j: [j::BIGINT])), lambda acc, j: list_append(acc, CASE WHEN a[t[1]] = b[j[1]] THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], acc[-1]) END)))"""


@query(f"WITH {_PAIRS}, w AS (SELECT key, coalesce({TOKENS % 'answer'}, []) AS a, coalesce({TOKENS % 'reference'}, []) AS b FROM p) SELECT key, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(2.0::DOUBLE * ({_LCS})[-1] / (len(a) + len(b)), 6) END AS f1 FROM w")
def rouge_l(s, d):
    return evaluation.rouge_l(_pairs(s, d))


@query('SELECT event_type AS "group", count(*) AS n, round(avg(CASE WHEN event_type = \'error\' THEN 1.0::DOUBLE ELSE 0 END), 6) AS failure_rate, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(sum(value), 4) AS total FROM events GROUP BY event_type')
def operational_report(s, d):
    return evaluation.operational(table(s, d, "events").select(F.col("event_type").alias("group"), "value", (F.col("event_type") == "error").alias("failed")))


@query("SELECT 'm' || user_id % 3 AS model, event_type AS stage, count(*) AS calls, sum(user_id) AS prompt_tokens, sum(event_id % 50) AS completion_tokens, round(sum(value), 6) AS cost, round(avg((event_id % 5 = 0)::INT::DOUBLE), 6) AS cached_share FROM events GROUP BY ALL")
def cost_report(s, d):
    e = table(s, d, "events")
    return evaluation.operational_costs(e.select(F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), F.col("event_type").alias("stage"), F.col("user_id").alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens"), F.col("value").alias("cost"), (F.col("event_id") % 5 == 0).alias("cached")))


@query("SELECT count(*) AS cases, count_if(length(regexp_replace(coalesce(expected_answer, ''), '[\\s\\x{a0}]+', '', 'g')) > 0) AS with_answer, count_if(len(coalesce(expected_chunk_ids, [])) > 0) AS with_labels, count_if(coalesce(lower(metadata['answerable']) = 'false', false)) AS unanswerable, count(DISTINCT question) AS questions FROM eval_cases")
def dataset_stats(s, d):
    return evaluation.dataset_stats(table(s, d, "eval_cases"))


@query()
def run_comparison(s, d):
    """BM25 against dense-free BM25 over summaries: recall of each case at 5 and at 10 stands for two runs."""
    m = evaluation.retrieval_metrics(*_case_lists(s, d), (5, 10))
    run = lambda k: m.where(F.col("k") == k).select(F.lit("recall").alias("metric"), F.col("qid").alias("key"), F.col("recall").alias("value"))
    return evaluation.compare_runs(run(5), run(10)).select("metric", "n", F.round("delta", 6).alias("delta"), "verdict")


# Budgets, packing, citations

_FOUND = f"WITH {CHUNKS}, {bm25_sql(DOCS)}, t AS ({ranked_sql('bs', 20)}), f AS (SELECT t.*, content AS text, CASE WHEN length(content) > 0 THEN greatest(1, length(content) // 4) ELSE 0 END AS tokens FROM t JOIN ch USING (chunk_id))"


def _found(s, d):
    return retrieval.bm25(asked(s, d), texts(s, d), 20).join(texts(s, d), "chunk_id")


@query(f"{_FOUND} SELECT qid, chunk_id, rank, CAST(upto AS BIGINT) AS upto FROM (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank) AS upto FROM f) WHERE upto <= 2000 OR rank = 0")
def budget_prefix(s, d):
    return context.budget_prefix(_found(s, d), 2000).select("qid", "chunk_id", "rank", "upto")


@query(f"{_FOUND} SELECT qid, CAST(sum(tokens) AS BIGINT) AS tokens, CASE WHEN sum(tokens) <= 3000 THEN 'fit' WHEN sum(tokens) <= 1.6 * 3000 THEN 'truncate' ELSE 'summarize' END AS strategy FROM f GROUP BY qid")
def budget_strategy(s, d):
    from quillspan.functions.columns import approximate_tokens

    by = _found(s, d).groupBy("qid").agg(F.sum(approximate_tokens(F.col("text"))).alias("tokens"))
    return by.withColumn("strategy", context.strategy(F.col("tokens"), 3000))


@query()
def packed_context(s, d):
    from_store = F.when(F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0, "web").otherwise("vector")
    return context.pack(_found(s, d).withColumn("store", from_store), 2000, {"vector": 0.7, "web": 0.3}, 8).select("qid", "chunk_id", "rank", "tokens", "clipped")


@query()
def context_windows(s, d):
    from quillspan.functions.columns import approximate_tokens

    return context.windows_by_rank(_found(s, d).select("qid", "chunk_id", "rank", approximate_tokens(F.col("text")).alias("tokens")), 1000)


@query(f"{_FOUND} SELECT qid, count(*) AS passages, CAST(sum(length(coalesce(text, '')) + length('<untrusted_document index=\"' || (rank + 1) || '\">') + 2 + length('</untrusted_document>')) + 2 * (count(*) - 1) AS BIGINT) AS characters FROM f GROUP BY qid")
def rendered_passages(s, d):
    from quillspan.operators.guards import passages

    found = _found(s, d)
    return passages(found).join(found.groupBy("qid").agg(F.count("*").alias("passages_")), "qid").select("qid", F.col("passages_").alias("passages"), F.length("passages").cast("bigint").alias("characters"))


def _answers(s, d):
    """Generated answers with marks after their sentences."""
    g = table(s, d, "generated_questions").where("answer is not null")
    return g.select(F.col("gq_id").alias("qid"), F.regexp_replace("answer", r"\.(\s|$)", " [1, 3].$1").alias("answer"))


@query(r"SELECT qid, len(x) AS cited FROM (SELECT gq_id AS qid, list_distinct(list_transform(string_split(array_to_string(regexp_extract_all(regexp_replace(answer, '\.(\s|$)', ' [1, 3].\1', 'g'), '\[(\d+(?:\s*,\s*\d+)*)\]', 1), ','), ','), lambda n: trim(n))) AS x, answer FROM generated_questions WHERE answer IS NOT NULL) WHERE regexp_matches(answer, '\.(\s|$)')")
def citation_marks(s, d):
    return _answers(s, d).select("qid", F.size(context.citations(F.col("answer"))).cast("bigint").alias("cited")).where("cited > 0")


@query()
def answer_claims(s, d):
    return context.claims(_answers(s, d))


@query()
def renumbered_citations(s, d):
    return _answers(s, d).select("qid", context.renumbered(F.col("answer"), F.array(F.lit(3), F.lit(1))).alias("answer"))


_PLAIN = "lower(trim(regexp_replace(translate(%s, '“”„«»‘’‚–—' || chr(160), '\"\"\"\"\"\'\'\'\'\'\'-- '), '\\s+', ' ', 'g')))"


@query(f"WITH {CHUNKS} SELECT g.gq_id, coalesce(length({_PLAIN % 'g.answer'}) > 0 AND contains({_PLAIN % 'c.content'}, {_PLAIN % 'g.answer'}), false) AS verbatim FROM generated_questions g JOIN ch c USING (chunk_id)")
def verbatim_answers(s, d):
    g = table(s, d, "generated_questions").select("gq_id", "chunk_id", "answer").join(texts(s, d), "chunk_id")
    return g.select("gq_id", F.coalesce(context.verbatim(F.col("answer"), F.col("text")), F.lit(False)).alias("verbatim"))


@query()
def attributed_sentences(s, d):
    g = table(s, d, "generated_questions").where("answer is not null").select(F.col("gq_id").alias("claim_id"), F.col("chunk_id").alias("source_id"), F.col("answer").alias("claim"))
    return context.best_sentences(g, texts(s, d).withColumnRenamed("chunk_id", "source_id"))


@query()
def answer_consistency(s, d):
    g = table(s, d, "generated_questions").where("answer is not null")
    return context.consistency(g.select(F.col("chunk_id").alias("qid"), F.col("gq_id").alias("sample"), "answer"))


@query(f"{_FOUND}, a AS (SELECT doc_id AS qid FROM documents WHERE doc_id % {EVERY} = 0 AND title IS NOT NULL) SELECT a.qid, CASE WHEN count(f.qid) < 3 THEN 'insufficient_context' WHEN count(f.qid) > 0 AND count_if(length(trim(coalesce(f.text, ''))) > 0) = 0 THEN 'empty_context' END AS reason FROM a LEFT JOIN f USING (qid) GROUP BY a.qid")
def abstention(s, d):
    return context.abstention_before(_found(s, d), asked(s, d), 3)


@query(f"WITH {CHUNKS}, {DENSE}, t AS ({ranked_sql('ds', 5)}), x AS (SELECT qid, count_if(score >= 0.6) AS good, count(*) AS n FROM t GROUP BY qid) SELECT qid, CASE WHEN good = 0 THEN 'INCORRECT' WHEN good = n THEN 'CORRECT' ELSE 'AMBIGUOUS' END AS label FROM x")
def evidence_labels(s, d):
    by = retrieval.dense(query_vectors(s, d), vectors(s, d), 5).groupBy("qid").agg(F.count_if(F.col("score") >= 0.6).alias("good"), F.count("*").alias("n"))
    return by.select("qid", context.evidence_label(F.col("good"), F.col("n")).alias("label"))



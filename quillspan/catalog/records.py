"""Ingest, stored tables, events, cached answers and file loaders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.catalog.registry import CHUNKS, chunks, query
from quillspan.operators import guards, ingest
from quillspan.plans.spool import delete, new_path
from quillspan.sources import loaders
from quillspan.sources.tables import table
from quillspan.streaming.windows import windowed_counts


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(s, d):
    return windowed_counts(table(s, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 2")
def rate_limit_violations(s, d):
    return guards.rate_violations(table(s, d, "events"), 2, 7200)


@query("SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS burst FROM events) WHERE recent > 8 OR burst > 1")
def rate_limit_bursts(s, d):
    return guards.rate_violations(table(s, d, "events"), 8, 86400, burst=1)


@query("SELECT d.doc_id, CASE WHEN e.id IS NULL THEN 'new' WHEN coalesce(lower(d.checksum) = lower(e.checksum), false) THEN 'unchanged' ELSE 'changed' END AS outcome FROM documents d LEFT JOIN (SELECT id, max(checksum) AS checksum FROM documents WHERE batch_no = 0 GROUP BY id) e USING (id) WHERE d.batch_no > 0")
def checksum_outcomes(s, d):
    docs = table(s, d, "documents")
    old = docs.where("batch_no = 0").groupBy("id").agg(F.max("checksum").alias("checksum"))
    return ingest.outcomes(docs.where("batch_no > 0"), old).select("doc_id", "outcome")


_ODD = r"""[\p{L}\p{N}\p{M}_\s.,;:!?''"()\[\]{}<>/@#$%&*+=|\\`~^-]"""
_WHY = f"CASE WHEN text IS NULL THEN 'missing' WHEN length(regexp_replace(text, '[\\s\\x{{a0}}]+', '', 'g')) < 1 THEN 'empty' WHEN length(text) > 20000000 THEN 'too_large' WHEN length(left(text, 4000)) > 0 AND length(regexp_replace(left(text, 4000), '{_ODD}', '', 'g')) > 0.35 * length(left(text, 4000)) THEN 'binary' END"


@query(f"SELECT doc_id, {_WHY} AS rejected FROM documents")
def document_validation(s, d):
    return ingest.validated(table(s, d, "documents")).select("doc_id", "rejected")


@query(f"""WITH i AS (SELECT *, {_WHY} AS why, row_number() OVER (PARTITION BY coalesce(lower(checksum), 'row ' || id) ORDER BY id) AS r FROM (SELECT id, min(checksum) AS checksum, min(text) AS text FROM documents WHERE batch_no > 0 AND id IS NOT NULL GROUP BY id)),
e AS (SELECT id, max(checksum) AS checksum FROM documents WHERE batch_no = 0 AND id IN (SELECT document_id FROM chunks) GROUP BY id),
o AS (SELECT CASE WHEN why IS NOT NULL THEN 'rejected: ' || why WHEN r > 1 THEN 'repeated' WHEN e.id IS NULL THEN 'new' WHEN coalesce(lower(i.checksum) = lower(e.checksum), false) THEN 'unchanged' ELSE 'changed' END AS outcome FROM i LEFT JOIN e USING (id))
SELECT outcome, count(*) AS documents FROM o GROUP BY outcome""")
def ingest_report(s, d):
    docs = table(s, d, "documents").where("id is not null")
    new = docs.where("batch_no > 0").groupBy("id").agg(F.min("checksum").alias("checksum"), F.min("text").alias("text"))
    old = docs.where("batch_no = 0").groupBy("id").agg(F.max("checksum").alias("checksum"))
    return ingest.ingest_report(new, old, table(s, d, "chunks"))


@query("SELECT id, chunks, tokens FROM (SELECT DISTINCT id FROM documents WHERE id IS NOT NULL) JOIN (SELECT document_id AS id, count(*) AS chunks, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens FROM (SELECT chunk_id, min(document_id) AS document_id, max(token_count) AS token_count FROM chunks GROUP BY chunk_id) GROUP BY document_id) USING (id)")
def document_summaries(s, d):
    return ingest.document_summaries(table(s, d, "documents"), table(s, d, "chunks")).select("id", "chunks", "tokens")


@query("SELECT id, chunks, epoch_us(last_change) AS changed FROM (SELECT id, max(created_at) AS last_change FROM documents WHERE id IS NOT NULL AND contains(lower(source), 'wiki') GROUP BY id) JOIN (SELECT document_id AS id, count(*) AS chunks FROM (SELECT chunk_id, min(document_id) AS document_id FROM chunks GROUP BY chunk_id) GROUP BY document_id) USING (id) ORDER BY last_change DESC, id LIMIT 25")
def document_summaries_of_source(s, d):
    out = ingest.document_summaries(table(s, d, "documents"), table(s, d, "chunks"), "Wiki", 25)
    return out.select("id", "chunks", F.unix_micros("last_change").alias("changed"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(lower(checksum), 'row ' || doc_id) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def duplicate_checksum_first(s, d):
    return ingest.first_of_checksum(table(s, d, "documents")).select("doc_id")


@query("SELECT id, epoch_us(max(created_at)) AS changed FROM documents WHERE id IS NOT NULL AND batch_no > 0 GROUP BY id UNION ALL SELECT id, epoch_us(max(created_at)) FROM documents WHERE batch_no = 0 AND id IS NOT NULL AND id NOT IN (SELECT id FROM documents WHERE batch_no > 0 AND id IS NOT NULL) GROUP BY id")
def upsert_documents(s, d):
    docs = table(s, d, "documents").where("id is not null").select("id", "created_at", "batch_no", "title", "source")
    stored = ingest.upsert(docs.where("1 = 0"), docs.where("batch_no = 0"))
    return ingest.upsert(stored, docs.where("batch_no > 0")).select("id", F.unix_micros("created_at").alias("changed"))


@query("SELECT chunk_id, epoch_us(max(created_at)) AS changed FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id")
def upsert_chunks(s, d):
    c = table(s, d, "chunks").select("chunk_id", "created_at", "content")
    first = c.where(F.col("created_at") < F.lit("2026-02-01").cast("timestamp"))
    later = c.where(~(F.col("created_at") < F.lit("2026-02-01").cast("timestamp")) | F.col("created_at").isNull())
    stored = ingest.upsert(c.where("1 = 0"), first, "chunk_id")
    return ingest.upsert(stored, later, "chunk_id").select("chunk_id", F.unix_micros("created_at").alias("changed"))


@query("SELECT DISTINCT chunk_id FROM chunks WHERE document_id NOT IN (SELECT id FROM documents WHERE batch_no = 8 AND id IS NOT NULL)")
def stale_purge(s, d):
    gone = table(s, d, "documents").where("batch_no = 8 and id is not null").select("id")
    return ingest.purge(table(s, d, "chunks"), gone).select("chunk_id").distinct()


@query("WITH g AS (SELECT DISTINCT id FROM documents WHERE batch_no = 8 AND id IS NOT NULL UNION ALL SELECT 'unknown') SELECT g.id, (SELECT count(*) FROM documents d WHERE d.id = g.id) AS documents, (SELECT count(*) FROM chunks c WHERE c.document_id = g.id) AS chunks FROM g")
def deletion_report(s, d):
    gone = table(s, d, "documents").where("batch_no = 8 and id is not null").select("id").unionByName(s.createDataFrame([("unknown",)], "id string"))
    return ingest.without_documents(table(s, d, "documents"), table(s, d, "chunks"), gone)[2]


@query(f"WITH {CHUNKS} SELECT chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, sha256(coalesce(content, '')) ORDER BY chunk_index, chunk_id) AS k FROM ch) WHERE k = 1")
def unique_chunks(s, d):
    return ingest.unique_chunks(chunks(s, d, "document_id", "chunk_index")).select("chunk_id")


@query(f"WITH {CHUNKS} SELECT chunk_id, parent_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY chunk_index, chunk_id) - 1 AS INT) AS place FROM ch WHERE parent_id IN (SELECT chunk_id FROM ch WHERE chunk_level = 1) AND parent_id IS NOT NULL")
def children_of(s, d):
    own = chunks(s, d, "parent_id", "chunk_index", "chunk_level")
    parents = own.where("chunk_level = 1").select(F.col("chunk_id").alias("parent_id"))
    return ingest.children_of(own.where("parent_id is not null"), parents).select("chunk_id", "parent_id", "place")


@query("SELECT tenant_id, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY tenant_id")
def counts_by_tenant(s, d):
    return table(s, d, "chunks").groupBy("tenant_id").agg(F.countDistinct("chunk_id").alias("chunks"))


# Cached answers: vectors of `embeddings` asked again by their neighbours in number.
_CACHE = "c AS (SELECT vec_id AS entry_id, embedding::DOUBLE[] AS v, 't' || label % 3 AS tenant_id, 's' || vec_id % 2 AS scope, TIMESTAMP '2026-01-01 00:00:00' + to_seconds(vec_id * 60) AS created_at FROM embeddings WHERE vec_id % 2 = 0)"


def _cache(s, d):
    e = table(s, d, "embeddings").where("vec_id % 2 = 0")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2026-01-01 00:00:00")) + F.col("vec_id") * 60)
    return e.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("v"), F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("tenant_id"), F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")).alias("scope"), at.alias("created_at"))


@query(f"WITH {_CACHE}, q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS v, 't' || label % 3 AS tenant_id, 's0' AS scope FROM embeddings WHERE vec_id % 5 = 0), x AS (SELECT qid, entry_id, round(list_cosine_similarity(q.v, c.v), 6) AS similarity FROM q JOIN c USING (tenant_id, scope) WHERE epoch(TIMESTAMP '2026-01-01 02:00:00') - epoch(created_at) <= 3600) SELECT qid, entry_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, entry_id) AS r FROM x WHERE similarity >= 0.6) WHERE r = 1")
def cache_hits(s, d):
    q = table(s, d, "embeddings").where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("v"), F.concat(F.lit("t"), (F.col("label") % 3).cast("string")).alias("tenant_id"), F.lit("s0").alias("scope"))
    return ingest.cache_hits(q, _cache(s, d), F.lit("2026-01-01 02:00:00").cast("timestamp"), 0.6)


@query("SELECT id AS entry_id FROM (SELECT id, list(c) AS cites FROM (SELECT id, unnest(expected_chunk_ids) AS c FROM eval_cases) GROUP BY id) WHERE NOT list_has_any(cites, (SELECT list(DISTINCT chunk_id) FROM chunks WHERE tenant_id = 'tnt-brethoth')) UNION SELECT id FROM eval_cases GROUP BY id HAVING coalesce(max(len(expected_chunk_ids)), 0) = 0")
def cache_invalidated(s, d):
    cases = table(s, d, "eval_cases").select(F.col("id").alias("entry_id"), F.explode_outer("expected_chunk_ids").alias("c")).groupBy("entry_id").agg(F.collect_set("c").alias("document_ids"))
    gone = table(s, d, "chunks").where("tenant_id = 'tnt-brethoth'").select(F.col("chunk_id").alias("id"))
    return ingest.invalidated(cases, gone).select("entry_id")


# Files: documents written out as files and loaded again.


def _written(s, d, kind: str) -> str:
    path = new_path(s, "files")
    docs = table(s, d, "documents").where(F.col("doc_id").isNotNull() & (F.col("text").rlike(r"[^\s\u00a0]") | F.lit(kind == "csv"))).select("doc_id", "source", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    if kind == "json":
        docs.select(F.col("doc_id").cast("string").alias("id"), "title", "content", "source").coalesce(4).write.json(path)
    else:
        docs.select(F.col("doc_id").alias("id"), "title", F.regexp_replace("source", "[\r\n\"]", " ").alias("source")).coalesce(4).write.option("header", True).option("escape", '"').csv(path)
    return path


@query(r"SELECT doc_id::VARCHAR AS id, nullif(title, '') AS title, length(trim(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8199) || chr(8239) || chr(12288))) AS n FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\s\x{a0}]')")
def load_json_lines(s, d):
    path, named = _written(s, d, "json"), new_path(s, "files")
    fs = s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(s._jvm.org.apache.hadoop.fs.Path(named))
    for i, f in enumerate(fs.globStatus(s._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*"))):
        fs.rename(f.getPath(), s._jvm.org.apache.hadoop.fs.Path(f"{named}/p{i}.jsonl"))
    delete(s, path)
    docs = loaders.load(s, named, "*.jsonl")
    return docs.where("error is null and content <> ''").select("id", "title", F.length("content").cast("bigint").alias("n"))


@query("SELECT doc_id::VARCHAR AS id, nullif(trim(title), '') AS title FROM documents WHERE doc_id IS NOT NULL")
def load_csv(s, d):
    docs = loaders.load(s, _written(s, d, "csv"), "*.csv")
    return docs.where("error is null").select("id", F.when(F.trim("title") != "", F.trim("title")).alias("title"))

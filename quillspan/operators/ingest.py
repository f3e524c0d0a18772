"""Incremental state: change detection, upserts, purges and validation of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import approximate_tokens, cosine
from quillspan.operators.guards import CONTROL, looks_binary


def outcomes(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """incoming(id, checksum), existing(id, checksum) -> incoming with outcome new, changed or unchanged; a null checksum is changed."""
    old = existing.select("id", F.col("checksum").alias("_old")).dropDuplicates(["id"])
    same = F.coalesce(F.lower("checksum") == F.lower("_old"), F.lit(False))
    seen = old.withColumn("_seen", F.lit(True))
    outcome = F.when(F.col("_seen").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return incoming.join(seen, "id", "left").withColumn("outcome", outcome).drop("_old", "_seen")


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """The latest incoming row of each key, and the existing rows of all other keys; a null key is none."""
    last = incoming.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def purge(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """chunks(document_id, ...) without those of the documents gone(id)."""
    return chunks.join(gone.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")


def first_of_checksum(rows: DataFrame, order: str = "doc_id") -> DataFrame:
    """The first row of every checksum; rows without one are kept."""
    w = Window.partitionBy("_sum").orderBy(order)
    keyed = rows.withColumn("_sum", F.coalesce(F.lower("checksum"), F.concat(F.lit("row "), F.col(order).cast("string"))))
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_sum")


def validated(docs: DataFrame, text: str = "text", most: int = 20_000_000, least: int = 1, tenant: str | None = None) -> DataFrame:
    """Adds `rejected`: missing, empty, too_large, binary, tenantless or null, and approximate token counts; control characters of the text become blanks.

    `tenant` names the column that must be filled.
    """
    t = F.col(text)
    why = F.when(t.isNull(), "missing").when(F.length(F.regexp_replace(t, r"[\s\u00a0]+", "")) < least, "empty").when(F.length(t) > most, "too_large").when(looks_binary(t), "binary")
    if tenant:
        why = why.when(F.length(F.trim(F.coalesce(F.col(tenant), F.lit("")))) == 0, "tenantless")
    return docs.withColumn("rejected", why).withColumn("tokens", approximate_tokens(t)).withColumn(text, F.regexp_replace(t, CONTROL, " "))


def document_summaries(docs: DataFrame, chunks: DataFrame, source: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, chunks, tokens, last_change) per document that has chunks; chunks are counted before they meet the documents.

    `source` keeps documents whose source contains it, whatever the case; the latest `limit` come first.
    """
    by = chunks.groupBy("chunk_id").agg(F.min("document_id").alias("id"), F.max("token_count").alias("t")).groupBy("id").agg(F.count("*").alias("chunks"), F.sum(F.coalesce("t", F.lit(0))).cast("bigint").alias("tokens"))
    some = docs.where("id is not null")
    if source:
        some = some.where(F.contains(F.lower("source"), F.lit(source.lower())))
    out = some.groupBy("id").agg(F.max("created_at").alias("last_change")).join(by, "id")
    return out if limit is None else out.orderBy(F.desc("last_change"), "id").limit(limit)


def in_order(rows: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows of the given ids(place, key), with the place that they were asked at; unknown ids have no row."""
    return ids.join(rows, key).orderBy("place")


def children_of(chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """chunks whose parent is one of parents(parent_id), in order of their index."""
    return chunks.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("parent_id").orderBy("chunk_index", "chunk_id")) - 1)


def without_documents(documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks without those of gone(id), and (id, documents, chunks): how many rows that took for each id, 0 for unknown ones."""
    ids = gone.select("id").distinct()
    d = documents.join(ids, "id").groupBy("id").agg(F.count("*").alias("documents"))
    c = chunks.withColumnRenamed("document_id", "id").join(ids, "id").groupBy("id").agg(F.count("*").alias("chunks"))
    report = ids.join(d, "id", "left").join(c, "id", "left").fillna(0, ["documents", "chunks"])
    return documents.join(ids, "id", "left_anti"), purge(chunks, ids), report


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """Of chunks with equal content in one document the first by index."""
    w = Window.partitionBy("document_id", F.sha2(F.coalesce("content", F.lit("")), 256)).orderBy("chunk_index", "chunk_id")
    return chunks.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ingest_report(incoming: DataFrame, existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """incoming(id, checksum, text), existing(id, checksum), chunks(document_id) of stored documents -> (outcome, documents).

    Outcomes add up to the incoming rows: rejected (with its reason), repeated (a checksum that came before in the batch),
    new, changed, unchanged. A stored document without chunks counts as new: its chunks were never written.
    """
    checked = validated(incoming).withColumn("_r", F.row_number().over(Window.partitionBy(F.coalesce(F.lower("checksum"), F.concat(F.lit("row "), F.col("id")))).orderBy("id")))
    whole = existing.join(chunks.select(F.col("document_id").alias("id")).distinct(), "id", "left_semi")
    bad = checked.where("rejected is not null").select(F.concat(F.lit("rejected: "), F.col("rejected")).alias("outcome"))
    again = checked.where("rejected is null and _r > 1").select(F.lit("repeated").alias("outcome"))
    rest = outcomes(checked.where("rejected is null and _r = 1"), whole).select("outcome")
    return bad.unionByName(again).unionByName(rest).groupBy("outcome").agg(F.count("*").alias("documents"))


# Cached answers


def scope_key(filters: Column, top_k: Column, pipeline: Column) -> Column:
    """What a cached answer holds for besides its question: filters, cut and pipeline."""
    return F.sha2(F.to_json(F.struct(filters.alias("filters"), top_k.alias("top_k"), pipeline.alias("pipeline"))), 256)


def cache_hits(questions: DataFrame, cache: DataFrame, now: Column, threshold: float = 0.97, seconds: int = 3600) -> DataFrame:
    """questions(qid, v, tenant_id, scope), cache(entry_id, v, tenant_id, scope, created_at) -> (qid, entry_id, similarity): the nearest entry of the same tenant and scope that is fresh and at the threshold.

    Questions meet only entries of their tenant and scope.
    """
    live = cache.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= seconds).select("entry_id", F.col("v").alias("_v"), "tenant_id", "scope")
    near = questions.join(live, ["tenant_id", "scope"]).withColumn("similarity", F.round(cosine(F.col("v"), F.col("_v")), 6)).where(F.col("similarity") >= threshold)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "entry_id")))
    return best.where("_r = 1").select("qid", "entry_id", "similarity")


def cached(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """cache and answers(entry_id, ..., abstained): answers replace entries of their id; abstentions are never kept."""
    new = answers.where(~F.coalesce("abstained", F.lit(False))).drop("abstained")
    return cache.join(new.select("entry_id"), "entry_id", "left_anti").unionByName(new)


def invalidated(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """cache(entry_id, document_ids, ...) without the entries that cite any document of gone(id)."""
    cites = cache.select("entry_id", F.explode("document_ids").alias("id")).join(gone.select("id").distinct(), "id", "left_semi")
    return cache.join(cites.select("entry_id").distinct(), "entry_id", "left_anti")

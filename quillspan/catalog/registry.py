"""Registered queries and the DuckDB SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.plans.once import once
from quillspan.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Every 50th row asks, against all rows.
EVERY = 50


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def chunks(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks, re-delivered ones once: the latest."""
    rows = table(s, d, "chunks").select("chunk_id", "created_at", "content", *[c for c in columns if c not in ("chunk_id", "created_at", "content")])
    return once(rows, "chunk_id", F.desc_nulls_last("created_at"), F.asc_nulls_last("content"))


def texts(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return chunks(s, d, *columns).select("chunk_id", F.col("content").alias("text"), *columns)


def vectors(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return chunks(s, d, "embedding", *columns).select("chunk_id", F.col("embedding").alias("v"), *columns)


def asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where(f"doc_id % {EVERY} = 0 and title is not null").select(F.col("doc_id").alias("qid"), F.col("title").alias("text"))


def query_vectors(s: SparkSession, d: str) -> DataFrame:
    """The vector of each asking document's first chunk that has one."""
    v = F.col("embedding")
    usable = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull()) & F.exists(v, lambda x: x != 0)
    first = chunks(s, d, "embedding", "document_id", "chunk_index").where(usable)
    docs = table(s, d, "documents").where(f"doc_id % {EVERY} = 0").select(F.col("doc_id").alias("qid"), F.col("id").alias("document_id"))
    return docs.join(first, "document_id").groupBy("qid").agg(F.min(F.struct("chunk_index", "chunk_id", v.alias("v"))).alias("x")).select("qid", "x.v")


WORD = r"[\p{L}\p{N}_]+"
#: Tokens of a text in SQL.
TOKENS = rf"regexp_extract_all(lower(%s), '{WORD}')"
CHUNKS = "ch AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, content NULLS LAST) AS r FROM chunks WHERE chunk_id IS NOT NULL) WHERE r = 1)"
NORM = "sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))"
USABLE = f"embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL), true) AND {NORM} > 0"
QVECS = f"qv AS (SELECT qid, embedding::DOUBLE[] AS v, {NORM} AS m FROM (SELECT d.doc_id AS qid, c.embedding, row_number() OVER (PARTITION BY d.doc_id ORDER BY c.chunk_index, c.chunk_id) AS r FROM documents d JOIN ch c ON c.document_id = d.id WHERE d.doc_id % {EVERY} = 0 AND {USABLE.replace('embedding', 'c.embedding')}) WHERE r = 1)"


def bm25_sql(docs: str, questions: str = f"SELECT doc_id AS qid, title AS text FROM documents WHERE doc_id % {EVERY} = 0 AND title IS NOT NULL") -> str:
    """CTEs up to bs(qid, chunk_id, score) over docs(chunk_id, text)."""
    return f"""tok AS (SELECT chunk_id, coalesce({TOKENS % 'text'}, []) AS t FROM ({docs})),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({TOKENS % 'text'}) AS term FROM ({questions}))),
bs AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)"""


DOCS = "SELECT chunk_id, content AS text FROM ch"
DENSE = f"""{QVECS}, nv AS (SELECT chunk_id, embedding::DOUBLE[] AS v, {NORM} AS m FROM ch WHERE {USABLE}),
ds AS (SELECT qid, b.chunk_id, round(list_dot_product(a.v, b.v) / (a.m * b.m), 6) AS score FROM qv a, nv b)"""


def ranked_sql(name: str, k: int) -> str:
    return f"SELECT qid, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) - 1 AS INT) AS rank FROM {name} WHERE score > 0 OR '{name}' <> 'bs') WHERE rank < {k}"

"""Problem 1: groups of texts that share most of their content (near-duplicate records with small edits)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.overlap_join import similar_classes
from quillspan.plans.spool import spool
from quillspan.sources.tables import table

THRESHOLD = 0.6
WIDTH = 3
MIN_TOKENS = 20
#: Copies of one text are paired with one another up to this group size.
EXPAND = 32


def near_copy_groups(rows: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, min_tokens: int = MIN_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows(key, text) -> (membership, links, degrees).

    membership(key, representative): each key whose text takes part and the smallest key with the same shingle set.
    links(key_a, key_b, similarity): pairs of representatives at or above the threshold, key_a < key_b. degrees(key,
    representative, copies, links): for each member the other rows with its set and the links of its representative.

    Null, empty and short texts (under `min_tokens` tokens) are no members; repeated rows of one key count once (with
    different texts once for each); an empty table gives empty results.
    """
    members, links = similar_classes(rows, threshold, width, min_tokens)
    members = members.dropDuplicates(["key", "did"])
    classes = spool(members.groupBy("did").agg(F.min("key").alias("representative"), (F.count("*") - 1).alias("copies")))
    a = classes.select(F.col("did").alias("a"), F.col("representative").alias("x"))
    b = classes.select(F.col("did").alias("b"), F.col("representative").alias("y"))
    named = spool(links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity"))
    membership = spool(members.join(classes, "did").select("key", "representative", "copies"))
    number = named.select(F.explode(F.array("key_a", "key_b")).alias("representative")).groupBy("representative").agg(F.count("*").alias("links"))
    degrees = membership.join(number, "representative", "left").select("key", "representative", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return membership.select("key", "representative"), named, degrees


def near_copy_pairs(rows: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, min_tokens: int = MIN_TOKENS, expand: int = EXPAND) -> DataFrame:
    """rows(key, text) -> (key_a, key_b, similarity), key_a < key_b: pairs of keys.

    Groups of at most `expand` copies are written out, within and across groups; a larger group shows its other members
    only as pairs with its representative, which keeps the rows linear in the copies, and `near_copy_groups` is the
    membership to read them with. No link between different texts is lost. Null, empty, short and repeated rows and
    empty tables are treated as in `near_copy_groups`.
    """
    members, links = similar_classes(rows, threshold, width, min_tokens)
    members = members.dropDuplicates(["key", "did"])
    classes = members.groupBy("did").agg(F.count("*").alias("copies"), F.min("key").alias("representative"))
    spread = spool(members.join(classes, "did"))
    shown = spread.where((F.col("copies") <= expand) | (F.col("key") == F.col("representative")))
    a = shown.select(F.col("did").alias("a"), F.col("key").alias("x"))
    b = shown.select(F.col("did").alias("b"), F.col("key").alias("y"))
    across = links.join(a, "a").join(b, "b").select("x", "y", "similarity")
    copied = shown.where("copies > 1")
    within = copied.select("did", F.col("key").alias("x")).join(copied.select("did", F.col("key").alias("y")), "did").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    star = spread.where((F.col("copies") > expand) & (F.col("key") != F.col("representative"))).select(F.col("representative").alias("x"), F.col("key").alias("y"), F.lit(1.0).alias("similarity"))
    every = across.unionByName(within).unionByName(star).where("x != y")
    return every.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Content by chunk_id. Re-delivered rows repeat a chunk's content and fall together by class later on."""
    return table(spark, folder, "chunks").select(F.col("chunk_id").alias("key"), F.col("content").alias("text")).where("key is not null")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different chunks with content similarity of at least 0.6."""
    return near_copy_pairs(_chunks(spark, folder)).select(F.col("key_a").alias("chunk_id_a"), F.col("key_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk that takes part: its group of copies, how many copies it has and how many other groups are similar."""
    return near_copy_groups(_chunks(spark, folder))[2].withColumnRenamed("key", "chunk_id")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
_SHINGLES = r"""w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS x FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE content IS NOT NULL AND chunk_id IS NOT NULL)),
s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])) AS g FROM w WHERE len(x) >= 20),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id), o AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE o >= 0.6 * (x.n + y.n - o) - 1e-9)"""
ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_SHINGLES} SELECT a AS chunk_id_a, b AS chunk_id_b FROM p",
    "p1_groups": f"""WITH {_SHINGLES}, c AS (SELECT chunk_id, list_sort(list(g)) AS k FROM s GROUP BY chunk_id), r AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY k) AS representative, count(*) OVER (PARTITION BY k) - 1 AS copies FROM c),
l AS (SELECT x AS representative, count(*) AS links FROM (SELECT unnest([a, b]) AS x FROM p JOIN r ra ON ra.chunk_id = a AND ra.representative = a JOIN r rb ON rb.chunk_id = b AND rb.representative = b) GROUP BY x)
SELECT chunk_id, representative, copies, coalesce(links, 0) AS links FROM r LEFT JOIN l USING (representative)""",
}

"""Problem 5: new batches checked against everything accepted so far, by incremental record linkage.

What is known of accepted documents lies in a folder, the index: the packed blocking keys of their shingle sets, the sets,
their fields, and a forest of parent pointers that says which cluster each document is in. `accept` links one batch: its
texts are shingled once, its keys probe the key table, candidates are compared on the stored sets, documents are accepted
in order, and the batch's part of each table is appended. No text of an earlier batch is read again. Candidates also get a
score from field agreements with learned weights, which decides under which accepted document a duplicate is filed; whether
it is one, is decided by the exact check alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.overlap_join import KEYS, SENT, accumulated, class_sets, multiplied, opened_keys, pack, packed_keys, ranges_for, verified, without
from quillspan.operators.graph import components
from quillspan.plans.folds import fold
from quillspan.plans.spool import counted, discard, new_path, observed, release, spool
from quillspan.sources.tables import table

THRESHOLD = 0.7
WIDTH = 3
MIN_TOKENS = 20
#: Bits for each key of a batch in the bitmap that thins out the key table before it is shuffled, and its bytes at most.
BITS_A_KEY = 16
#: A batch of so few keys doesn't touch all buckets.
SMALL = 1_000
MOST_BYTES = 1 << 25


def agreement_weights(patterns: list[tuple[tuple[int, ...], int]], levels: tuple[int, ...], rounds: int = 25) -> tuple[float, list[np.ndarray]]:
    """Fellegi-Sunter weights by expectation-maximization.

    patterns: (agreement level of each field, how many pairs have them), at most the product of `levels` of them.
    Returns the prior log-odds of a match and for each field the log-ratio of each level. An empty list gives zeros.
    """
    if not patterns:
        return 0.0, [np.zeros(n) for n in levels]
    x = np.array([p for p, _ in patterns])
    w = np.array([c for _, c in patterns], dtype=float)
    # Starts from the last field, the share of met keys, whose order is known: more met keys, more likely a match.
    g = (x[:, -1] + 0.5) / levels[-1]
    for _ in range(rounds):
        m, u = [], []
        for f, n in enumerate(levels):
            a = np.bincount(x[:, f], w * g, n) + 0.5
            b = np.bincount(x[:, f], w * (1 - g), n) + 0.5
            m.append(a / a.sum())
            u.append(b / b.sum())
        prior = (w @ g + 0.5) / (w.sum() + 1)
        odds = np.log(prior / (1 - prior)) + sum(np.log(m[f][x[:, f]] / u[f][x[:, f]]) for f in range(len(levels)))
        g = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return float(np.log(prior / (1 - prior))), [np.log(m[f] / u[f]) for f in range(len(levels))]


class Index:
    """The tables in a folder that all executors share; every batch has a part of each, numbered in order of acceptance."""

    SCHEMAS = {
        "sets": "did bigint, n int, members binary",
        "keys": KEYS,
        "classes": "did bigint, n int, doc_id bigint, batch_no int, checksum string, source string",
        "links": "doc_id bigint, head bigint, similarity double, score double",
        "parents": "node bigint, parent bigint",
    }

    def __init__(self, spark: SparkSession, path: str, threshold: float = THRESHOLD):
        self.spark, self.path, self.threshold = spark, path, threshold
        self.parts: dict[str, int] = {name: self._count(name) for name in self.SCHEMAS}
        self.sketch: np.ndarray | None = None
        if self.parts["classes"]:
            rows = spark.read.parquet(f"{path}/order").orderBy("seg").collect()  # fixed size
            self.sketch, self.ranges = np.concatenate([np.frombuffer(r.part, np.int32) for r in rows]), rows[0].ranges

    def _count(self, name: str) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return len(files.listStatus(folder)) if files.exists(folder) else 0

    def read(self, name: str, first: int = 0, upto: int | None = None) -> DataFrame:
        upto = self.parts[name] if upto is None else upto
        reader = self.spark.read.schema(self.SCHEMAS[name])
        if upto <= first:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return reader.parquet(*[f"{self.path}/{name}/part-{i}" for i in range(first, upto)])

    def append(self, name: str, df: DataFrame) -> DataFrame:
        out = spool(df, path=f"{self.path}/{name}/part-{self.parts[name]}")
        self.parts[name] += 1
        return out

    def fix_order(self, sketch: np.ndarray, columns: int) -> None:
        """The order of columns and the ranges are those of the first part ever after: any fixed order keeps the result exact."""
        self.sketch, self.ranges = sketch, ranges_for(columns)
        width = len(sketch) // 16
        rows = [(i, self.ranges, bytearray(sketch[i * width : (i + 1) * width].astype(np.int32).tobytes())) for i in range(16)]
        spool(self.spark.createDataFrame(rows, "seg int, ranges int, part binary"), path=f"{self.path}/order")


def _first_of_class(sets: DataFrame, batch_no: int) -> DataFrame:
    first = sets.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "did", "n", "checksum", "source")).alias("x"))
    return first.select("c1", "c2", "x.did", "x.n", "x.doc_id", F.lit(batch_no).alias("batch_no"), F.lower("x.checksum").alias("checksum"), F.lower(F.trim("x.source")).alias("source"))


def _shingled(index: Index, records: DataFrame, batch_no: int) -> tuple[DataFrame, DataFrame, int]:
    """Sets of the records (appended to the index), the first record of each class, and how many of these there are."""
    some = records.select("doc_id", "checksum", "source", "text").where("doc_id is not null")
    seq = index.parts["sets"]
    sets, sketch = class_sets(some, WIDTH, MIN_TOKENS, seq, f"{index.path}/sets/part-{seq}", count=index.sketch is None)
    index.parts["sets"] += 1
    firsts, number = counted(_first_of_class(sets, batch_no))
    if index.sketch is None:
        index.fix_order(sketch, firsts.agg(F.sum("n")).first()[0] or 0)
    return sets, firsts, number


def _keys_of(index: Index, sets: DataFrame, firsts: DataFrame, number: int) -> tuple[DataFrame, int]:
    """The first records' packed keys, appended to the index, and how many there are."""
    if number <= SENT:
        own, others = without(sets.select("did", "members"), firsts.select("did"), number, keep=True), None
    else:  # copies are fewer
        others, copies = counted(sets.select("did").join(firsts.select("did"), "did", "left_anti"))
        own = without(sets.select("did", "members"), others, copies)
    seen = Observation()
    packed = packed_keys(own, index.sketch, index.ranges, index.threshold).observe(seen, F.sum("m").alias("m"))
    out = index.append("keys", packed.sortWithinPartitions("bucket"))
    if others is not None:
        discard(others)
    return out, observed(seen, "m")


def begin(index: Index, history: DataFrame) -> None:
    """history(doc_id, checksum, source, text): accepted as it is; the first part of an empty index."""
    sets, firsts, number = _shingled(index, history, 0)
    _keys_of(index, sets, firsts, number)
    index.append("classes", firsts.drop("c1", "c2"))


def thinned(old: DataFrame, new: DataFrame, keys: int) -> DataFrame:
    """The packed keys of `old` that may be among the `keys` of `new`, by a bitmap of fixed size; all, where `new` would fill it.

    For a small batch only the buckets that it has are read.
    """
    size = 1 << max(12, (keys * BITS_A_KEY // 8).bit_length())
    if not keys:
        return old.limit(0)
    if keys <= SMALL:
        old = old.where(F.col("bucket").isin([r.bucket for r in new.select("bucket").distinct().collect()]))  # at most SMALL
    if size > MOST_BYTES:
        return old

    def bit_of(bucket: int, h: np.ndarray) -> np.ndarray:
        salt = np.uint64(bucket * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return ((h.astype(np.uint64) + salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(size * 8)

    def mark(acc: np.ndarray, batch: pa.RecordBatch) -> None:
        for bucket, m, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bit = bit_of(bucket, opened_keys(m, k)[0])
            np.bitwise_or.at(acc, (bit >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (bit & np.uint64(7)).astype(np.uint8)))

    bitmap = old.sparkSession.sparkContext.broadcast(fold(new.select("bucket", "m", "keys").coalesce(8), size, "uint8", mark, np.bitwise_or))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            out = []
            for bucket, m, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, did, code = opened_keys(m, k)
                bit = bit_of(bucket, h)
                ok = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                if ok.any():
                    h = h[ok]
                    out.append((bucket, len(h), pack(np.diff(h, prepend=np.uint32(0)), did[ok], code[ok])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "m", "keys"])

    return old.select("bucket", "m", "keys").mapInArrow(run, KEYS)


def scored(pairs: DataFrame) -> DataFrame:
    """Adds to candidate pairs `score`: the log-odds of a match under weights learned from how often fields agree."""
    agree = lambda c: F.when(F.col(c + "_a").isNull() | F.col(c + "_b").isNull(), 1).when(F.col(c + "_a") == F.col(c + "_b"), 2).otherwise(0)
    near = F.least(F.lit(4), F.floor(5 * F.least("n_a", "n_b") / F.greatest("n_a", "n_b"))).cast("int")
    both = spool(pairs.withColumn("levels", F.array(agree("checksum"), agree("source"), near)))
    counts = both.groupBy("levels").count().collect()  # at most 3 * 3 * 5 rows
    prior, weights = agreement_weights([(tuple(r.levels), r["count"]) for r in counts], (3, 3, 5))
    score = F.lit(prior)
    for f, w in enumerate(weights):
        score = score + F.element_at(F.array(*[F.lit(float(v)) for v in w]), F.element_at("levels", f + 1) + 1)
    return both.withColumn("score", score)


def accepted_of(firsts: DataFrame, hit: DataFrame, links: DataFrame) -> DataFrame:
    """(did) of a batch's classes that are accepted: in order of doc_id, each without a link to an accepted one.

    hit(did): those with a link to an earlier batch; links(first, second): linked classes of the batch, in order. A round
    settles every class whose earlier links are settled, so rounds number the longest chain of links.
    """
    rejected = spool(hit.distinct())
    free, number = counted(links.join(rejected.withColumnRenamed("did", "second"), "second", "left_anti").join(rejected.withColumnRenamed("did", "first"), "first", "left_anti"))
    while number:
        # Whatever has no earlier open link is accepted; what it is linked to, is rejected and links no more.
        heads = free.select(F.col("first").alias("did")).distinct().join(free.select(F.col("second").alias("did")), "did", "left_anti")
        gone = spool(free.join(heads.withColumnRenamed("did", "first"), "first", "left_semi").select(F.col("second").alias("did")).distinct())
        rejected = rejected.unionByName(gone)
        free, number = counted(free.join(gone.withColumnRenamed("did", "second"), "second", "left_anti").join(gone.withColumnRenamed("did", "first"), "first", "left_anti"))
    return firsts.select("did").join(rejected, "did", "left_anti")


def accept(index: Index, records: DataFrame, batch_no: int) -> DataFrame:
    """Link a batch records(doc_id, checksum, source, text) to the index, append it, and return found(doc_id_a, doc_id_b).

    doc_id_b is similar to an accepted document; doc_id_a is the smallest doc_id of those accepted before it. Documents of
    a batch are accepted in order of doc_id. Texts that are null, empty or shorter than MIN_TOKENS tokens take no part and
    rows without a doc_id neither; repeated rows of a doc_id count once each; an empty batch appends empty parts.
    """
    spark, t = index.spark, index.threshold
    sets, firsts, number = _shingled(index, records, batch_no)
    new, size = _keys_of(index, sets, firsts, number)
    keys = thinned(index.read("keys", 0, index.parts["keys"] - 1), new, size).withColumn("fresh", F.lit(False)).unionByName(new.select("bucket", "m", "keys").withColumn("fresh", F.lit(True)))
    met, tiles = multiplied(keys, index.ranges, t)
    # Candidates with the fields of accepted documents and of the batch's own.
    known = index.read("classes").unionByName(firsts.drop("c1", "c2"))
    side = lambda x: known.select([F.col(c).alias(f"{c}_{x}" if c != "did" else x) for c in known.columns])
    candidates = scored(accumulated(met, tiles, index.ranges, t).join(side("a"), "a").join(side("b"), "b"))
    fields = ["a", "b", "doc_id_a", "doc_id_b", "score"]
    links = spool(verified(candidates.select(*fields), index.read("sets"), t))
    # Of a pair within the batch the one with the smaller doc_id comes first.
    within = F.shiftright("a", 52) == index.parts["sets"] - 1
    turned = within & (F.col("doc_id_a") > F.col("doc_id_b"))
    pick = lambda c, x, y: F.when(turned, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}")).alias(f"{c}{x}")
    links = links.select(*[pick(c, x, y) for c in ("", "doc_id_") for x, y in ("ab", "ba")], "score", "similarity", within.alias("within"))
    outside, inside = links.where("not within"), links.where("within")
    accepted = spool(accepted_of(firsts, outside.select(F.col("b").alias("did")), inside.select(F.col("a").alias("first"), F.col("b").alias("second"))))
    heads = firsts.join(accepted, "did", "left_semi")
    index.append("classes", heads.drop("c1", "c2"))
    # What each class repeats: accepted documents of earlier batches, accepted ones of its own batch, its own first record.
    own = accepted.withColumnRenamed("did", "head")
    both = inside.select(F.col("b").alias("class"), F.col("a").alias("head"), F.col("doc_id_a").alias("head_doc"), "similarity", "score").unionByName(
        inside.select(F.col("a").alias("class"), F.col("b").alias("head"), F.col("doc_id_b").alias("head_doc"), "similarity", "score")).join(own, "head", "left_semi")
    near = outside.select(F.col("b").alias("class"), F.col("doc_id_a").alias("head_doc"), "similarity", "score", F.lit(True).alias("before"))
    near = near.unionByName(both.select("class", "head_doc", "similarity", "score", F.lit(False).alias("before")))
    near = near.unionByName(heads.select(F.col("did").alias("class"), F.col("doc_id").alias("head_doc"), F.lit(1.0).alias("similarity"), F.lit(None).cast("double").alias("score"), F.lit(False).alias("before")))
    of_class = sets.select("doc_id", "c1", "c2").dropDuplicates(["doc_id", "c1", "c2"]).join(firsts.select("c1", "c2", F.col("did").alias("class")), ["c1", "c2"]).select("doc_id", "class")
    hits = of_class.join(near, "class").where(F.col("before") | (F.col("head_doc") < F.col("doc_id")))
    kept = index.append("links", hits.select("doc_id", F.col("head_doc").alias("head"), "similarity", "score"))
    discard(met)
    del keys, met, candidates
    release(spark)
    return kept.groupBy(F.col("doc_id").alias("doc_id_b")).agg(F.min("head").alias("doc_id_a")).select("doc_id_a", "doc_id_b")


def roots(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(node) -> (node, root): parent pointers followed to their end. A pointer only leads to a smaller node."""
    now = spool(nodes.select("node", F.col("node").alias("root")).distinct())
    best = parents.groupBy("node").agg(F.min("parent").alias("parent"))
    while True:
        step = now.join(best.select(F.col("node").alias("root"), "parent"), "root", "left")
        nxt = spool(step.select("node", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("moved")))
        moved = not nxt.where("moved").isEmpty()
        now = nxt.drop("moved")
        if not moved:
            return now


def merge_clusters(index: Index) -> None:
    """Union-find over the links of parts not yet merged: only the clusters that they touch get new parent pointers."""
    done = index.parts["parents"]
    links = index.read("links", done)
    parents = index.read("parents")
    ends = links.select(F.explode(F.array("doc_id", "head")).alias("node")).distinct()
    at = roots(parents, ends)
    edges = links.join(at.select(F.col("node").alias("doc_id"), F.col("root").alias("src")), "doc_id").join(at.select(F.col("node").alias("head"), F.col("root").alias("dst")), "head").select("src", "dst")
    merged = components(edges.where("src <> dst").distinct()).where("node <> component")
    index.append("parents", merged.select("node", F.col("component").alias("parent")))
    while index.parts["parents"] < index.parts["links"]:  # one part of pointers for each part of links
        index.append("parents", parents.limit(0))


def _numbers(records: DataFrame) -> list[int]:
    return sorted(r.b for r in records.select(F.col("batch_no").alias("b")).where("b > 0").distinct().collect())  # a row a batch


def link_batches(records: DataFrame, threshold: float = THRESHOLD, path: str | None = None, clusters: bool = False) -> tuple[DataFrame, Index]:
    """records(doc_id, batch_no, checksum, source, text) -> (found, index): batch 0 begins an index, later ones are accepted in order.

    A null batch_no counts as history. With `clusters` each batch is merged into the clusters as it is accepted.
    """
    spark = records.sparkSession
    records = records.withColumn("batch_no", F.coalesce("batch_no", F.lit(0)))
    index = Index(spark, path or new_path(spark, "index"), threshold)
    begin(index, records.where("batch_no <= 0"))
    found = None
    for number in _numbers(records):
        one = accept(index, records.where(F.col("batch_no") == number), number)
        found = one if found is None else found.unionByName(one)
        if clusters:
            merge_clusters(index)
    return (spark.createDataFrame([], "doc_id_a bigint, doc_id_b bigint") if found is None else found), index


def best_heads(index: Index) -> DataFrame:
    """(doc_id, head, root): each duplicate, the accepted document that it is filed under, and the representative of its cluster.

    Of several accepted documents the one with the highest learned score is taken, then the highest similarity, then the
    smallest doc_id. Equal sets have no score of their own and come first.
    """
    order = F.struct(F.coalesce(-F.col("score"), F.lit(float("-inf"))), -F.col("similarity"), "head")
    filed = index.read("links").groupBy("doc_id").agg(F.min_by("head", order).alias("head"))
    at = roots(index.read("parents"), filed.select(F.col("doc_id").alias("node")))
    return filed.join(at.select(F.col("node").alias("doc_id"), "root"), "doc_id")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "batch_no", "checksum", "source", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of batch 1 and later that repeat an accepted document, and the smallest doc_id that they repeat."""
    return link_batches(_records(spark, folder))[0]


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Each duplicate with the accepted document that it is filed under and its cluster's representative."""
    return best_heads(link_batches(_records(spark, folder), clusters=True)[1])


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
ORACLES: dict[str, str] = {}

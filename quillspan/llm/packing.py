"""Problem 8: items packed into containers of fixed capacity by non-negative least squares over the length histogram.

Only the histogram of lengths goes to the driver; its size is bounded by the capacity. Shallow combinations of lengths
that fill a window under the capacity are the columns of a non-negative least squares problem whose solution says how
often each combination is repeated; the counts are rounded down and what is left is packed greedily, still as a
histogram. The plan then says, per length, which container the i-th item of that length goes into, so items are placed
by their rank within their length, in parallel.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.plans.spool import counted, spool
from quillspan.sources.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Length classes of a plan, distinct lengths of a combination, and the share of the capacity that a combination may leave.
CLASSES = 48
DEPTH = 3
WINDOW = 0.02
#: Pieces of one length that are ranked in one window, and rows of a side table that is sent to all executors at most.
A_SALT, SENT = 200_000, 1_000_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """rows(..., text) -> rows with n_tokens instead of text; null texts have no tokens. The vocabulary's file is read on the executors."""
    kept = [c for c in rows.columns if c != "text"]

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for s in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int32")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.select(*kept, F.pandas_udf(run, "int")("text").alias("n_tokens"))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x of least |a x - b|, by projected gradients with momentum."""
    gram, rhs = a.T @ a, a.T @ b
    step = 1.0 / max(np.linalg.norm(gram, 2) if len(gram) <= 400 else np.abs(gram).sum(0).max(), 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - step * (gram @ y - rhs))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = nxt + (t - 1) / s * (nxt - x), nxt, s
    return x


def combinations(lengths: list[int], capacity: int, depth: int, window: float) -> list[dict[int, int]]:
    """Combinations of at most `depth` distinct lengths, repeated as they fit, that fill the capacity but for the window."""
    out, low = [], capacity * (1 - window)
    for l in lengths:
        m = capacity // l
        if m and m * l >= low:
            out.append({l: m})
    for a, b in itertools.combinations(lengths, 2):
        tops = range(1, capacity // a + 1)
        for m in tops if len(tops) <= 6 else sorted({1, 2, 3, len(tops) // 2, len(tops) - 1, len(tops)}):
            k = (capacity - m * a) // b
            if k > 0 and m * a + k * b >= low:
                out.append({a: m, b: k})
    if depth >= 3:
        for a, b in itertools.combinations_with_replacement(sorted(lengths, reverse=True), 2):
            rest = capacity - a - b
            fit = [l for l in lengths if l <= rest and l not in (a, b) and (rest // l) * l >= rest - (capacity - low)]
            for l in fit[-1:]:
                combo = {a: 1, l: rest // l}
                combo[b] = combo.get(b, 0) + 1
                out.append(combo)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths and how many of each, how many such containers)] that hold the whole histogram (lengths <= capacity).

    Lengths are rounded up to classes, so every container fits.
    """
    if not histogram:
        return []
    step = max(1, -(-capacity // (CLASSES * 4)))
    lengths = sorted(histogram)
    weights = np.array([histogram[l] for l in lengths], float)
    # At most CLASSES representative lengths, at equal shares of the total size.
    share = np.cumsum(weights * np.array(lengths))
    marks = np.unique(np.searchsorted(share, np.linspace(0, share[-1], CLASSES + 1)[1:], side="left").clip(0, len(lengths) - 1))
    classes = [lengths[i] for i in marks]
    if classes[-1] < lengths[-1]:
        classes.append(lengths[-1])
    by_class: dict[int, float] = {c: 0.0 for c in classes}
    for l in lengths:
        by_class[classes[int(np.searchsorted(classes, l))]] += histogram[l]
    combos = combinations(classes, capacity, DEPTH, WINDOW)
    left = dict(histogram)
    out: list[tuple[dict[int, int], int]] = []
    if combos:
        index = {c: i for i, c in enumerate(classes)}
        a = np.zeros((len(classes), len(combos)))
        for j, combo in enumerate(combos):
            for l, m in combo.items():
                a[index[l], j] = m
        b = np.array([by_class[c] for c in classes])
        scale = 1 / np.sqrt(np.maximum(b, 1))
        x = nnls(a * scale[:, None], b * scale)
        pools = {c: [l for l in lengths if classes[int(np.searchsorted(classes, l))] == c] for c in classes}
        for j in np.argsort(-x):
            times = int(x[j])
            if times < 1:
                break
            out += take(combos[j], times, pools, left)
    return out + greedy(left, capacity)


def take(combo: dict[int, int], times: int, pools: dict[int, list[int]], left: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Up to `times` containers of a combination of classes, as runs of containers with the same actual lengths."""
    out = []
    while times > 0:
        actual: dict[int, int] = {}
        for c, m in combo.items():
            need = m
            for l in reversed(pools[c]):
                got = min(need, left[l] - actual.get(l, 0))
                if got > 0:
                    actual[l] = actual.get(l, 0) + got
                    need -= got
                if not need:
                    break
            if need:
                return out
        run = min(times, *(left[l] // m for l, m in actual.items()))
        for l, m in actual.items():
            left[l] -= run * m
        out.append((actual, run))
        times -= run
    return out


def greedy(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit for what is left: the largest length that still fits, over and over; equal containers in one run."""
    lengths = np.array(sorted(l for l, c in left.items() if c > 0))
    counts = np.array([left[l] for l in lengths])
    out = []
    while len(lengths):
        room, actual = capacity, {}
        avail = counts.copy()
        while True:
            i = int(np.searchsorted(lengths, room, side="right")) - 1
            while i >= 0 and not avail[i]:
                i -= 1
            if i < 0:
                break
            m = int(min(avail[i], room // lengths[i]))
            actual[i] = m
            avail[i] -= m
            room -= m * int(lengths[i])
        run = int(min(counts[i] // m for i, m in actual.items()))
        for i, m in actual.items():
            counts[i] -= run * m
        out.append(({int(lengths[i]): m for i, m in actual.items()}, run))
        keep = counts > 0
        lengths, counts = lengths[keep], counts[keep]
    return out


def slots(planned: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first container, ranks a container) of the plan's runs."""
    out, used, container = [], {}, 0
    for actual, run in planned:
        for l, m in actual.items():
            begin = used.get(l, 0)
            out.append((l, begin, run * m, container, m))
            used[l] = begin + run * m
        container += run
    return out


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items(key, n_tokens) -> (key, piece_no, token_start, token_end, container_id, n_tokens).

    Items above the capacity are split into pieces of the capacity and a rest, others never; items of no tokens (null and
    empty texts) take no room and give no row; repeated keys are items of their own; an empty table gives no rows.
    """
    spark = items.sparkSession
    some = items.where("n_tokens > 0")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")))
    pieces = some.withColumn("piece_no", piece).withColumn("token_start", F.col("piece_no") * capacity)
    pieces = pieces.withColumn("token_end", F.least("n_tokens", F.col("token_start") + capacity)).withColumn("length", F.col("token_end") - F.col("token_start"))
    pieces = pieces.select("key", "piece_no", "token_start", "token_end", "length")
    # Ranks within a length, by salt: counts per (length, salt) give each salt's first rank. All full pieces share one
    # length, so the salts grow with the pieces, and a window has about A_SALT of them.
    few = lambda df, n: F.broadcast(df) if n <= SENT else df
    number = some.agg(F.sum(F.ceil(F.col("n_tokens") / capacity))).first()[0] or 0
    salts = 1 << max(6, (number // A_SALT).bit_length())
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("key", "piece_no"), F.lit(salts)).cast("int"))
    counts, groups = counted(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    planned = slots(plan(histogram, capacity))
    table_of = spark.createDataFrame(planned or [(0, 0, 0, 0, 1)], "length int, first long, many long, container long, each long")
    offset = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "offset")
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece_no")) - 1)
    ranked = ranked.join(few(offset, groups), ["length", "salt"]).withColumn("rank", F.col("offset") + F.col("r"))
    runs = table_of.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "many", "container", "each"))).alias("runs"))
    placed = ranked.join(few(runs, len(planned)), "length").withColumn("run", F.filter("runs", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["many"]))[0])
    container = F.col("run.container") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.each"))
    return placed.select("key", "piece_no", "token_start", "token_end", container.cast("long").alias("container_id"), F.col("length").alias("n_tokens"))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return spool(token_counts(table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of each capacity of pack_targets."""
    sizes = _sizes(spark, folder)
    out = None
    for label, capacity in sorted((r.pack_label, r.capacity_tokens) for r in table(spark, folder, "pack_targets").dropDuplicates(["pack_label"]).collect() if r.capacity_tokens):
        one = pack(sizes, capacity).select(F.lit(label).alias("pack_label"), F.lit(capacity).alias("capacity_tokens"), F.col("key").alias("doc_id"), "piece_no", "token_start", "token_end", "container_id", "n_tokens")
        out = one if out is None else out.unionByName(one)
    return out


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """(pack_label, capacity_tokens, containers, tokens, fill): how full the containers are."""
    packed = p8_packed(spark, folder).groupBy("pack_label", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    by = packed.groupBy("pack_label", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return by.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """(pack_label, within, conserved, only_large_split): no container is too full, no token is lost, and only items above the capacity are split."""
    sizes = _sizes(spark, folder)
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    packed = spool(p8_packed(spark, folder))
    by = packed.groupBy("pack_label", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"))
    full = by.groupBy("pack_label").agg(F.bool_and(F.col("n") <= F.col("capacity_tokens")).alias("within"), (F.sum("n") == total).alias("conserved"))
    item = packed.groupBy("pack_label", "capacity_tokens", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"))
    split = item.groupBy("pack_label").agg(F.bool_and((F.col("pieces") == 1) == (F.col("n") <= F.col("capacity_tokens"))).alias("only_large_split"))
    return full.join(split, "pack_label")


QUERIES = {"p8_packed": p8_packed, "p8_fill": p8_fill, "p8_invariants": p8_invariants}
ORACLES: dict[str, str] = {"p8_invariants": "SELECT DISTINCT pack_label, true AS within, true AS conserved, true AS only_large_split FROM pack_targets WHERE capacity_tokens > 0"}

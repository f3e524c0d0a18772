"""Problem 9: sources mixed to target shares of the total size by Poisson replication.

Each document is repeated as often as the inverse of a Poisson distribution at a number seeded by its id says, capped at
the source's most repeats; the distribution's parameter is such that the capped mean is the repetition rate that the
target share asks for. The number is the fractional part of the document's hash plus a shift of its source; of SHIFTS
shifts the one is taken that brings the source's sum of tokens closest to its target, from one aggregate over all
documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.packing import token_counts
from quillspan.plans.spool import spool
from quillspan.sources.tables import table

SEED = 9_271
SHIFTS = 64
BINS = 4096
#: A capped mean comes no closer to the cap than this share of it, so that the parameter stays finite.
MOST = 0.97
#: How far from its share, relative to it, a source that no cap holds may end: documents are whole, so small sources are coarse.
NEAR = 0.1


def capped_mean(rate: float, cap: int) -> float:
    """The mean of min(Poisson(rate), cap)."""
    p, total, below = math.exp(-rate), 0.0, 0.0
    for i in range(cap):
        total += i * p
        below += p
        p *= rate / (i + 1)
    return total + cap * (1 - below)


def rate_for(mean: float, cap: int) -> float:
    """The rate whose capped mean is `mean` (< cap)."""
    lo, hi = 0.0, 60.0 + 4.0 * cap
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return hi


def steps(rate: float, cap: int) -> list[float]:
    """The capped distribution's upper bounds of 0, 1, ..., cap - 1 repeats."""
    out, p, upto = [], math.exp(-rate), 0.0
    for i in range(cap):
        upto += p
        out.append(upto)
        p *= rate / (i + 1)
    return out


def best_shift(held: np.ndarray, bounds: list[float], goal: float) -> float:
    """Of SHIFTS shifts the one that brings the tokens times their repeats closest to the goal."""
    middle = (np.arange(BINS) + 0.5) / BINS
    sums = [held @ np.searchsorted(bounds, (middle + i / SHIFTS) % 1.0, side="right") for i in range(SHIFTS)]
    return min(range(SHIFTS), key=lambda i: (abs(sums[i] - goal), i)) / SHIFTS


def source_name(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def rates(totals: dict[str, int], targets: dict[str, tuple[float, int]], size: float | None = None) -> dict[str, tuple[float, int, float]]:
    """{source: (mean repeats, cap, share wanted)}. Sources without tokens get no share; the rest are scaled to sum up to 1.

    Without a size the total is the largest at which no source needs more than MOST of its cap.
    """
    live = {s: (w, int(r)) for s, (w, r) in targets.items() if totals.get(s, 0) > 0 and w and w > 0 and r and r > 0}
    weight = sum(w for w, _ in live.values())
    if not live:
        return {}
    if size is None:
        size = min(MOST * r * totals[s] * weight / w for s, (w, r) in live.items())
    return {s: (min(MOST * r, w / weight * size / totals[s]), r, w / weight) for s, (w, r) in live.items()}


def mix(items: DataFrame, targets: DataFrame, size: float | None = None, seed: int = SEED, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """items(key, source, n_tokens), targets(source, target_share, max_repeats) -> (mixture, shares).

    With `whole` the size is that of all tokens of the targeted sources: small sources stop at MOST of their cap, and the
    mixture is smaller than that by what they fall short.

    mixture(key, source, copy_no, n_tokens, place): every repeat of a document, in a global random order by place.
    shares(source, target_share, wanted_share, tokens, documents, most_repeats, actual_share, source_tokens, at_cap,
    mixture_of_targeted): what came out, the tokens that the source has, whether its cap binds, and the mixture's size
    over the tokens of all targeted sources; target sources that no document has are reported with a share of 0, and their share is spread over the rest.

    Sources are compared without case and outer blanks; documents of null or untargeted sources, and those of no tokens,
    are not part of the mixture; of a source with several targets the smallest row counts; null targets count as 0.
    """
    spark = items.sparkSession
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")).collect()}
    own = items.select("key", source_name("source").alias("source"), "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(list(wanted)))
    totals = {r.source: r.n for r in own.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row per target
    if whole:
        size = float(sum(totals[s] for s in rates(totals, wanted)))
    planned = rates(totals, wanted, size)
    unit = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11).cast("double")) / float(1 << 53)
    fields = "source string, mean double, cap int, bounds array<double>, goal double"
    rows = [(s, m, c, steps(rate_for(m, c), c), m * totals[s]) for s, (m, c, _) in planned.items()]
    table_of = spark.createDataFrame(rows, fields)
    drawn = own.join(F.broadcast(table_of), "source").withColumn("u", unit)  # as many rows as targets

    def count(shift: Column) -> Column:
        at = F.col("u") + shift
        at = at - F.floor(at)
        return F.size(F.filter("bounds", lambda b: b <= at))

    # Tokens by source and place of u in BINS bins say how much each shift would bring: at most BINS rows a target.
    held: dict[str, np.ndarray] = {source: np.zeros(BINS) for source in planned}
    for r in drawn.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).collect():
        held[r.source][r.bin] = r.n
    shift = {source: best_shift(held[source], bounds, goal) for source, _, _, bounds, goal in rows}
    shifts = spark.createDataFrame(list(shift.items()), "source string, shift double")
    repeated = drawn.join(F.broadcast(shifts), "source").withColumn("times", count(F.col("shift"))).where("times > 0")
    copies = repeated.select("key", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "times")).alias("copy_no"))
    mixture = copies.withColumn("place", F.xxhash64("key", "copy_no", F.lit(seed + 1))).select("key", "source", "copy_no", "n_tokens", "place")
    bound = lambda s: s in planned and planned[s][0] >= MOST * planned[s][1] - 1e-9
    known = spark.createDataFrame([(s, w, planned.get(s, (0, 0, 0.0))[2], totals.get(s, 0), bound(s)) for s, (w, _) in wanted.items()], "source string, target_share double, wanted_share double, source_tokens bigint, at_cap boolean")
    by = repeated.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.sum("times").alias("documents"), F.max("times").alias("most_repeats"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = known.join(by, "source", "left").select("source", "target_share", F.round("wanted_share", 6).alias("wanted_share"), zero("tokens"), zero("documents"), zero("most_repeats"), "source_tokens", "at_cap")
    over = lambda c: F.sum(c).over(Window.partitionBy())  # noqa: E731  a row per target
    shares = shares.withColumn("actual_share", F.round(F.try_divide("tokens", over("tokens")), 6))
    return mixture, shares.withColumn("mixture_of_targeted", F.round(F.try_divide(over("tokens"), over("source_tokens")), 6))


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return spool(token_counts(docs)), table(spark, folder, "mix_targets")


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeat of every document of the mixture, globally shuffled, at the size of all targeted tokens: small sources stop at their cap."""
    return _shuffled(spark, mix(*_inputs(spark, folder), whole=True)[0])


def _shuffled(spark: SparkSession, mixture: DataFrame) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixture.withColumnRenamed("key", "doc_id").repartitionByRange(parts, "place").sortWithinPartitions("place")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in p9_mixture."""
    return mix(*_inputs(spark, folder), whole=True)[1]


def p9_exact_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mixture in which no source passes its cap, so that all shares are met."""
    return _shuffled(spark, mix(*_inputs(spark, folder))[0])


def p9_exact_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in p9_exact_mixture."""
    return mix(*_inputs(spark, folder))[1]


def p9_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """(source, capped, near_target): no document is repeated above the source's cap; a source that its cap leaves free has its share of what is not capped."""
    shares = p9_shares(spark, folder)
    free = F.sum(F.when(~F.col("at_cap") & (F.col("source_tokens") > 0), F.col("wanted_share"))).over(Window.partitionBy())
    tokens = F.sum(F.when(~F.col("at_cap"), F.col("tokens"))).over(Window.partitionBy())
    off = F.abs(F.col("tokens") / tokens - F.col("wanted_share") / free)
    caps = table(spark, folder, "mix_targets").where("source is not null").groupBy(source_name("source").alias("source")).agg(F.min("max_repeats").alias("cap"))
    near = F.col("at_cap") | (F.col("source_tokens") == 0) | (off <= F.lit(NEAR) * F.col("wanted_share") / free)
    return shares.join(caps, "source").select("source", (F.col("most_repeats") <= F.col("cap")).alias("capped"), near.alias("near_target"))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_exact_mixture": p9_exact_mixture, "p9_exact_shares": p9_exact_shares, "p9_invariants": p9_invariants}
ORACLES: dict[str, str] = {"p9_invariants": "SELECT DISTINCT lower(trim(source)) AS source, true AS capped, true AS near_target FROM mix_targets WHERE source IS NOT NULL"}

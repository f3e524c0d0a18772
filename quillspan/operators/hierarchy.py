"""A hierarchy of clusters over vectors: groups of similar units, a unit for each group, groups of those, and so on.

Vectors are reduced to a few principal components and modelled by Gaussian mixtures; the number of components is the one of
the least Bayesian information criterion in a window around the size that is aimed at. Membership is soft. Models are fitted
on a bounded sample, every unit is assigned.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.plans.spool import spool

# Levels, sizes of a cluster, least membership, components that are kept, and the width of the window.
LEVELS, SMALLEST, LARGEST, MEMBER, COMPONENTS, WIDTH = 3, 2, 12, 0.1, 8, 8
#: Rows that components and parts are fitted on at most, clusters that a mixture aims at, and parts.
SAMPLE, MOST, PARTS = 20_000, 20, 2_000
SEED = 20_240


def reduced(units: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """units(node, v array<float>) -> (node, x vector): the leading principal components, fitted on at most SAMPLE rows."""
    rows = spool(units.select("node", array_to_vector(F.transform("v", lambda y: y.cast("double"))).alias("v")))
    width = len(rows.first()["v"])
    model = PCA(k=min(components, width), inputCol="v", outputCol="x").fit(_sample(rows))
    return spool(model.transform(rows).select("node", "x"))


def _sample(rows: DataFrame) -> DataFrame:
    n = rows.count()
    return rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / n))


def squares(x: np.ndarray) -> np.ndarray:
    """Each point's coordinates' products (all d * d), coordinates and 1: log densities of Gaussians are linear in them."""
    n, d = x.shape
    return np.concatenate([(x[:, :, None] * x[:, None]).reshape(n, d * d), x, np.ones((n, 1))], 1)


def densities(terms: np.ndarray, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Log of weight times density of each point (row), given as `squares`, under each Gaussian (column)."""
    k, d = mean.shape
    low = np.linalg.inv(np.linalg.cholesky(cov))
    inverse = low.transpose(0, 2, 1) @ low
    pull = (inverse @ mean[:, :, None])[:, :, 0]
    alone = np.log(weight) + np.log(np.einsum("kii->ki", low)).sum(1) - 0.5 * (pull * mean).sum(1) - 0.5 * d * math.log(2 * math.pi)
    return terms @ np.concatenate([-0.5 * inverse.reshape(k, d * d), pull, alone[:, None]], 1).T


def fitted(x: np.ndarray, k: int, rounds: int = 60) -> tuple[float, np.ndarray]:
    """(criterion, memberships) of a mixture of k Gaussians of full covariance, by expectation-maximization from spread-out points."""
    n, d = x.shape
    x = x - x.mean(0)  # products of coordinates lose the fewest digits around the mean
    rng = np.random.default_rng(SEED)
    at = [int(rng.integers(n))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k:  # the next start is far from those before
        at.append(int(np.argmax(near)))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    floor = np.eye(d) * max(1e-6, 1e-3 * x.var(0).mean())
    mean, cov, weight = x[at].copy(), np.repeat((np.cov(x.T).reshape(d, d) + floor)[None], k, 0), np.full(k, 1 / k)
    terms = squares(x)
    before = -np.inf
    for _ in range(rounds):
        log = densities(terms, weight, mean, cov)
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        some = p.sum(1, keepdims=True)
        p /= some
        total = (top + np.log(some)).sum()
        sums = p.T @ terms
        held = sums[:, -1] + 1e-9
        weight, mean = held / held.sum(), sums[:, d * d : -1] / held[:, None]
        # The scatter around the mean, which is the sum of products less that of the mean, but for what `held` adds.
        cov = (sums[:, : d * d].reshape(k, d, d) - (2 * held - sums[:, -1])[:, None, None] * mean[:, :, None] * mean[:, None]) / held[:, None, None] + floor
        if total - before < 1e-4 * n:
            break
        before = total
    free = k * (d + d * (d + 1) / 2) + k - 1
    return free * math.log(n) - 2 * total, p


def soft_clusters(x: np.ndarray, target: int) -> np.ndarray:
    """Memberships under the mixture with the least criterion among numbers of components around n / target."""
    n = len(x)
    aim = max(1, round(n / target))
    best = None
    for k in range(max(2, aim - WIDTH // 2), min(aim + WIDTH // 2, n // 2) + 1):
        score, p = fitted(x, k)
        if best is None or score < best[0]:
            best = (score, p)
    return np.ones((n, 1)) if best is None else best[1]


def memberships(points: DataFrame, target: int = LARGEST) -> DataFrame:
    """points(node, x) -> (node, cluster, p), spooled: clusters of probability MEMBER or more, the most probable one at least.

    Points are first parted by k-means into parts of about MOST * target, each with a mixture of its own, fitted in one
    task. A part of more than four times that size is cut into slices by a hash of the node.
    """
    n = points.count()
    size = MOST * target
    parted = points.withColumn("part", F.lit(0))
    if n > size:
        model = KMeans(featuresCol="x", predictionCol="part", k=min(PARTS, math.ceil(n / size)), seed=SEED).fit(_sample(points))
        parted = model.transform(points)
    parted = spool(parted.select("node", vector_to_array("x").alias("x"), "part"))
    slices = parted.groupBy("part").agg(F.ceil(F.count("*") / (4 * size)).cast("int").alias("slices"))
    placed = parted.join(F.broadcast(slices), "part").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))  # at most PARTS rows
    kind = dict(points.dtypes)["node"]

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        p = soft_clusters(np.stack(f["x"].to_numpy()), target)
        keep = (p >= MEMBER) | (np.arange(p.shape[1])[None] == p.argmax(1)[:, None])
        i, j = np.nonzero(keep)
        name = f"{f['part'].iloc[0]}-{f['slice'].iloc[0]}-"
        return pd.DataFrame({"node": f["node"].to_numpy()[i], "cluster": [f"{name}{c}" for c in j], "p": p[i, j]})

    # A stated number of tasks: by size alone, few bytes that take long to fit would all go to one or two.
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism
    spread = placed.repartition(tasks, "part", "slice").groupBy("part", "slice")
    return spool(spread.applyInPandas(fit, f"node {kind}, cluster string, p double"))


def folded(members: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """members(node, cluster, p): nodes of clusters under `smallest` move to the larger cluster that they belong to next, else to the largest one."""
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    sized = members.join(size, "cluster")
    big = sized.where(F.col("size") >= smallest)
    lost = sized.where(F.col("size") < smallest).select("node").distinct().join(big.select("node").distinct(), "node", "left_anti")
    largest = size.orderBy(F.desc("size"), "cluster").limit(1).select("cluster")
    return big.select("node", "cluster", "p").unionByName(lost.join(F.broadcast(largest)).select("node", "cluster", F.lit(0.0).alias("p")))  # one row


def chopped(members: DataFrame, largest: int = LARGEST) -> DataFrame:
    """members(node, cluster, p) -> (node, group): clusters above `largest` in slices by node, and equal sets of members once."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy("node")) - 1
    sliced = members.withColumn("group", F.concat_ws(".", F.col("cluster").cast("string"), F.floor(place / largest).cast("string")))
    sets = sliced.groupBy("group").agg(F.array_sort(F.collect_set("node")).alias("nodes"))  # at most `largest` nodes
    first = sets.groupBy("nodes").agg(F.min("group").alias("group"))
    return first.select("group", F.explode("nodes").alias("node"))


def hierarchy(units: DataFrame, summarize: Callable[[DataFrame], DataFrame] | None = None, levels: int = LEVELS, target: int = LARGEST) -> DataFrame:
    """units(node string, v) -> (level, parent, node): each group's members; a parent is a unit of the next level.

    `summarize` takes members(parent, node, v) and returns units(node, v); without it a parent's vector is the mean of its
    members'. It ends when a level no longer has fewer units than the one below.
    """
    now, out = units.select("node", "v"), None
    for level in range(1, levels + 1):
        now = spool(now)
        n = now.count()
        if n <= SMALLEST:
            break
        groups = chopped(folded(memberships(reduced(now), target)), target)
        parents = spool(groups.select(F.lit(level).alias("level"), F.concat(F.lit(f"L{level}-"), "group").alias("parent"), "node"))
        if parents.select("parent").distinct().count() >= n:
            break
        out = parents if out is None else out.unionByName(parents)
        members = parents.join(now, "node").select("parent", "node", "v")
        now = summarize(members) if summarize else means(members)
    return units.sparkSession.createDataFrame([], "level int, parent string, node string") if out is None else out


def means(members: DataFrame) -> DataFrame:
    """members(parent, node, v) -> (node, v): the mean vector of each parent, component by component."""
    flat = members.select("parent", F.posexplode("v").alias("i", "x")).groupBy("parent", "i").agg(F.avg("x").alias("x"))
    return flat.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select(F.col("parent").alias("node"), F.transform("a", lambda y: y["x"]).alias("v"))


def forecast(n: int, levels: int = LEVELS, size: int = LARGEST) -> int:
    """How many groups, and so summaries, a hierarchy over n units will have at most."""
    total = 0
    for _ in range(levels):
        if n <= SMALLEST:
            break
        n = math.ceil(n / max(2, size / 2))
        total += n
    return total

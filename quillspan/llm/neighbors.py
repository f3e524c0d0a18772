"""Problem 3: the most similar vectors of every vector, by low-dimensional stable projections under a kd-tree.

Unit vectors are projected on DIMS Gaussian directions (2-stable: a projected squared distance is the true one times a
chi-square variable of DIMS degrees of freedom). A kd-tree over the projections, fitted on a bounded sample, gives cells of
about CELL vectors; every row is put into its cell. In a cell a finer kd-tree is walked in waves of projected distance:
each wave's vectors are verified by true distance, and a query stops when the next leaf is so far that a vector at its
current k-th distance would have been met before with probability SURE (the chi-square stopping test). Queries whose
ball leaves their cell are sent on to the cells that it reaches and are searched there in the same way.

With a high floor most neighbours are found for less by several trees, each over projections of its own. A vector goes into
every cell of a tree in which a vector at the floor's distance would lie with a probability of at least a cutoff (projected
differences are normal), and vectors that share a cell are compared exactly. Trees and cutoff are the cheapest that lose at
most LOST of sample vectors' neighbours at the floor. A vector whose cells hold less than SURE of its neighbours takes smaller
cutoffs, and one for which these don't do either is searched in waves and sent on as above.

Between tasks vectors travel with 16 bits a component, which leaves similarities exact to about 0.00002.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.plans.once import once
from quillspan.plans.spool import counted, release, spool
from quillspan.sources.tables import table

K = 10
DIMS = 16
SEED = 20_111
#: The upper kd-tree is fitted on SAMPLE rows or on A_CELL rows for each of its cells, if that is more, up to MOST_SAMPLE
#: rows (some 130 MB of projections on the driver); cells are larger than CELL beyond MOST_SAMPLE / A_CELL of them.
SAMPLE, A_CELL, MOST_SAMPLE = 40_000, 64, 2_000_000
#: Rows that a cell aims at, rows of a leaf of the tree within a cell.
CELL = 25_000
LEAF = 256
SURE = 0.95
#: The same test for sending a query to another cell, over the dimensions in which it must leave its own.
SENT = 0.85
#: Queries taken at once, which bounds a task's memory.
BLOCK = 8_192
#: Share of the neighbours at the floor that the trees may lose, trees at most, cutoffs to choose from, sample vectors to choose by.
LOST, MOST_TREES, CUTOFFS, TRIED = 0.002, 64, (0.05, 0.1, 0.15, 0.2, 0.25, 0.3), 2_000
#: Copies of a vector that are moved at once, about, which bounds the shuffle files; comparisons that cost as much as one copy.
ROUND, MOVED = 2, 5_000
#: Vectors of a side of a block of comparisons.
SIDE = 768
#: Rows of a side table that is sent to all executors at most.
FEW = 1_000_000
SCALE = 32_767


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square distribution of m degrees of freedom, by bisection of its closed form."""

    def cdf(x: float) -> float:
        if m % 2:
            total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
            for i in range(1, m, 2):
                total -= term
                term *= x / (i + 2)
            return total
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 10.0 * m + 50
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree of splits (dimension, value); node i has children 2i+1 (below) and 2i+2. Leaves carry bounding boxes."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1, np.float32)
        parts = [np.arange(len(points))]
        for level in range(depth):
            nxt = []
            for i, part in enumerate(parts):
                node = 2**level - 1 + i
                p = points[part]
                spread = p.max(0) - p.min(0) if len(p) else np.zeros(points.shape[1])
                d = int(np.argmax(p.std(0))) if len(p) > 1 and spread.max() > 0 else level % points.shape[1]
                v = float(np.median(p[:, d])) if len(p) else 0.0
                self.dim[node], self.value[node] = d, v
                below = p[:, d] < v if len(p) else np.zeros(0, bool)
                nxt += [part[below], part[~below]]
            parts = nxt
        self.leaves = parts

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] >= self.value[node])
        return node - (2**self.depth - 1)

    def regions(self, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(low, high) of each node's region, level by level."""
        low, high = np.full((1, m), -np.inf, np.float32), np.full((1, m), np.inf, np.float32)
        out = [(low, high)]
        for level in range(self.depth):
            node = 2**level - 1 + np.arange(2**level)
            low, high = np.repeat(low, 2, 0), np.repeat(high, 2, 0)
            at = np.arange(2**level)
            high[2 * at, self.dim[node]] = np.minimum(high[2 * at, self.dim[node]], self.value[node])
            low[2 * at + 1, self.dim[node]] = np.maximum(low[2 * at + 1, self.dim[node]], self.value[node])
            out.append((low, high))
        return out


def cells_reached(q: np.ndarray, bound: np.ndarray, tree: Tree, boxes: list[tuple[np.ndarray, np.ndarray]], sending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, cell): the cells outside of which a query's neighbours may lie, by descent of the tree.

    A cell is reached if its squared distance is within the bound times the quantile for the dimensions in which the query
    lies outside of it; inner nodes are left as soon as they are out of reach for any number of dimensions.
    """
    rows, nodes = np.arange(len(q)), np.zeros(len(q), np.int64)
    for level in range(tree.depth + 1):
        low, high = boxes[level]
        gap = np.maximum(np.maximum(low[nodes] - q[rows], q[rows] - high[nodes]), 0)
        far = (gap * gap).sum(1)
        if level == tree.depth:
            ok = far <= sending[(gap > 0).sum(1)] * bound[rows]
            return rows[ok], nodes[ok]
        ok = far <= sending[-1] * bound[rows]
        rows, nodes = np.repeat(rows[ok], 2), np.repeat(2 * nodes[ok], 2)
        nodes[1::2] += 1
    raise AssertionError


def normal_below(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, to about 1e-7 (Abramowitz and Stegun 7.1.26)."""
    y = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * y)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-y * y) / 2
    return np.where(x >= 0, 1 - tail, tail)


def cells_likely(q: np.ndarray, apart: float, tree: Tree, boxes: list[tuple[np.ndarray, np.ndarray]], cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, cell, probability): the cells in which a vector at the distance `apart` lies with a probability of at least `cutoff`."""
    rows, nodes, chance = np.arange(len(q)), np.zeros(len(q), np.int64), np.ones(len(q))
    for level in range(tree.depth):
        low, high = boxes[level]
        node = 2**level - 1 + nodes
        d, x = tree.dim[node], q[rows, tree.dim[node]]
        a, b, c = (normal_below((edge - x) / apart) for edge in (low[nodes, d], tree.value[node], high[nodes, d]))
        b = np.clip(b, a, c)
        both = np.stack([chance * (b - a), chance * (c - b)], 1) / np.maximum(c - a, 1e-12)[:, None]
        i, side = np.nonzero(both >= cutoff)
        rows, nodes, chance = rows[i], 2 * nodes[i] + side, both[i, side]
    return rows, nodes, chance


def trees_for(v: np.ndarray, least: float, tree: Tree, axes: np.ndarray, cell: float) -> tuple[int, float, float]:
    """(trees, cutoff, copies in a tree) that cost least for sample vectors v; no trees if MOST_TREES would lose more than LOST."""
    if least <= 0 or v.shape[1] < 2:
        return 0, 0.0, 0.0
    side = np.random.default_rng(SEED).standard_normal(v.shape)
    side -= (side * v).sum(1, keepdims=True) * v
    other = least * v + math.sqrt(max(0.0, 1 - least * least)) * side / np.linalg.norm(side, axis=1, keepdims=True)
    apart, boxes, found = math.sqrt(max(2 - 2 * least, 1e-6)), tree.regions(DIMS), []
    for cutoff in CUTOFFS:
        (i, c, _), (j, d, _) = (cells_likely((x @ axes).astype(np.float32), apart, tree, boxes, cutoff) for x in (v, other))
        met = len(np.unique(np.intersect1d(i * 2**tree.depth + c, j * 2**tree.depth + d) >> tree.depth)) / len(v)
        trees = 1 if met > 1 - LOST else math.ceil(math.log(LOST) / math.log1p(-met)) if met > 0 else 0
        if met > 0 and trees <= MOST_TREES:
            copies = len(i) / len(v)
            found.append((trees * copies * (MOVED + copies * cell / 2), trees, cutoff, copies))
    return min(found)[1:] if found else (0, 0.0, 0.0)


def box_distances(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.zeros((len(q), len(low)), np.float32)
    for d in range(q.shape[1]):
        x = q[:, d : d + 1]
        gap = np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0)
        out += gap * gap
    return out


class Best:
    """The k best (similarity, id) of each query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int, floor: float):
        self.sim = np.full((n, k), -np.inf, np.float32)
        self.pos = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor

    def bound(self) -> np.ndarray:
        """Squared distance beyond which nothing is looked for: that of the k-th so far, or of the least similarity asked for."""
        return 2 - 2 * np.maximum(self.sim[:, -1], self.floor)

    def add(self, q: np.ndarray, p: np.ndarray, sim: np.ndarray) -> None:
        if not len(q):
            return
        order = np.lexsort((p, -sim, q))
        q, p, sim = q[order], p[order], sim[order]
        start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        k = self.sim.shape[1]
        keep = rank < k
        rows = q[start]
        new_sim, new_pos = np.full((len(rows), k), -np.inf, np.float32), np.full((len(rows), k), np.iinfo(np.int64).max, np.int64)
        at = np.repeat(np.arange(len(rows)), np.diff(np.append(start, len(q))))
        new_sim[at[keep], rank[keep]], new_pos[at[keep], rank[keep]] = sim[keep], p[keep]
        both, pos = np.concatenate([self.sim[rows], new_sim], 1), np.concatenate([self.pos[rows], new_pos], 1)
        order = np.lexsort((pos, -both), axis=1)[:, :k]
        self.sim[rows], self.pos[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(pos, order, 1)


def places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, by way of its flat form, which is several times faster."""
    flat = np.flatnonzero(mask)
    return np.divmod(flat, mask.shape[1])


def search(q: np.ndarray, qv: np.ndarray, q_rank: np.ndarray, best: Best, pv: np.ndarray, p: np.ndarray, rank: np.ndarray, tree: Tree, boxes: tuple[np.ndarray, np.ndarray], factor: float) -> None:
    """Search queries (projections q, vectors qv) in one cell; `rank` orders its vectors by id, `q_rank` is the query's own or -1."""
    far = box_distances(q, *boxes)
    order = np.argsort(far, 1, kind="stable")
    wave, begin, served, missed = 1, 0, 0, 0
    active = np.arange(len(q))
    while begin < far.shape[1] and len(active):
        cols = order[active, begin : begin + wave]
        reach = factor * best.bound()[active]
        near = np.take_along_axis(far[active], cols, 1) <= reach[:, None]
        rows, leaf = np.repeat(active, cols.shape[1])[near.ravel()], cols.ravel()[near.ravel()]
        by = np.argsort(leaf, kind="stable")
        rows, leaf = rows[by], leaf[by]
        edges = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]])) if len(leaf) else np.zeros(1, int)
        found = []
        least = np.maximum(best.sim[:, -1], best.floor)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            own, members = rows[a:b], tree.leaves[leaf[a]]
            if not len(members):
                continue
            if np.isfinite(least[own]).all() and missed <= 16 + served:
                # Projected distances first, as long as they leave little to verify.
                d = (q[own] ** 2).sum(1)[:, None] + (p[members] ** 2).sum(1)[None] - 2 * q[own] @ p[members].T
                i, j = places(d <= (factor * (2 - 2 * least[own]))[:, None])
                served, missed = served + (8 * len(i) < d.size), missed + (8 * len(i) >= d.size)
                if 8 * len(i) < d.size:
                    i, j = own[i], members[j]
                    sim = np.einsum("ij,ij->i", qv[i], pv[j])
                    ok = (sim >= least[i]) & (q_rank[i] != rank[j])
                    found.append((i[ok], rank[j][ok], sim[ok]))
                    continue
            # True similarities of a whole leaf at once; only those that can be among a query's k best go on.
            sim = qv[own] @ pv[members].T
            sim[q_rank[own][:, None] == rank[members][None]] = -np.inf
            k = best.sim.shape[1]
            if sim.shape[1] > 2 * k and not np.isfinite(least[own]).all():
                sim = np.where(sim >= np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None], sim, -np.inf)
            i, j = places(sim >= np.maximum(least[own], np.finfo(np.float32).min)[:, None])
            found.append((own[i], rank[members[j]], sim[i, j]))
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        begin += wave
        wave *= 2
        if begin < far.shape[1]:
            still = np.take_along_axis(far[active], order[active, begin : begin + 1], 1)[:, 0] <= factor * best.bound()[active]
            active = active[still]


def all_pairs(v: np.ndarray, k: int, least: float) -> Best:
    """The k best of each vector among all of them, by matrix products of blocks; a pair of blocks is multiplied once."""
    best, waiting, floor = Best(len(v), k, least), [], np.float32(least)

    def flush() -> None:
        if waiting:
            best.add(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting.clear()

    for a in range(0, len(v), SIDE):
        for b in range(a, len(v), SIDE):
            sim = v[a : a + SIDE] @ v[b : b + SIDE].T
            if a == b:
                np.fill_diagonal(sim, -np.inf)
            i, j = places(sim >= floor)
            if len(i) <= 4 * k * SIDE:
                waiting += [(a + i, b + j, sim[i, j]), (b + j, a + i, sim[i, j])][: 1 + (a < b)]
            else:  # where much is similar, only what can be among a vector's k best
                for m, x, y in ((sim, a, b), (np.ascontiguousarray(sim.T), b, a))[: 1 + (a < b)]:
                    own = np.maximum(best.sim[x : x + SIDE, -1], floor)
                    if m.shape[1] > k:
                        own = np.maximum(own, np.partition(m, m.shape[1] - k, axis=1)[:, m.shape[1] - k])
                    i, j = places(m >= own[:, None])
                    waiting.append((x + i, y + j, m[i, j]))
            if sum(len(w[0]) for w in waiting) > 4 * k * SIDE:
                flush()
    flush()
    return best


def directions(width: int, tree: int = 0) -> np.ndarray:
    return np.random.default_rng(SEED + tree).standard_normal((width, DIMS)).astype(np.float32)


def vectors_of(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.int16).reshape(len(column), -1).astype(np.float32) / SCALE


def usable(rows: DataFrame, width: int) -> DataFrame:
    """rows(key, embedding) -> (key, v binary): unit vectors of the rows that take part, each key once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["embedding"].to_numpy()).astype(np.float64)
            unit = np.rint(x / np.sqrt((x**2).sum(1, keepdims=True)) * SCALE).astype(np.int16)
            yield pd.DataFrame({"key": f["key"], "v": [u.tobytes() for u in unit]})

    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = rows.where(F.col("key").isNotNull() & (F.size("embedding") == width) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    return once(whole.select("key", "embedding"), "key", F.col("embedding")).mapInPandas(run, "key string, v binary")


def nearest(rows: DataFrame, k: int = K, least: float = 0.9, width: int = 64, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """rows(key, embedding) -> (key, other, similarity, place): the k most similar others with cosine of at least `least`.

    Rows whose embedding is null, holds nulls, is not `width` long, is zero or not finite do not take part; a repeated key
    counts once; ties go to the smaller key; an empty table gives an empty result. Exact copies of a vector are searched
    once: each copy gets the k smallest keys of its copies and of the found vectors' copies, so copies stay linear.
    """
    spark = rows.sparkSession
    base, total = counted(usable(rows, width).withColumn("vid", F.xxhash64("v")))
    if not total:
        return spark.createDataFrame([], "key string, other string, similarity double, place int")
    few = lambda df, n: F.broadcast(df) if n <= FEW else df
    # Copies: only vectors that come more than once are grouped with their keys, first by salt, so that no group meets in one task.
    several, groups = counted(base.groupBy("vid").agg(F.count("*").alias("_n")).where("_n > 1").select("vid"))
    copies = spool(base.select("vid", "key").join(few(several, groups), "vid", "left_semi").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64))))
    some = copies.withColumn("r", F.row_number().over(Window.partitionBy("vid", "salt").orderBy("key"))).where(F.col("r") <= k + 1)
    some = spool(some.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy("key"))).where(F.col("r") <= k + 1).select("vid", "key", "r"))
    owner = some.where("r = 1").select("vid", F.col("key").alias("owner"))
    again, number = counted(copies.join(few(owner, groups), "vid").where(F.col("key") != F.col("owner")).select("key"))
    single = base.join(few(several, groups), "vid", "left_anti").select("vid", "key", F.lit(1).alias("r"))
    firsts = single.unionByName(some)
    reps = base.join(few(again, number), "key", "left_anti").select("vid", "v")

    n = total - number
    cells = max(1, math.ceil(n / cell))
    sample = min(max(sample, A_CELL * cells), MOST_SAMPLE)
    depth = max(0, math.ceil(math.log2(min(cells, max(1, sample // A_CELL)))))
    share = min(1.0, 1.2 * sample / n)
    drawn = reps.where(F.pmod(F.xxhash64("vid", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(sample).select("v").toPandas()
    axes = directions(width)
    points = vectors_of(drawn["v"]) if len(drawn) else np.zeros((1, width), np.float32)
    top = Tree(points @ axes, depth)
    trees, cutoff, spread = trees_for(points[:: max(1, len(points) // TRIED)], least, top, axes, n / 2**depth)
    forest = [(axes, top), *((x, Tree(points @ x, depth)) for x in (directions(width, t) for t in range(1, trees)))]
    shared = spark.sparkContext.broadcast([(x, t.depth, t.dim, t.value) for x, t in forest])
    factor = chi_square_quantile(SURE, DIMS)
    sending = np.array([0.0, *(chi_square_quantile(SENT, m) for m in range(1, DIMS + 1))], np.float32)
    apart = math.sqrt(max(2 - 2 * least, 1e-6))

    def upper(tree: int = 0) -> Tree:
        t = Tree.__new__(Tree)
        _, t.depth, t.dim, t.value = shared.value[tree]
        return t

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cell of each vector in the first tree, its cells `at` in all trees, and whether it has to be searched besides."""
        each = [(shared.value[t][0], upper(t), upper(t).regions(DIMS)) for t in range(max(1, trees))]
        for f in frames:
            if not len(f):
                continue
            v = vectors_of(f["v"])
            cell = each[0][1].place(v @ each[0][0])
            left, rows, at = np.arange(len(f)), [], []
            for c in (cutoff, cutoff / 4, cutoff / 16) if trees else ():
                missed, i_new, at_new = np.ones(len(left)), [], []
                for t, (axes, tree, boxes) in enumerate(each):
                    i, to, chance = cells_likely(v[left] @ axes, apart, tree, boxes, c)
                    missed *= np.maximum(1 - np.bincount(i, chance, len(left)), 0)
                    i_new.append(i)
                    at_new.append(t * 2**tree.depth + to)
                done = missed <= 1 - SURE
                i, to = np.concatenate(i_new), np.concatenate(at_new)
                rows.append(left[i[done[i]]])
                at.append(to[done[i]])
                left = left[~done]
                if not len(left):
                    break
            if trees and len(left):  # the others are met at home by those that are sure
                for t, (axes, tree, _) in enumerate(each):
                    rows.append(left)
                    at.append(t * 2**tree.depth + tree.place(v[left] @ axes))
            rows, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, at))
            by = np.argsort(rows, kind="stable")
            edges = np.searchsorted(rows[by], np.arange(1, len(f)))
            ask = np.zeros(len(f), bool)
            ask[left] = True
            yield f.assign(cell=cell, at=np.split(at[by], edges), ask=ask)

    homed = reps.mapInPandas(place, "vid bigint, v binary, cell int, at array<bigint>, ask boolean")
    asking = n
    if trees:
        homed, asking = counted(homed, F.col("ask"))

    def local_tree(p: np.ndarray) -> tuple[Tree, tuple[np.ndarray, np.ndarray]]:
        t = Tree(p, max(0, math.ceil(math.log2(max(1, len(p)) / LEAF))))
        lows = np.stack([p[m].min(0) if len(m) else np.full(DIMS, np.inf, np.float32) for m in t.leaves])
        highs = np.stack([p[m].max(0) if len(m) else np.full(DIMS, np.inf, np.float32) for m in t.leaves])
        return t, (lows, highs)

    def hits(ids: np.ndarray, best: Best, names: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(np.isfinite(best.sim))
        return pd.DataFrame({"vid": ids[i], "other": names[best.pos[i, j]], "sim": best.sim[i, j].astype(np.float64)})

    def at_home(f: pd.DataFrame) -> pd.DataFrame:
        """Each vector that asks in its own cell; rows with a cell are those sent on: to that cell, with the bound so far."""
        axes, above = shared.value[0][0], upper()
        boxes_above = above.regions(DIMS)
        f = f.sort_values("vid", ignore_index=True)
        ids, v = f["vid"].to_numpy(), vectors_of(f["v"])
        p, here, asks = v @ axes, int(f["cell"].iloc[0]), np.flatnonzero(f["ask"].to_numpy())
        t, boxes = local_tree(p)
        rank, out = np.arange(len(p)), [pd.DataFrame({"vid": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "sim": np.zeros(0), "v": None, "cell": np.zeros(0, np.int64), "bound": np.zeros(0)})]
        for a in range(0, len(asks), BLOCK):
            s = asks[a : a + BLOCK]
            best = Best(len(s), k, least)
            search(p[s], v[s], rank[s], best, v, p, rank, t, boxes, factor)
            out.append(hits(ids[s], best, ids).assign(v=None, cell=-1, bound=0.0))
            i, c = cells_reached(p[s], best.bound(), above, boxes_above, sending)
            i, c = i[c != here], c[c != here]
            raw = f["v"].to_numpy()[s]
            out.append(pd.DataFrame({"vid": ids[s][i], "other": np.zeros(len(i), np.int64), "sim": 0.0, "v": raw[i], "cell": c, "bound": best.sim[i, -1].astype(np.float64)}))
        return pd.concat(out, ignore_index=True)[["vid", "other", "sim", "v", "cell", "bound"]]

    def together(f: pd.DataFrame) -> pd.DataFrame:
        """All vectors of a cell of one of the trees with each other."""
        f = f.sort_values("vid", ignore_index=True)
        ids = f["vid"].to_numpy()
        return hits(ids, all_pairs(vectors_of(f["v"]), k, least), ids)

    parts, began = [], 0
    while began < trees:
        ended = min(trees, began + max(1, round(ROUND / spread)))
        now = (began << depth, (ended << depth) - 1)
        moved = homed.select("vid", "v", F.explode(F.filter("at", lambda x: x.between(*now))).alias("to"))  # noqa: B023
        parts.append(spool(moved.groupBy("to").applyInPandas(together, "vid bigint, other bigint, sim double")))
        del moved
        release(spark)
        began = ended

    def visited(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"vid": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "sim": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        axes = shared.value[0][0]
        left = left.sort_values("vid", ignore_index=True)
        ids, v = left["vid"].to_numpy(), vectors_of(left["v"])
        p = v @ axes
        t, boxes = local_tree(p)
        rank, out = np.arange(len(p)), [empty]
        for a in range(0, len(right), BLOCK):
            part = right.iloc[a : a + BLOCK]
            qv = vectors_of(part["qv"])
            best = Best(len(part), k, least)
            floor = np.maximum(part["bound"].to_numpy(), least).astype(np.float32)
            best.sim[:, -1] = np.where(floor > least, floor, -np.inf)  # the bound found at home holds here too
            search(qv @ axes, qv, np.full(len(part), -1), best, v, p, rank, t, boxes, factor)
            best.sim[best.pos == np.iinfo(np.int64).max] = -np.inf
            out.append(hits(part["qid"].to_numpy(), best, ids))
        return pd.concat(out, ignore_index=True)

    if asking:
        homed = homed.select("vid", "v", "cell", "ask")
        first = spool(homed.groupBy("cell").applyInPandas(at_home, "vid bigint, other bigint, sim double, v binary, cell int, bound double"))
        release(spark)
        sent = first.where("cell >= 0").select(F.col("vid").alias("qid"), F.col("cell").alias("to"), "bound", F.col("v").alias("qv"))
        # A cell that many queries are sent to is visited in slices of about four times its size, each beside the cell's vectors.
        load = sent.groupBy(F.col("to").alias("cell")).agg(F.ceil(F.count("*") / (4 * cell)).cast("int").alias("slices"))
        load = F.broadcast(spool(load))  # a row for each cell: at most 2 * MOST_SAMPLE / A_CELL
        visits = homed.join(load, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select("vid", "v", "cell", "slice")
        guests = sent.join(load.withColumnRenamed("cell", "to"), "to").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("slices")).cast("int")).drop("slices")
        away = visits.groupBy("cell", "slice").cogroup(guests.groupBy("to", "part")).applyInPandas(visited, "vid bigint, other bigint, sim double")
        parts += [first.where("cell < 0").select("vid", "other", "sim"), away]
    found = functools.reduce(DataFrame.unionByName, parts)
    if trees:
        found = found.groupBy("vid", "other").agg(F.max("sim").alias("sim"))
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k).select("vid", "other", "sim")
    best = best.unionByName(some.where("r = 2").select("vid", F.col("vid").alias("other"), F.lit(1.0).alias("sim")))
    # From vectors to keys: each copy of a vector against the k + 1 smallest keys of each found vector.
    named = best.join(firsts.select(F.col("vid").alias("other"), F.col("key").alias("name")), "other").select("vid", "name", F.least(F.lit(1.0), F.round("sim", 6)).alias("sim"))
    near = named.withColumn("r", F.row_number().over(Window.partitionBy("vid").orderBy(F.desc("sim"), "name"))).where(F.col("r") <= k + 1).drop("r")
    all_of = base.select("vid", "key").join(near, "vid").where(F.col("key") != F.col("name"))
    placed = all_of.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("sim"), "name"))).where(F.col("place") <= k)
    return placed.select("key", F.col("name").alias("other"), F.col("sim").alias("similarity"), "place")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with cosine of at least 0.90 where one is among the other's 10 most similar."""
    rows = table(spark, folder, "chunks").select(F.col("chunk_id").alias("key"), "embedding")
    near = nearest(rows)
    return near.select(F.least("key", "other").alias("chunk_id_a"), F.greatest("key", "other").alias("chunk_id_b")).distinct()


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar chunks of every usable embedding, however far they are."""
    near = nearest(table(spark, folder, "chunks").select(F.col("chunk_id").alias("key"), "embedding"), least=-1.0)
    return near.select(F.col("key").alias("chunk_id"), F.col("other").alias("near_chunk_id"), "similarity", "place")


QUERIES = {"p3_found": p3_found, "p3_nearest": p3_nearest}
ORACLES: dict[str, str] = {}

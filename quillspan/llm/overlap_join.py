"""Exact similarity join of texts: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the incidence matrix are classes of texts with equal shingle sets, columns are shingles, ordered by a frequency
sketch with the rarest first (any fixed order keeps the result exact, a good one keeps it cheap). The columns fall into
blocks. Two rows of similarity t or more miss at most n - ceil(t n) of each other's columns. A row's leading columns are
taken until those that aren't the first of their block exceed that bound by SPARE; then two such rows share at least
1 + SPARE pairs of columns of one block among them. The product runs over these pairs of columns: each worker holds a range
of them, multiplies the rows that meet and adds up their overlap counts; the counts of all ranges are accumulated, pairs
of rows below the bound are dropped, and the rest is compared on the whole rows.

What is shuffled are packed arrays: a range's column pairs, sorted and stored by differences, with the rows' numbers
beside them, and likewise the partial counts. A column pair with many rows is cut into tiles that are multiplied apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspan.llm.shingles import Sets, sets_from, sets_of, unpacked
from quillspan.plans.folds import merged, segments
from quillspan.plans.spool import counted, discard, release, spool

SKETCH = 1 << 20
#: Smallest row size of each scheme of blocks; the number of blocks follows from it. A pair meets in the scheme of its
#: smaller row, so a row takes part in each scheme whose pairs it can be in. Rows of the first one go by single columns.
SCHEMES = (1, 18, 38, 180, 800, 3600, 16000)
SPARE = 2
#: Keys that a range aims at, rows of a key beyond which it is cut into tiles of so many, and rows packed at once.
RANGE = 500_000
TILE = 2_048
PACK = 2_000_000
#: Ids of rows that are sent to all executors at most; beyond that they are joined.
SENT = 1_000_000
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Sizes are kept to a factor of GROW where a byte has to do.
GROW = 1.06
KEYS = "bucket int, m int, keys binary"


def size_code(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.log(np.maximum(n, 1)) / math.log(GROW) + 1e-9).astype(np.uint8)


def block_keys(sets: Sets, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each key): hashed pairs of leading columns of one block, for each scheme that a row takes part in.

    A row's columns are ordered by count, then by number.
    """
    n = sets.sizes
    need = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 + SPARE
    keys, rows = [], []
    for j, low in enumerate(SCHEMES):
        high = SCHEMES[j + 1] / threshold + 1 if j + 1 < len(SCHEMES) else math.inf
        mine = (n >= low) & (n < high)
        if not mine.any():
            continue
        doc = sets.owners()
        inside = mine[doc]
        doc, h = doc[inside], sets.values[inside]
        # By row and count; within a count the numbers stay in their order, which is ascending in a row.
        order = np.argsort((doc.astype(np.int64) << 32) | counts[(h & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")
        doc, h = doc[order], h[order]
        start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        begin = np.repeat(start, np.diff(np.append(start, len(doc))))
        blocks = math.floor(threshold * low + 1e-9) - 1 - SPARE
        if blocks < 1:  # too small for pairs: single columns
            head = np.arange(len(doc)) - begin < need[doc]
            key = (h[head] + np.uint64(j + 1)) * _MIX
            keys.append(key ^ (key >> np.uint64(31)))
            rows.append(doc[head])
            continue
        block = (h >> np.uint64(21)) % np.uint64(blocks)
        group = doc * blocks + block.astype(np.int64)
        by = np.argsort(group, kind="stable")
        again = np.ones(len(doc), dtype=bool)
        again[by[np.concatenate([[True], group[by][1:] != group[by][:-1]])]] = False
        # Up to which column those that aren't the first of their block number `need`.
        upto = np.cumsum(again)
        upto -= upto[begin] - again[begin]
        head = (upto - again) < need[doc]
        by = by[head[by]]
        cols, own = h[by], group[by]
        step = 1
        while step < len(cols):
            same = own[step:] == own[:-step]
            if not same.any():
                break
            pair = ((cols[:-step][same] * _MIX) ^ (cols[step:][same] + np.uint64(j + 1))) * _MIX
            keys.append(pair ^ (pair >> np.uint64(32)))
            rows.append(own[:-step][same] // blocks)
            step += 1
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def class_sets(rows: DataFrame, width: int, min_tokens: int, seq: int = 0, path: str | None = None, count: bool = True) -> tuple[DataFrame, np.ndarray | None]:
    """rows(text, *kept) -> (sets(*kept, did, c1, c2, n, members), sketch), in one pass over the texts.

    A row for each text that takes part: its number `did` (unique for each seq), two independent hashes of its set, the
    set's size and the set itself. The sketch has the counts of texts by hashed shingle.
    """
    kept = [f for f in rows.schema.fields if f.name != "text"]
    text_at = rows.columns.index("text")
    kinds = [to_arrow_type(f.dataType) for f in kept]
    names = [*[f.name for f in kept], "did", "c1", "c2", "n", "members", "seg", "salt", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(SKETCH, np.int32)
        did = (seq << 52) | (TaskContext.get().partitionId() << 30)
        for batch, sets in sets_of(batches, width, min_tokens, text_at):
            if count:
                acc += np.bincount((sets.values & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.int32)
            taken = batch.take(pa.array(sets.at, pa.int64()))
            m = len(sets)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[i].tobytes()) for i in range(m)), np.int64).reshape(m, 2)
            none = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            own = [pa.array(np.arange(did, did + m, dtype=np.int64)), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(sets.sizes, pa.int32()), pa.array(sets.packed(), pa.binary())]
            did += m
            yield pa.RecordBatch.from_arrays([*[taken.column(f.name) for f in kept], *own, *none], names=names)
        if count:
            for part in segments(acc):
                empty = [pa.nulls(part.num_rows, t) for t in (*kinds, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, *part.columns], names=names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "did bigint, c1 bigint, c2 bigint, n int, members binary, seg int, salt int, part binary"
    out = spool(rows.mapInArrow(run, schema), path=path)
    sketch = merged(out.where("seg is not null").select("seg", "salt", "part"), SKETCH, "int32", np.add) if count else None
    sets = out.where("did is not null").drop("seg", "salt", "part")
    sets._spooled = out._spooled
    return sets, sketch


def without(rows: DataFrame, ids: DataFrame, number: int, keep: bool = False) -> DataFrame:
    """rows whose did isn't (with `keep`: is) in the spooled ids(did), of which there are `number`. Few ids are sent to all executors, many are joined."""
    return rows.join(F.broadcast(ids) if number <= SENT else ids, "did", "left_semi" if keep else "left_anti")


# Packed column pairs: keys within a range are sorted, their differences, row numbers and size codes stored byte by byte.


def planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).ravel()


def from_planes(raw: np.ndarray, m: int, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(-1, m).T).view(kind).ravel()


def pack(*columns: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([planes(c) for c in columns]), codec="zstd", asbytes=True)


def unpack(packed: bytes, m: int, kinds: tuple[type, ...]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(packed, m * sum(widths), codec="zstd", asbytes=True), np.uint8)
    at = np.concatenate([[0], np.cumsum(widths)]) * m
    return [from_planes(raw[at[i] : at[i + 1]], m, k) for i, k in enumerate(kinds)]


_KEY, _PAIR = (np.uint32, np.int64, np.uint8), (np.int64, np.int64, np.uint8)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def packed_keys(sets: DataFrame, sketch: np.ndarray, ranges: int, threshold: float) -> DataFrame:
    """sets(did, members) -> (bucket, m, keys): column pairs by range; `ranges` is a power of two."""
    shared = sets.sparkSession.sparkContext.broadcast(sketch)
    top = np.uint64(64 - (ranges.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            dids, members = batch.column(0).to_numpy(), batch.column(1)
            upto = np.cumsum([len(x) // 6 for x in members.to_pylist()])
            begin = 0
            while begin < len(dids):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PACK, side="right")))
                sets = sets_from(members.slice(begin, end - begin).to_pylist())
                keys, of = block_keys(sets, counts, threshold)
                order = np.argsort(keys)
                keys, of = keys[order], of[order]
                bucket = (keys >> top).astype(np.int64) if ranges > 1 else np.zeros(len(keys), np.int64)
                low = ((keys << np.uint64(ranges.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)
                code, own = size_code(sets.sizes), dids[begin:end]
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, int)
                blobs = [pack(_steps(low[a:b]), own[of[a:b]], code[of[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "m", "keys"])
                begin = end

    return sets.select("did", "members").mapInArrow(run, KEYS)


def opened_keys(m: int, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, did, code = unpack(packed, m, _KEY)
    return np.cumsum(step, dtype=np.uint32), did, code


def _met(h: np.ndarray, did: np.ndarray, code: np.ndarray, fresh: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, count of 1 or more) of the rows that meet in a key, one of them fresh; h is sorted, fresh rows come first within a key."""
    apart = int(math.log(1 / threshold) / math.log(GROW) + 1.000001)
    small = size_code(np.array([SCHEMES[1]]))[0]
    step = 1
    left = np.flatnonzero(fresh)
    while len(left):
        left = left[left + step < len(h)]
        left = left[h[left + step] == h[left]]
        right = left + step
        near = (np.abs(code[left].astype(np.int16) - code[right].astype(np.int16)) <= apart) & (did[left] != did[right])
        a, b = did[left[near]], did[right[near]]
        # Rows too small for the count to rise above the bound pass it at once.
        few = np.minimum(code[left[near]], code[right[near]]) <= small
        yield np.minimum(a, b), np.maximum(a, b), np.where(few, 1 + SPARE, 1).astype(np.int64)
        step += 1


def _summed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(c, at) if len(at) else c


class _Counts:
    """Partial counts of a task, given out as packed arrays by a hash of the smaller row."""

    def __init__(self, ranges: int):
        self.ranges, self.parts, self.held = ranges, [], 0

    def add(self, part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > PACK:
            self.fold()
            if self.held > PACK // 2:
                yield from self.flush()

    def fold(self) -> None:
        if self.parts:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        if self.held:
            a, b, c = self.parts[0]
            mixed = a.view(np.uint64) * _MIX
            bucket = ((mixed >> np.uint64(40)) % np.uint64(self.ranges)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            a, b, c, bucket = a[order], b[order], np.minimum(c[order], 255).astype(np.uint8), bucket[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            blobs = [pack(_steps(a[i:j]), b[i:j], c[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            n = len(blobs)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(np.diff(edges).astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(n, pa.binary())], names=["bucket", "m", "keys", "other"])
        self.parts, self.held = [], 0


_MET = KEYS + ", other binary"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket after the other, of batches that are sorted by bucket."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and bucket[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = bucket[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def multiplied(keys: DataFrame, ranges: int, threshold: float) -> tuple[DataFrame, int]:
    """keys(bucket, m, keys, fresh) -> (spooled (bucket, m, keys, other), tiles): packed partial counts of the rows that meet, one of them fresh.

    Rows with `other` are two tiles of a key with many rows, which `tiles_multiplied` takes apart from its range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(ranges)
        for bucket in _by_bucket(batches):
            parts = [(*opened_keys(m, k), np.full(m, f)) for m, k, f in zip(*(bucket.column(c).to_pylist() for c in ("m", "keys", "fresh")), strict=True)]
            h, did, code, fresh = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort((h.astype(np.uint64) << np.uint64(1)) | (~fresh).astype(np.uint64))
            h, did, code, fresh = h[order], did[order], code[order], fresh[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.diff(np.append(start, len(h)))
            hot = many > TILE
            for at, n in zip(start[hot].tolist(), many[hot].tolist(), strict=True):
                tiles = [slice(i, min(i + TILE, at + n)) for i in range(at, at + n, TILE)]
                packed = [pack(did[t], code[t], fresh[t].astype(np.uint8)) for t in tiles]
                out = [(i, j) for i in range(len(tiles)) for j in range(i, len(tiles)) if fresh[tiles[i]].any()]
                salt = [int(xxhash.xxh3_64_intdigest(f"{h[at]} {i} {j}".encode()) & 0x7FFFFFFF) for i, j in out]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(salt, pa.int32()), pa.array([(tiles[i].stop - tiles[i].start) * (TILE + 1) + tiles[j].stop - tiles[j].start for i, j in out], pa.int32()), pa.array([packed[i] for i, _ in out], pa.binary()), pa.array([packed[j] for _, j in out], pa.binary())], names=["bucket", "m", "keys", "other"])
            if hot.any():
                cool = np.repeat(~hot, many)
                h, did, code, fresh = h[cool], did[cool], code[cool], fresh[cool]
            for part in _met(h, did, code, fresh, threshold):
                yield from counts.add(part)
        yield from counts.flush()

    return counted(keys.select("bucket", "m", "keys", "fresh").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _MET), F.col("other").isNotNull())


def tiles_multiplied(tiles: DataFrame, ranges: int, threshold: float) -> DataFrame:
    """Partial counts of pairs of tiles (see `multiplied`), each pair in one piece of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kinds = _Counts(ranges), (np.int64, np.uint8, np.uint8)
        for batch in batches:
            for m, x, y in zip(*(batch.column(c).to_pylist() for c in ("m", "keys", "other")), strict=True):
                same = x == y
                sides = [unpack(x, m // (TILE + 1), kinds)] + ([] if same else [unpack(y, m % (TILE + 1), kinds)])
                did, code, fresh = (np.concatenate(z) for z in zip(*sides, strict=True))
                tile = np.repeat(np.arange(len(sides)), [len(z[0]) for z in sides])
                for a, b, c in _met(np.zeros(len(did), np.uint32), np.arange(len(did)), code, fresh.astype(bool), threshold):
                    across = np.full(len(a), same) | (tile[a] != tile[b])
                    da, db = did[a[across]], did[b[across]]
                    yield from counts.add((np.minimum(da, db), np.maximum(da, db), c[across]))
        yield from counts.flush()

    return tiles.repartition(F.col("bucket")).mapInArrow(run, _MET)


def accumulated(met: DataFrame, tiles: int, ranges: int, threshold: float) -> DataFrame:
    """(a, b): the pairs of rows whose counts, added up over all ranges and tiles, reach the bound."""
    counts = met.where("other is null")
    if tiles:
        counts = counts.unionByName(tiles_multiplied(met.where("other is not null"), ranges, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _by_bucket(batches):
            parts = []
            for m, k in zip(bucket.column("m").to_pylist(), bucket.column("keys").to_pylist(), strict=True):
                step, b, c = unpack(k, m, _PAIR)
                parts.append((np.cumsum(step), b, c.astype(np.int64)))
            a, b, c = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            ok = c > SPARE
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return counts.select("bucket", "m", "keys").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a bigint, b bigint")


def ranges_for(columns: int) -> int:
    """The number of ranges for rows of so many columns in all: a power of two, so that a range has about RANGE keys."""
    return 1 << max(4, min(24, math.ceil(math.log2(max(1, columns) / RANGE))))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """pairs(a, b, ...) of rows whose similarity over the whole sets(did, n, members) reaches the threshold: adds `similarity`."""
    wanted, number = counted(pairs.select(F.explode(F.array("a", "b")).alias("did")).distinct())
    some = without(sets.select("did", "members"), wanted, number, keep=True)
    both = pairs.join(some.select(F.col("did").alias("a"), F.col("members").alias("x")), "a").join(some.select(F.col("did").alias("b"), F.col("members").alias("y")), "b")
    kept = [f for f in pairs.schema.fields if f.name not in ("a", "b")]
    names = ["a", "b", *[f.name for f in kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = unpacked(x), unpacked(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(shared / max(1, len(x) + len(y) - shared))
            sim = np.array(sims)
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sim)], names=[*names, "similarity"])
            yield out.filter(pa.array(sim >= threshold - 1e-9))

    return both.select(*names, "x", "y").mapInArrow(run, "a bigint, b bigint, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "similarity double")


def similar_classes(rows: DataFrame, threshold: float, width: int, min_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Self-join of rows(key, text): (members, links).

    members(key, did) has a row for each text that takes part, did being the number of its class (that of one of its
    rows); links(a, b, similarity) one for each pair of different classes at or above the threshold, a < b.
    """
    spark = rows.sparkSession
    sets, sketch = class_sets(rows.select("key", "text"), width, min_tokens)
    classes = spool(sets.groupBy("c1", "c2").agg(F.min("did").alias("first"), F.count("*").alias("copies")))
    copied = F.col("copies") > 1
    again = sets.select("key", "did", "c1", "c2").join(classes.where(copied).select("c1", "c2", "first"), ["c1", "c2"])
    copies, number = counted(again.where("did <> first").select("key", "did", "first"))
    firsts = without(sets, copies.select("did"), number)
    columns = firsts.agg(F.sum("n")).first()[0] or 0
    ranges = ranges_for(columns)
    met, tiles = multiplied(packed_keys(firsts, sketch, ranges, threshold).withColumn("fresh", F.lit(True)), ranges, threshold)
    release(spark)
    pairs = spool(accumulated(met, tiles, ranges, threshold))
    discard(met)
    release(spark)
    links = spool(verified(pairs, sets, threshold))
    members = firsts.select("key", "did").unionByName(copies.select("key", F.col("first").alias("did")))
    return members, links



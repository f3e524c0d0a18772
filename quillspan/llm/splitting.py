"""Problem 2: oversized texts cut at natural boundaries, range by range.

A text is handled as ranges of a fixed number of characters, each read with a halo on both sides, so that no worker needs
the whole text: ranges report the cuts that end inside them, the cut tables are stitched by offset, and pieces are
emitted by offset. The same works for files: byte ranges, a halo, and a prefix sum of the ranges' lengths in characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.plans.once import once
from quillspan.plans.spool import new_path, spool
from quillspan.sources.tables import table

LIMIT = 2048
OVERLAP = 64
RANGE = 1 << 16
HALO = 1 << 10
#: Kinds of cut from the coarsest on; a cut lies after the match.
KINDS = ("paragraph", "line", "sentence", "word")
PATTERNS = (r"\n\n+", r"\n+", r"[.!?][\"')\]]?\s+", r"\s+")
_CUTS = [re.compile(p) for p in PATTERNS]


def cuts_in(text: str, start: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """(position, kind) of the cuts at lo < position <= hi, with `text` beginning at `start`; each position once, with its coarsest kind.

    A run of white space longer than the halo may be seen in part; it is then cut where the part ends, which still is
    white space.
    """
    found: dict[int, int] = {}
    for kind, pattern in enumerate(_CUTS):
        for m in pattern.finditer(text):
            at = start + m.end()
            if lo < at <= hi:
                found.setdefault(at, kind)
    return sorted(found.items())


def ranges(rows: DataFrame, size: int, halo: int) -> DataFrame:
    """rows(key, text) -> (key, total, part, lo, hi, start, piece): overlapping parts of each text."""
    total = F.length("text")
    cut = rows.select("key", "text", total.alias("total")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / size).cast("int"))))
    lo = F.col("part") * size
    start = F.greatest(F.lit(0), lo - halo)
    return cut.select("key", "total", "part", lo.alias("lo"), F.least("total", lo + size).alias("hi"), start.alias("start"), F.expr(f"substring(text, greatest(0, part * {size} - {halo}) + 1, {size} + 2 * {halo})").alias("piece"))


def range_cuts(parts: DataFrame) -> DataFrame:
    """(key, total, part, lo, hi, at array<int>, kind array<int>): the cuts of each range."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ats, kinds = [], []
            for piece, start, lo, hi in zip(f["piece"], f["start"], f["lo"], f["hi"], strict=True):
                found = cuts_in(piece, int(start), int(lo), int(hi))
                ats.append([a for a, _ in found])
                kinds.append([k for _, k in found])
            yield f[["key", "total", "part", "lo", "hi"]].assign(at=ats, kind=kinds)

    return parts.mapInPandas(run, "key string, total int, part int, lo int, hi int, at array<int>, kind array<int>")


def boundary_kinds(rows: DataFrame, limit: int = LIMIT, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """rows(key, text) -> (key, total, boundary) of the texts longer than `limit` characters.

    boundary is the first of KINDS such that cutting at all places of this kind and the coarser ones leaves no segment
    above the limit, or "none". Null and short texts give no row, repeated keys one.
    """
    return _kinds_of(spool(range_cuts(ranges(_large(rows, limit), size, halo))), limit)


def _kinds_of(tabled: DataFrame, limit: int) -> DataFrame:
    # Per range and level only the first cut, the last one and the widest gap between are kept and stitched.
    def level(k: int):
        own = F.transform(F.filter(F.arrays_zip("at", "kind"), lambda x: x["kind"] <= k), lambda x: x["at"])
        return own.alias(f"own{k}")

    levels = tabled.select("key", "total", "part", *[level(k) for k in range(len(KINDS))])
    summary = levels.select(
        "key", "total", "part",
        *[F.try_element_at(F.col(f"own{k}"), F.lit(1)).alias(f"first{k}") for k in range(len(KINDS))],
        *[F.try_element_at(F.col(f"own{k}"), F.lit(-1)).alias(f"last{k}") for k in range(len(KINDS))],
        *[F.coalesce(F.array_max(F.zip_with(F.slice(f"own{k}", 2, 1 << 30), F.col(f"own{k}"), lambda b, a: b - a)), F.lit(0)).alias(f"gap{k}") for k in range(len(KINDS))],
    )
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(len(KINDS)):
        summary = summary.withColumn(f"join{k}", F.col(f"first{k}") - F.coalesce(F.last(f"last{k}", ignorenulls=True).over(before), F.lit(0)))
    whole = summary.groupBy("key").agg(
        F.max("total").alias("total"),
        *[F.greatest(F.coalesce(F.max(f"gap{k}"), F.lit(0)), F.coalesce(F.max(f"join{k}"), F.lit(0)), F.max("total") - F.coalesce(F.max(f"last{k}"), F.lit(0))).alias(f"widest{k}") for k in range(len(KINDS))],
    )
    named = F.lit("none")
    for k in reversed(range(len(KINDS))):
        named = F.when(F.col(f"widest{k}") <= limit, KINDS[k]).otherwise(named)
    return whole.select("key", "total", named.alias("boundary"))


class Walk:
    """Pieces of one text, range after range: each ends as far as the limit allows, at the coarsest kind of cut in its second
    half, else at the last cut, else at the limit. What a piece is depends on the text alone, not on its ranges."""

    def __init__(self, total: int, limit: int, overlap: int):
        self.total, self.limit, self.overlap = total, limit, overlap
        self.start, self.number = 0, 0
        self.cuts, self.kinds = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def take(self, cuts: np.ndarray, kinds: np.ndarray, known: int) -> Iterator[tuple[int, int, int]]:
        """(number, start, end) of the pieces that the cuts up to `known` settle."""
        self.cuts, self.kinds = np.concatenate([self.cuts, cuts]), np.concatenate([self.kinds, kinds])
        while True:
            room = self.limit - (self.overlap if self.start else 0)
            if self.total - self.start <= room:
                if known >= self.total and self.start < self.total:
                    yield self._piece(self.total)
                return
            if self.start + room > known:
                return
            i, j = np.searchsorted(self.cuts, [self.start + 1, self.start + room + 1])
            end = self.start + room
            if j > i:
                half = np.searchsorted(self.cuts, self.start + room // 2 + 1)
                a = max(i, half) if half < j else i
                best = self.kinds[a:j].min()
                end = int(self.cuts[a:j][self.kinds[a:j] == best][-1])
            yield self._piece(end)
            keep = np.searchsorted(self.cuts, end, side="right")
            self.cuts, self.kinds = self.cuts[keep:], self.kinds[keep:]

    def _piece(self, end: int) -> tuple[int, int, int]:
        out = (self.number, max(0, self.start - (self.overlap if self.start else 0)), end)
        self.start, self.number = end, self.number + 1
        return out


def split_pieces(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """rows(key, text) -> (key, piece_no, start_char, end_char, content) of the texts longer than `limit` characters.

    Pieces are at most `limit` characters long, cover the text, and each but the first begins `overlap` characters
    before the end of the one before. Null and short texts give no row, repeated keys one.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half of the limit")
    large = _large(rows, limit)
    spans = piece_spans(range_cuts(ranges(large, size, halo)), limit, overlap)
    # Each piece is cut out of the range that it begins in: the halo is longer than a piece.
    parts = ranges(large, size, max(halo, limit)).select("key", "part", "start", "piece")
    placed = spans.withColumn("part", F.floor(F.col("start_char") / size).cast("int"))
    return placed.join(parts, ["key", "part"]).select("key", "piece_no", "start_char", "end_char", F.expr("substring(piece, start_char - start + 1, end_char - start_char)").alias("content"))


def _large(rows: DataFrame, limit: int) -> DataFrame:
    """The texts above the limit, each key once: of several texts the first in order."""
    return once(rows.where(F.length("text") > limit).select("key", "text"), "key", F.col("text"))


def piece_spans(tabled: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Cut tables of ranges (key, total, part, hi, at, kind) -> (key, piece_no, start_char, end_char).

    A text's cut tables come to one task in order and are stitched there as they come: what is held are the cuts of one
    range and those of an unfinished piece, however long the text is.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, walk = None, None
        for f in frames:
            out = []
            for k, total, hi, at, kind in zip(f["key"], f["total"], f["hi"], f["at"], f["kind"], strict=True):
                if walk is None or k != key:
                    key, walk = k, Walk(int(total), limit, overlap)
                out += [(key, *piece) for piece in walk.take(np.asarray(at, np.int64), np.asarray(kind, np.int64), int(hi))]
            yield pd.DataFrame(out, columns=["key", "piece_no", "start_char", "end_char"])

    in_order = tabled.select("key", "total", "part", "hi", "at", "kind").repartition("key").sortWithinPartitions("key", "part")
    return in_order.mapInPandas(run, "key string, piece_no int, start_char int, end_char int")


def split_files(spark: SparkSession, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """files(key, path, bytes): UTF-8 files on a path that all executors see -> (key, piece_no, start_char, end_char).

    A worker reads `size` bytes at its offset and a halo, moved to whole characters; the ranges' lengths in characters
    are summed up per file to turn local offsets into offsets in the file, and pieces are emitted by offset.
    """
    last_part = F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / size)).cast("int")
    work = files.where("bytes > 0").select("key", "path", "bytes", F.explode(F.sequence(F.lit(0), last_part)).alias("part"))
    work = work.repartition(F.col("key"), F.col("part"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda raw, at: next((at + i for i in range(4) if at + i >= len(raw) or raw[at + i] & 0xC0 != 0x80), at)
        for f in frames:
            out = []
            for key, path, part in zip(f["key"], f["path"], f["part"], strict=True):
                lo = int(part) * size
                begin = max(0, lo - halo)
                system, at = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)
                with system.open_input_file(at) as h:
                    raw = h.read_at(max(0, min(lo - begin + size + halo, h.size() - begin)), begin)
                a, b = whole(raw, lo - begin), whole(raw, min(len(raw), lo - begin + size))
                head = raw[whole(raw, 0) if begin else 0 : a].decode("utf-8", "replace")
                body = raw[a:b].decode("utf-8", "replace")
                tail = raw[b:].decode("utf-8", "ignore")
                found = cuts_in(head + body + tail, -len(head), 0, len(body))
                out.append((key, int(part), len(body), [x for x, _ in found], [k for _, k in found]))
            yield pd.DataFrame(out, columns=["key", "part", "chars", "at", "kind"])

    local = spool(work.mapInPandas(read, "key string, part int, chars int, at array<int>, kind array<int>"))
    upto = Window.partitionBy("key").orderBy("part")
    lo = (F.sum("chars").over(upto) - F.col("chars")).cast("int")
    shifted = local.withColumn("lo", lo).withColumn("total", F.sum("chars").over(Window.partitionBy("key")).cast("int"))
    tabled = shifted.select("key", "total", "part", "lo", (F.col("lo") + F.col("chars")).alias("hi"), F.expr("transform(at, x -> x + lo)").alias("at"), "kind")
    return piece_spans(tabled, limit, overlap)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select(F.col("chunk_id").alias("key"), F.col("content").alias("text"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contents longer than 2,048 characters and the kind of boundary that suffices to cut them."""
    return boundary_kinds(_chunks(spark, folder)).select(F.col("key").alias("chunk_id"), "boundary")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all contents longer than 2,048 characters."""
    return split_pieces(_chunks(spark, folder)).withColumnRenamed("key", "chunk_id")


def p2_cover(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, exact, within, overlapping, whole): what pieces must be, per content."""
    pieces = p2_pieces(spark, folder).withColumnRenamed("chunk_id", "key").join(_large(_chunks(spark, folder), LIMIT), "key")
    order = Window.partitionBy("key").orderBy("piece_no")
    before = F.lag("end_char").over(order)
    good = pieces.withColumn("linked", F.when(before.isNull(), F.col("start_char") == 0).otherwise(F.col("start_char") == F.greatest(F.lit(0), before - OVERLAP)))
    by = good.groupBy("key").agg(F.bool_and(F.expr("content = substring(text, start_char + 1, end_char - start_char)")).alias("exact"), F.bool_and(F.length("content") <= LIMIT).alias("within"), F.bool_and("linked").alias("overlapping"), (F.max("end_char") == F.max(F.length("text"))).alias("whole"))
    return by.withColumnRenamed("key", "chunk_id")


def p2_file_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(key, piece_no, start_char, end_char): all contents as a few large files, split by byte ranges without loading one whole."""
    path = new_path(spark, "texts")
    _chunks(spark, folder).where("text is not null").select("text").coalesce(4).write.text(path)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length")
    files = listed.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("key"), "path", F.col("length").alias("bytes"))
    return split_files(spark, files)


# Cuts of a kind and of the coarser ones, marked and counted; a mark may stand within a run of white space.
_SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LEVELS = {
    "paragraph": r"regexp_replace(content, '(\n\n+)', '\1' || chr(30), 'g')",
    "line": r"regexp_replace(content, '(\n+)', '\1' || chr(30), 'g')",
}
_LEVELS["sentence"] = rf"regexp_replace({_LEVELS['line']}, '([.!?][\"'')\]]?{_SPACE}+)', '\1' || chr(30), 'g')"
_LEVELS["word"] = rf"regexp_replace(content, '({_SPACE}+)', '\1' || chr(30), 'g')"


def _fits(level: str) -> str:
    return f"list_max(list_transform(string_split({_LEVELS[level]}, chr(30)), lambda x: length(x))) <= {LIMIT}"


_LONG = f"SELECT DISTINCT chunk_id, content FROM chunks WHERE length(content) > {LIMIT} AND chunk_id IS NOT NULL"
QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_cover": p2_cover, "p2_file_pieces": p2_file_pieces}
ORACLES: dict[str, str] = {
    "p2_found": f"SELECT chunk_id, CASE {' '.join(f'WHEN {_fits(k)} THEN ' + chr(39) + k + chr(39) for k in KINDS)} ELSE 'none' END AS boundary FROM ({_LONG})",
    "p2_cover": f"SELECT DISTINCT chunk_id, true AS exact, true AS within, true AS overlapping, true AS whole FROM ({_LONG})",
}

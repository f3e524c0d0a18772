"""Texts cut into spans with exact offsets: content == text[start:end] for every span of every strategy.

A strategy proposes cuts; shared rules trim spans, pack or cut them to size and add overlap. Spans are planned a text at a
time in Arrow batches, since each cut depends on the one before; everything around them stays in Spark.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import chunk_key

# Sizes in characters, the ladder of separators, and abbreviations whose stop ends no sentence.
SIZE, OVERLAP, LEAST, MOST = 512, 64, 64, 2048
PARENT, CHILD = 2048, 256
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")
ABBREVIATIONS = frozenset(
    "dr mr mrs ms mx prof rev hon pres gov sen rep sr jr st mt ft gen col lt sgt capt cmdr adm "
    "inc ltd llc llp plc co corp dept div univ assn e.g i.e etc vs viz cf al ibid op seq "
    "fig figs eq eqs ref refs vol vols no nos pp ed eds trans approx est min max avg std var "
    "a.m p.m u.s u.k u.n e.u ph.d m.d b.a m.a b.s m.s "
    "jan feb mar apr jun jul aug sep sept oct nov dec mon tue tues wed thu thur thurs fri sat sun".split()
)

_STOP = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|\n[^\S\n]*\n\s*")
_WORD_BEFORE = re.compile(r"[\w.]+$")


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    whole: bool = False  # a block that isn't cut
    group: str = ""  # spans of different groups never merge and never overlap

    def __len__(self) -> int:
        return self.end - self.start


def sentences(text: str) -> list[tuple[int, int]]:
    """Contiguous sentences that cover the text; white space belongs to the sentence before it.

    A stop after an abbreviation, an initial or a list number ends none, nor one that a lower-case word follows; a blank
    line always does.
    """
    out, begin = [], 0
    for m in _STOP.finditer(text):
        end = m.end()
        if not m.group().startswith("\n"):
            while end < len(text) and text[end].isspace():
                end += 1
            if m.group()[0] == "." and not m.group().startswith(".."):
                word = _WORD_BEFORE.search(text, max(0, m.start() - 24), m.start())
                before = word.group().strip(".").lower() if word else ""
                line = text.rfind("\n", 0, m.start()) + 1
                initial = len(before) == 1 and before.isalpha() and word.group()[-1].isupper()
                listed = before.isdigit() and not text[max(line, begin) : word.start()].strip()
                if before in ABBREVIATIONS or before.split(".")[-1] in ABBREVIATIONS or initial or listed:
                    continue
            if end < len(text) and text[end].islower() and "\n\n" not in text[m.end() : end]:
                continue
        if end > begin:
            out.append((begin, end))
            begin = end
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def trimmed(spans: list[Span], text: str) -> list[Span]:
    """Spans within the text without outer white space, in order; one inside another is dropped."""
    kept: list[Span] = []
    for s in spans:
        a, b = max(0, s.start), min(s.end, len(text))
        piece = text[a:b]
        a += len(piece) - len(piece.lstrip())
        b = a + len(piece.strip())
        if b > a:
            kept.append(replace(s, start=a, end=b))
    out: list[Span] = []
    for s in sorted(kept, key=lambda s: (s.start, -s.end)):
        if not out or s.end > out[-1].end:
            out.append(s)
    return out


def packed(spans: list[Span], least: int, most: int) -> list[Span]:
    """Neighbours are joined while one of them is under `least` and both together are within `most`."""
    out: list[Span] = []
    for s in spans:
        p = out[-1] if out else None
        if p and not p.whole and not s.whole and p.group == s.group and min(len(p), len(s)) < least and s.end - p.start <= most:
            out[-1] = replace(p, end=s.end)
        else:
            out.append(s)
    return out


def cut_to(spans: list[Span], text: str, most: int, goal: int) -> list[Span]:
    """Spans above `most` are cut at the last paragraph, line, sentence or word end before the goal, else before the limit."""
    out: list[Span] = []
    for s in spans:
        at = s.start
        while not s.whole and s.end - at > most:
            floor, aim, limit = at + max(goal // 2, 1), min(at + goal, at + most), at + most
            end = limit
            for mark in ("\n\n", "\n", ". ", " "):
                place = max(text.rfind(mark, floor, aim), -1)
                if place < 0:
                    place = text.rfind(mark, floor, limit)
                if place > floor:
                    end = min(place + len(mark), limit)
                    break
            out.append(replace(s, start=at, end=end))
            at = end
        out.append(replace(s, start=at))
    return out


def overlapped(spans: list[Span], text: str, overlap: int) -> list[Span]:
    """Each span starts up to `overlap` characters earlier, at a word's start, within its group and after its predecessor's start."""
    out = spans[:1]
    for p, s in zip(spans, spans[1:], strict=False):
        start = max(p.start + 1, s.start - overlap)
        if overlap > 0 and not (s.whole or p.whole) and p.group == s.group and start < s.start:
            blank = re.compile(r"\s").search(text, start, s.start)
            start = blank.end() if blank else start
            s = replace(s, start=min(start, s.start))
        out.append(s)
    return out


# Strategies: a text's spans before trimming and overlap


def recursive(text: str, size: int = SIZE, start: int = 0, end: int | None = None, group: str = "") -> list[Span]:
    """Cut by the coarsest separator whose pieces all fit; pieces that don't are cut by finer ones, and all are packed up to the size."""

    def pieces(a: int, b: int, mark: str) -> list[tuple[int, int]]:
        ends, at = [], text.find(mark, a, b)
        while at >= 0:
            ends.append(at + len(mark))
            at = text.find(mark, at + len(mark), b)
        edges = [a, *[e for e in ends if e < b], b]
        return list(zip(edges, edges[1:], strict=False))

    def cut(a: int, b: int, rung: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        first = None
        for i in range(rung, len(SEPARATORS)):
            parts = pieces(a, b, SEPARATORS[i])
            if len(parts) > 1:
                if all(y - x <= size for x, y in parts):
                    yield from parts
                    return
                first = first or (i, parts)
        if first:
            for x, y in first[1]:
                yield from cut(x, y, first[0] + 1)
        else:
            yield from ((i, min(i + size, b)) for i in range(a, b, size))

    end = len(text) if end is None else end
    return packed([Span(a, b, group=group) for a, b in cut(start, end, 0)] if end > start else [], size, size)


def by_tokens(text: str, size: int = 128, overlap: int = 16) -> list[Span]:
    """Windows of so many tokens (words and marks), each starting `overlap` tokens before the end of the one before."""
    ends = [m.end() for m in re.finditer(r"\w+|[^\w\s]", text)]
    starts = [0, *ends[:-1]]
    step = max(1, size - overlap)
    return [Span(starts[i], ends[min(i + size, len(ends)) - 1]) for i in range(0, len(ends), step) if i == 0 or i + overlap < len(ends)]


def sections(text: str) -> list[tuple[str, str, int, int]]:
    """(heading path, kind, start, end) of Markdown blocks: headings open sections, fences and tables are blocks of their own."""
    out: list[tuple[str, str, int, int]] = []
    path: list[tuple[int, str]] = []
    fence, at = "", 0
    for line in text.splitlines(keepends=True):
        begin, at = at, at + len(line)
        bare = line.strip()
        if fence:
            kind = "code"
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
        elif m := re.match(r"(`{3,}|~{3,})", bare):
            kind, fence = "code-start", m.group(1)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", bare):
            level = len(m.group(1))
            path = [p for p in path if p[0] < level] + [(level, m.group(2))]
            kind = "heading"
        else:
            kind = "table" if bare.startswith("|") else "text"
        name = " > ".join(t for _, t in path)
        grows = out and out[-1][0] == name and (out[-1][1] == kind != "heading" or (kind == "code" and out[-1][1] == "code-start") or (kind == "text" and out[-1][1] == "heading"))
        if grows:
            out[-1] = (name, out[-1][1] if kind != "text" else "text", out[-1][2], at)
        else:
            out.append((name, kind, begin, at))
    return [(n, "code" if k == "code-start" else "text" if k == "heading" else k, a, b) for n, k, a, b in out]


def markdown(text: str, size: int = SIZE) -> list[Span]:
    """Sections by heading, cut to size; code and tables stay whole. The heading path is the span's group."""
    out: list[Span] = []
    for name, kind, a, b in sections(text):
        if kind in ("code", "table"):
            out.append(Span(a, b, True, name))
        else:
            out += recursive(text, size, a, b, name)
    return packed(trimmed(out, text), size, size)


# Line patterns that open a unit of code, by language.
UNITS = {
    "python": r"(?:(?:async\s+def|def|class)\b|@)",
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|interface|type)\b",
    "java": r"(?:public|private|protected|static|final|abstract|class|interface|enum)\b",
    "go": r"(?:func|type)\b",
    "rust": r"(?:pub\s+)?(?:fn|struct|enum|impl|trait|mod)\b",
    "sql": r"(?i:create|select|with|insert|update|delete|alter)\b",
}
SUFFIXES = {"py": "python", "js": "javascript", "ts": "javascript", "jsx": "javascript", "tsx": "javascript", "java": "java", "kt": "java", "go": "go", "rs": "rust", "sql": "sql"}


def language(text: str, name: str = "") -> str:
    """By the file name's suffix, else the language most of whose units the text has; empty if none."""
    if known := SUFFIXES.get(name.rpartition(".")[2].lower()):
        return known
    count = {k: len(re.findall(rf"(?m)^(?:{p})", text)) for k, p in UNITS.items()}
    best = max(count, key=count.get)
    return best if count[best] else ""


def code(text: str, size: int = SIZE, name: str = "") -> list[Span]:
    """Units that start at the margin, imports with the first; small ones are packed, large ones cut."""
    kind = language(text, name)
    if not kind:
        return recursive(text, size)
    starts = [m.start() for m in re.finditer(rf"(?m)^(?:{UNITS[kind]})", text)]
    starts = [s for i, s in enumerate(starts) if i == 0 or not text[starts[i - 1] : s].lstrip().startswith("@")]
    edges = [0, *[s for s in starts[1:] if s], len(text)] if starts else [0, len(text)]
    units = [Span(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    out: list[Span] = []
    for u in packed(units, size, size):
        out += [u] if len(u) <= size else recursive(text, size, u.start, u.end)
    return out


def breakpoints(distances: np.ndarray, mode: str = "percentile", amount: float = 95.0) -> np.ndarray:
    """Which distances between neighbours are breaks: strictly above a percentile, mean + k deviations, mean + k quartile ranges, or a percentile of the gradient."""
    if not len(distances):
        return np.zeros(0, bool)
    if mode == "percentile":
        return distances > np.percentile(distances, amount)
    if mode == "deviation":
        return distances > distances.mean() + amount * distances.std()
    if mode == "quartiles":
        low, high = np.percentile(distances, [25, 75])
        return distances > distances.mean() + amount * (high - low)
    if mode == "gradient":
        slope = np.gradient(distances) if len(distances) > 1 else np.zeros(1)
        return slope > np.percentile(slope, amount)
    raise ValueError(f"unknown mode: {mode}")


def hashed_vector(text: str, width: int = 256) -> np.ndarray:
    """A stand-in for an embedder: a unit vector of hashed words, the same everywhere."""
    import zlib

    v = np.zeros(width)
    for w in re.findall(r"\w+", text.lower()):
        v[zlib.crc32(w.encode()) % width] += 1
    return v / max(np.linalg.norm(v), 1e-12)


def semantic(text: str, size: int = MOST, embed: Callable[[str], np.ndarray] = hashed_vector, mode: str = "percentile", amount: float = 95.0, around: int = 1, fewest: int = 3) -> list[Span]:
    """Sentences are joined until the vectors of neighbouring windows are far apart."""
    own = sentences(text)
    if len(own) < fewest:
        return [Span(0, len(text))]
    v = np.stack([embed(text[own[max(0, i - around)][0] : own[min(len(own) - 1, i + around)][1]]) for i in range(len(own))])
    far = breakpoints(1 - (v[1:] * v[:-1]).sum(1), mode, amount)
    edges = [0, *[own[i + 1][0] for i in np.flatnonzero(far)], len(text)]
    return cut_to([Span(a, b) for a, b in zip(edges, edges[1:], strict=False)], text, size, size)


STRATEGIES: dict[str, Callable[..., list[Span]]] = {
    "recursive": recursive, "token": by_tokens, "markdown": markdown, "code": code, "semantic": semantic,
    "sentence": lambda text: [Span(a, b) for a, b in sentences(text)],
}


def spans_of(text: str, strategy: str = "recursive", overlap: int = OVERLAP, least: int = LEAST, most: int = MOST, **options) -> list[Span]:
    """The spans of a text by a strategy, after the shared rules; an unknown strategy is the recursive one."""
    out = trimmed(STRATEGIES.get(strategy, recursive)(text, **options), text)
    if strategy not in ("token", "sentence"):
        out = overlapped(trimmed(cut_to(packed(out, least, most), text, most, most), text), text, overlap)
    return out


def split(documents: DataFrame, strategy: str = "recursive", **options) -> DataFrame:
    """documents(id, text, ...) -> chunks(chunk_id, document_id, chunk_index, start_char, end_char, content, heading).

    Null, empty and blank texts give no chunk; documents that come twice are split twice; offsets are exact.
    """

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s.start, "end": s.end, "heading": s.group} for s in spans_of(t, strategy, **options)] if t else [] for t in texts])

    spans = F.pandas_udf(run, "array<struct<start: int, end: int, heading: string>>")
    cut = documents.select(F.col("id").alias("document_id"), "text", F.posexplode(spans("text")).alias("chunk_index", "s"))
    content = F.expr("substring(text, s.start + 1, s.end - s.start)")
    return cut.select(chunk_key(F.col("document_id"), F.col("chunk_index"), content).alias("chunk_id"), "document_id", "chunk_index", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), content.alias("content"), F.col("s.heading").alias("heading"))


def sentence_windows(documents: DataFrame, around: int = 3) -> DataFrame:
    """documents(id, text) -> a chunk for each sentence, with the `around` sentences on either side as `window`."""
    own = split(documents, "sentence")
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    first = F.min("start_char").over(w.rowsBetween(-around, around))
    last = F.max("end_char").over(w.rowsBetween(-around, around))
    spans = own.withColumn("from", first).withColumn("to", last)
    texts = documents.select(F.col("id").alias("document_id"), "text")
    return spans.join(texts, "document_id").withColumn("window", F.expr("substring(text, `from` + 1, `to` - `from`)")).drop("text", "from", "to")


def parents_and_children(documents: DataFrame, parent: int = PARENT, child: int = CHILD) -> DataFrame:
    """documents(id, text) -> chunks of both sizes; children carry the parent's chunk_id, and their offsets are those of the document."""
    large = split(documents, "recursive", size=parent, overlap=0, most=parent).withColumn("parent_id", F.lit(None).cast("string")).withColumn("chunk_level", F.lit(1))
    small = split(large.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), "recursive", size=child, overlap=0, least=0, most=child)
    at = large.select(F.col("chunk_id").alias("parent_id"), F.col("document_id").alias("_doc"), F.col("start_char").alias("_at"))
    small = small.withColumnRenamed("document_id", "parent_id").join(at, "parent_id")
    columns = ["chunk_id", "document_id", "chunk_index", "start_char", "end_char", "content", "heading", "parent_id", "chunk_level"]
    small = small.select("chunk_id", F.col("_doc").alias("document_id"), "chunk_index", (F.col("start_char") + F.col("_at")).alias("start_char"), (F.col("end_char") + F.col("_at")).alias("end_char"), "content", "heading", "parent_id", F.lit(0).alias("chunk_level"))
    return large.select(*columns).unionByName(small)


def expanded(scored: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """scored(qid, chunk_id, score), chunks(chunk_id, parent_id, content) -> the k best parents, each with its best child and its number of siblings.

    A chunk without a parent stands for itself; a parent that isn't in chunks leaves the child's own text.
    """
    child = scored.join(chunks.select("chunk_id", "parent_id", F.col("content").alias("own")), "chunk_id")
    unit = child.withColumn("unit", F.coalesce("parent_id", "chunk_id"))
    best = unit.groupBy("qid", "unit").agg(F.max_by(F.struct("chunk_id", "own"), F.struct("score", F.negative(F.xxhash64("chunk_id")))).alias("x"), F.max("score").alias("score"), (F.count("*") - 1).alias("siblings"))
    whole = chunks.select(F.col("chunk_id").alias("unit"), F.col("content").alias("parent_text"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "unit")) - 1).where(F.col("rank") < k)
    return ranked.join(whole, "unit", "left").select("qid", "unit", F.col("x.chunk_id").alias("chunk_id"), "score", "rank", "siblings", F.coalesce("parent_text", "x.own").alias("text"))


def containing_spans(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """For each token window the span that it covers most; ties go to the one whose middle is nearer. -1 without spans."""
    starts, out = [a for a, _ in spans], []
    for a, b in tokens:
        lo = max(0, bisect.bisect_right(starts, a) - 1)
        near = range(lo, max(lo + 1, bisect.bisect_left(starts, b))) if spans else ()
        out.append(max(near, key=lambda i: (min(b, spans[i][1]) - max(a, spans[i][0]), -abs(a + b - sum(spans[i])), -i), default=-1))
    return out


"""Checks of answers before they go out, derived units of chunks, token matrices, and results of statements as evidence."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import approximate_tokens, tokens
from quillspan.operators.context import citations, coverage, folded_quote

#: The share of a quote that must stand in its source in one piece where it isn't there verbatim.
QUOTED = 0.92


def quote_present(quote: Column, source: Column) -> Column:
    """Whether the quote is in the source: after folding, verbatim or with one block of QUOTED of its length."""

    def run(quotes: pd.Series, sources: pd.Series) -> pd.Series:
        out = []
        for q, s in zip(quotes, sources, strict=True):
            if not q or s is None:
                out.append(False)
            elif q in s:
                out.append(True)
            else:
                out.append(difflib.SequenceMatcher(None, q, s, autojunk=False).find_longest_match().size >= QUOTED * len(q))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean")(folded_quote(quote), folded_quote(source))


# Traces of a prompt that an answer must not show.
LEAKS = r"(?i)</?untrusted_document\b[^>]*>|<\|[a-z_]+\|>|\[/?(?:INST|SYS|SYSTEM)\]|\byou are a helpful assistant\b|\bsystem prompt\s*:"


def validated_answers(answers: DataFrame) -> DataFrame:
    """answers(qid, answer, passages int) -> (qid, invalid array<int>, leaks, coverage, clean): numbers cited that no passage has, whether traces of a prompt show, the share of sentences that cite, and the answer without traces."""
    cited = citations(F.col("answer"))
    clean = F.trim(F.regexp_replace("answer", LEAKS, ""))
    return answers.select("qid", F.filter(cited, lambda n: ~n.between(1, F.col("passages"))).alias("invalid"), F.col("answer").rlike(LEAKS).alias("leaks"), F.round(coverage(F.col("answer")), 6).alias("coverage"), clean.alias("clean"))


class HeldBack:
    """A stream's filter: the last `width` characters wait, so that a trace of a prompt is seen whole before it goes out."""

    def __init__(self, width: int = 96):
        self.width, self.held, self.pattern = width, "", re.compile(LEAKS)

    def push(self, delta: str) -> str:
        self.held = self.pattern.sub("", self.held + delta)
        cut = max(0, len(self.held) - self.width)
        out, self.held = self.held[:cut], self.held[cut:]
        return out

    def end(self) -> str:
        out, self.held = self.pattern.sub("", self.held), ""
        return out


# Units made from chunks


def propositions(made: DataFrame, least: int = 3, most: int = 12) -> DataFrame:
    """made(chunk_id, place, proposition) -> those of at least `least` words, each once after folding, the first `most` of a chunk."""
    words = F.size(tokens(F.col("proposition")))
    some = made.where(words >= least).withColumn("_k", F.regexp_replace(F.regexp_replace(folded_quote(F.col("proposition")), r"[^\p{L}\p{N} ]", ""), r"^ +| +$", ""))
    first = some.withColumn("_r", F.row_number().over(Window.partitionBy("chunk_id", "_k").orderBy("place"))).where("_r = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("place")) - 1).where(F.col("n") < most).drop("_r", "_k")


def verbatim_span(excerpt: Column, source: Column) -> Column:
    """struct<start, end> of the excerpt in the source, found with white space and case folded and mapped back; null if it isn't there."""

    def run(excerpts: pd.Series, sources: pd.Series) -> pd.DataFrame:
        out = []
        for e, s in zip(excerpts, sources, strict=True):
            parts = [re.escape(w) for w in (e or "").split()]
            m = re.search(r"\s+".join(parts), s or "", re.I) if parts else None
            out.append((m.start(), m.end()) if m else (None, None))
        return pd.DataFrame(out, columns=["start", "end"]).astype("Int32")

    span = F.pandas_udf(run, "start int, end int")(excerpt, source)
    return F.when(span["start"].isNotNull(), span)


def document_windows(length: int, size: int, share: float = 0.25) -> list[tuple[int, int]]:
    """Windows of a document's tokens that overlap by a share of their size."""
    step = max(1, int(size * (1 - share)))
    return [(i, min(i + size, length)) for i in range(0, max(length, 1), step) if i == 0 or i + int(size * share) < length] if length else []


def embedding_strategy(late_supported: bool, contextual: bool, budget_left: bool) -> str:
    """late where token vectors are to be had, contextual where a model may be asked, early else."""
    return "late" if late_supported else "contextual" if contextual and budget_left else "early"


# Token matrices


def pooled(tokens_: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens(doc, tok, v), spans(doc, span, first, last) -> (doc, span, v): the mean of the token vectors of each span, last included."""
    inside = spans.join(tokens_, "doc").where(F.col("tok").between(F.col("first"), F.col("last")))
    flat = inside.select("doc", "span", F.posexplode("v").alias("i", "x")).groupBy("doc", "span", "i").agg(F.avg("x").alias("x"))
    return flat.groupBy("doc", "span").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("a")).select("doc", "span", F.transform("a", lambda y: y["x"]).alias("v"))


def pruned_tokens(tokens_: DataFrame, most: int = 192, spread: float = 1e-3) -> DataFrame:
    """tokens(doc, tok, v): the `most` token vectors of each document that say most: the longest ones, or where all are of one length those farthest from their mean."""
    kind = ", ".join(f"`{c}` {t}" for c, t in tokens_.dtypes)

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) <= most:
            return f
        x = np.stack(f["v"].to_numpy()).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        weight = norm if np.ptp(norm) > spread else np.linalg.norm(x - x.mean(0), axis=1)
        return f.iloc[np.sort(np.lexsort((f["tok"].to_numpy(), -np.round(weight, 12)))[:most])]

    return tokens_.groupBy("doc").applyInPandas(keep, kind)


def storage(docs: int, tokens_each: int, width: int, bytes_each: int = 4) -> int:
    """Bytes of the token matrices of so many documents."""
    return docs * tokens_each * width * bytes_each


# Results of statements as evidence


def result_chunk(result: DataFrame, question: str, statement: str, most: int = 40) -> DataFrame:
    """The rows of a guarded statement as one passage: a table in Markdown of the first `most` rows in the result's order, and how many more there are.

    A passage has to be short: the rest is counted, never shown. One row of one column is said as a fact.
    """
    rows = result.limit(most + 1).collect()
    more = result.count() - most if len(rows) > most else 0
    names = result.columns
    if len(rows) == 1 and len(names) == 1:
        text = f"{names[0]}: {rows[0][0]}"
    else:
        line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
        text = "\n".join([line(names), line("---" for _ in names), *[line(r) for r in rows[:most]], *([f"({more} more rows)"] if more > 0 else [])])
    content = f"Question: {question}\nQuery: {statement}\n\n{text}"
    return result.sparkSession.createDataFrame([(content, 1.0, "relational")], "content string, score double, source string").withColumn("tokens", approximate_tokens(F.col("content")))


# What a graph query may not contain.
CYPHER_WRITES = r"(?i)\b(CREATE|MERGE|DELETE|DETACH|SET|REMOVE|DROP|LOAD\s+CSV|FOREACH|GRANT|DENY|REVOKE|ALTER|START|STOP|TERMINATE|USE|SHOW)\b"


def cypher_verdict(statement: Column, hops: int = 4) -> Column:
    """Why a graph query is refused: writes, calls, several, unbounded, too_far, no_return; null where it may run. Strings and comments don't count."""
    bare = F.regexp_replace(F.regexp_replace(statement, r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|`[^`]*`", "''"), r"//[^\n]*|/\*[\s\S]*?\*/", " ")
    far = F.array_max(F.transform(F.regexp_extract_all(bare, F.lit(r"\*\s*\d*\s*\.\.\s*(\d+)|\*\s*(\d+)\s*[\]{ ]"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0))))
    return (
        F.when(bare.rlike(CYPHER_WRITES), "writes").when(bare.rlike(r"(?i)\bCALL\b"), "calls").when(bare.rlike(r";\s*\S"), "several")
        .when(bare.rlike(r"\*\s*(?:\d+\s*)?(?:\.\.)?\s*\]"), "unbounded").when(far > hops, "too_far").when(~bare.rlike(r"(?i)\bRETURN\b"), "no_return")
    )


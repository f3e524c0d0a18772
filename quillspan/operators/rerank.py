"""Reordering and compressing fetched lists: permutations from noisy output, windows, and what of each passage is kept."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import approximate_tokens, cosine, tokens
from quillspan.operators.context import sentences_of


def sliding_windows(total: int, window: int, step: int) -> list[tuple[int, int]]:
    """Windows from the end of a list to its front; the last begins at 0."""
    out, end = [], total
    while end > 0:
        out.append((max(0, end - window), end))
        if end <= window:
            break
        end -= step
    return out


def repaired(raw: Column, size: Column) -> Column:
    """A permutation of 0..size-1 from text such as "[2] > [1] > 7": 1-based (0-based where a 0 occurs), repeats and numbers out of range left out, missing ones appended in order."""

    def run(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for t, n in zip(texts, sizes, strict=True):
            said = [int(x) for x in re.findall(r"\d+", t or "")]
            base = 0 if 0 in said else 1
            kept = [x for x in dict.fromkeys(v - base for v in said) if 0 <= x < n]
            out.append(kept + [i for i in range(int(n)) if i not in set(kept)])
        return pd.Series(out)

    return F.pandas_udf(run, "array<int>")(raw, size)


def reordered(scored: DataFrame, orders: DataFrame) -> DataFrame:
    """scored(qid, chunk_id, rank), orders(qid, permutation array<int>) -> rank by the permutation, score 1 - rank / total; what lies behind the permutation stays behind in its order."""
    places = orders.select("qid", F.posexplode("permutation").alias("_new", "rank"))
    both = scored.join(places, ["qid", "rank"], "left")
    w = Window.partitionBy("qid").orderBy(F.col("_new").asc_nulls_last(), "rank", "chunk_id")
    out = both.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("qid")))
    return out.drop("_new", "rank", "score").select("*", F.col("_at").alias("rank"), (1 - F.col("_at") / F.col("_n")).alias("score")).drop("_at", "_n")


def rescored(scored: DataFrame, scores: DataFrame, window: int) -> DataFrame:
    """scored(qid, chunk_id, rank), scores(qid, chunk_id, model_score) -> the first `window` ranked by the model's score, the rest behind them as before.

    A question that any of its first rows has no model score for keeps its order.
    """
    both = scored.join(scores, ["qid", "chunk_id"], "left")
    within = F.col("rank") < window
    failed = F.max((within & F.col("model_score").isNull()).cast("int")).over(Window.partitionBy("qid")) == 1
    key = F.when(within & ~failed, -F.col("model_score"))
    w = Window.partitionBy("qid").orderBy((~within).cast("int"), key.asc_nulls_last(), "rank", "chunk_id")
    return both.withColumn("_f", failed).withColumn("_w", within).withColumn("new_rank", F.row_number().over(w) - 1).drop("_f", "_w", "model_score")


def overlap_score(question: Column, text: Column) -> Column:
    """A reranker without a model: the share of the question's words of more than two characters that the text has."""
    asked = F.array_distinct(F.filter(tokens(question), lambda t: F.length(t) > 2))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tokens(text))), F.size(asked)), F.lit(0.0)), 6)


def filter_by_vector(scored: DataFrame, ratio: float = 0.5, threshold: float | None = None) -> DataFrame:
    """scored(qid, chunk_id, rank, qv, v): the ceil(ratio n) rows nearest to the question's vector, or those at the threshold; one survives; order is kept."""
    near = scored.withColumn("similarity", F.round(cosine(F.col("qv"), F.col("v")), 6))
    q = Window.partitionBy("qid")
    placed = near.withColumn("_r", F.row_number().over(q.orderBy(F.desc("similarity"), "rank"))).withColumn("_n", F.count("*").over(q))
    keep = F.col("_r") <= F.ceil(F.lit(ratio) * F.col("_n") - 1e-9) if threshold is None else (F.col("similarity") >= threshold)
    return placed.where(keep | (F.col("_r") == 1)).drop("_r", "_n")


def compress_sentences(scored: DataFrame, ratio: float = 0.5) -> DataFrame:
    """scored(qid, chunk_id, question, text) -> (qid, chunk_id, text, tokens_before, tokens_after): of each passage the ceil(ratio n) sentences that share the most words with the question, in their order."""
    cut = scored.select("qid", "chunk_id", "question", approximate_tokens(F.col("text")).alias("tokens_before"), F.posexplode(sentences_of(F.col("text"))).alias("place", "s"))
    shared = F.size(F.array_intersect(tokens(F.col("question")), tokens(F.col("s"))))
    unit = Window.partitionBy("qid", "chunk_id")
    placed = cut.withColumn("_r", F.row_number().over(unit.orderBy(F.desc(shared), "place"))).withColumn("_n", F.count("*").over(unit))
    kept = placed.where(F.col("_r") <= F.ceil(F.lit(ratio) * F.col("_n") - 1e-9))
    out = kept.groupBy("qid", "chunk_id").agg(F.first("tokens_before").alias("tokens_before"), F.array_sort(F.collect_list(F.struct("place", F.trim("s").alias("s")))).alias("x"))
    text = F.array_join(F.transform("x", lambda y: y["s"]), " ")
    return out.select("qid", "chunk_id", text.alias("text"), "tokens_before", approximate_tokens(text).alias("tokens_after"))


def compression_report(compressed: DataFrame) -> DataFrame:
    """(qid, passages, tokens_before, tokens_after, ratio)."""
    by = compressed.groupBy("qid").agg(F.count("*").alias("passages"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return by.withColumn("ratio", F.round(F.coalesce(F.try_divide("tokens_after", "tokens_before"), F.lit(1.0)), 6))

"""Retrieval metrics, answer overlap, run reports and run comparison as aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import tokens

CUTS = (1, 3, 5, 10, 20, 50)


def retrieval_metrics(ranked: DataFrame, labels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """ranked(qid, doc, rank), labels(qid, doc, gain) -> (qid, k, recall, precision, hit_rate, ndcg, ap, rr).

    A document counts at its first place. Questions without labels have null metrics, since nothing can be recalled;
    questions with labels and no list have zeros. rr doesn't depend on k.
    """
    w = Window.partitionBy("qid", "doc").orderBy("rank")
    first = ranked.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "doc", "rank")
    place = first.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "doc")))
    good = labels.where("gain > 0").groupBy("qid", "doc").agg(F.max("gain").alias("gain"))
    order = good.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "doc")))
    cut = lambda c: F.explode(F.array(*[F.lit(k) for k in cuts])).alias(c)
    ideal = order.select("qid", "gain", "i", cut("k")).groupBy("qid", "k").agg(F.count("*").alias("n"), F.sum(F.when(F.col("i") <= F.col("k"), F.col("gain") / F.log2(F.col("i") + 1.0)).otherwise(0.0)).alias("ideal"))
    hits = place.join(good, ["qid", "doc"]).withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("place")))
    got = hits.select("qid", "place", "gain", "nth", cut("k")).where("place <= k").groupBy("qid", "k").agg(
        F.count("*").alias("hits"), F.sum(F.col("gain") / F.log2(F.col("place") + 1.0)).alias("dcg"), F.sum(F.col("nth") / F.col("place")).alias("precisions"))
    rr = hits.groupBy("qid").agg((1 / F.min("place")).alias("rr"))
    asked = ranked.select("qid").union(labels.select("qid")).distinct().select("qid", cut("k"))
    m = asked.join(ideal, ["qid", "k"], "left").join(got, ["qid", "k"], "left").join(rr, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    some = lambda c: F.round(F.when(F.col("n").isNotNull(), c), 6)
    return m.select(
        "qid", "k", some(zero("hits") / F.col("n")).alias("recall"), some(zero("hits") / F.col("k")).alias("precision"), some((zero("hits") > 0).cast("double")).alias("hit_rate"),
        some(zero("dcg") / F.col("ideal")).alias("ndcg"), some(zero("precisions") / F.least("n", "k")).alias("ap"), some(zero("rr")).alias("rr"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """pairs(key, answer, reference) -> (key, f1): of the multisets of tokens; 1 where both have none, 0 where one has none.

    Counts are compared per token, so long texts stay linear.
    """
    side = lambda c, n: pairs.select("key", F.explode(tokens(F.col(c))).alias("t")).groupBy("key", "t").agg(F.count("*").alias(n))
    both = side("answer", "a").join(side("reference", "b"), ["key", "t"]).groupBy("key").agg(F.sum(F.least("a", "b")).alias("shared"))
    sized = pairs.select("key", F.size(tokens(F.col("answer"))).alias("na"), F.size(tokens(F.col("reference"))).alias("nb"))
    out = sized.join(both, "key", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    f1 = F.when((F.col("na") == 0) & (F.col("nb") == 0), 1.0).otherwise(F.coalesce(F.try_divide(2.0 * F.col("shared"), F.col("na") + F.col("nb")), F.lit(0.0)))
    return out.select("key", F.round(f1, 6).alias("f1"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """pairs(key, answer, reference) -> (key, f1): of the longest common subsequence of tokens, over Arrow batches."""

    def lcs(a: list[str], b: list[str]) -> int:
        index: dict[str, list[int]] = {}
        for j, t in enumerate(b):
            index.setdefault(t, []).append(j)
        tails: list[int] = []
        for t in a:  # longest increasing run of match positions
            for j in reversed(index.get(t, ())):
                i = int(np.searchsorted(tails, j))
                tails[i : i + 1] = [j]
        return len(tails)

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if not len(x) and not len(y) else round(2.0 * lcs(list(x), list(y)) / (len(x) + len(y)), 6) for x, y in zip(a, b, strict=True)])

    score = F.pandas_udf(run, "double")
    return pairs.select("key", score(tokens(F.col("answer")), tokens(F.col("reference"))).alias("f1"))


def operational(calls: DataFrame) -> DataFrame:
    """calls(group, value, failed) -> rates, linear percentiles and sums per group."""
    return calls.groupBy("group").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("failure_rate"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"), F.round(F.sum("value"), 4).alias("total"))


def mean_metrics(by_question: DataFrame) -> DataFrame:
    """retrieval_metrics(...) -> (k, questions, recall, precision, hit_rate, ndcg, map, mrr): means over the questions that have labels."""
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return by_question.groupBy("k").agg(F.count("recall").alias("questions"), mean("recall", "recall"), mean("precision", "precision"), mean("hit_rate", "hit_rate"), mean("ndcg", "ndcg"), mean("ap", "map"), mean("rr", "mrr"))


def at_document_grain(ranked: DataFrame, owners: DataFrame) -> DataFrame:
    """ranked(qid, chunk_id, rank), owners(chunk_id, doc) -> (qid, doc, rank): documents in order of their first chunk."""
    first = ranked.join(owners, "chunk_id").groupBy("qid", "doc").agg(F.min("rank").alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("_at", "doc")) - 1).drop("_at")


def lexical_overlap(pairs: DataFrame) -> DataFrame:
    """pairs(key, answer, reference) -> (key, f1, rouge_l, overlap): overlap is the mean of the other two."""
    both = token_f1(pairs).join(rouge_l(pairs).withColumnRenamed("f1", "rouge_l"), "key")
    return both.withColumn("overlap", F.round((F.col("f1") + F.col("rouge_l")) / 2, 6))


def answer_correctness(pairs: DataFrame) -> DataFrame:
    """pairs(key, answer, reference, similarity) -> (key, correctness): three quarters of the token F1 and a quarter of the similarity of meaning."""
    return token_f1(pairs).join(pairs.select("key", "similarity"), "key").select("key", F.round(0.75 * F.col("f1") + 0.25 * F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0))), 6).alias("correctness"))


def supported_share(verdicts: DataFrame) -> DataFrame:
    """verdicts(qid, claim, supported) -> (qid, share): of an answer's claims those that are supported; null without claims."""
    return verdicts.groupBy("qid").agg(F.round(F.try_divide(F.count_if("supported").cast("double"), F.count("supported")), 6).alias("share"))


def context_precision(used: DataFrame) -> DataFrame:
    """used(qid, rank, useful) -> (qid, share, precision): the share of useful passages, and their precision weighted by rank."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = used.withColumn("_good", F.count_if("useful").over(w)).withColumn("_n", F.count("*").over(w))
    by = upto.groupBy("qid").agg(F.count_if("useful").alias("good"), F.count("*").alias("n"), F.sum(F.when(F.col("useful"), F.col("_good") / F.col("_n")).otherwise(0.0)).alias("s"))
    return by.select("qid", F.round(F.col("good") / F.col("n"), 6).alias("share"), F.round(F.coalesce(F.try_divide("s", "good"), F.lit(0.0)), 6).alias("precision"))


def answer_relevance(reverse: DataFrame) -> DataFrame:
    """reverse(qid, v, back): the question's vector and that of a question made from the answer -> (qid, relevance), the mean cosine."""
    from quillspan.functions.columns import cosine

    return reverse.groupBy("qid").agg(F.round(F.avg(cosine(F.col("v"), F.col("back"))), 6).alias("relevance"))


def dataset_stats(cases: DataFrame) -> DataFrame:
    """cases(question, expected_answer, expected_chunk_ids, metadata) -> one row: how many there are, have an answer, have labels, are unanswerable."""
    unanswerable = F.coalesce(F.lower(F.try_element_at("metadata", F.lit("answerable"))) == "false", F.lit(False))
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(F.length(F.regexp_replace(F.coalesce("expected_answer", F.lit("")), r"[\s\u00a0]+", "")) > 0).alias("with_answer"), F.count_if(F.size(F.coalesce("expected_chunk_ids", F.array().cast("array<string>"))) > 0).alias("with_labels"),
        F.count_if(unanswerable).alias("unanswerable"), F.countDistinct("question").alias("questions"))


def sliced(cases: DataFrame, axes: Mapping[str, str]) -> DataFrame:
    """The cases whose metadata has these values; of a value with commas one part is enough."""
    out = cases
    for axis, value in axes.items():
        parts = F.transform(F.split(F.coalesce(F.try_element_at("metadata", F.lit(axis)), F.lit("")), ","), lambda x: F.trim(x))
        out = out.where(F.array_contains(parts, value))
    return out


def series(results: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """results(key, one column a metric) -> (metric, key, value), the form that runs are compared in; null values have no row."""
    return results.unpivot(key, metrics, "metric", "value").where("value is not null").select("metric", F.col(key).alias("key"), F.col("value").cast("double").alias("value"))


def sampled(cases: DataFrame, n: int, seed: int = 17, key: str = "id") -> DataFrame:
    """n rows without replacement, the same for the same seed: those with the smallest seeded hashes of their key."""
    return cases.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def extended(cases: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """The cases and those of `more` whose key is new; of several with one key the first question in order."""
    new = more.join(cases.select(key), key, "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("question"))).where("_r = 1").drop("_r")
    return cases.unionByName(new, allowMissingColumns=True)


def operational_costs(calls: DataFrame) -> DataFrame:
    """calls(model, stage, prompt_tokens, completion_tokens, cost, cached) -> sums per model and stage, with the share that came from a cache."""
    total = lambda c: F.sum(c).alias(c)
    return calls.groupBy("model", "stage").agg(F.count("*").alias("calls"), total("prompt_tokens"), total("completion_tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.avg(F.col("cached").cast("double")), 6).alias("cached_share"))


def lower_is_better(metric: Column) -> Column:
    return metric.rlike(r"(?i)latency|_ms\b|seconds|cost|tokens|error|fail|p50|p95|abstain|hallucinat|unsupported")


def paired_bootstrap(pairs: DataFrame, draws: int = 2000, seed: int = 17, confidence: float = 0.95) -> DataFrame:
    """pairs(metric, key, a, b) -> (metric, n, delta, low, high, p_value) of b - a by resampling the keys.

    Draws are Poisson(1) weights hashed from (key, draw), the usual form of the bootstrap over distributed rows. Each task
    keeps a vector of `draws` sums per metric and only these are shuffled; rows are never multiplied. A single pair or equal
    differences have no spread: the interval is the difference itself, with a p of 1 where it is 0 and of 0 where not.
    """
    d = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("metric", F.xxhash64("key", F.lit(seed)).alias("h"), (F.col("b") - F.col("a")).cast("double").alias("d"))
    bounds = np.cumsum([np.exp(-1.0) / np.prod(range(1, i + 1)) for i in range(9)])
    mix = np.uint64(0xD6E8FEB86659FD93)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        number = np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for f in frames:
            for metric, own in f.groupby("metric", dropna=False):
                acc = held.setdefault(metric, [np.zeros(draws), np.zeros(draws)])
                for i in range(0, len(own), 1024):
                    x = (own["h"].to_numpy()[i : i + 1024].view(np.uint64)[:, None] ^ number[None]) * mix
                    x = (x ^ (x >> np.uint64(31))) * mix
                    w = np.searchsorted(bounds, ((x ^ (x >> np.uint64(29))) >> np.uint64(11)) / float(1 << 53), side="right")
                    acc[0] += w.T @ own["d"].to_numpy()[i : i + 1024]
                    acc[1] += w.sum(0)
        for metric, (s, w) in held.items():
            yield pd.DataFrame({"metric": metric, "draw": np.arange(draws), "s": s, "w": w})

    drawn = d.mapInPandas(sums, "metric string, draw int, s double, w double")
    means = drawn.groupBy("metric", "draw").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m")).where("m is not null")
    tail = (1 - confidence) / 2
    ends = means.groupBy("metric").agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("m") <= 0).cast("double")), F.avg((F.col("m") >= 0).cast("double")))).alias("p"))
    by = d.groupBy("metric").agg(F.count("*").alias("n"), F.avg("d").alias("delta"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("_s")).join(ends, "metric", "left")
    flat = F.col("_s") <= 1e-12
    pick = lambda c: F.when(flat, F.col("delta")).otherwise(F.col(c)).alias(c)
    return by.select("metric", "n", "delta", pick("low"), pick("high"), F.when(flat, (F.abs("delta") <= 1e-12).cast("double")).otherwise(F.col("p")).alias("p_value"))


def compare_runs(baseline: DataFrame, candidate: DataFrame, draws: int = 2000) -> DataFrame:
    """Two runs (metric, key, value) -> the bootstrap of each metric that both have, and a verdict: better, worse or inconclusive, by the metric's direction."""
    both = baseline.select("metric", "key", F.col("value").alias("a")).join(candidate.select("metric", "key", F.col("value").alias("b")), ["metric", "key"])
    by = paired_bootstrap(both, draws)
    sure = (F.col("low") > 0) | (F.col("high") < 0)
    up = F.col("delta") > 0
    return by.withColumn("lower_is_better", lower_is_better(F.col("metric"))).withColumn("verdict", F.when(~sure, "inconclusive").when(up != F.col("lower_is_better"), "better").otherwise("worse"))

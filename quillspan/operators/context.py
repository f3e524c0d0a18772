"""Context for an answer: budgets, which passages fit, citations, and checks of what was answered."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.columns import approximate_tokens, tokens

#: Share of a model's window that may be used, and up to which overrun passages are cut instead of summarized.
USABLE, CUT_UP_TO = 0.95, 1.6
#: Shares of the stores in a window.
SHARES = {"vector": 0.55, "relational": 0.20, "graph": 0.10, "web": 0.10, "memory": 0.05}
_MARK = r"\[(\d+(?:\s*,\s*\d+)*)\]"


# Budgets


def token_budget(window: int, reserved: int) -> int:
    """Tokens that passages may take of a window."""
    return max(0, int(window * USABLE) - reserved)


def store_budgets(budget: int, shares: Mapping[str, float] = SHARES) -> dict[str, int]:
    """What each store is granted; shares are scaled to sum up to 1."""
    total = sum(v for v in shares.values() if v > 0)
    return {k: int(budget * v / total) for k, v in shares.items() if v > 0} if total else {}


def strategy(tokens_asked: Column, budget: int) -> Column:
    """fit, truncate or summarize, by how far the passages exceed the budget."""
    return F.when(tokens_asked <= budget, "fit").when(tokens_asked <= CUT_UP_TO * budget, "truncate").otherwise("summarize")


def first_tokens(text: Column, most: int) -> Column:
    """A prefix of so many approximate tokens."""
    return F.substring(text, 1, 4 * most)


def budget_prefix(scored: DataFrame, budget: int) -> DataFrame:
    """scored(qid, chunk_id, rank, text): the longest prefix by rank whose approximate tokens fit; the first always stays."""
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = scored.withColumn("tokens", approximate_tokens(F.col("text"))).withColumn("upto", F.sum("tokens").over(w))
    return upto.where((F.col("upto") <= budget) | (F.col("rank") == 0))


def pack(scored: DataFrame, budget: int, shares: Mapping[str, float] | None = None, overhead: int = 0) -> DataFrame:
    """scored(qid, chunk_id, rank, score, text, store) -> the rows that fit, with tokens and clipped.

    The first by rank is always taken, cut if it alone is too long. Of the rest, those of most score per token come first:
    with `shares` each store that has candidates first fills its own part of what is left, then all compete. `overhead` is
    added to each passage's tokens. Scores under 0 are shifted to start at 0. A question's rows are a fetched list.
    """

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["rank", "chunk_id"], ignore_index=True)
        cost = (f["tokens"] + overhead).tolist()
        room, first = budget, min(cost[0], budget)
        taken, clipped = {0}, cost[0] > budget
        room -= first
        shift = max(0.0, -f["score"].min())
        density = [(-((s + shift) / max(c, 1)), i) for i, (s, c) in enumerate(zip(f["score"], cost, strict=True)) if i]
        order = [i for _, i in sorted(density)]
        live = {s: shares[s] for s in {f["store"].iloc[i] for i in order} if shares.get(s, 0) > 0} if shares else {}
        parts = {s: int(room * v / sum(live.values())) for s, v in sorted(live.items(), key=lambda x: (-x[1], x[0]))}
        for store, part in [*parts.items(), (None, room)]:
            spent = 0
            for i in order:
                if i not in taken and (store is None or f["store"].iloc[i] == store) and cost[i] <= room and (store is None or spent + cost[i] <= part):
                    taken.add(i)
                    room -= cost[i]
                    spent += cost[i]
        out = f.iloc[sorted(taken)].copy()
        out["clipped"] = [clipped and i == 0 for i in sorted(taken)]
        if clipped:
            out.iloc[0, out.columns.get_loc("text")] = (f["text"].iloc[0] or "")[: 4 * max(budget - overhead, 0)]
            out.iloc[0, out.columns.get_loc("tokens")] = max(budget - overhead, 0)
        return out

    kind = dict(scored.dtypes)
    ready = scored.select("qid", "chunk_id", "rank", "score", "text", "store", approximate_tokens(F.col("text")).alias("tokens"))
    return ready.groupBy("qid").applyInPandas(fill, f"qid {kind['qid']}, chunk_id {kind['chunk_id']}, rank int, score double, text string, store string, tokens int, clipped boolean")


def windows_by_rank(scored: DataFrame, budget: int) -> DataFrame:
    """scored(qid, chunk_id, rank, tokens) -> group: passages in order of rank, a new group when the next one doesn't fit."""

    def fill(f: pd.DataFrame) -> pd.DataFrame:
        f, at, used, out = f.sort_values("rank", ignore_index=True), 0, 0, []
        for n in f["tokens"]:
            if used and used + n > budget:
                at, used = at + 1, 0
            used += n
            out.append(at)
        return f.assign(group=out)

    return scored.groupBy("qid").applyInPandas(fill, ", ".join(f"`{c}` {t}" for c, t in scored.dtypes) + ", group int")


# Citations


def citations(text: Column) -> Column:
    """The numbers cited as [1] or [1, 3], in order of appearance, each once."""
    marks = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(marks, lambda m: F.transform(F.split(m, r"\s*,\s*"), lambda x: x.cast("int")))))


def sentences_of(text: Column) -> Column:
    """Sentences by stop and white space, without empty ones."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?][\"'”’)\]]*(?:\s*\[\d+(?:\s*,\s*\d+)*\])*)\s+", "$1\u001e"), "\u001e"), lambda x: F.length(F.trim(x)) > 0)


def claims(answers: DataFrame) -> DataFrame:
    """answers(qid, answer) -> (qid, place, claim, cited): each sentence without its marks, and the numbers that it cites."""
    said = answers.select("qid", F.posexplode(sentences_of(F.col("answer"))).alias("place", "sentence"))
    return said.select("qid", "place", F.trim(F.regexp_replace(F.regexp_replace("sentence", r"\s*" + _MARK, ""), r"\s+", " ")).alias("claim"), citations(F.col("sentence")).alias("cited"))


def coverage(answer: Column, least: int = 15) -> Column:
    """The share of sentences of more than `least` characters that cite something; 1 where there is none."""
    long = F.filter(sentences_of(answer), lambda s: F.length(F.trim(s)) > least)
    return F.when(F.size(long) > 0, F.size(F.filter(long, lambda s: s.rlike(_MARK))) / F.size(long)).otherwise(1.0)


def renumbered(answer: Column, keep: Column) -> Column:
    """Citations of the numbers in `keep` numbered from 1 in their order; the others are taken out."""

    def run(answers: pd.Series, keeps: pd.Series) -> pd.Series:
        import re

        out = []
        for a, k in zip(answers, keeps, strict=True):
            new = {int(n): i for i, n in enumerate(k if k is not None else [], 1)}
            fix = lambda m, new=new: f"[{', '.join(map(str, x))}]" if (x := [new[n] for n in map(int, m.group(1).split(",")) if n in new]) else ""
            out.append(None if a is None else re.sub(_MARK, fix, a))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(answer, keep)


def folded_quote(text: Column) -> Column:
    """Quotes and dashes made plain, white space single, lower case: what counts as the same wording."""
    plain = F.translate(text, "“”„«»‘’‚–— ", "\"\"\"\"\"'''-- ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def verbatim(excerpt: Column, source: Column) -> Column:
    """Whether the excerpt occurs in the source after both are folded; false for an empty one."""
    e = folded_quote(excerpt)
    return (F.length(e) > 0) & F.contains(folded_quote(source), e)


def quote_places(quotes: DataFrame, passages: DataFrame) -> DataFrame:
    """quotes(qid, quote_id, quote), passages(qid, rank, chunk_id, text) -> each quote with the first passage that has it, or null."""
    both = quotes.join(passages.withColumnRenamed("text", "_text"), "qid", "left").where(verbatim(F.col("quote"), F.col("_text")))
    first = both.groupBy("qid", "quote_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id"))
    return quotes.join(first, ["qid", "quote_id"], "left")


def best_sentences(claimed: DataFrame, sources: DataFrame) -> DataFrame:
    """claimed(claim_id, source_id, claim), sources(source_id, text) -> the sentence of the source that shares the most with the claim.

    Shared tokens weigh ln(1 + sentences / sentences with the token) within the source; ties go to the earlier sentence.
    """
    cut = sources.select("source_id", F.posexplode(sentences_of(F.col("text"))).alias("place", "sentence"))
    words = cut.select("source_id", "place", F.explode(F.array_distinct(tokens(F.col("sentence")))).alias("t"))
    n = cut.groupBy("source_id").agg(F.count("*").alias("n"))
    weight = words.groupBy("source_id", "t").agg(F.count("*").alias("df")).join(n, "source_id").select("source_id", "t", F.log1p(F.col("n") / F.col("df")).alias("w"))
    asked = claimed.select("claim_id", "source_id", F.explode(F.array_distinct(tokens(F.col("claim")))).alias("t"))
    scores = asked.join(weight, ["source_id", "t"]).join(words, ["source_id", "t"]).groupBy("claim_id", "source_id", "place").agg(F.round(F.sum("w"), 6).alias("score"))
    best = scores.groupBy("claim_id", "source_id").agg(F.max_by("place", F.struct("score", F.negative("place"))).alias("place"), F.max("score").alias("score"))
    return best.join(cut, ["source_id", "place"]).select("claim_id", "source_id", "place", "sentence", "score")


# Agreement and abstention


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text, without thousands' separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.regexp_replace(text, r"(?<=\d),(?=\d{3})", ""), F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.cast("double")))


def consistency(samples: DataFrame) -> DataFrame:
    """samples(qid, sample, answer) -> (qid, score, medoid, conflicts) of several answers to a question.

    Two answers agree by half the overlap coefficient of their words and half the Jaccard index of their numbers (the
    words alone if neither has a number); score is the mean over pairs, 1 for a single answer; medoid is the sample that
    agrees most with the others; conflicts are the magnitudes at which samples state different numbers.
    """
    own = samples.select("qid", "sample", F.array_distinct(tokens(F.col("answer"))).alias("w"), numbers_in(F.col("answer")).alias("x"))
    a, b = own.select("qid", F.col("sample").alias("a"), F.col("w").alias("wa"), F.col("x").alias("xa")), own.select("qid", F.col("sample").alias("b"), F.col("w").alias("wb"), F.col("x").alias("xb"))
    pairs = a.join(b, "qid").where("a <> b")  # a handful of samples a question
    words = F.coalesce(F.try_divide(F.size(F.array_intersect("wa", "wb")), F.least(F.size("wa"), F.size("wb"))), F.lit(0.0))
    union = F.size(F.array_union("xa", "xb"))
    agree = F.when(union == 0, words).otherwise(0.5 * words + 0.5 * F.size(F.array_intersect("xa", "xb")) / union)
    by = pairs.groupBy("qid", "a").agg(F.avg(agree).alias("mean"))
    total = by.groupBy("qid").agg(F.round(F.avg("mean"), 6).alias("score"), F.min_by("a", F.struct(-F.round("mean", 9), "a")).alias("medoid"))
    size = own.select("qid", "sample", F.explode("x").alias("n")).where("n <> 0").withColumn("magnitude", F.floor(F.log10("n")))
    several = size.groupBy("qid", "magnitude").agg(F.countDistinct("sample").alias("samples"), F.countDistinct("n").alias("values")).where("samples > 1 and values > 1")
    conflicts = several.groupBy("qid").agg(F.array_sort(F.collect_list("magnitude")).alias("conflicts"))
    out = samples.groupBy("qid").agg(F.min("sample").alias("_one")).join(total, "qid", "left").join(conflicts, "qid", "left")
    return out.select("qid", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("medoid", "_one").alias("medoid"), F.coalesce("conflicts", F.array().cast("array<bigint>")).alias("conflicts"))


def abstention_before(scored: DataFrame, questions: DataFrame, least: int = 1) -> DataFrame:
    """questions(qid), scored(qid, text) -> (qid, reason): insufficient_context, empty_context or null."""
    by = scored.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).alias("full"))
    out = questions.select("qid").distinct().join(by, "qid", "left").fillna(0)
    return out.select("qid", F.when(F.col("n") < least, "insufficient_context").when((F.col("n") > 0) & (F.col("full") == 0), "empty_context").alias("reason"))


def abstention_after(contradicted: Column, insufficient: Column, grounded: Column, invalid: Column, answer: Column) -> Column:
    """Why an answer is withheld, by the most decisive reason; null where it isn't."""
    return F.when(contradicted > 0, "contradicted").when(insufficient, "model_reported_insufficient").when(~grounded, "ungrounded").when(invalid > 0, "fabricated_citations").when(F.length(F.trim(F.coalesce(answer, F.lit("")))) == 0, "empty_answer")


def evidence_label(relevant: Column, graded: Column) -> Column:
    """INCORRECT without a relevant passage, CORRECT where all are, AMBIGUOUS else."""
    return F.when(relevant == 0, "INCORRECT").when(relevant == graded, "CORRECT").otherwise("AMBIGUOUS")


def evidence(refined: DataFrame, ungraded: DataFrame, web: DataFrame, label: Column, limit: int) -> DataFrame:
    """Passages (qid, chunk_id, rank) in order of where they come from, by the question's label: refined ones and the web's
    where that isn't CORRECT, refined and ungraded ones where it is; each once, cut to the limit."""
    tiers = refined.withColumn("tier", F.lit(0)).unionByName(ungraded.withColumn("tier", F.lit(1))).unionByName(web.withColumn("tier", F.lit(2)), allowMissingColumns=True)
    wanted = tiers.where(F.when(label == "CORRECT", F.col("tier") < 2).when(label == "INCORRECT", F.col("tier") == 2).otherwise(F.col("tier") != 1))
    once = wanted.withColumn("_r", F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy("tier", "rank"))).where("_r = 1").drop("_r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "rank", "chunk_id")) - 1).where(F.col("place") < limit)

"""Where a question goes: stores, pipelines, and the variants of a question that are searched."""

from __future__ import annotations

import difflib
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.columns import cosine

# What a question's wording says about the stores that it needs.
RELATIONAL = r"(?i)\b(how many|how much|count of|number of|total (?:of|number|amount|revenue|sales)|sum of|average|avg|median|mean of|top \d+|bottom \d+|highest|lowest|largest|smallest|rank(?:ed|ing)? by|group(?:ed)? by|per (?:month|quarter|year|customer|region)|between \d{4} and \d{4}|since \d{4}|year over year|month over month)\b"
GRAPH = r"(?i)\b(connected to|connection between|related to|relationship between|path (?:from|between)|how (?:is|are|does) \w+ (?:related|connected|linked)|who (?:works|worked) (?:with|for)|reports to|owned by|downstream of|upstream of|depends on|influenced by|shortest path|(?:two|three|multi)[- ]hop)\b"
NONE = r"(?i)^\s*(hi|hello|hey|thanks|thank you|good (?:morning|afternoon|evening)|who are you|what can you do|help)\b[\s!?.]*$"
THEMATIC = r"(?i)\b(overall|overview|main|themes?|summar(?:y|ize|ise)|trends?|across|in general|landscape|big picture)\b"


def route(question: Column) -> Column:
    """struct<stores, confidence, method> by rules; null where none applies, so that another router or the default decides."""
    stores = lambda *names: F.array(*[F.lit(n) for n in names])
    made = lambda s, c: F.struct(s.alias("stores"), F.lit(c).alias("confidence"), F.lit("rule").alias("method"))
    relational, graph = question.rlike(RELATIONAL), question.rlike(GRAPH)
    return (
        F.when(F.trim(question).rlike(NONE), made(stores("none"), 0.95)).when(relational & graph, made(stores("relational", "graph", "vector"), 0.7))
        .when(relational, made(stores("relational", "vector"), 0.85)).when(graph, made(stores("graph", "vector"), 0.85))
    )


def routed(question: Column, otherwise: Column | None = None) -> Column:
    """The rules' decision, else another router's, else the vector store at a confidence of 0.5."""
    default = F.struct(F.array(F.lit("vector")).alias("stores"), F.lit(0.5).alias("confidence"), F.lit("default").alias("method"))
    return F.coalesce(route(question), *([otherwise] if otherwise is not None else []), default)


def semantic_route(questions: DataFrame, exemplars: DataFrame, threshold: float) -> DataFrame:
    """questions(qid, v), exemplars(route, v) -> (qid, route, confidence): the route of the nearest exemplar, null under the threshold.

    Exemplars are a list that someone wrote, so they are sent to all executors.
    """
    near = questions.join(F.broadcast(exemplars.select("route", F.col("v").alias("_v")))).withColumn("s", F.round(cosine(F.col("v"), F.col("_v")), 6))
    best = near.groupBy("qid").agg(F.max_by("route", F.struct("s", F.negative(F.xxhash64("route")))).alias("route"), F.max("s").alias("confidence"))
    return best.withColumn("route", F.when(F.col("confidence") >= threshold, F.col("route")))


def graph_mode(question: Column) -> Column:
    """local for a question that names something, global for one about themes, drift for both, local for neither."""
    named = question.rlike(r"(?<=\s)\p{Lu}[\p{L}\p{N}]+|[\"“'][^\"”']+[\"”']")
    return F.when(named & question.rlike(THEMATIC), "drift").when(question.rlike(THEMATIC), "global").otherwise("local")


def variants(question: Column, raw: Column, most: int = 4, alike: float = 0.88, least: int = 8) -> Column:
    """Usable variants of a question: enumeration and quotes taken off, short ones and those too like the question or an earlier one left out."""

    def run(questions: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for q, items in zip(questions, lists, strict=True):
            kept: list[str] = []
            for v in items if items is not None else []:
                v = re.sub(r"^\s*(?:[-*•]|\(?\d+[.):]|[a-zA-Z][.)])\s+", "", v or "").strip().strip("\"'“”‘’").strip()
                if len(v) >= least and all(difflib.SequenceMatcher(None, v.lower(), (x or "").lower()).ratio() <= alike for x in [q, *kept]):
                    kept.append(v)
            out.append(kept[:most])
        return pd.Series(out)

    return F.pandas_udf(run, "array<string>")(question, raw)


# Pipelines: which one a configuration asks for, and the decisions on their edges. All are plain functions, so that a
# driver loop over DataFrames can take them; see plans.registry for the graphs.

#: Flags from the most demanding pipeline on; the first that is set names it.
LADDER = (("self_rag_enabled", "self_rag"), ("crag_enabled", "crag"), ("multihop_enabled", "multihop"), ("graph_enabled", "graphrag"), ("router_enabled", "adaptive"))


def select_pipeline(flags: Mapping[str, bool]) -> tuple[str, str]:
    """(pipeline, reason)."""
    on = [(f, p) for f, p in LADDER if flags.get(f)]
    if len(on) > 1 and flags.get("agentic_enabled"):
        return "agentic", "several of " + ", ".join(f for f, _ in on)
    return (on[0][1], on[0][0]) if on else ("naive", "no flag is set")


def select_stores(stores: list[str], configured: set[str], broken: set[str] = frozenset()) -> list[str]:
    """The stores of a route that are configured and whose breaker is closed, each once; the vector store if none is left."""
    out = [s for s in dict.fromkeys(stores) if s != "none" and s in configured and s not in broken]
    return out or (["vector"] if "none" not in stores and "vector" in configured - set(broken) else [])


def after_grade(label: str, retries: int, most: int, web: bool) -> str:
    """generate, refine, web, rewrite or abstain, by the label of the graded evidence."""
    if label == "CORRECT":
        return "generate"
    if label == "AMBIGUOUS":
        return "refine"
    return "web" if web else "rewrite" if retries < most else "abstain"


def after_judge(grounded: bool, useful: bool, tries: int, most: int) -> str:
    if grounded and useful:
        return "accept"
    return "retry" if tries <= most else "abstain" if not grounded else "accept"


def within_budget(calls: int, cost: float, most_calls: int | None, most_cost: float | None) -> bool:
    return (most_calls is None or calls < most_calls) and (most_cost is None or cost < most_cost)


def after_hop(sufficient: bool, follow_up: str, asked: list[str], hops: int, most: int) -> str:
    """collect where the evidence suffices, the budget is spent, or the follow-up was asked before; hop else."""
    known = {re.sub(r"\W+", " ", q).strip().lower() for q in asked}
    again = re.sub(r"\W+", " ", follow_up or "").strip().lower()
    return "collect" if sufficient or hops >= most or not again or again in known else "hop"

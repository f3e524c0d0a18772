"""Plug-ins by kind and name, the contracts that they keep, and pipelines as graphs of steps over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame

KINDS = ("retriever", "embedder", "reranker", "splitter", "loader", "compressor", "llm", "pipeline")
_PLUGINS: dict[tuple[str, str], Any] = {}


def register(kind: str, name: str) -> Callable[[Any], Any]:
    """Decorator: make a plug-in known under a kind and a name; a name can't be taken twice by different objects."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")

    def put(thing: Any) -> Any:
        if _PLUGINS.setdefault((kind, name), thing) is not thing:
            raise ValueError(f"{kind} {name} is taken")
        return thing

    return put


def resolve(kind: str, name: str) -> Any:
    try:
        return _PLUGINS[kind, name]
    except KeyError:
        known = sorted(n for k, n in _PLUGINS if k == kind)
        raise LookupError(f"no {kind} {name}; there are {known}") from None


@runtime_checkable
class Retriever(Protocol):
    def __call__(self, questions: DataFrame, k: int) -> DataFrame:
        """questions(qid, text, ...) -> (qid, chunk_id, score, rank)."""


@runtime_checkable
class Embedder(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame:
        """(..., text) -> (..., text, v array<float>)."""


@runtime_checkable
class Reranker(Protocol):
    def __call__(self, scored: DataFrame) -> DataFrame:
        """(qid, chunk_id, rank, question, text) -> (qid, chunk_id, model_score)."""


@runtime_checkable
class Splitter(Protocol):
    def __call__(self, documents: DataFrame) -> DataFrame:
        """(id, text) -> chunks."""


@runtime_checkable
class LLM(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame:
        """(id, prompt) -> (id, completion); whatever it calls, it calls it from the executors."""


# Pipelines: steps take and return a dictionary of DataFrames, and say which step comes next.

State = dict[str, Any]
Step = Callable[[State], State]


class Pipeline:
    """Named steps and edges. An edge is a step's name or a function of the state that gives one; None ends."""

    def __init__(self, start: str, steps: Mapping[str, Step], edges: Mapping[str, str | Callable[[State], str | None] | None]):
        unknown = {e for e in edges.values() if isinstance(e, str)} - set(steps)
        if start not in steps or unknown:
            raise ValueError(f"unknown steps: {sorted(unknown | ({start} - set(steps)))}")
        self.start, self.steps, self.edges = start, dict(steps), dict(edges)

    def run(self, state: State, most: int = 50) -> State:
        """The state after the last step; its `trace` lists the steps taken. `most` bounds loops."""
        at: str | None = self.start
        state = {**state, "trace": []}
        while at is not None:
            if len(state["trace"]) >= most:
                raise RuntimeError(f"more than {most} steps: {state['trace'][-5:]}")
            state = merged(state, self.steps[at](state))
            state["trace"] = [*state["trace"], at]
            edge = self.edges.get(at)
            at = edge(state) if callable(edge) else edge
        return state


#: Parts of the state that steps add to instead of replacing.
ADDED = ("candidates", "errors", "usage")


def merged(state: State, news: State) -> State:
    """The state with a step's results: tables of ADDED are appended, everything else is replaced."""
    out = dict(state)
    for k, v in news.items():
        out[k] = out[k].unionByName(v, allowMissingColumns=True) if k in ADDED and isinstance(out.get(k), DataFrame) else v
    return out


def standard(name: str, retrieve: Step, judge: Step | None = None, hop: Step | None = None, web: Step | None = None, finish: Step | None = None, most: int = 3) -> Pipeline:
    """One of the seven pipelines from its steps: naive, adaptive, crag, self_rag, graphrag, multihop, agentic.

    naive, adaptive and graphrag retrieve and finish; crag judges the evidence and goes to the web where the judge sets
    `label` to anything but CORRECT; self_rag judges the answer and retrieves again until `accepted`; multihop hops until
    `sufficient`; agentic hops and then judges. Loops end after `most` rounds.
    """
    done = finish or (lambda s: {})
    rounds = lambda s, step: s["trace"].count(step)
    if name in ("naive", "adaptive", "graphrag"):
        return Pipeline("retrieve", {"retrieve": retrieve, "finish": done}, {"retrieve": "finish", "finish": None})
    if name == "crag":
        steps = {"retrieve": retrieve, "judge": judge, "web": web or (lambda s: {}), "finish": done}
        return Pipeline("retrieve", steps, {"retrieve": "judge", "judge": lambda s: "finish" if s.get("label") == "CORRECT" else "web", "web": "finish", "finish": None})
    if name == "self_rag":
        steps = {"retrieve": retrieve, "judge": judge, "finish": done}
        return Pipeline("retrieve", steps, {"retrieve": "judge", "judge": lambda s: "finish" if s.get("accepted") or rounds(s, "judge") >= most else "retrieve", "finish": None})
    if name == "multihop":
        steps = {"retrieve": retrieve, "hop": hop, "finish": done}
        more = lambda s: "finish" if s.get("sufficient") or rounds(s, "hop") >= most else "hop"
        return Pipeline("retrieve", steps, {"retrieve": more, "hop": more, "finish": None})
    if name == "agentic":
        steps = {"retrieve": retrieve, "hop": hop, "judge": judge, "finish": done}
        more = lambda s: "judge" if s.get("sufficient") or rounds(s, "hop") >= most else "hop"
        return Pipeline("retrieve", steps, {"retrieve": more, "hop": more, "judge": lambda s: "finish" if s.get("accepted") or rounds(s, "judge") >= most else "retrieve", "finish": None})
    raise LookupError(f"no pipeline {name}")

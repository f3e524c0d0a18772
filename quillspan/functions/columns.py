"""Column builders that stay in the JVM: vectors, text, identity, scores and filters."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vectors


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null where either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """The vector over its norm, which counts as 1e-12 at least."""
    # The norm goes along as an array, since what stands inside of a lambda is computed for each element.
    return F.zip_with(a, F.array_repeat(F.greatest(norm(a), F.lit(1e-12)), F.size(a)), lambda x, n: x.cast("double") / n)


def quantize(a: Column) -> Column:
    """Signed 8-bit scalar quantization by the largest magnitude; zero vectors stay zero."""
    top = F.array_repeat(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.size(a))
    return F.zip_with(a, top, lambda x, t: F.coalesce(F.round(F.try_divide(x.cast("double") * 127, t)), F.lit(0.0)).cast("int"))


def blend(query: Column, hypothetical: Column, share: float = 0.3) -> Column:
    """Normalized weighted sum of a query vector and a normalized mean of hypothetical documents."""
    return l2_normalize(F.zip_with(query, l2_normalize(hypothetical), lambda x, y: x.cast("double") * share + y * (1 - share)))


# Text


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.array().cast("array<string>"))


def collapse(text: Column) -> Column:
    """Three or more line breaks as two, outer white space off."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def folded(text: Column) -> Column:
    """Lower case with runs of white space as one blank: what counts as the same content."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", ""))


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one; 0 for empty and null texts."""
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0).cast("int")


# Articles before and legal forms after a name that don't tell entities apart.
ARTICLES = ("the", "a", "an")
LEGAL_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "llp", "lp", "plc", "gmbh", "mbh", "ag", "kg", "kgaa", "sa", "sas", "sarl", "spa", "srl", "bv", "nv", "ab", "as", "asa", "oy", "oyj", "aps", "pty", "pte", "kk")


def entity_key(name: Column) -> Column:
    """The name by which entities are merged: no punctuation, articles or legal forms; a name of nothing else stays as it is."""
    s = F.lower(F.regexp_replace(name, "&", " and "))
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "), r"^ +| +$", "")
    s = F.regexp_replace(s, rf"^(?:(?:{'|'.join(ARTICLES)})(?: |$))+", "")
    s = F.regexp_replace(s, rf"(?:(?:^| )(?:{'|'.join(LEGAL_FORMS)}))+$", "")
    return F.when(s != "", s).otherwise(F.lower(F.trim(name)))


def unquoted(name: Column) -> Column:
    """A name without outer quotes and with single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s+", " "), r"^[\s\"'“”‘’`]+|[\s\"'“”‘’`]+$", ""))


def relation_type(name: Column) -> Column:
    """Upper snake case, or RELATED_TO where that is no valid type."""
    s = F.upper(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))
    return F.when(s.rlike(r"^[A-Z][A-Z0-9_]{0,63}$"), s).otherwise(F.lit("RELATED_TO"))


# Identity


#: Fixed value: the name space of stable ids.
NAMESPACE = uuid.UUID("6b2f4a5e-9c3d-4f1a-8b7e-2d5c9a1f3e40")


def _digest(parts: tuple, size: int) -> str:
    return hashlib.blake2b(b"".join(str(p).encode() + b"\x1f" for p in parts if p is not None), digest_size=size).hexdigest()


def content_hash(*parts: Column, size: int = 16) -> Column:
    """BLAKE2b of the parts as text, each followed by a unit separator; null parts are skipped."""

    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([_digest(row, size) for row in x.itertuples(index=False, name=None)], dtype=object)

    return F.pandas_udf(run, "string")(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]))


def stable_uuid(*parts: Column) -> Column:
    """A name-based (version 5) UUID of the parts' hash: the same for the same parts, everywhere."""

    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series([str(uuid.uuid5(NAMESPACE, _digest(row, 32))) for row in x.itertuples(index=False, name=None)], dtype=object)

    return F.pandas_udf(run, "string")(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]))


def chunk_key(document: Column, index: Column, content: Column, level: int = 0) -> Column:
    """A chunk's id: of its document, place, level and content, so that an edited chunk gets a new one."""
    return stable_uuid(F.lit("chunk"), document, index, F.lit(level), content)


def entity_id(name: Column, tenant: Column | None = None) -> Column:
    """An entity's id: of its name in lower case, within its tenant."""
    return stable_uuid(F.lit("entity"), F.coalesce(tenant, F.lit("")) if tenant is not None else F.lit(""), F.lower(F.trim(name)))


# Filters

_BOUNDS = {"gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


def condition(filters: Mapping[str, Any] | None, kinds: Mapping[str, str] | None = None) -> Column:
    """A filter dialect as one boolean column.

    {field: value} is equality, a list any-of, None absent or empty; {field: {op: value}} with eq, ne, in, nin, gt, gte,
    lt, lte, range [low, high] and contains (an array's element or a part of a text); $and, $or and $not nest. Several
    operators of a field hold together. Unknown operators raise when the plan is built. `kinds` tells array fields.
    """
    out = F.lit(True)
    for field, spec in (filters or {}).items():
        if field == "$and":
            for part in spec:
                out = out & condition(part, kinds)
        elif field == "$or":
            some = F.lit(False)
            for part in spec:
                some = some | condition(part, kinds)
            out = out & some
        elif field == "$not":
            out = out & ~F.coalesce(condition(spec, kinds), F.lit(False))
        else:
            out = out & _field(field, spec, (kinds or {}).get(field, ""))
    return out


def _field(name: str, spec: Any, kind: str) -> Column:
    c = F.col(name)
    if not isinstance(spec, Mapping):
        return _equal(c, spec, kind)
    out = F.lit(True)
    for op, value in spec.items():
        if op in _BOUNDS:
            out = out & _BOUNDS[op](c, value)
        elif op == "eq":
            out = out & _equal(c, value, kind)
        elif op == "ne":
            out = out & ~F.coalesce(_equal(c, value, kind), F.lit(False))
        elif op == "in":
            out = out & c.isin(list(value))
        elif op == "nin":
            out = out & ~F.coalesce(c.isin(list(value)), F.lit(False))
        elif op == "range":
            low, high = value
            out = out & (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)
        elif op == "contains":
            out = out & (F.array_contains(c, value) if kind == "array" else c.contains(value))
        else:
            raise ValueError(f"unknown filter operator: {op}")
    return out


def _equal(c: Column, value: Any, kind: str) -> Column:
    if value is None:
        empty = F.size(c) == 0 if kind == "array" else c.cast("string") == ""
        return c.isNull() | empty
    if isinstance(value, (list, tuple, set)):
        return c.isin(list(value))
    if isinstance(value, float):  # stored in single precision or double: both are the same value
        return c.between(value - 1e-9 * max(1.0, abs(value)), value + 1e-9 * max(1.0, abs(value)))
    return F.array_contains(c, value) if kind == "array" else c == value


#: Operators by kind of attribute that a parsed condition may use.
OPERATORS = {"string": {"eq", "ne", "in", "nin", "contains"}, "int": {"eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "range"}, "float": {"eq", "ne", "gt", "gte", "lt", "lte", "range"}, "bool": {"eq", "ne"}, "date": {"eq", "gt", "gte", "lt", "lte", "range"}}


def _coerced(value: Any, kind: str) -> Any:
    if isinstance(value, (list, tuple)):
        return [_coerced(v, kind) for v in value]
    text = str(value).strip()
    if kind == "int":
        return int(float(text.replace(",", "")))
    if kind == "float":
        return float(text.replace(",", ""))
    if kind == "bool":
        if text.lower() not in ("true", "yes", "1", "false", "no", "0"):
            raise ValueError(text)
        return text.lower() in ("true", "yes", "1")
    if kind == "date":
        from datetime import datetime

        return datetime(int(text), 1, 1) if text.isdigit() and len(text) == 4 else datetime.fromisoformat(text)
    return text


def parsed_conditions(conditions: list[tuple[str, str, Any]], attributes: Mapping[str, str], any_of: bool = False) -> dict[str, Any]:
    """(field, operator, value) triples of a parsed question -> a filter; unknown fields, operators and values that don't fit the kind are left out.

    Several conditions on one field are merged, so that bounds become one interval; `any_of` joins fields by or.
    """
    out: dict[str, dict[str, Any]] = {}
    for field, op, value in conditions:
        kind = attributes.get(field)
        if kind is None or op not in OPERATORS.get(kind, set()):
            continue
        try:
            value = _coerced(value if op not in ("in", "nin") or isinstance(value, (list, tuple)) else [value], kind)
        except ValueError:
            continue
        if op == "range" and (not isinstance(value, list) or len(value) != 2):
            continue
        out.setdefault(field, {})[op] = value
    return {"$or": [{f: spec} for f, spec in out.items()]} if any_of and len(out) > 1 else dict(out)


def tenant_scope(filters: Mapping[str, Any] | None, tenant: str | None, required: bool = True) -> dict[str, Any]:
    """The filters and the tenant's; a filter on another tenant raises, and so does a missing tenant where one is required."""
    own = dict(filters or {})
    if tenant is None:
        if required:
            raise PermissionError("a tenant is required")
        return own
    if own.get("tenant_id", tenant) != tenant:
        raise PermissionError("the filter names another tenant")
    return {"$and": [own, {"tenant_id": tenant}]} if own else {"tenant_id": tenant}

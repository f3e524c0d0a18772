"""Which tenant a request may see, and filters as SQL text with parameters."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def resolved_tenant(asked: str | None, principal: str | None, bindings: Mapping[str, str], required: bool = True) -> str | None:
    """The tenant that a principal is bound to, or the one asked for; another than the bound one, or none where one is required, raises."""
    bound = bindings.get(principal) if principal is not None else None
    if bound is not None and asked not in (None, bound):
        raise PermissionError(f"{principal} is bound to another tenant")
    tenant = bound if bound is not None else asked
    if tenant is None and required:
        raise PermissionError("a tenant is required")
    return tenant


def isolated(target: str, enforced: bool, policy: str) -> bool:
    """Whether a part that can't tell tenants apart (a graph, a foreign retriever, a generated query) may be used: always where isolation isn't enforced, with the policy "allow" where it is, else it raises ("reject") or is left out ("skip")."""
    if not enforced or policy == "allow":
        return True
    if policy == "skip":
        return False
    raise PermissionError(f"{target} can't be scoped to a tenant")


_SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def where_sql(filters: Mapping[str, Any] | None, tenant: str | None = None, columns: set[str] | None = None, metadata: str = "metadata") -> tuple[str, dict[str, Any]]:
    """A filter as SQL text with named parameters, for spark.sql(text, args): values never become part of the text.

    Fields that aren't among `columns` are keys of the metadata map. The operators are those of `condition`.
    """
    args: dict[str, Any] = {}

    def name(value: Any) -> str:
        args[f"p{len(args)}"] = value
        return f":p{len(args) - 1}"

    def field(f: str) -> str:
        if not f.replace("_", "").isalnum():
            raise ValueError(f"not a field: {f}")
        return f if columns is None or f in columns else f"try_element_at({metadata}, '{f}')"

    def part(spec: Mapping[str, Any]) -> str:
        out = []
        for key, value in spec.items():
            if key in ("$and", "$or"):
                out.append("(" + (" AND " if key == "$and" else " OR ").join(part(x) for x in value) + ")" if value else ("true" if key == "$and" else "false"))
            elif key == "$not":
                out.append(f"NOT coalesce({part(value)}, false)")
            else:
                for op, v in value.items() if isinstance(value, Mapping) else [("in" if isinstance(value, (list, tuple, set)) else "eq", value)]:
                    c = field(key)
                    if v is None and op in ("eq", "ne"):
                        out.append(f"({c} IS NULL OR CAST({c} AS STRING) = '')" if op == "eq" else f"NOT ({c} IS NULL OR CAST({c} AS STRING) = '')")
                    elif op in ("in", "nin"):
                        some = f"{c} IN ({', '.join(name(x) for x in v)})" if v else "false"
                        out.append(some if op == "in" else f"NOT coalesce({some}, false)")
                    elif op == "ne":
                        out.append(f"NOT coalesce({c} = {name(v)}, false)")
                    elif op == "range":
                        out.append(f"{c} BETWEEN {name(v[0])} AND {name(v[1])}")
                    elif op == "contains":
                        out.append(f"contains({c}, {name(v)})")
                    elif op in _SIGNS:
                        out.append(f"{c} {_SIGNS[op]} {name(v)}")
                    else:
                        raise ValueError(f"unknown filter operator: {op}")
        return "(" + " AND ".join(out) + ")" if out else "true"

    text = part(filters or {})
    return (f"{text} AND tenant_id = {name(tenant)}" if tenant is not None else text), args

"""Condition trees: one form for all spellings of rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

#: The leaf operators, and the words of the flat dialect for them.
OPERATORS = (">", ">=", "<", "<=", "==", "!=", "in", "not_in", "contains", "starts_with", "ends_with", "regex", "exists", "not_exists")
WORDS = {"eq": "==", "ne": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in", "contains": "contains"}
AGGREGATES = ("count", "sum", "min", "max", "avg")
#: Node types that plug-ins have registered.
CUSTOM: set[str] = set()
SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


class RuleError(ValueError):
    """A rule that cannot be compiled; path tells where."""

    def __init__(self, message: str, path: str = "$"):
        super().__init__(f"{path}: {message}")
        self.path = path


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = None

    def key(self) -> str:
        return json.dumps([self.field, self.op, self.value], sort_keys=True, default=str)


@dataclass(frozen=True)
class Group:
    op: str
    children: tuple = ()


@dataclass(frozen=True)
class NestedAccumulate:
    source: str
    field: str | None
    aggregate: str
    op: str
    value: Any
    where: Any = None


@dataclass(frozen=True)
class NestedSequence:
    source: str
    steps: tuple = ()


@dataclass(frozen=True)
class CrossFactCount:
    correlate_field: str


@dataclass(frozen=True)
class Accumulate:
    over: Any = None
    seconds: float | None = None
    group_by: tuple = ()
    aggregates: Any = None
    constraint: Any = None


@dataclass(frozen=True)
class Sequence:
    steps: tuple
    within: float
    correlate_on: tuple = ()


@dataclass(frozen=True)
class CrossFactJoin:
    left: Any
    right: Any
    join_on: tuple = ()
    match: str = "all"


@dataclass(frozen=True)
class Custom:
    """A node whose Column a plug-in makes."""

    kind: str
    spec: Any = field(default=None, hash=False)


def parse(node: Any, compat: bool = False, path: str = "$"):
    """A tree from a dict or its JSON text, in any dialect; None for an empty condition."""
    if isinstance(node, str):
        node = json.loads(node) if node.strip() else None
    if not node:
        return None
    if isinstance(node, (Leaf, Group, NestedAccumulate, NestedSequence, CrossFactCount, Accumulate, Sequence, CrossFactJoin, Custom)):
        return node
    if not isinstance(node, dict):
        raise RuleError("a condition is an object", path)
    kind = node.get("type") or ("group" if "children" in node else "condition")
    if kind == "group":
        children = node.get("children") or ()
        return Group(str(node.get("op", "AND")).upper(), tuple(x for i, c in enumerate(children) if (x := parse(c, compat, f"{path}.children[{i}]")) is not None))
    if kind == "condition":
        name = node.get("field") if node.get("field") is not None else node.get("fact")
        op = node.get("op", node.get("operator"))
        op = WORDS.get(op, op)
        if op not in OPERATORS:
            if compat:
                return None
            raise RuleError(f"unknown operator {op!r}", path)
        value = node.get("value")
        return Leaf(name, op, tuple(value) if isinstance(value, list) else value)
    if kind == "accumulate":
        if "source" in node:
            return NestedAccumulate(node["source"], node.get("field"), node.get("aggregate", "count"), node.get("op", ">="), node.get("value"), parse(node.get("where"), compat, f"{path}.where"))
        window = node.get("window") or {}
        seconds = window.get("duration_seconds", window["value"] * SECONDS[window.get("unit", "minutes")] if "value" in window else None)
        group = node.get("group_by") or ()
        aggregate = node.get("aggregate")
        over = node.get("over", node.get("source_event"))
        constraint = node.get("constraint")
        if "metric_op" in node:
            aggregate = {"op": node["metric_op"], "field": node.get("metric_field"), "as": "metric"}
            constraint = {"field": "metric", "op": ">=", "value": node.get("threshold")}
        return Accumulate(over, seconds, (group,) if isinstance(group, str) else tuple(group), aggregate, constraint)
    if kind == "sequence":
        steps = tuple(parse(s, compat, f"{path}.steps[{i}]") for i, s in enumerate(node.get("steps") or ()))
        if "source" in node:
            return NestedSequence(node["source"], steps)
        within = node.get("within_window_seconds", node.get("within"))
        if isinstance(within, dict):
            within = within["value"] * SECONDS[within.get("unit", "minutes")]
        return Sequence(steps, within if within is not None else 0, tuple(node.get("correlate_on") or ()))
    if kind == "cross_fact_join":
        if "left" in node:
            on = tuple((j["left_field"], j["right_field"]) for j in node.get("join_on", ()))
            return CrossFactJoin(parse(node["left"], compat, f"{path}.left"), parse(node["right"], compat, f"{path}.right"), on, node.get("match", "all"))
        return CrossFactCount(node.get("correlate_field"))
    if kind in CUSTOM:
        return Custom(kind, {k: v for k, v in node.items() if k != "type"})
    if compat:
        return None
    raise RuleError(f"unknown type {kind!r}", path)


def leaves(node) -> Iterator[Leaf]:
    """All leaves, under any groups."""
    if isinstance(node, Leaf):
        yield node
    for child in getattr(node, "children", ()):
        yield from leaves(child)


def fields(node) -> set[str]:
    out = {x.field for x in leaves(node)}
    for x in walk(node):
        out |= {v for k in ("correlate_field", "source") if (v := getattr(x, k, None))}
    return out


def walk(node) -> Iterator[Any]:
    if node is not None:
        yield node
        for child in getattr(node, "children", ()):
            yield from walk(child)


def canonical(node: Any) -> str:
    """JSON text that does not depend on the order of keys."""
    if isinstance(node, str):
        node = json.loads(node)
    return json.dumps(node, sort_keys=True, separators=(",", ":"), default=str)


def content_hash(node: Any) -> str:
    return hashlib.md5(canonical(node).encode(), usedforsecurity=False).hexdigest()


def render(node) -> str:
    """A tree as SQL-like text, all operators included."""
    if node is None:
        return "false"
    if isinstance(node, Group):
        if not node.children:
            return "true"
        if node.op == "NOT":
            return f"NOT ({render(node.children[0])})"
        return "(" + f" {node.op} ".join(map(render, node.children)) + ")"
    if isinstance(node, Leaf):
        lit = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
        name = f"`{node.field}`"
        if node.op in ("in", "not_in") and isinstance(node.value, tuple):
            return f"{name} {'IN' if node.op == 'in' else 'NOT IN'} ({', '.join(map(lit, node.value))})"
        form = {"==": "{} = {}", "!=": "{} <> {}", "in": "contains({1}, {0})", "not_in": "NOT contains({1}, {0})", "contains": "contains({}, {})", "starts_with": "startswith({}, {})", "ends_with": "endswith({}, {})", "regex": "{} RLIKE {}", "exists": "{} IS NOT NULL", "not_exists": "{} IS NULL"}.get(node.op, "{} " + node.op + " {}")
        return form.format(name, lit(node.value))
    return type(node).__name__


STATEFUL = {"accumulate", "sequence", "cross_fact_join"}


def lint(dsl: Any) -> tuple[list[dict], list[dict]]:
    """(errors, warnings) of stateful nodes, each with the JSON path: one family at the top level, two steps or facts at least."""
    errors, warnings = [], []
    dsl = json.loads(dsl) if isinstance(dsl, str) else dsl
    if not isinstance(dsl, dict):
        return [{"path": "$", "message": "a condition is an object"}], []
    top = [k for k in (*sorted(STATEFUL), "count_threshold") if k in dsl or dsl.get("type") == k]
    if len(top) > 1:
        errors.append({"path": "$", "message": f"only one stateful family is allowed, found {', '.join(top)}"})

    def visit(node: Any, path: str) -> None:
        if isinstance(node, dict):
            kind = node.get("type")
            if kind == "sequence":
                steps = node.get("steps")
                if not isinstance(steps, list) or len(steps) < 2:
                    errors.append({"path": f"{path}.steps", "message": "a sequence has two steps at least"})
                elif len({canonical(s) for s in steps}) == 1:
                    warnings.append({"path": f"{path}.steps", "message": "all steps are alike"})
            if kind == "cross_fact_join" and "correlate_field" not in node and "left" not in node:
                facts = node.get("facts")
                if not isinstance(facts, list) or len(facts) < 2:
                    errors.append({"path": f"{path}.facts", "message": "a cross-fact join has two facts at least"})
            for k, v in node.items():
                visit(v, f"{path}.{k}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                visit(v, f"{path}[{i}]")

    visit(dsl, "$")
    return errors, warnings

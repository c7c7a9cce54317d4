"""Events against rule sets: which rules match, in which order, and why."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_str
from ..plans import ir
from ..plans.compiler import Fields, Flags, compile_leaf, compile_tree, truth

#: Rules of one shape (field and operator, one number) from which on they become a table that is broadcast.
PARAMETER_RULES = 16
#: Rules in a broadcast parameter table at most (24 bytes each); more are matched in several joins.
PARAMETER_LIMIT = 100_000
ORDERED = {">", ">=", "<", "<="}


@dataclass(frozen=True)
class Rule:
    id: int
    name: str
    condition: Any
    action: str = ""
    priority: int = 0
    group: str | None = None
    enabled: bool = True
    evaluation_mode: str | None = "stateless"
    description: str | None = None
    metadata: dict = field(default_factory=dict, hash=False)

    def tree(self, compat: bool = False):
        return ir.parse(self.condition, compat)


def ordered(rules: Iterable[Rule]) -> list[Rule]:
    """By priority, highest first; ties by id."""
    return sorted(rules, key=lambda r: (-r.priority, r.id))


def active(rules: Iterable[Rule], group: str | None = None, ids: Iterable[int] | None = None) -> list[Rule]:
    """Enabled rules that are not stateful, of a group and among ids where those are given (an empty list of ids is all)."""
    wanted = set(ids or ())
    return [r for r in ordered(rules) if r.enabled and r.evaluation_mode != "stateful" and (group is None or r.group == group) and (not wanted or r.id in wanted)]


@dataclass
class Compiled:
    """Distinct leaves, each once, and every rule over them."""

    leaves: dict[str, ir.Leaf]
    rules: list[tuple[Rule, Any]]
    hash: str
    shared: int

    @property
    def stats(self) -> dict:
        return {"alpha_nodes": len(self.leaves), "rules": len(self.rules), "shared_conditions": self.shared, "rules_hash": self.hash}


_CACHE: OrderedDict[tuple, tuple[float, Compiled]] = OrderedDict()
#: Rule sets that are kept, and for how many seconds; those used last stay longest.
CACHED = 32
CACHE_SECONDS = 300.0


def compile_rules(rules: list[Rule], flags: Flags = Flags()) -> Compiled:
    """Parsed rules with shared leaves; kept by content for a while, or until invalidate()."""
    key = (ir.content_hash([[r.id, r.name, r.condition, r.action, r.priority, r.group] for r in rules]), flags)
    now = time.monotonic()
    if key not in _CACHE or _CACHE[key][0] < now:
        leaves: dict[str, ir.Leaf] = {}
        trees, seen = [], 0
        for r in rules:
            tree = r.tree(flags.compat)
            trees.append((r, tree))
            for leaf in ir.leaves(tree):
                seen += 1
                leaves.setdefault(leaf.key(), leaf)
        _CACHE[key] = (now + CACHE_SECONDS, Compiled(leaves, trees, key[0], seen - len(leaves)))
        while len(_CACHE) > CACHED:
            _CACHE.popitem(last=False)
    _CACHE.move_to_end(key)
    return _CACHE[key][1]


def invalidate(group: str | None = None) -> None:
    """Drop compiled rule sets: all, or those that hold a rule of a group."""
    for key in [k for k, (_, c) in _CACHE.items() if group is None or any(r.group == group for r, _ in c.rules)]:
        del _CACHE[key]


def _over_leaves(node, names: dict[str, str], fields: Fields, flags: Flags) -> Column:
    if isinstance(node, ir.Leaf):
        return F.col(names[node.key()])
    if isinstance(node, ir.Group) and node.children and node.op in ("AND", "OR", "NOT"):
        if node.op == "NOT":
            return ~truth(_over_leaves(node.children[0], names, fields, flags))
        out = None
        for c in node.children:
            one = _over_leaves(c, names, fields, flags)
            out = one if out is None else (out & one if node.op == "AND" else out | one)
        return out
    return compile_tree(node, fields, flags)


def _parameter_shape(tree) -> tuple | None:
    leaf = tree.children[0] if isinstance(tree, ir.Group) and tree.op in ("AND", "OR") and len(tree.children) == 1 else tree
    if isinstance(leaf, ir.Leaf) and leaf.op in ORDERED and isinstance(leaf.value, (int, float)) and not isinstance(leaf.value, bool) and leaf.value == leaf.value:
        return leaf.field, leaf.op, leaf.value
    return None


def match(events: DataFrame, rules: Iterable[Rule], key: str | list[str], flags: Flags = Flags(), strategy: str = "auto", explain: bool = False, execution_order: bool = True, keep: Iterable[str] = (), group: str | None = None, ids: Iterable[int] | None = None) -> DataFrame:
    """(key..., keep..., rule_id, rule_name, priority, action[, exec_order][, explanation]), a row for each match.

    group and ids choose among the rules as active() does. Many rules that compare one field with a number become a small table
    that is joined by broadcast (``params``): each event meets each threshold, of which it matches half on average, so the join
    does about as much as it returns. All others become one array of matches over shared leaves (``wide``), where the order of
    execution is the order in the array. Neither needs a shuffle, but an order of execution takes a window over the event's key
    wherever a parameter table is used.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rules = active(rules, group, ids)
    compiled = compile_rules(rules, flags)
    fields = Fields(events.schema)
    shapes: dict[tuple, list] = {}
    wide = []
    for r, tree in compiled.rules:
        shape = _parameter_shape(tree)
        found = shape and fields.get(shape[0])
        if strategy != "wide" and not explain and found and isinstance(found[1], T.NumericType):
            shapes.setdefault(shape[:2], []).append((r, shape[2]))
        else:
            wide.append((r, tree))
    for shape, own in list(shapes.items()):
        if strategy == "auto" and len(own) < PARAMETER_RULES:
            wide += [(r, r.tree(flags.compat)) for r, _ in own]
            del shapes[shape]
    carried = [*keys, *keep]
    parts = []
    if wide or not shapes:
        parts.append(_wide(events, wide, carried, fields, flags, explain, execution_order and not shapes))
    for (name, op), own in shapes.items():
        for a in range(0, len(own), PARAMETER_LIMIT):
            parts.append(_params(events, own[a : a + PARAMETER_LIMIT], carried, fields, name, op))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if execution_order and shapes:
        out = out.withColumn("exec_order", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("priority"), "rule_id")))
    return out


def _params(events: DataFrame, own: list, carried: list[str], fields: Fields, name: str, op: str) -> DataFrame:
    column, kind = fields.get(name)
    rows = [(r.id, r.name, r.priority, r.action, float(v)) for r, v in own]
    table = F.broadcast(events.sparkSession.createDataFrame(rows, "rule_id long, rule_name string, priority int, action string, threshold double"))
    left = events.select(*carried, column.cast("double").alias("__x"))
    x, t = F.col("__x"), F.col("threshold")
    test = {">": x > t, ">=": x >= t, "<": x < t, "<=": x <= t}[op]
    return left.where(x.isNotNull() & ~F.isnan(x)).join(table, test).select(*carried, "rule_id", "rule_name", "priority", "action")


def _wide(events: DataFrame, rules: list, carried: list[str], fields: Fields, flags: Flags, explain: bool, order: bool) -> DataFrame:
    rules = sorted(rules, key=lambda x: (-x[0].priority, x[0].id))
    leaves = {leaf.key(): leaf for _, tree in rules for leaf in ir.leaves(tree)}
    names = {k: f"__leaf{i}" for i, k in enumerate(leaves)}
    base = events.select("*", *[truth(compile_leaf(leaves[k], fields, flags)).alias(n) for k, n in names.items()]) if names else events
    hits = []
    for r, tree in rules:
        test = F.lit(False) if tree is None else truth(_over_leaves(tree, names, fields, flags))
        cells = [F.lit(r.id).cast("long").alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.priority).cast("int").alias("priority"), F.lit(r.action).alias("action")]
        if explain:
            cells.append(explanation(r, tree, fields, flags).alias("explanation"))
        hits.append(F.when(test, F.struct(*cells)))
    extra = ["explanation"] if explain else []
    form = "array<struct<rule_id:bigint,rule_name:string,priority:int,action:string" + (",explanation:string" if explain else "") + ">>"
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array()
    base = base.select(*carried, found.cast(form).alias("__hits"))
    if order:
        out = base.select(*carried, F.posexplode("__hits").alias("__pos", "h"))
        return out.select(*carried, "h.rule_id", "h.rule_name", "h.priority", "h.action", *[f"h.{e}" for e in extra], (F.col("__pos") + 1).alias("exec_order"))
    return base.select(*carried, F.explode("__hits").alias("h")).select(*carried, "h.rule_id", "h.rule_name", "h.priority", "h.action", *[f"h.{e}" for e in extra])


def _shown(value) -> str:
    return str(list(value)) if isinstance(value, tuple) else str(value)


def explanation(rule: Rule, tree, fields: Fields, flags: Flags = Flags()) -> Column:
    """Why a rule matched: its tree with each leaf's value and whether it holds; null and absent fields read MISSING."""
    good: list[Column] = []

    def part(node) -> Column:
        if isinstance(node, ir.Leaf):
            found = fields.get(node.field)
            value = F.lit("MISSING") if found is None else F.coalesce(py_str(*found), F.lit("MISSING"))
            test = truth(compile_leaf(node, fields, flags))
            text = F.concat(F.lit(f"{node.field}="), value, F.lit(f" {node.op} {_shown(node.value)}"))
            good.append(F.when(test, text))
            return F.concat(F.when(test, F.lit("[✓ ")).otherwise(F.lit("[✗ ")), text, F.lit("]"))
        if isinstance(node, ir.Group):
            if not node.children:
                return F.lit("(always)")
            if node.op == "NOT":
                return F.concat(F.lit("NOT "), part(node.children[0]))
            return F.concat(F.lit("("), F.concat_ws(f" {node.op} ", *[part(c) for c in node.children]), F.lit(")"))
        return F.lit(f"[{type(node).__name__}]")

    body = part(tree) if tree is not None else F.lit("(never)")
    return F.concat(F.lit(f"Rule '{rule.name}' matched: "), body, F.lit(" | Matching conditions: "), F.concat_ws(", ", *good) if good else F.lit("none"))


def parse_explanation(column: Column) -> tuple[Column, Column]:
    """(conditions that held, conditions that did not), as arrays of text."""
    parts = F.transform(F.regexp_extract_all(column, F.lit(r"\[([✓✗] [^\]]*)\]"), F.lit(1)), lambda x: x)
    pick = lambda mark: F.transform(F.filter(parts, lambda x: x.startswith(mark)), lambda x: F.substring(x, 3, 1 << 20))
    return pick("✓"), pick("✗")


def top_activation(matches: DataFrame) -> DataFrame:
    """Of each event the match that runs first."""
    return matches.where(F.col("exec_order") == 1)


def nested_result(matches: DataFrame, key: str) -> DataFrame:
    """One row for each event: ids in order of execution and a map of explanations. For the edge of an application only."""
    cells = [F.struct("exec_order", "rule_id").alias("r")]
    out = matches.select(key, *cells, *(["explanation", "rule_id"] if "explanation" in matches.columns else []))
    aggs = [F.transform(F.array_sort(F.collect_list("r")), lambda x: x["rule_id"]).alias("execution_order")]
    if "explanation" in matches.columns:
        aggs.append(F.map_from_entries(F.collect_list(F.struct("rule_id", "explanation"))).alias("explanations"))
    return out.groupBy(key).agg(*aggs)


def strictness(events: DataFrame, rules: Iterable[Rule], flags: Flags = Flags()) -> DataFrame:
    """One row: null evaluations, type mismatches and boolean coercions over all events and distinct leaves."""
    compiled = compile_rules(active(rules), flags)
    fields = Fields(events.schema)
    nulls, mismatch, coerced = F.lit(0), 0, F.lit(0)
    for leaf in compiled.leaves.values():
        found = fields.get(leaf.field)
        if found is None or leaf.op in ("exists", "not_exists"):
            continue
        nulls = nulls + found[0].isNull().cast("int")
        number, text = isinstance(found[1], T.NumericType), isinstance(found[1], T.StringType)
        if (text and isinstance(leaf.value, (int, float))) or (number and isinstance(leaf.value, str)):
            mismatch += 1
        if flags.coerce_bool_strings and text:
            coerced = coerced + truth(F.lower(F.trim(found[0])).isin("true", "false")).cast("int")
    return events.agg(F.coalesce(F.sum(nulls), F.lit(0)).cast("long").alias("null_evaluations"), (F.count(F.lit(1)) * mismatch).cast("long").alias("type_mismatches"), F.coalesce(F.sum(coerced), F.lit(0)).cast("long").alias("bool_coercions"))

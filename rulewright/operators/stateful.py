"""Patterns over many facts: accumulation, ordered sequences, cross-fact counts and joins, retraction, agenda, working memory."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import ir
from ..plans.compiler import Fields, Flags, compile_leaf, compile_tree, truth

_FLAGS = Flags(stateless=False)


def over(facts: DataFrame, spec) -> Column:
    """Which facts a source spec takes: all, a type, a leaf, an equality map, or several of them at once."""
    if spec is None or spec == "*":
        return F.lit(True)
    if isinstance(spec, str):
        kind = next((F.col(c) for c in ("type", "fact_type", "event_type") if c in facts.columns), None)
        return F.lit(False) if kind is None else truth(kind == spec)
    if isinstance(spec, (list, tuple)):
        return reduce(lambda a, b: a & b, [over(facts, s) for s in spec], F.lit(True))
    if isinstance(spec, dict) and {"field", "op"} <= set(spec):
        return truth(compile_leaf(ir.parse(spec), Fields(facts.schema), _FLAGS))
    if isinstance(spec, dict):
        return reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) if k in facts.columns else F.lit(v is None) for k, v in spec.items()], F.lit(True))
    return truth(compile_tree(spec, Fields(facts.schema), _FLAGS))


def _numbers(facts: DataFrame, name: str | None) -> Column:
    kind = dict(zip(facts.schema.names, facts.schema.fields, strict=True)).get(name)
    if kind is None or not isinstance(kind.dataType, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast("double")
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def aggregates(facts: DataFrame, spec) -> list[Column]:
    """count, sum, min, max, avg over numbers (booleans count as numbers); sums of nothing are 0, the others null."""
    if spec is None:
        spec = "count"
    if isinstance(spec, (list, tuple)):
        return [a for s in spec for a in aggregates(facts, s)]
    op, name, alias = (spec, None, None) if isinstance(spec, str) else (spec.get("op", "count"), spec.get("field"), spec.get("as"))
    if op not in ir.AGGREGATES:
        raise ir.RuleError(f"unsupported aggregate {op!r}")
    alias = alias or (op if name is None else f"{op}_{name}")
    if op == "count":
        return [F.count(F.lit(1)).alias(alias)]
    x = _numbers(facts, name)
    return [{"sum": F.coalesce(F.sum(x), F.lit(0.0)), "min": F.min(x), "max": F.max(x), "avg": F.avg(x)}[op].alias(alias)]


def trailing(facts: DataFrame, now, seconds: float, column: str = "inserted_at") -> DataFrame:
    """Facts of the last seconds before now, both ends included and none too late; a negative window holds nothing."""
    if seconds < 0:
        return facts.where(F.lit(False))
    kind = facts.schema[column].dataType
    at = F.lit(now).cast(kind)
    return facts.where(F.col(column) >= at - F.expr(f"interval {float(seconds):.6f} second"))


def accumulate(facts: DataFrame, spec: ir.Accumulate | dict, now=None, time_col: str = "inserted_at", collect: bool = False) -> DataFrame:
    """(group..., aggregates...[, specificity, matched_facts]) of the groups that meet the constraint.

    Without group_by there is exactly one group, even of no facts. The constraint names an aggregate, a group field, or either
    by a dotted path (accumulate.NAME, group.NAME). collect gathers the facts of each group: only for groups of known size.
    """
    spec = ir.parse(spec) if isinstance(spec, dict) else spec
    rows = facts.where(over(facts, spec.over))
    if spec.seconds is not None:
        rows = trailing(rows, now, spec.seconds, time_col)
    group = [F.col(f"`{g}`").alias(g) if g in facts.columns else F.lit(None).cast("string").alias(g) for g in spec.group_by]
    aggs = aggregates(facts, spec.aggregates)
    if collect:
        aggs += [F.count(F.lit(1)).alias("specificity"), F.collect_list(F.struct(*[f"`{c}`" for c in facts.columns])).alias("matched_facts")]
    out = rows.groupBy(*group).agg(*aggs) if group else rows.agg(*aggs)
    if spec.constraint:
        c = dict(spec.constraint)
        head, _, rest = str(c.get("field", "")).partition(".")
        c["field"] = rest if rest and head in ("accumulate", "group") else c.get("field")
        out = out.where(compile_leaf(ir.parse(c), Fields(out.schema), _FLAGS))
    return out


def sequence(facts: DataFrame, spec: ir.Sequence | dict, time_col: str, arrival_col: str, id_col: str) -> DataFrame:
    """(id_1, ..., id_n) of every ordered combination of facts that meets the steps.

    Each fact is earlier than the next (ties in time go by arrival), shares the correlation values (null with null), lies within
    the window before the last, and has arrived before it: a late fact triggers nothing. Steps are joined from the last back,
    on the correlation values and a range of times, so one value's facts are all that meets; filters reach the scans.
    """
    spec = ir.parse(spec) if isinstance(spec, dict) else spec
    fields = Fields(facts.schema)
    n = len(spec.steps)
    keys = list(spec.correlate_on)
    within = F.expr(f"interval {float(spec.within):.6f} second")

    def step(k: int) -> DataFrame:
        own = facts.where(truth(compile_tree(spec.steps[k], fields, _FLAGS)))
        cells = [F.col(f"`{c}`").alias(f"c{i}_{k}") for i, c in enumerate(keys)]
        return own.select(F.col(id_col).alias(f"id_{k + 1}"), F.col(time_col).alias(f"t_{k}"), F.col(arrival_col).alias(f"a_{k}"), *cells)

    out = step(n - 1)
    last = n - 1
    for k in range(n - 2, -1, -1):
        earlier = (F.col(f"t_{k}") < F.col(f"t_{k + 1}")) | ((F.col(f"t_{k}") == F.col(f"t_{k + 1}")) & (F.col(f"a_{k}") < F.col(f"a_{k + 1}")))
        test = [F.col(f"c{i}_{k}").eqNullSafe(F.col(f"c{i}_{last}")) for i in range(len(keys))]
        test += [earlier, F.col(f"t_{k}") >= F.col(f"t_{last}") - within, F.col(f"a_{k}") < F.col(f"a_{last}")]
        out = out.join(step(k), reduce(lambda a, b: a & b, test))
    return out.select(*[f"id_{k + 1}" for k in range(n)])


def cross_fact_count(facts: DataFrame, correlate: str, arrival_col: str) -> DataFrame:
    """Facts that are not the first of their correlation value (as text; null never), with ``seen``, the count so far.

    A window over the value orders its facts; what follows needs the count only as far as two, so a hot value whose first
    fact alone matters is better served by cross_fact_later().
    """
    w = Window.partitionBy("__key").orderBy(arrival_col).rowsBetween(Window.unboundedPreceding, 0)
    keyed = facts.where(F.col(f"`{correlate}`").isNotNull()).withColumn("__key", F.col(f"`{correlate}`").cast("string"))
    return keyed.withColumn("seen", F.count(F.lit(1)).over(w)).where("seen > 1").drop("__key")


def cross_fact_later(facts: DataFrame, correlate: str, arrival_col: str) -> DataFrame:
    """The same facts without the count: all but each value's first, found by an aggregation that no hot value can swamp."""
    first = facts.where(F.col(f"`{correlate}`").isNotNull()).groupBy(F.col(f"`{correlate}`").cast("string").alias("__key")).agg(F.min(arrival_col).alias("__first"))
    return facts.join(first, (F.col(f"`{correlate}`").cast("string") == F.col("__key")) & (F.col(arrival_col) > F.col("__first"))).drop("__key", "__first")


def cross_fact_join(left: DataFrame, right: DataFrame, on: Iterable[tuple[str, str]], match: str = "all", left_id: str = "event_id", right_id: str = "event_id") -> DataFrame:
    """(left_id, right_id) of facts that agree on all, or on any, of the pairs of fields.

    ``any`` is a union of equi-joins, one for each pair, and not a join on an OR, which could only compare all with all.
    """
    on = list(on)
    a = left.select(F.col(left_id).alias("left_id"), *[F.col(f"`{x}`").alias(f"l{i}") for i, (x, _) in enumerate(on)])
    b = right.select(F.col(right_id).alias("right_id"), *[F.col(f"`{y}`").alias(f"r{i}") for i, (_, y) in enumerate(on)])
    tests = [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(on))]
    if match == "all":
        return a.join(b, reduce(lambda x, y: x & y, tests)).select("left_id", "right_id")
    out = None
    for i, t in enumerate(tests):
        fresh = reduce(lambda x, y: x & y, [~truth(p) for p in tests[:i]], F.lit(True))  # each pair once
        one = a.join(b, t).where(fresh).select("left_id", "right_id")
        out = one if out is None else out.unionByName(one)
    return out


def retract(facts: DataFrame, retracted: DataFrame, id_col: str) -> DataFrame:
    """Facts less those retracted; ids that were never asserted change nothing."""
    return facts.join(retracted.select(id_col).distinct(), id_col, "left_anti")


def cancelled(activations: DataFrame, retracted: DataFrame, id_col: str = "fact_id") -> DataFrame:
    """Queued activations that used a retracted fact; matched_facts is an array of structs with the id."""
    used = activations.withColumn("__f", F.explode(f"matched_facts.{id_col}"))
    gone = used.join(retracted.select(F.col(id_col).alias("__f")).distinct(), "__f", "left_semi").select("rule_id", "recency").distinct()
    return activations.join(gone, ["rule_id", "recency"], "left_semi")


def agenda(activations: DataFrame, key: str | None = None) -> DataFrame:
    """Activations with ``turn``: by priority, recency, specificity, all highest first; by key where there is one."""
    w = Window.partitionBy(key if key else F.lit(0)).orderBy(F.desc("priority"), F.desc("recency"), F.desc("specificity"))
    return activations.withColumn("turn", F.row_number().over(w))


def keep_newest(facts: DataFrame, key: str, order_col: str, capacity: int) -> DataFrame:
    """Working memory of a capacity for each key: the first in goes first."""
    w = Window.partitionBy(key).orderBy(F.desc(order_col))
    return facts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= capacity).drop("__r")


def keep_budget(facts: DataFrame, key: str, order_col: str, budget: int, payload: Column | None = None) -> DataFrame:
    """Newest facts whose payloads, as compact JSON bytes, fit the budget together."""
    size = F.octet_length(payload if payload is not None else F.to_json(F.struct(*[f"`{c}`" for c in sorted(facts.columns)])))
    w = Window.partitionBy(key).orderBy(F.desc(order_col)).rowsBetween(Window.unboundedPreceding, 0)
    return facts.withColumn("__b", F.sum(size).over(w)).where(F.col("__b") <= budget).drop("__b")


def expired(sessions: DataFrame, now, ttl: float, sliding: bool = True) -> DataFrame:
    """Sessions whose time is over: since the last touch, or since they were made."""
    column = "updated_at" if sliding else "created_at"
    return sessions.where(F.col(column) + F.expr(f"interval {float(ttl):.6f} second") <= F.lit(now).cast(sessions.schema[column].dataType))


def by_field(facts: DataFrame, name: str, value) -> DataFrame:
    """Facts whose field has a value; one without the field has null."""
    return facts.where(F.col(f"`{name}`").eqNullSafe(F.lit(value)) if name in facts.columns else F.lit(value is None))

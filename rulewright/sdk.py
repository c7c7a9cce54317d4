"""The flat dialect: rule sets of rules that each AND a few conditions with word operators; errors are raised, not swallowed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import ir
from .plans.compiler import Fields, compile_tree, truth


class UnknownOperatorError(ValueError):
    pass


@dataclass(frozen=True)
class RuleCondition:
    fact: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Rule:
    id: str
    conditions: tuple = ()
    actions: tuple = ()
    priority: int = 0

    def tree(self) -> ir.Group:
        for c in self.conditions:
            if c.operator not in ir.WORDS:
                raise UnknownOperatorError(c.operator)
        return ir.Group("AND", tuple(ir.Leaf(c.fact, ir.WORDS[c.operator], tuple(c.value) if isinstance(c.value, list) else c.value) for c in self.conditions))


@dataclass(frozen=True)
class Ruleset:
    id: str
    rules: tuple = ()

    def ordered(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: (r.priority, r.id), reverse=True)


@dataclass(frozen=True)
class EvaluationResult:
    ruleset_id: str
    matched_rule_ids: list
    actions: list
    trace: list
    execution_id: str = field(default_factory=lambda: str(uuid.uuid4()))


def validate(ruleset: Ruleset) -> list[str]:
    out = [] if ruleset.rules else ["ruleset has no rules"]
    ids = [r.id for r in ruleset.rules]
    out += [f"duplicate rule id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for r in ruleset.rules:
        if not r.conditions:
            out.append(f"rule {r.id} has no conditions")
        out += [f"rule {r.id} uses unsupported operator {c.operator}" for c in r.conditions if c.operator not in ir.WORDS]
    return out


def trace(facts: DataFrame, ruleset: Ruleset, key: str) -> DataFrame:
    """(key, rule_id, turn, matched): a row for each fact and rule, misses too, in order of priority and id, both descending."""
    problems = validate(ruleset)
    if problems:
        raise ValueError("; ".join(problems))
    fields = Fields(facts.schema)
    cells = [F.struct(F.lit(r.id).alias("rule_id"), F.lit(i).alias("turn"), truth(compile_tree(r.tree(), fields)).alias("matched"), F.lit(list(r.actions)).cast("array<string>").alias("actions")) for i, r in enumerate(ruleset.ordered(), 1)]
    return facts.select(key, F.explode(F.array(*cells)).alias("t")).select(key, "t.rule_id", "t.turn", "t.matched", "t.actions")


class Service:
    """Evaluate single facts and keep the results by execution id, those of simulations too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.results = spark, {}

    def evaluate(self, ruleset: Ruleset, facts: dict) -> EvaluationResult:
        return self.simulate(ruleset, [facts])[0]

    def simulate(self, ruleset: Ruleset, samples: list[dict]) -> list[EvaluationResult]:
        df = self.spark.createDataFrame([{"__key": i, **s} for i, s in enumerate(samples)])
        rows = trace(df, ruleset, "__key").orderBy("__key", "turn").collect()
        out = []
        for i in range(len(samples)):
            own = [r for r in rows if r["__key"] == i]
            hit = [r for r in own if r["matched"]]
            out.append(EvaluationResult(ruleset.id, [r["rule_id"] for r in hit], [a for r in hit for a in r["actions"]], [{"rule_id": r["rule_id"], "matched": r["matched"]} for r in own]))
        self.results |= {r.execution_id: r for r in out}
        return out

    def explain(self, execution_id: str) -> list[dict]:
        return self.results[execution_id].trace

"""Actions, node types and pipeline steps that applications add; entry points of group ``rulewright.plugins`` are found by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import partial
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame

from .plans import compiler, ir

ACTIONS: dict[str, dict] = {}
STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {}
#: The actions that come with the engine; each only reports that it was asked for.
BUILT_IN = ("send_alert", "send_email", "block_transaction", "approve_transaction", "flag_for_review", "call_webhook", "print_debug")


def action(name: str, description: str = "", category: str = "general"):
    def add(function: Callable[[dict, dict], dict]):
        ACTIONS[name] = {"function": function, "description": description, "category": category}
        return function

    return add


def _report(event: dict, context: dict, name: str) -> dict:
    return {"success": True, "action": name}


for _name in BUILT_IN:
    action(_name, f"report {_name}", "built-in")(partial(_report, name=_name))


def action_names(actions) -> list[str]:
    """Actions as a list of names: none, one, or several."""
    return [] if actions is None else [actions] if isinstance(actions, str) else [str(a) for a in actions]


def execute(name: str, event: dict, context: dict | None = None, registry: dict | None = None) -> dict:
    """What an action returns; unknown names and errors are told, not raised."""
    registry = ACTIONS if registry is None else registry
    if name not in registry:
        return {"success": False, "error": f"unknown action {name!r}", "available": sorted(registry)}
    try:
        return {"success": True, **(registry[name]["function"](event, context or {}) or {})}
    except Exception as e:  # noqa: BLE001  an action's error is its result
        return {"success": False, "error": f"{type(e).__name__}: {e}"}


def _run(batches: Iterable[pd.DataFrame], registry: dict) -> Iterable[pd.DataFrame]:
    for pdf in batches:
        results = [execute(a, json.loads(e) if e else {}, {"rule_id": r}, registry) for a, e, r in zip(pdf["action"], pdf["event"], pdf["rule_id"], strict=True)]
        yield pdf.assign(success=[bool(r["success"]) for r in results], result=[json.dumps(r, default=str) for r in results])


def execute_all(matches: DataFrame) -> DataFrame:
    """(rule_id, action, event, success, result) from matches with the event as JSON text."""
    return matches.select("rule_id", "action", "event").mapInPandas(partial(_run, registry=dict(ACTIONS)), "rule_id long, action string, event string, success boolean, result string")


def register_rule_type(kind: str, make) -> None:
    """make(spec, fields, flags) gives the Column of a Custom node; conditions of this type are such nodes, their other keys the spec."""
    ir.CUSTOM.add(kind)
    compiler.NODES[kind] = make


def register_pipeline_step(name: str, step: Callable[[DataFrame], DataFrame]) -> None:
    STEPS[name] = step


def run_pipeline(df: DataFrame, names: Iterable[str]) -> DataFrame:
    for n in names:
        df = df.transform(STEPS[n])
    return df


def discover(group: str = "rulewright.plugins") -> list[str]:
    found = []
    for e in entry_points(group=group):
        e.load()()
        found.append(e.name)
    return found

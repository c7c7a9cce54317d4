"""Readers of rule sets: JSON, CSV, XLSX, by file name, and from tables. Bad rows are reported next to good ones."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matcher import Rule
from ..plans import ir

JSON_SCHEMA = "id long, name string, description string, `group` string, priority int, enabled boolean, condition_dsl string, action string, rule_metadata string, evaluation_mode string, _bad string"
TRUE = ("true", "1", "yes")
REQUIRED = ("name", "action", "condition_dsl")


def from_records(records: Iterable[dict]) -> tuple[list[Rule], list[tuple[int, str]]]:
    """(rules, errors) of dicts; conditions may be objects or JSON text."""
    rules, errors = [], []
    for i, r in enumerate(records, 1):
        try:
            missing = [k for k in REQUIRED if r.get(k) in (None, "")]
            if missing:
                raise ValueError(f"missing {', '.join(missing)}")
            dsl = r["condition_dsl"]
            dsl = json.loads(dsl) if isinstance(dsl, str) else dsl
            ir.parse(dsl, compat=True)
            enabled = r.get("enabled", True)
            enabled = enabled.strip().lower() in TRUE if isinstance(enabled, str) else True if enabled is None else bool(enabled)
            meta = r.get("rule_metadata") or {}
            rules.append(Rule(int(r.get("id") or i), r["name"], dsl, r["action"], int(r.get("priority") or 0), r.get("group") or None, enabled, r.get("evaluation_mode") or "stateless", r.get("description"), json.loads(meta) if isinstance(meta, str) else meta))
        except (ValueError, TypeError, KeyError) as e:
            errors.append((i, str(e)))
    return rules, errors


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A row for each object of JSON lines or arrays; conditions as text; what cannot be read is in _bad."""
    return spark.read.schema(JSON_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows with ``error`` where required cells are missing or the condition is no JSON; no row stops the others."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    cell = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    bad = F.lit(None).cast("string")
    for n in REQUIRED:
        bad = F.when(F.coalesce(F.trim(cell(n)), F.lit("")) == "", F.lit(f"missing {n}")).otherwise(bad)
    bad = F.coalesce(bad, F.when(F.try_parse_json(cell("condition_dsl")).isNull(), F.lit("condition_dsl is no JSON")))
    return raw.select(cell("name").alias("name"), cell("description").alias("description"), cell("group").alias("group"), F.coalesce(cell("priority").try_cast("int"), F.lit(0)).alias("priority"), F.lower(F.trim(F.coalesce(cell("enabled"), F.lit("true")))).isin(*TRUE).alias("enabled"), cell("condition_dsl").alias("condition_dsl"), cell("action").alias("action"), cell("rule_metadata").alias("rule_metadata"), bad.alias("error"))


def read_xlsx(path: str) -> list[dict]:
    """Records of the first sheet, headers lower-cased; needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise RuntimeError("reading .xlsx needs openpyxl") from e
    rows = openpyxl.load_workbook(path, read_only=True, data_only=True).worksheets[0].iter_rows(values_only=True)
    head = [str(h or "").strip().lower() for h in next(rows, ())]
    return [dict(zip(head, r, strict=False)) for r in rows if any(c is not None for c in r)]


def load(spark: SparkSession, path: str) -> tuple[list[Rule], list[tuple[int, str]]]:
    """(rules, errors) of a file by its name's ending. A rule set is read to the driver, where it is compiled."""
    end = path.rsplit(".", 1)[-1].lower()
    if end == "csv":
        rows = [r.asDict() for r in read_csv(spark, path).collect()]
    elif end in ("xlsx", "xls"):
        rows = read_xlsx(path)
    elif end in ("json", "jsonl"):
        rows = [r.asDict() for r in read_json(spark, path).collect()]
    else:
        raise ValueError(f"cannot read rules from .{end}")
    if not rows:
        raise ValueError("the file has no rules")
    return from_records(rows)


def scan(rules: DataFrame, group: str | None = None) -> DataFrame:
    """Enabled rules that are not stateful, highest priority first."""
    out = rules.where("enabled and (evaluation_mode is null or evaluation_mode <> 'stateful')")
    return (out if group is None else out.where(F.col("grp") == group)).orderBy(F.desc("priority"), "rule_id")


def events_from_json(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Typed columns out of a JSON payload: each field by its type, null where the payload holds another type.

    Numbers are not read out of texts, nor texts out of numbers; ``__has_FIELD`` tells an absent field from a null one.
    """
    v = F.try_parse_json(F.col(column))
    out = df
    for name, kind in fields.items():
        path = f"$.{name}"
        stored_kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
        good = stored_kind == "STRING" if kind == "string" else stored_kind == "BOOLEAN" if kind == "boolean" else stored_kind.isin("BIGINT", "DOUBLE", "FLOAT") | stored_kind.startswith("DECIMAL")
        out = out.withColumn(name, F.when(good, F.try_variant_get(v, path, kind))).withColumn(f"__has_{name}", F.try_variant_get(v, path, "variant").isNotNull())
    return out

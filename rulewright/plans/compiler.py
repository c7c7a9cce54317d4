"""Condition trees to Columns, resolved against a schema when the plan is made.

The rules are two-valued (null is false) and never cast: a leaf whose value and column have different types becomes a constant
or a null test. Positive parts keep SQL's null, so that filters on them still reach the Parquet scan; only under NOT, and where
a boolean column is made of a tree, is null turned into false.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_str
from . import ir


@dataclass(frozen=True)
class Flags:
    coerce_bool_strings: bool = False
    strict_types: bool = False
    strict_nulls: bool = False
    compat: bool = False
    stateless: bool = True


class Fields:
    """Columns by field name: a flat name (dots included), else a path into structs; None where the schema lacks it."""

    def __init__(self, schema: T.StructType, root: Column | None = None):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.root = root

    def get(self, name: str) -> tuple[Column, T.DataType] | None:
        if name in self.types:
            return (F.col(f"`{name}`") if self.root is None else self.root[name]), self.types[name]
        head, _, rest = name.partition(".")
        kind = self.types.get(head)
        if rest and isinstance(kind, T.StructType):
            return Fields(kind, F.col(f"`{head}`") if self.root is None else self.root[head]).get(rest)
        return None


NODES: dict[str, Callable] = {}
_NUMBER = (int, float)


def truth(column: Column) -> Column:
    return F.coalesce(column, F.lit(False))


def compile_tree(node, fields: Fields | T.StructType, flags: Flags = Flags()) -> Column:
    """The Column of a tree; it may be null where it is not true."""
    fields = fields if isinstance(fields, Fields) else Fields(fields)
    if node is None:
        return F.lit(False)
    if isinstance(node, ir.Leaf):
        return compile_leaf(node, fields, flags)
    if isinstance(node, ir.Group):
        if not node.children:
            return F.lit(True)
        if node.op == "NOT":
            return ~truth(compile_tree(node.children[0], fields, flags))
        parts = [compile_tree(c, fields, flags) for c in node.children]
        if node.op == "AND":
            return reduce(lambda a, b: a & b, parts)
        if node.op == "OR":
            return reduce(lambda a, b: a | b, parts)
        return F.lit(False)
    if isinstance(node, ir.NestedAccumulate):
        return _nested_accumulate(node, fields, flags)
    if isinstance(node, ir.NestedSequence):
        return _nested_sequence(node, fields, flags)
    if isinstance(node, ir.CrossFactCount):
        return F.lit(False)  # without state there is never a second fact
    if isinstance(node, ir.Custom) and node.kind in NODES:
        return NODES[node.kind](node.spec, fields, flags)
    raise ir.RuleError(f"{type(node).__name__} is not a condition on one event")


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, (T.MapType, T.StructType)):
        return "map"
    return "other"


def _value_kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, _NUMBER):
        return "number"
    if isinstance(v, str):
        return "string"
    return "list" if isinstance(v, (list, tuple)) else "other"


def _not_nan(column: Column, t: T.DataType) -> Column | None:
    return ~F.isnan(column) if isinstance(t, (T.FloatType, T.DoubleType)) else None


def compile_leaf(leaf: ir.Leaf, fields: Fields, flags: Flags = Flags()) -> Column:
    no, op, value = F.lit(False), leaf.op, leaf.value
    found = fields.get(leaf.field)
    if op in ("exists", "not_exists"):
        return F.lit((found is not None) == (op == "exists"))
    if found is None or op not in ir.OPERATORS:
        return no
    column, t = found
    kind, vkind = _kind(t), _value_kind(value)
    present = column.isNotNull()
    if flags.strict_nulls and op in ("==", "!=") and value is None:
        return column.isNull() if op == "==" else present
    if flags.strict_nulls and op == "!=":  # a null event value differs from any rule value
        return ~truth(compile_leaf(ir.Leaf(leaf.field, "==", value), fields, flags))
    if flags.coerce_bool_strings:
        if vkind == "string" and value.strip().lower() in ("true", "false"):
            value, vkind = value.strip().lower() == "true", "bool"
        if kind == "string" and vkind in ("bool", "number") and op in ("==", "!="):
            low = F.lower(F.trim(column))
            as_bool = F.when(low == "true", F.lit(1.0)).when(low == "false", F.lit(0.0))
            same = as_bool == F.lit(float(value))
            return truth(same) & present if op == "==" else present & ~truth(same)
    if flags.strict_types:
        if op in (">", ">=", "<", "<=") and not (kind == "number" and vkind == "number"):
            return no
        if op in ("==", "!=") and not (kind == vkind or {kind, vkind} <= {"array", "list"}):
            return no
    if op in (">", ">=", "<", "<=", "==", "!="):
        return _compare(column, t, kind, op, value, vkind)
    if op in ("in", "not_in"):
        return _member(column, t, kind, op == "in", value, vkind)
    if op == "contains":
        if kind == "string":
            return column.contains(value) if vkind == "string" else no
        if kind == "array":
            return _array_has(column, t, value, vkind)
        if kind == "map":
            if vkind != "string":
                return no
            return F.map_contains_key(column, F.lit(value)) if isinstance(t, T.MapType) else (present if value in t.names else no)
        return no
    text = py_str(column, t)
    shown = value if isinstance(value, str) else str(value)
    if op == "starts_with":
        return text.startswith(shown)
    if op == "ends_with":
        return text.endswith(shown)
    return matches(text, shown)


#: What Python's and Java's patterns share as they stand.
_COMMON = re.compile(r"\A(?:[^\\(]|\\[^dDwWsSbBAZ0-9gk]|\\[.^$*+?{}\[\]|()/\-\\]|\((?!\?)|\(\?[:=!]|\(\?<[=!])*\Z")


def matches(text: Column, pattern: str) -> Column:
    """Python's re.match: anchored at the start, not at the end; a bad pattern matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    if _COMMON.match(pattern):
        return text.rlike(f"^(?:{pattern})")
    if not re.search(r"\(\?[^:=!<]|\(\?<[^=!]|\\[gkZ]|\(\?\(", pattern):
        return text.rlike(f"(?U)^(?:{pattern})")  # classes such as \d cover Unicode, as in Python
    return _python_match(pattern)(text)


def _python_match(pattern: str):
    import pandas as pd

    @F.pandas_udf(T.BooleanType())
    def match(x: pd.Series) -> pd.Series:
        own = re.compile(pattern)
        return x.map(lambda v: v is not None and own.match(v) is not None)

    return match


def _compare(column: Column, t: T.DataType, kind: str, op: str, value, vkind: str) -> Column:
    present, no = column.isNotNull(), F.lit(False)
    unlike = present if op == "!=" else no
    if vkind in ("null", "other"):
        return unlike
    if kind in ("number", "bool") and vkind in ("number", "bool"):
        if kind == "bool":
            if vkind == "bool" and op in ("==", "!="):
                return column == F.lit(value) if op == "==" else column != F.lit(value)
            column, t = column.cast("int"), T.IntegerType()
        if isinstance(value, float) and value != value:
            return unlike
        lit = F.lit(int(value) if vkind == "bool" else value)
        out = {">": column > lit, ">=": column >= lit, "<": column < lit, "<=": column <= lit, "==": column == lit, "!=": column != lit}[op]
        real = _not_nan(column, t)
        return out if real is None or op in ("<", "<=", "==", "!=") else out & real  # Spark holds NaN for the largest number
    if kind == "string" and vkind == "string":
        lit = F.lit(value)
        return {">": column > lit, ">=": column >= lit, "<": column < lit, "<=": column <= lit, "==": column == lit, "!=": column != lit}[op]
    if kind == "array" and vkind == "list" and op in ("==", "!="):
        element = _kind(t.elementType)
        if all(_value_kind(v) == element for v in value):
            lit = F.array(*[F.lit(v) for v in value]).cast(t)
            return column == lit if op == "==" else column != lit
    return unlike


def _member(column: Column, t: T.DataType, kind: str, inside: bool, value, vkind: str) -> Column:
    present, no = column.isNotNull(), F.lit(False)
    if vkind == "string":  # a text as the rule's value: is the field's text part of it
        if kind != "string":
            return no
        out = F.lit(value).contains(column)
        return out if inside else ~out
    if vkind != "list":
        return no
    like = {"number": ("number", "bool"), "bool": ("number", "bool"), "string": ("string",)}.get(kind, ())
    members = [v for v in value if _value_kind(v) in like and v == v]
    if not members:
        return no if inside else present
    if kind == "bool":
        column = column.cast("int")
    if kind in ("number", "bool"):
        members = [int(v) if isinstance(v, bool) else v for v in members]
    out = column.isin(*members)
    return out if inside else ~out


def _array_has(column: Column, t: T.ArrayType, value, vkind: str) -> Column:
    kind = _kind(t.elementType)
    if kind == vkind and vkind in ("string", "number", "bool"):
        return F.exists(column, lambda x: truth(x == F.lit(value)))
    if {kind, vkind} == {"number", "bool"}:
        return F.exists(column, lambda x: truth(x.cast("double") == F.lit(float(value))))
    return F.lit(False)


def _nested(node, fields: Fields):
    found = fields.get(node.source)
    return found if found is not None and isinstance(found[1], T.ArrayType) else None


def _sub(element: Column, t: T.DataType, node, flags: Flags) -> Column:
    return truth(compile_tree(node, Fields(t, element), flags)) if isinstance(t, T.StructType) else F.lit(False)


def _nested_accumulate(node: ir.NestedAccumulate, fields: Fields, flags: Flags) -> Column:
    found = _nested(node, fields)
    if found is None or node.aggregate not in ir.AGGREGATES:
        return F.lit(False)
    column, t = found
    rows = column if node.where is None else F.filter(column, lambda x: _sub(x, t.elementType, node.where, flags))
    if node.aggregate == "count":
        result, kind = F.size(rows), T.IntegerType()
    else:
        e = t.elementType
        inner = e[node.field].dataType if isinstance(e, T.StructType) and node.field in e.names else None
        if inner is None or _kind(inner) not in ("number", "bool"):
            values = F.expr("cast(array() as array<double>)")
        else:
            values = F.filter(F.transform(rows, lambda x: x[node.field].cast("double")), lambda v: v.isNotNull() & ~F.isnan(v))
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        result = {"sum": total, "min": F.coalesce(F.array_min(values), F.lit(0.0)), "max": F.coalesce(F.array_max(values), F.lit(0.0)), "avg": F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)}[node.aggregate]
        kind = T.DoubleType()
    return column.isNotNull() & _compare(result, kind, "number", node.op, node.value, _value_kind(node.value))


def _nested_sequence(node: ir.NestedSequence, fields: Fields, flags: Flags) -> Column:
    found = _nested(node, fields)
    if found is None or not node.steps:
        return F.lit(False)
    column, t = found

    def step(i: Column, x: Column) -> Column:
        out = F.when(F.lit(False), i)
        for k, s in enumerate(node.steps):
            out = out.when((i == k) & _sub(x, t.elementType, s, flags), F.lit(k + 1))
        return out.otherwise(i)

    return F.aggregate(column, F.lit(0), step) == len(node.steps)

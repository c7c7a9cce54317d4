"""The truth table of the compiler, and random trees against an evaluator of its own."""

import random
import re

import pytest

from rulewright.plans import ir
from rulewright.plans.compiler import Flags, compile_tree, truth

SCHEMA = "k int, n double, i int, s string, b boolean, a array<string>, m map<string,int>"
ROWS = [(1, 5.0, 5, "true", True, ["x", "y"], {"q": 1}), (2, None, None, None, None, None, None), (3, float("nan"), 0, "FR-2", False, [], {}), (4, -1.5, 18, "x", True, ["z"], {"z": 2})]


def leaf(f, op, v=None):
    return {"type": "condition", "field": f, "op": op, "value": v}


def hits(spark, tree, flags=Flags()):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return [r.k for r in df.where(truth(compile_tree(ir.parse(tree), df.schema, flags))).orderBy("k").collect()]


@pytest.mark.parametrize(("tree", "flags", "expected"), [
    (leaf("n", ">", 0), Flags(), [1]),
    (leaf("n", "!=", 5), Flags(), [3, 4]),
    (leaf("i", "==", True), Flags(), []),
    (leaf("b", "==", 1), Flags(), [1, 4]),
    (leaf("b", "==", 1), Flags(strict_types=True), []),
    (leaf("s", "==", True), Flags(), []),
    (leaf("s", "==", True), Flags(coerce_bool_strings=True), [1]),
    (leaf("s", "==", None), Flags(), []),
    (leaf("s", "==", None), Flags(strict_nulls=True), [2]),
    (leaf("s", "!=", None), Flags(strict_nulls=True), [1, 3, 4]),
    (leaf("s", "!=", 5), Flags(), [1, 3, 4]),
    (leaf("s", "!=", 5), Flags(strict_types=True), []),
    (leaf("s", "in", "a true story"), Flags(), [1, 4] if "x" in "a true story" else [1]),
    (leaf("i", "in", [5, "18", True]), Flags(), [1]),
    (leaf("i", "not_in", [5, None]), Flags(), [3, 4]),
    (leaf("i", "not_in", "5"), Flags(), []),
    (leaf("a", "contains", "x"), Flags(), [1]),
    (leaf("m", "contains", "z"), Flags(), [4]),
    (leaf("n", "contains", 5), Flags(), []),
    (leaf("n", "starts_with", "5.0"), Flags(), [1]),
    (leaf("b", "ends_with", "rue"), Flags(), [1, 4]),
    (leaf("s", "regex", "F[A-Z]"), Flags(), [3]),
    (leaf("s", "regex", "R-2"), Flags(), []),
    (leaf("s", "regex", "("), Flags(), []),
    (leaf("zz", "not_exists"), Flags(), [1, 2, 3, 4]),
    (leaf("zz", "!=", 1), Flags(), []),
    ({"type": "group", "op": "OR", "children": []}, Flags(), [1, 2, 3, 4]),
    ({"type": "group", "op": "NOT", "children": [leaf("s", "==", "x")]}, Flags(), [1, 2, 3]),
    ({"type": "group", "op": "NOT", "children": [{"type": "group", "op": "NOT", "children": [leaf("s", "==", "x")]}]}, Flags(), [4]),
    (None, Flags(), []),
])
def test_truth_table(spark, tree, flags, expected):
    assert hits(spark, tree, flags) == expected


def plain(node, row):
    if isinstance(node, ir.Group):
        vals = [plain(c, row) for c in node.children]
        return not vals[0] if node.op == "NOT" else all(vals) if node.op == "AND" else (any(vals) or not vals)
    v, w = row.get(node.field), node.value
    if v is None:
        return False
    try:
        return {">": lambda: v > w, ">=": lambda: v >= w, "<": lambda: v < w, "<=": lambda: v <= w, "==": lambda: v == w, "!=": lambda: v != w, "in": lambda: v in w, "not_in": lambda: v not in w, "contains": lambda: w in v, "regex": lambda: re.match(w, v) is not None}[node.op]()
    except TypeError:
        return False


def test_random_trees(spark):
    rng = random.Random(3)
    pool = [("n", [1.0, 5, "5", True]), ("i", [0, 5, 18.0, "x"]), ("s", ["x", "true", 5]), ("b", [True, False, 1])]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            f, vs = rng.choice(pool)
            return leaf(f, rng.choice([">", ">=", "<", "<=", "==", "!="]), rng.choice(vs))
        op = rng.choice(["AND", "OR", "NOT"])
        return {"type": "group", "op": op, "children": [tree(depth - 1) for _ in range(1 if op == "NOT" else rng.randint(1, 3))]}

    trees = [tree(3) for _ in range(60)]
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = df.select("k", *[truth(compile_tree(ir.parse(t), df.schema)).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for got, row in zip(sorted(out, key=lambda r: r.k), ROWS, strict=True):
        for i, t in enumerate(trees):
            assert got[f"t{i}"] == plain(ir.parse(t), dict(zip(names, row, strict=True))), (t, row)


def test_unknown_operator():
    with pytest.raises(ir.RuleError):
        ir.parse(leaf("a", "like", 1))
    assert ir.parse(leaf("a", "like", 1), compat=True) is None

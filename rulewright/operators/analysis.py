"""Static analysis of rule sets: constraints as a DataFrame, and detectors as joins, windows and aggregates over it."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import ir
from . import pairs
from .matcher import Rule

INF = float("inf")
#: Findings that keep a rule from being written.
BLOCKING = frozenset(("duplicate_condition", "priority_collision", "overlap", "dead_rule", "duplicate_name"))
CONSTRAINTS = "rule_id long, ordinal int, rule_name string, grp string, action string, priority int, branch int, branches int, field string, op string, num double, txt string, low double, high double, low_in boolean, high_in boolean"


def interval(op: str, value) -> tuple | None:
    """(low, high, low included, high included) of a bound on a number; none for other operators and values."""
    if not isinstance(value, (int, float)) or op not in (">", ">=", "<", "<=", "=="):
        return None
    v = float(value)
    return {">": (v, INF, False, False), ">=": (v, INF, True, False), "<": (-INF, v, False, False), "<=": (-INF, v, False, True), "==": (v, v, True, True)}[op]


#: Operators whose negation is an operator; null values apart, which meet neither.
NEGATED = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "==": "!=", "!=": "==", "in": "not_in", "not_in": "in", "exists": "not_exists", "not_exists": "exists"}
#: Conjunctions that a rule may stand for at most; more are an error.
BRANCHES = 4096


def conjunctions(node, positive: bool = True) -> Iterator[tuple]:
    """The conjunctions of leaves that a tree stands for, one at a time, NOT pushed into the leaves. What has no negated operator,
    or is no leaf, is left out of its conjunction: it can hold."""
    if node is None:
        return iter(() if positive else ((),))
    if isinstance(node, ir.Group):
        if not node.children:
            return iter(((),) if positive else ())
        if node.op == "NOT":
            return conjunctions(node.children[0], not positive)
        if (node.op == "AND") == positive:
            return _product(node.children, positive)
        return itertools.chain.from_iterable(conjunctions(c, positive) for c in node.children)
    if isinstance(node, ir.Leaf):
        if positive:
            return iter(((node,),))
        return iter(((ir.Leaf(node.field, NEGATED[node.op], node.value),),)) if node.op in NEGATED else iter(((),))
    return iter(((),))


def _product(children, positive: bool) -> Iterator[tuple]:
    if not children:
        yield ()
        return
    for head in conjunctions(children[0], positive):
        for rest in _product(children[1:], positive):
            yield head + rest


def constraint_rows(rules: Iterable[Rule], compat: bool = False) -> list[tuple]:
    out = []
    for ordinal, r in enumerate(rules):
        tree = r.tree(compat)
        if compat:  # the children of an OR at the top, whatever stands below read as AND
            branches = [tuple(ir.leaves(b)) for b in (tree.children if isinstance(tree, ir.Group) and tree.op == "OR" else (tree,))]
        else:
            branches = list(itertools.islice(conjunctions(tree), BRANCHES + 1))
            if len(branches) > BRANCHES:
                raise ir.RuleError(f"rule {r.name!r} stands for more than {BRANCHES} conjunctions")
        for b, branch in enumerate(branches):
            for leaf in branch:
                i = interval(leaf.op, leaf.value)
                text = leaf.value if isinstance(leaf.value, str) else None
                out.append((r.id, ordinal, r.name, r.group or "default", r.action or "", r.priority, b, len(branches), leaf.field, leaf.op, float(leaf.value) if isinstance(leaf.value, (int, float)) else None, text, *(i or (None, None, None, None))))
    return out


def constraints(spark: SparkSession, rules: Iterable[Rule], compat: bool = False) -> DataFrame:
    """A row for each leaf of each conjunction (branch) that a rule stands for, with its interval.

    compat: branches are the children of an OR at the top, and all below is read as a conjunction, NOT and OR as well."""
    return spark.createDataFrame(constraint_rows(rules, compat), CONSTRAINTS)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """A row for each rule, conditions as canonical text."""
    rows = [(r.id, i, r.name, r.group or "default", r.priority, r.enabled, r.action or "", ir.canonical(r.condition) if r.condition else None, sorted(ir.fields(r.tree(True)))) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id long, ordinal int, rule_name string, grp string, priority int, enabled boolean, action string, condition string, fields array<string>")


def intersects(a: str, b: str) -> Column:
    """Whether intervals a and b (column prefixes) share a value; ends count only where both include them."""
    low, high = F.greatest(f"{a}low", f"{b}low"), F.least(f"{a}high", f"{b}high")
    low_in = F.when(F.col(f"{a}low") > F.col(f"{b}low"), F.col(f"{a}low_in")).when(F.col(f"{a}low") < F.col(f"{b}low"), F.col(f"{b}low_in")).otherwise(F.col(f"{a}low_in") & F.col(f"{b}low_in"))
    high_in = F.when(F.col(f"{a}high") < F.col(f"{b}high"), F.col(f"{a}high_in")).when(F.col(f"{a}high") > F.col(f"{b}high"), F.col(f"{b}high_in")).otherwise(F.col(f"{a}high_in") & F.col(f"{b}high_in"))
    return (low < high) | ((low == high) & low_in & high_in)


def contains(a: str, b: str) -> Column:
    """Whether interval a holds all of b."""
    lower = (F.col(f"{a}low") < F.col(f"{b}low")) | ((F.col(f"{a}low") == F.col(f"{b}low")) & (F.col(f"{a}low_in") | ~F.col(f"{b}low_in")))
    upper = (F.col(f"{a}high") > F.col(f"{b}high")) | ((F.col(f"{a}high") == F.col(f"{b}high")) & (F.col(f"{a}high_in") | ~F.col(f"{b}high_in")))
    return lower & upper


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of intervals by key: those that intersect or touch become one (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy("low", "high")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("high", F.col("high_in").cast("int").alias("i"))).over(before)
    fresh = top.isNull() | (F.col("low") > top["high"]) | ((F.col("low") == top["high"]) & ~F.col("low_in") & (top["i"] == 0))
    islands = intervals.withColumn("__new", fresh.cast("int")).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.min(F.struct("low", (~F.col("low_in")).cast("int").alias("o"))), F.max(F.struct("high", F.col("high_in").cast("int").alias("i")))
    out = islands.groupBy(*keys, "__island").agg(low.alias("l"), high.alias("h"))
    return out.select(*keys, F.col("l.low").alias("low"), F.col("h.high").alias("high"), (F.col("l.o") == 0).alias("low_in"), (F.col("h.i") == 1).alias("high_in"))


def branch_intervals(cons: DataFrame, exact: bool = True) -> DataFrame:
    """Intervals of a branch by field: the union of its bounds (compatible), or their intersection (exact)."""
    keys = ["rule_id", "grp", "action", "branch", "field"]
    own = cons.where("low is not null")
    if not exact:
        return merged(own, keys)
    low, high = F.max(F.struct("low", (~F.col("low_in")).cast("int").alias("o"))), F.min(F.struct("high", F.col("high_in").cast("int").alias("i")))
    out = own.groupBy(*keys).agg(low.alias("l"), high.alias("h"))
    return out.select(*keys, F.col("l.low").alias("low"), F.col("h.high").alias("high"), (F.col("l.o") == 0).alias("low_in"), (F.col("h.i") == 1).alias("high_in"))


def conflicts(cons: DataFrame, exact: bool = True, fallback: bool = False, candidate: DataFrame | None = None) -> DataFrame:
    """(rule1, rule2, grp, fields): rules of one group with different actions whose branches overlap.

    Branches overlap on fields whose intervals meet, unless a field that both have is disjoint, as numbers or as texts that
    must be equal. A group's rules are dealt to blocks, and each two blocks are compared in one step (pairs.py): only pairs that
    conflict become rows. fallback also reports pairs that share one number field that overlaps, whatever their texts say.
    candidate: constraints of rules; only pairs with them are looked at.
    """
    rows = _flat(cons, exact)
    dealt = cons.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / pairs.BLOCK).cast("int").alias("blocks"))
    place = lambda n: F.pmod(F.xxhash64("rule_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    if candidate is None:
        rows = rows.join(dealt, "grp").withColumn("own", place("blocks")).withColumn("other", every("blocks"))
        side = F.when(F.col("own") == F.col("other"), 3).when(F.col("own") < F.col("other"), 1).otherwise(2)
        cells = rows.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), *pairs.ROW)
    else:
        sizes = dealt.join(candidate.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / pairs.BLOCK).cast("int").alias("parts")), "grp")
        mine = _flat(candidate, exact).join(sizes, "grp").select(place("parts").alias("i"), every("blocks").alias("j"), F.lit(1).alias("side"), *pairs.ROW)
        cells = mine.unionByName(rows.join(sizes, "grp").select(every("parts").alias("i"), place("blocks").alias("j"), F.lit(2).alias("side"), *pairs.ROW))
    # a number of partitions of its own: pairs, not bytes, are what a partition costs
    spark = cons.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pairs.overlapping(pa.Table.from_batches(list(batches)), fallback, candidate_is_none)

    candidate_is_none = candidate is None
    found = cells.repartition(n, "grp", "i", "j").groupBy("grp", "i", "j").applyInArrow(work, pairs.FOUND)
    found = found.select("grp", "own", "fields", F.explode("others").alias("other"))
    kind = dict(cons.dtypes)["rule_id"]
    low, high = (F.least("own", "other"), F.greatest("own", "other")) if candidate is None else (F.col("own"), F.col("other"))
    return found.select(low.cast(kind).alias("rule1"), high.cast(kind).alias("rule2"), "grp", "fields")


def _flat(cons: DataFrame, exact: bool) -> DataFrame:
    """What pairs of branches are held against: a row for each interval of a branch, and for each text that a field must equal."""
    own = branch_intervals(cons, exact).withColumn("txt", F.lit(None).cast("string"))
    eq = cons.where("op = '==' and txt is not null").select("rule_id", "grp", "action", "branch", "field", "txt").distinct()
    none = {"low": F.lit(0.0), "high": F.lit(0.0), "low_in": F.lit(True), "high_in": F.lit(True)}
    both = own.unionByName(eq.withColumns(none)).where("grp is not null and rule_id is not null and action is not null and field is not null")
    return both.withColumn("rule_id", F.col("rule_id").cast("long")).withColumn("branch", F.col("branch").cast("int")).select(*pairs.ROW)


def redundancies(cons: DataFrame, exact: bool = True) -> DataFrame:
    """(rule_id, redundant_to): rules that fire only where another one does, by the first such rule in order.

    exact: each branch of the rule lies in a branch of the other that tests the same number fields, each within a range that holds
    the rule's, and the same of everything else. Otherwise: each interval of the rule, whatever its branch, lies in one of the
    other's of that field.
    """
    if exact:
        return _redundant_branches(cons)
    own = cons.where("low is not null").select("rule_id", "ordinal", "field", "low", "high", "low_in", "high_in")
    child = own.select(*[F.col(c).alias(c if c == "field" else f"a_{c}") for c in own.columns])
    parent = own.select(*[F.col(c).alias(c if c == "field" else f"b_{c}") for c in own.columns])
    inside = child.join(parent, "field").where((F.col("a_rule_id") != F.col("b_rule_id")) & contains("b_", "a_"))
    place = F.struct("field", "a_low", "a_high", "a_low_in", "a_high_in")
    covered = inside.groupBy("a_rule_id", "b_rule_id", "b_ordinal").agg(F.count_distinct(place).alias("n"))
    total = own.groupBy("rule_id").agg(F.count_distinct(F.struct("field", "low", "high", "low_in", "high_in")).alias("all"))
    out = covered.join(total.select(F.col("rule_id").alias("a_rule_id"), "all"), "a_rule_id").where("n = all")
    return out.groupBy(F.col("a_rule_id").alias("rule_id")).agg(F.min_by("b_rule_id", "b_ordinal").alias("redundant_to"))


def _redundant_branches(cons: DataFrame) -> DataFrame:
    keys = ["rule_id", "branch"]
    ranges = branch_intervals(cons, True).select(*keys, F.struct("field", "low", "high", "low_in", "high_in").alias("r"))
    ranges = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("ranges"))
    rest = F.array_sort(F.collect_set(F.when(F.col("low").isNull(), F.concat_ws("\u0001", "field", "op", F.coalesce("txt", F.col("num").cast("string"))))))
    rows = cons.groupBy(*keys).agg(F.first("ordinal").alias("ordinal"), F.first("branches").alias("branches"), rest.alias("rest")).join(ranges, keys)
    # only branches that test the same fields and the same rest meet; equal branches are one kind
    rows = rows.withColumn("shape", F.to_json(F.struct(F.transform("ranges", lambda x: x["field"]).alias("fields"), "rest")))
    of = lambda c: F.transform("ranges", lambda x: x[c] + F.lit(0.0) if c in ("low", "high") else x[c]).alias(c)  # noqa: E731  # no negative zero
    rows = rows.select("rule_id", "ordinal", "branches", "shape", F.struct(*(of(c) for c in ("low", "high", "low_in", "high_in"))).alias("ends"))
    rows = rows.withColumn("kind", F.md5(F.concat_ws("\u0001", "shape", F.to_json("ends"))))
    # rules of equal kinds are one class, of which the first two in order are enough: a rule is not held against itself
    own = rows.groupBy("rule_id").agg(F.first("ordinal").alias("ordinal"), (F.count(F.lit(1)) == F.first("branches")).alias("whole"), F.collect_set(F.struct("kind", "shape", "ends")).alias("parts"))
    own = own.withColumn("parts", F.array_sort("parts")).withColumn("class", F.md5(F.concat_ws(",", F.col("parts")["kind"], F.col("whole").cast("string")))).localCheckpoint()
    place = F.row_number().over(Window.partitionBy("class").orderBy("ordinal", "rule_id"))
    classes = own.withColumn("place", place).where("place <= 2").groupBy("class").agg(F.first("whole").alias("whole"), F.first("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("ordinal", "rule_id"))).alias("two"))
    classes = classes.localCheckpoint()
    has = classes.select("class", "whole", "two", F.size("parts").alias("n"), F.explode("parts").alias("part")).select("class", "whole", "two", "n", "part.*")
    kinds = has.groupBy("shape", "kind").agg(F.first("ends").alias("ends"), F.collect_list("two").alias("all"), F.count(F.lit(1)).alias("size"), F.max(F.expr("whole and n = 1")).alias("single"), F.max(F.expr("whole and n > 1")).alias("several"))
    kinds = kinds.withColumn("all", F.slice(F.array_sort(F.flatten("all")), 1, 2)).select("shape", "kind", "ends.*", F.col("all")["ordinal"].alias("ordinals"), F.col("all")["rule_id"].alias("rules"), "size", "single", "several")
    found = _inside(kinds).localCheckpoint()
    # a class of one kind: the first two rules of those that hold it
    best = found.where("b_kind is null").groupBy("a_kind").agg(F.slice(F.array_sort(F.collect_set(F.struct("ordinal", F.col("rule").alias("rule_id")))), 1, 2).alias("best"))
    best = has.where("whole and n = 1").select("class", F.col("kind").alias("a_kind")).join(best, "a_kind").select("class", "best")
    # a class of several: those that hold the kind that fewest hold, if they hold the others too
    inside = found.where("b_kind is not null")
    reach = inside.groupBy("a_kind").agg(F.sum("size").alias("reach"))
    rarest = has.where("whole and n > 1").select("class", F.col("kind").alias("a_kind")).join(reach, "a_kind").groupBy("class").agg(F.min_by("a_kind", F.struct("reach", "a_kind")).alias("a_kind"))
    met = rarest.join(inside, "a_kind").join(has.select(F.col("kind").alias("b_kind"), F.col("class").alias("b_class")), "b_kind").select("class", "b_class").distinct()
    lower = "exists(sequence(0, size(x.ends.low) - 1), i -> not (y.ends.low[i] < x.ends.low[i] or (y.ends.low[i] = x.ends.low[i] and (y.ends.low_in[i] or not x.ends.low_in[i]))))"
    upper = "exists(sequence(0, size(x.ends.low) - 1), i -> not (y.ends.high[i] > x.ends.high[i] or (y.ends.high[i] = x.ends.high[i] and (y.ends.high_in[i] or not x.ends.high_in[i]))))"
    holds = F.expr(f"forall(parts, x -> exists(b_parts, y -> x.kind = y.kind or (x.shape = y.shape and not {lower} and not {upper})))")
    met = met.join(classes.select("class", "parts"), "class").join(classes.select(F.col("class").alias("b_class"), F.col("parts").alias("b_parts"), F.explode("two").alias("b")), "b_class").where(holds).select("class", "b")
    first = met.withColumn("place", F.row_number().over(Window.partitionBy("class").orderBy("b"))).where("place <= 2")
    best = best.unionByName(first.groupBy("class").agg(F.array_sort(F.collect_list("b")).alias("best")))
    other = F.expr("get(filter(best, b -> b.rule_id <> rule_id), 0).rule_id")
    return own.where("whole").select("rule_id", "class").join(best, "class").select("rule_id", other.alias("redundant_to")).where("redundant_to is not null")


def _inside(kinds: DataFrame) -> DataFrame:
    """What kinds of branches lie in which: (a_kind, b_kind, size) of kinds that are one of several of a rule, and
    (a_kind, ordinal, rule) of the first two rules that hold a kind which is a rule's only one.

    Kinds of one shape are sorted by the field that tells most of them apart and cut to zones; only zones whose ends allow it meet.
    """
    spark = kinds.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tell = kinds.select("shape", F.posexplode("low").alias("pos", "v")).groupBy("shape", "pos").agg(F.approx_count_distinct("v").alias("n")).groupBy("shape").agg(F.max_by("pos", F.struct("n", -F.col("pos"))).alias("pos"))
    rows = kinds.join(tell, "shape").withColumn("at", F.col("low")[F.col("pos")]).drop("pos")
    rows = rows.repartitionByRange(n, "shape", "at").sortWithinPartitions("shape", "at").drop("at")
    zones = rows.mapInArrow(pairs.zones, pairs.ZONE).localCheckpoint()  # cut once: a zone is looked up by its name
    side = lambda p, *c: zones.select("shape", *(F.col(x).alias(f"{p}{x}") for x in c))
    may = F.expr("forall(zip_with(b_low_least, a_low_most, (y, x) -> y <= x), z -> z) and forall(zip_with(b_high_most, a_high_least, (y, x) -> y >= x), z -> z)")
    names = side("a_", "zone", "low_most", "high_least").join(side("b_", "zone", "low_least", "high_most"), "shape").where(may).select("a_zone", "b_zone")
    both = names.repartition(n, "a_zone", "b_zone").join(side("a_", "zone", "blob").drop("shape"), "a_zone").join(side("b_", "zone", "blob").drop("shape"), "b_zone")
    return both.select("a_blob", "b_blob").repartition(n).mapInArrow(pairs.held, pairs.HELD)


def dead_rules(cons: DataFrame, compat: bool = False) -> DataFrame:
    """(rule_id, field, reason): rules that can never fire because each of their branches contradicts itself on a field.

    compat: all of a rule's leaves are read as one conjunction, branches and all.
    """
    eq = F.when(F.col("op") == "==", F.coalesce(F.col("num").cast("string"), F.col("txt")))
    low = F.max(F.when(F.col("op").isin(">", ">=") & F.col("num").isNotNull(), F.struct("num", (F.col("op") == ">").cast("int").alias("o"))))
    high = F.min(F.when(F.col("op").isin("<", "<=") & F.col("num").isNotNull(), F.struct("num", (F.col("op") == "<=").cast("int").alias("i"))))
    by = ["rule_id", "field"] if compat else ["rule_id", "branch", "branches", "field"]
    per = cons.groupBy(*by).agg(F.count_distinct(eq).alias("values"), F.max(F.when(F.col("op") == "==", F.col("num"))).alias("eq"), F.max(F.when(F.col("op") == "==", F.col("txt"))).alias("text"), low.alias("lo"), high.alias("hi"))
    reason = (
        F.when(F.col("values") > 1, F.lit("conflicting equality values"))
        .when((F.col("lo.num") > F.col("hi.num")) | ((F.col("lo.num") == F.col("hi.num")) & ((F.col("lo.o") == 1) | (F.col("hi.i") == 0))), F.lit("contradictory bounds"))
        .when((F.col("eq") < F.col("lo.num")) | ((F.col("eq") == F.col("lo.num")) & (F.col("lo.o") == 1)), F.lit("equality conflicts with lower bound"))
        .when((F.col("eq") > F.col("hi.num")) | ((F.col("eq") == F.col("hi.num")) & (F.col("hi.i") == 0)), F.lit("equality conflicts with upper bound"))
        .when(F.col("text").isNotNull() & (F.col("lo").isNotNull() | F.col("hi").isNotNull()), F.lit("equality outside bounded interval"))
    )
    found = per.withColumn("reason", reason).where("reason is not null")
    if not compat:
        whole = found.groupBy("rule_id").agg(F.count_distinct("branch").alias("n"), F.first("branches").alias("all")).where("n = all").select("rule_id")
        found = found.join(whole, "rule_id", "left_semi")
    return found.select("rule_id", "field", "reason").distinct()


def gaps(cons: DataFrame, finite_only: bool = False) -> DataFrame:
    """(field, low, high): ranges of each number field that no rule covers; ends are -Infinity and Infinity."""
    islands = merged(cons.where("low is not null").select("field", "low", "high", "low_in", "high_in"), ["field"])
    w = Window.partitionBy("field").orderBy("low", "high")
    before = islands.select("field", F.coalesce(F.lag("high").over(w), F.lit(-INF)).alias("low"), F.col("low").alias("high"))
    after = islands.groupBy("field").agg(F.max("high").alias("low")).withColumn("high", F.lit(INF))
    out = before.unionByName(after).where("low < high")
    return out.where((F.col("low") > -INF) & (F.col("high") < INF)) if finite_only else out


def coverage(cons: DataFrame) -> DataFrame:
    """(field, rules, covered_ranges, uncovered_ranges)."""
    islands = merged(cons.where("low is not null").select("field", "low", "high", "low_in", "high_in"), ["field"]).groupBy("field").agg(F.count(F.lit(1)).alias("covered_ranges"))
    holes = gaps(cons).groupBy("field").agg(F.count(F.lit(1)).alias("uncovered_ranges"))
    rules = cons.where("low is not null").groupBy("field").agg(F.count_distinct("rule_id").alias("rules"))
    return rules.join(islands, "field").join(holes, "field", "left").select("field", "rules", "covered_ranges", F.coalesce("uncovered_ranges", F.lit(0)).cast("long").alias("uncovered_ranges"))


def duplicates(rules: DataFrame, with_action: bool = False) -> DataFrame:
    """(rule_id, duplicate_of): rules whose condition (and action) another has before them; the order of keys is no matter."""
    keys = ["condition"] + (["action"] if with_action else [])
    first = rules.where("condition is not null").groupBy(*keys).agg(F.min_by("rule_id", "ordinal").alias("duplicate_of"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return rules.join(first, keys).where("rule_id <> duplicate_of").select("rule_id", "duplicate_of")


def priority_collisions(rules: DataFrame) -> DataFrame:
    """(grp, priority, rules, rule_ids) of groups and priorities that several rules have."""
    return rules.groupBy("grp", "priority").agg(F.count(F.lit(1)).alias("rules"), F.array_join(F.array_sort(F.collect_list("rule_id")).cast("array<string>"), ",").alias("rule_ids")).where("rules > 1")


def constraint_graph(cons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields of each rule, and rules of each field."""
    edges = cons.select("rule_id", "field").distinct()
    return edges.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("fields")), edges.groupBy("field").agg(F.array_join(F.array_sort(F.collect_list("rule_id")).cast("array<string>"), ",").alias("rule_ids"))


def dependency_edges(cons: DataFrame) -> DataFrame:
    """(rule1, rule2, shared): pairs of rules that share fields."""
    e = cons.select("rule_id", "field").distinct()
    pairs = e.select(F.col("rule_id").alias("rule1"), "field").join(e.select(F.col("rule_id").alias("rule2"), "field"), "field").where("rule1 < rule2")
    return pairs.groupBy("rule1", "rule2").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("shared"))


def shared_fields(cons: DataFrame, top: int | None = None) -> DataFrame:
    """(field, rule_count, pair_count) of fields that several rules have: pairs by formula, not by joining."""
    out = cons.select("rule_id", "field").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("rule_count")).where("rule_count > 1")
    out = out.withColumn("pair_count", (F.col("rule_count") * (F.col("rule_count") - 1) / 2).cast("long"))
    return out.orderBy(F.desc("pair_count"), F.desc("rule_count"), "field").limit(top) if top else out


def connectivity(rules: DataFrame, cons: DataFrame) -> DataFrame:
    """(rule_id, connections, field_count, isolated)."""
    edges = dependency_edges(cons)
    ends = edges.select(F.col("rule1").alias("rule_id")).unionByName(edges.select(F.col("rule2").alias("rule_id"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("connections"))
    count = cons.groupBy("rule_id").agg(F.count_distinct("field").alias("field_count"))
    out = rules.select("rule_id").join(ends, "rule_id", "left").join(count, "rule_id", "left")
    return out.select("rule_id", F.coalesce("connections", F.lit(0)).cast("long").alias("connections"), F.coalesce("field_count", F.lit(0)).cast("long").alias("field_count")).withColumn("isolated", F.col("connections") == 0)


def top_rules(rules: DataFrame, cons: DataFrame, k: int = 10) -> DataFrame:
    """(rule_id, rule_name, connections, field_count) of the k rules that share fields with most others."""
    out = connectivity(rules, cons).join(rules.select("rule_id", "rule_name"), "rule_id")
    return out.orderBy(F.desc("connections"), F.desc("field_count"), "rule_id").limit(k).select("rule_id", "rule_name", "connections", "field_count")


def graph(rules: DataFrame, cons: DataFrame, group: str | None = None, field: str | None = None, name: str | None = None, max_nodes: int = 500) -> dict:
    """Nodes and edges for display; edges only up to max_nodes nodes or where a filter is given."""
    nodes = rules
    if group:
        nodes = nodes.where(F.col("grp") == group)
    if field:
        nodes = nodes.where(F.array_contains("fields", field))
    if name:
        nodes = nodes.where(F.lower("rule_name").contains(name.lower()))
    filtered = bool(group or field or name)
    detail = filtered or nodes.limit(max_nodes + 1).count() <= max_nodes
    own = cons.join(nodes.select("rule_id"), "rule_id", "left_semi")
    return {"nodes": nodes, "edges": dependency_edges(own) if detail else None, "summary_only": not detail, "fields": shared_fields(own)}


def similar(rules: DataFrame, candidate: Rule, top: int = 5, least: int = 30) -> DataFrame:
    """(rule_id, rule_name, score): 30 for the group, 20 where one name holds the other, 10 for each common field."""
    own = sorted(ir.fields(candidate.tree(True)))
    name = candidate.name.lower()
    score = F.when(F.col("grp") == (candidate.group or "default"), 30).otherwise(0) + F.when(F.lower("rule_name").contains(name) | F.lit(name).contains(F.lower("rule_name")), 20).otherwise(0)
    score = score + 10 * F.size(F.array_intersect("fields", F.array(*[F.lit(x) for x in own]).cast("array<string>")))
    out = rules.where(F.col("rule_id") != candidate.id).select("rule_id", "rule_name", score.cast("long").alias("score")).where(F.col("score") >= least)
    return out.orderBy(F.desc("score"), "rule_id").limit(top)


def satisfiable(node, limit: int = 100_000) -> bool | None:
    """Whether some event can meet a tree: exact for bounds, equalities and memberships under AND, OR and NOT; None beyond limit."""
    for k, term in enumerate(conjunctions(node)):
        if k >= limit:
            return None
        if _possible(term):
            return True
    return False


def _possible(term: tuple) -> bool:
    for _, own in itertools.groupby(sorted(term, key=lambda x: x.field), key=lambda x: x.field):
        own = list(own)
        low, high, allowed, banned = (-INF, True), (INF, True), None, set()
        absent = any(x.op == "not_exists" for x in own)
        if absent and len(own) > sum(x.op == "not_exists" for x in own):
            return False
        for x in own:
            i = interval(x.op, x.value)
            if x.op in ("==", "in"):
                values = {x.value} if x.op == "==" else set(x.value) if isinstance(x.value, tuple) else None
                if values is not None:
                    allowed = values if allowed is None else allowed & values
            elif x.op in ("!=", "not_in"):
                banned |= {x.value} if x.op == "!=" else set(x.value) if isinstance(x.value, tuple) else set()
            elif i:
                low = max(low, (i[0], not i[2])) if x.op in (">", ">=") else low
                high = min(high, (i[1], i[3])) if x.op in ("<", "<=") else high
        inside = lambda v: isinstance(v, (int, float)) and (v > low[0] or (v == low[0] and not low[1])) and (v < high[0] or (v == high[0] and high[1]))
        bounded = low[0] > -INF or high[0] < INF
        if allowed is not None:
            if not any(v not in banned and (not bounded or inside(v)) for v in allowed):
                return False
        elif bounded and (low[0] > high[0] or (low[0] == high[0] and (low[1] or not high[1] or low[0] in banned))):
            return False
    return True


def sat_report(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, satisfiable): worked out for each rule's own tree on the driver, whose size the tree alone decides."""
    return spark.createDataFrame([(r.id, satisfiable(r.tree(True))) for r in rules], "rule_id long, satisfiable boolean")


def import_findings(spark: SparkSession, candidates: list[Rule], rules: list[Rule]) -> tuple[dict, dict, dict]:
    """What speaks against candidates, in one pass over all: (place: dead reason), (place: an existing rule that overlaps), and of the
    other places (place: those of earlier candidates that overlap), which the caller resolves in order.

    Equal conditions, names and priorities need no join. Constraints of all candidates are one table; a rule with the candidate's
    id does not speak against it.
    """
    own = [replace(r, id=-1 - i) for i, r in enumerate(candidates)]
    mine = constraints(spark, own).cache()
    dead = {-1 - r["rule_id"]: r["reason"] for r in dead_rules(mine).groupBy("rule_id").agg(F.min("reason").alias("reason")).collect()}
    peers = [r for r in rules if r.enabled]
    names = spark.createDataFrame([(-1 - i, r.id) for i, r in enumerate(candidates)], "rule1 long, own long")
    first = {}
    if peers:
        met = conflicts(constraints(spark, peers).unionByName(mine), candidate=mine).where("rule2 >= 0").join(names, "rule1").where("rule2 <> own")
        first = {-1 - r["rule1"]: (r["rule2"], r["fields"]) for r in met.groupBy("rule1").agg(F.min_by(F.struct("rule2", "fields"), "rule2").alias("f")).select("rule1", "f.*").collect()}
    left = mine.where(~F.col("rule_id").isin([-1 - i for i in {*dead, *first}])) if dead or first else mine
    earlier: dict[int, list] = {}
    for r in conflicts(left).select(F.greatest("rule1", "rule2").alias("early"), F.least("rule1", "rule2").alias("late"), "fields").collect():
        earlier.setdefault(-1 - r["late"], []).append((-1 - r["early"], r["fields"]))
    mine.unpersist()
    return dead, first, earlier


def validate_candidate(spark: SparkSession, candidate: Rule, rules: Iterable[Rule]) -> DataFrame:
    """(type, rule_id, other, detail): what speaks against writing a rule, next to those that exist."""
    peers = [r for r in rules if r.id != candidate.id and r.enabled]
    table, own = rule_table(spark, [*peers, candidate]), rule_table(spark, [candidate])
    same = ["condition", "action"]
    dup = table.where(F.col("rule_id") != candidate.id).join(own.select(*same), same).select(F.lit("duplicate_condition").alias("type"), F.col("rule_id").alias("other"), F.lit("same condition and action").alias("detail"))
    clash = table.where((F.col("rule_id") != candidate.id) & (F.col("grp") == (candidate.group or "default")) & (F.col("priority") == candidate.priority)).select(F.lit("priority_collision").alias("type"), F.col("rule_id").alias("other"), F.col("priority").cast("string").alias("detail"))
    named = table.where((F.col("rule_id") != candidate.id) & (F.col("rule_name") == candidate.name)).select(F.lit("duplicate_name").alias("type"), F.col("rule_id").alias("other"), F.col("rule_name").alias("detail"))
    mine = constraints(spark, [candidate])
    over = conflicts(constraints(spark, peers), candidate=mine).select(F.lit("overlap").alias("type"), F.col("rule2").alias("other"), F.col("fields").alias("detail"))
    dead = dead_rules(mine).select(F.lit("dead_rule").alias("type"), F.lit(None).cast("long").alias("other"), F.col("reason").alias("detail"))
    out = dup.unionByName(clash).unionByName(named).unionByName(over).unionByName(dead)
    return out.select("type", F.lit(candidate.id).cast("long").alias("rule_id"), "other", "detail").withColumn("blocking", F.col("type").isin(*sorted(BLOCKING)))

"""One query for each operator of the engine, over the whole tables, and SQL that gives the same rows on another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sdk
from .functions.text import hmac_sha256
from .operators import analysis, analytics, catalog, matcher, stateful
from .operators.matcher import Rule, match
from .plans import ir
from .plans.compiler import Fields, Flags, compile_tree, truth
from .sources.rules import events_from_json
from .streaming import sessions

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            SQL[key] = sql
        return function

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def leaf(field, op, value=None) -> dict:
    return {"type": "condition", "field": field, "op": op, "value": value}


def group(op, *children) -> dict:
    return {"type": "group", "op": op, "children": list(children)}


def quoted(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows, columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({columns})"


# --- matching ---------------------------------------------------------------------------------------------------------

THRESHOLDS = [(1, "large", 10, "review", 200000.0), (2, "medium", 5, "sample", 100000.0), (3, "small", 5, "log", 50000.0)]
THREE = [Rule(i, n, leaf("o_totalprice", ">", t), a, p) for i, n, p, a, t in THRESHOLDS]
_MATCH = f"FROM orders o JOIN (SELECT * FROM {values(THRESHOLDS, 'rule_id, rule_name, priority, action, threshold')}) r ON o.o_totalprice > r.threshold"
_CELLS = "o.o_orderkey, CAST(r.rule_id AS BIGINT) AS rule_id, r.rule_name, CAST(r.priority AS INTEGER) AS priority, r.action"


@query(f"SELECT {_CELLS} {_MATCH}")
def rule_match(spark, d):
    return match(table(spark, d, "orders"), THREE, "o_orderkey", execution_order=False)


_ORDER = f"SELECT {_CELLS}, CAST(row_number() OVER (PARTITION BY o.o_orderkey ORDER BY r.priority DESC, r.rule_id) AS INTEGER) AS exec_order {_MATCH}"


@query(_ORDER)
def exec_order(spark, d):
    return match(table(spark, d, "orders"), THREE, "o_orderkey")


@query(f"SELECT * FROM ({_ORDER}) WHERE exec_order = 1")
def top_activation(spark, d):
    return matcher.top_activation(match(table(spark, d, "orders"), THREE, "o_orderkey"))


def _where(name: str, of: str, key: str, tree: dict, sql: str):
    def run(spark, d):
        df = table(spark, d, of)
        return df.where(compile_tree(ir.parse(tree), df.schema)).select(*key.split(", "))

    query(f"SELECT {key} FROM {of} WHERE {sql}", name)(run)


TREE = group("AND", group("OR", leaf("o_orderstatus", "==", "F"), leaf("o_totalprice", ">", 250000)), group("NOT", leaf("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])), leaf("o_totalprice", ">=", 20000))
_where("tree_and_or_not", "orders", "o_orderkey", TREE, "(o_orderstatus = 'F' OR o_totalprice > 250000) AND NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false) AND o_totalprice >= 20000")
for _n, _op, _sql in (("gt", ">", ">"), ("ge", ">=", ">="), ("lt", "<", "<"), ("le", "<=", "<="), ("eq", "==", "="), ("ne", "!=", "<>")):
    _where(f"leaf_{_n}", "lineitem", "l_orderkey, l_linenumber", leaf("l_quantity", _op, 25), f"l_quantity {_sql} 25")
_where("leaf_in", "orders", "o_orderkey", leaf("o_orderstatus", "in", ["F", "P"]), "o_orderstatus IN ('F', 'P')")
_where("leaf_not_in", "orders", "o_orderkey", leaf("o_orderstatus", "not_in", ["F", None]), "o_orderstatus NOT IN ('F')")
_where("leaf_in_text", "orders", "o_orderkey", leaf("o_orderstatus", "in", "FPX"), "contains('FPX', o_orderstatus)")
_where("leaf_contains", "part", "p_partkey", leaf("p_name", "contains", "a"), "p_name LIKE '%a%'")
_where("leaf_starts_with", "part", "p_partkey", leaf("p_brand", "starts_with", "Brand#1"), "p_brand LIKE 'Brand#1%'")
_where("leaf_ends_with", "part", "p_partkey", leaf("p_brand", "ends_with", "3"), "p_brand LIKE '%3'")
_where("leaf_starts_with_number", "orders", "o_orderkey", leaf("o_orderkey", "starts_with", 12), "CAST(o_orderkey AS VARCHAR) LIKE '12%'")
_where("leaf_regex", "documents", "doc_id", leaf("text", "regex", "[A-D][a-z]+ [a-z]"), "regexp_matches(text, '^(?:[A-D][a-z]+ [a-z])')")
_where("leaf_bool_as_int", "labels", "doc_id", group("AND", leaf("quality", "==", True), leaf("toxic", "!=", True)), "quality = 1 AND toxic <> 1")
_where("page_urls", "pages", "page_id", group("OR", leaf("url", "starts_with", "https://blog."), leaf("url", "ends_with", ".html")), "url LIKE 'https://blog.%' OR url LIKE '%.html'")
_where("customer_rules", "customer", "c_custkey", group("AND", leaf("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), leaf("c_acctbal", ">", 0)), "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
_where("cross_type_leaf", "orders", "o_orderkey", group("AND", leaf("o_totalprice", "!=", "100"), group("NOT", leaf("o_orderstatus", "==", 5))), "o_totalprice IS NOT NULL")
_where("missing_field", "orders", "o_orderkey", group("AND", leaf("no_such_field", "not_exists"), group("NOT", leaf("no_such_field", "!=", 1)), leaf("o_orderkey", "exists")), "true")


@query("SELECT event_id FROM (SELECT event_id, nullif(CAST(json_extract_string(props, '$.k') AS BIGINT), 5) AS x FROM events) WHERE NOT coalesce(x <> 7, false)")
def not_null_semantics(spark, d):
    df = events_from_json(table(spark, d, "events"), "props", {"k": "bigint"}).withColumn("x", F.nullif("k", F.lit(5)))
    return df.where(compile_tree(ir.parse(group("NOT", leaf("x", "!=", 7))), df.schema)).select("event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 80")
def json_field_rule(spark, d):
    df = events_from_json(table(spark, d, "events"), "props", {"k": "bigint"})
    return df.where(compile_tree(ir.parse(leaf("k", ">", 80)), df.schema)).select("event_id", "k")


@query("SELECT count(*) FILTER (json_exists(props, '$.k')) AS present, count(*) FILTER (NOT json_exists(props, '$.zz')) AS absent FROM events")
def leaf_exists_json(spark, d):
    df = events_from_json(table(spark, d, "events"), "props", {"k": "bigint", "zz": "bigint"})
    return df.agg(F.count_if("__has_k").alias("present"), F.count_if(~F.col("__has_zz")).alias("absent"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice > 100000")
def strict_flags(spark, d):
    df = table(spark, d, "orders")
    tree = ir.parse(group("AND", leaf("o_orderstatus", "!=", None), leaf("o_totalprice", ">", 100000), group("NOT", leaf("o_orderstatus", ">", 5))))
    return df.where(compile_tree(tree, df.schema, Flags(strict_nulls=True, strict_types=True))).select("o_orderkey")


MANY = [(i, f"r{i}", i % 7, f"a{i % 20}", float(1000 * (i // 10) * 5 + 1000)) for i in range(1, 101)]


@query(f"SELECT CAST(r.rule_id AS BIGINT) AS rule_id, count(*) AS hit_count FROM orders o JOIN (SELECT * FROM {values(MANY, 'rule_id, rule_name, priority, action, threshold')}) r ON o.o_totalprice > r.threshold GROUP BY r.rule_id")
def shared_alpha_ruleset(spark, d):
    rules = [Rule(i, n, leaf("o_totalprice", ">", t), a, p) for i, n, p, a, t in MANY]
    return analytics.rule_hits(match(table(spark, d, "orders"), rules, "o_orderkey", execution_order=False))


@query("SELECT o_orderkey, CAST(7 AS BIGINT) AS rule_id, 'Rule ''urgent'' matched: ([✓ o_orderstatus=F == F] AND [✓ o_custkey=' || o_custkey || ' > 700]) | Matching conditions: o_orderstatus=F == F, o_custkey=' || o_custkey || ' > 700' AS explanation FROM orders WHERE o_orderstatus = 'F' AND o_custkey > 700")
def explanations(spark, d):
    rules = [Rule(7, "urgent", group("AND", leaf("o_orderstatus", "==", "F"), leaf("o_custkey", ">", 700)), "alert", 1)]
    return match(table(spark, d, "orders"), rules, "o_orderkey", explain=True).select("o_orderkey", "rule_id", "explanation")


@query("SELECT CAST(0 AS BIGINT) AS null_evaluations, count(*) AS type_mismatches, CAST(0 AS BIGINT) AS bool_coercions FROM orders")
def strictness_counts(spark, d):
    return matcher.strictness(table(spark, d, "orders"), [Rule(1, "a", group("AND", leaf("o_totalprice", ">", 5), leaf("o_orderstatus", ">", 5)))])


# --- analytics --------------------------------------------------------------------------------------------------------

FOUR = [*THREE, Rule(4, "never", leaf("o_totalprice", "<", -1), "none", 1)]
_HITS = f"SELECT CAST(r.rule_id AS BIGINT) AS rule_id, count(*) AS hit_count {_MATCH} GROUP BY r.rule_id"


def _matches(spark, d):
    return match(table(spark, d, "orders"), FOUR, "o_orderkey", execution_order=False)


@query(_HITS)
def rule_hits(spark, d):
    return analytics.rule_hits(_matches(spark, d))


@query(f"SELECT h.rule_id, r.rule_name, h.hit_count FROM (SELECT * FROM ({_HITS}) ORDER BY hit_count DESC, rule_id LIMIT 2) h LEFT JOIN {values([(r.id, r.name) for r in FOUR], 'rule_id, rule_name').replace(' AS t(', ' AS r(')} ON h.rule_id = r.rule_id")
def hot_rules(spark, d):
    hot = analytics.hot_rules(analytics.rule_hits(_matches(spark, d)), 2)
    return analytics.with_names(hot, analysis.rule_table(spark, FOUR)).select("rule_id", "rule_name", "hit_count")


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_name FROM {values([(r.id, r.name) for r in FOUR if r.enabled], 'rule_id, rule_name')} WHERE rule_id NOT IN (SELECT rule_id FROM ({_HITS}))")
def cold_rules(spark, d):
    return analytics.cold_rules(analysis.rule_table(spark, FOUR), _matches(spark, d))


@query(f"SELECT CAST(4 AS BIGINT) AS total_rules, count(DISTINCT rule_id) AS triggered_rules, 4 - count(DISTINCT rule_id) AS never_fired, CAST(sum(hit_count) AS BIGINT) AS total_hits, round(100.0 * count(DISTINCT rule_id) / 4, 2) AS coverage_pct FROM ({_HITS})")
def coverage_summary(spark, d):
    return analytics.coverage_summary(analysis.rule_table(spark, FOUR), _matches(spark, d))


# --- stateful ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS DECIMAL(18,2))) > 60")
def accumulate_group_having(spark, d):
    return stateful.accumulate(table(spark, d, "lineitem"), {"type": "accumulate", "over": {"field": "l_returnflag", "op": "==", "value": "R"}, "group_by": ["l_orderkey"], "aggregate": [{"op": "count", "as": "n"}, {"op": "sum", "field": "l_quantity", "as": "qty"}], "constraint": {"field": "accumulate.qty", "op": ">", "value": 60}})


@query("SELECT count(*) AS count, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_quantity FROM lineitem")
def accumulate_global(spark, d):
    return stateful.accumulate(table(spark, d, "lineitem"), {"type": "accumulate", "over": "*", "aggregate": ["count", {"op": "sum", "field": "l_quantity"}]})


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS mean")
def accumulate_empty(spark, d):
    return stateful.accumulate(table(spark, d, "lineitem"), {"type": "accumulate", "over": {"field": "l_quantity", "op": "<", "value": 0}, "aggregate": [{"op": "count", "as": "n"}, {"op": "sum", "field": "l_quantity", "as": "total"}, {"op": "avg", "field": "l_quantity", "as": "mean"}]})


@query("SELECT l_suppkey, count(*) AS count, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_l_quantity FROM lineitem GROUP BY l_suppkey")
def accumulate_multi_agg(spark, d):
    return stateful.accumulate(table(spark, d, "lineitem"), {"type": "accumulate", "over": "*", "group_by": "l_suppkey", "aggregate": ["count"] + [{"op": o, "field": "l_quantity"} for o in ("sum", "min", "max", "avg")]})


@query("SELECT event_type, count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 86400 SECOND GROUP BY event_type")
def accumulate_trailing_window(spark, d):
    return stateful.accumulate(table(spark, d, "events"), {"type": "accumulate", "over": "*", "window": {"duration_seconds": 86400}, "group_by": ["event_type"], "aggregate": "count"}, now="2024-01-20 00:00:00", time_col="ts")


@query("SELECT l_orderkey FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey HAVING sum(CAST(l_quantity AS DECIMAL(18,2))) >= 150")
def nested_accumulate(spark, d):
    facts = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag")).alias("lines"))
    tree = ir.parse({"type": "accumulate", "source": "lines", "field": "l_quantity", "aggregate": "sum", "op": ">=", "value": 150, "where": leaf("l_quantity", ">", 10)})
    return facts.where(compile_tree(tree, facts.schema)).select("l_orderkey")


@query("""WITH a AS (SELECT conv_id, min(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id), b AS (SELECT c.conv_id, min(c.turn) AS t FROM conversations c JOIN a ON c.conv_id = a.conv_id AND c.turn > a.t WHERE role = 'assistant' GROUP BY c.conv_id)
SELECT DISTINCT c.conv_id FROM conversations c JOIN b ON c.conv_id = b.conv_id AND c.turn > b.t WHERE role = 'user'""")
def nested_sequence(spark, d):
    facts = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    tree = ir.parse({"type": "sequence", "source": "turns", "steps": [leaf("role", "==", r) for r in ("user", "assistant", "user")]})
    return facts.where(compile_tree(tree, facts.schema)).select("conv_id")


def _steps(*kinds):
    return [leaf("event_type", "==", k) for k in kinds]


@query("SELECT a.event_id AS id_1, b.event_id AS id_2 FROM events a JOIN events b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.ts < b.ts AND a.ts >= b.ts - INTERVAL 86400 SECOND AND a.event_id < b.event_id WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def sequence_2(spark, d):
    return stateful.sequence(table(spark, d, "events"), {"type": "sequence", "steps": _steps("view", "purchase"), "within_window_seconds": 86400, "correlate_on": ["user_id"]}, "ts", "event_id", "event_id")


@query("""SELECT a.event_id AS id_1, b.event_id AS id_2, c.event_id AS id_3 FROM events a JOIN events b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.ts < b.ts JOIN events c ON b.user_id IS NOT DISTINCT FROM c.user_id AND b.ts < c.ts
WHERE a.event_type = 'signup' AND b.event_type = 'view' AND c.event_type = 'purchase' AND a.ts >= c.ts - INTERVAL 172800 SECOND AND a.event_id < c.event_id AND b.event_id < c.event_id""")
def sequence_3_window(spark, d):
    return stateful.sequence(table(spark, d, "events"), {"type": "sequence", "steps": _steps("signup", "view", "purchase"), "within": {"value": 2, "unit": "days"}, "correlate_on": ["user_id"]}, "ts", "event_id", "event_id")


_SEEN = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events WHERE user_id IS NOT NULL"


@query(f"SELECT event_id, seen FROM ({_SEEN}) WHERE seen > 1")
def cross_fact(spark, d):
    return stateful.cross_fact_count(table(spark, d, "events"), "user_id", "event_id").select("event_id", "seen")


@query(f"SELECT event_id FROM ({_SEEN}) WHERE seen > 1")
def cross_fact_later(spark, d):
    return stateful.cross_fact_later(table(spark, d, "events"), "user_id", "event_id").select("event_id")


def _sides(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.where("event_type = 'signup'"), e.where("event_type = 'error'")


_SIDES = "(SELECT *, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'signup') a JOIN (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error') b"


@query(f"SELECT a.event_id AS left_id, b.event_id AS right_id FROM {_SIDES} ON a.user_id = b.user_id AND a.day = b.day")
def cross_fact_join_all(spark, d):
    return stateful.cross_fact_join(*_sides(spark, d), [("user_id", "user_id"), ("day", "day")])


@query(f"SELECT a.event_id AS left_id, b.event_id AS right_id FROM {_SIDES} ON a.user_id = b.user_id OR a.value = b.value")
def cross_fact_join_any(spark, d):
    return stateful.cross_fact_join(*_sides(spark, d), [("user_id", "user_id"), ("value", "value")], "any")


@query("SELECT event_id, seen FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events WHERE event_id % 7 <> 0) WHERE seen > 1")
def retract(spark, d):
    events = table(spark, d, "events")
    left = stateful.retract(events, events.where("event_type is not null and event_id % 7 = 0"), "event_id")
    return stateful.cross_fact_count(left, "user_id", "event_id").select("event_id", "seen")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10")
def wm_fifo(spark, d):
    return stateful.keep_newest(table(spark, d, "events"), "user_id", "event_id", 10).select("event_id")


@query("SELECT event_id FROM (SELECT event_id, sum(octet_length(encode(props))) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b FROM events) WHERE b <= 100")
def wm_lru(spark, d):
    return stateful.keep_budget(table(spark, d, "events"), "user_id", "event_id", 100, F.col("props")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 3600 SECOND")
def wm_window(spark, d):
    return stateful.trailing(table(spark, d, "events"), "2024-01-25 12:00:00", 3600, "ts").select("event_id")


@query("SELECT event_id FROM events WHERE user_id IS NOT DISTINCT FROM 17")
def wm_by_field(spark, d):
    return stateful.by_field(table(spark, d, "events"), "user_id", 17).select("event_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) AS turn FROM events WHERE event_type = 'purchase'")
def agenda_order(spark, d):
    own = table(spark, d, "events").where("event_type = 'purchase'").withColumn("priority", F.col("event_id") % 3).withColumn("recency", F.col("event_id")).withColumn("specificity", F.lit(1))
    return stateful.agenda(own, "user_id").select("event_id", F.col("turn").cast("long").alias("turn"))


# --- analysis of rule sets --------------------------------------------------------------------------------------------

SET = [
    Rule(1, "adult", leaf("age", ">=", 18), "allow", 10, "age"),
    Rule(2, "senior", leaf("age", ">=", 65), "discount", 10, "age"),
    Rule(3, "impossible", group("AND", leaf("age", ">", 60), leaf("age", "<", 50)), "never", 5, "age"),
    Rule(4, "teen", group("AND", leaf("age", ">", 12), leaf("age", "<", 18), leaf("country", "==", "NL")), "ask", 3, "age"),
    Rule(5, "teen abroad", group("AND", leaf("age", ">=", 13), leaf("age", "<=", 17), leaf("country", "==", "UK")), "deny", 3, "age"),
    Rule(6, "rich", leaf("income", ">", 90000), "offer", 1, "money"),
    Rule(7, "rich again", leaf("income", ">", 90000), "offer", 2, "money"),
    Rule(8, "poor", leaf("income", "<=", 10000), "help", 2, "money"),
]
_BOUNDS = [(r.id, r.group, r.action, f, *i) for r in SET for x in ir.leaves(r.tree()) if (i := analysis.interval(x.op, x.value)) for f in [x.field]]
_I = f"SELECT rule_id, grp, action, field, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, li, hi FROM {values([tuple(str(c) if c in (analysis.INF, -analysis.INF) else c for c in b) for b in [(a, g, x, f, str(lo), str(hi), p, q) for a, g, x, f, lo, hi, p, q in _BOUNDS]], 'rule_id, grp, action, field, low, high, li, hi')}"
#: One interval for each rule and field: the intersection of its bounds.
_X = f"SELECT rule_id, grp, action, field, max(low) AS low, min(high) AS high, bool_and(li OR low < ml) AS li, bool_and(hi OR high > mh) AS hi FROM (SELECT *, max(low) OVER (PARTITION BY rule_id, field) AS ml, min(high) OVER (PARTITION BY rule_id, field) AS mh FROM ({_I})) GROUP BY rule_id, grp, action, field"
_MEET = "(greatest(a.low, b.low) < least(a.high, b.high) OR (greatest(a.low, b.low) = least(a.high, b.high) AND (a.li OR a.low < b.low) AND (b.li OR b.low < a.low) AND (a.hi OR a.high > b.high) AND (b.hi OR b.high > a.high)))"
_TEXTS = f"SELECT * FROM {values([(r.id, x.field, x.value) for r in SET for x in ir.leaves(r.tree()) if isinstance(x.value, str)], 'rule_id, field, txt')}"
_PAIRS = f"SELECT CAST(a.rule_id AS BIGINT) AS rule1, CAST(b.rule_id AS BIGINT) AS rule2, a.grp, a.field FROM ({_X}) a JOIN ({_X}) b ON a.grp = b.grp AND a.field = b.field AND a.rule_id < b.rule_id AND a.action <> b.action AND {_MEET} WHERE NOT EXISTS (SELECT 1 FROM ({_TEXTS}) x JOIN ({_TEXTS}) y ON x.field = y.field AND x.txt <> y.txt WHERE x.rule_id = a.rule_id AND y.rule_id = b.rule_id)"


def _cons(spark):
    return analysis.constraints(spark, SET)


@query(f"SELECT rule1, rule2, grp, field AS fields FROM ({_PAIRS})")
def conflicts_full(spark, d):
    return analysis.conflicts(_cons(spark), exact=True)


@query(f"SELECT CAST(2 AS BIGINT) AS rule1, CASE WHEN rule1 = 2 THEN rule2 ELSE rule1 END AS rule2, grp, field AS fields FROM ({_PAIRS}) WHERE 2 IN (rule1, rule2)")
def conflicts_candidate(spark, d):
    return analysis.conflicts(analysis.constraints(spark, [r for r in SET if r.id != 2]), exact=True, candidate=analysis.constraints(spark, [SET[1]]))


_IN = "((b.low < a.low OR (b.low = a.low AND (b.li OR NOT a.li))) AND (b.high > a.high OR (b.high = a.high AND (b.hi OR NOT a.hi))))"


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(min(other) AS BIGINT) AS redundant_to FROM (SELECT a.rule_id, b.rule_id AS other, count(DISTINCT (a.field, a.low, a.high)) AS n FROM ({_I}) a JOIN ({_I}) b ON a.field = b.field AND a.rule_id <> b.rule_id AND {_IN} GROUP BY 1, 2) JOIN (SELECT rule_id AS r, count(DISTINCT (field, low, high)) AS n_all FROM ({_I}) GROUP BY 1) ON r = rule_id AND n = n_all GROUP BY 1")
def redundancy(spark, d):
    return analysis.redundancies(_cons(spark), exact=False)


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, field, 'contradictory bounds' AS reason FROM ({_X}) WHERE low > high OR (low = high AND NOT (li AND hi))")
def dead_rules(spark, d):
    return analysis.dead_rules(_cons(spark))


_RUN = f"SELECT field, low, high, CASE WHEN low > coalesce(max(high) OVER (PARTITION BY field ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('-inf' AS DOUBLE)) THEN coalesce(max(high) OVER (PARTITION BY field ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('-inf' AS DOUBLE)) END AS hole FROM ({_I})"


@query(f"SELECT field, hole AS low, low AS high FROM ({_RUN}) WHERE hole IS NOT NULL UNION ALL SELECT field, max(high), CAST('inf' AS DOUBLE) FROM ({_I}) GROUP BY field HAVING max(high) < CAST('inf' AS DOUBLE)")
def gaps(spark, d):
    return analysis.gaps(_cons(spark))


@query(f"SELECT i.field, count(DISTINCT i.rule_id) AS rules, any_value(c.n) AS covered_ranges, any_value(c.holes) AS uncovered_ranges FROM ({_I}) i JOIN (SELECT field, count(*) FILTER (hole IS NOT NULL OR low = CAST('-inf' AS DOUBLE) AND first) AS n, count(*) FILTER (hole IS NOT NULL) + CASE WHEN max(high) < CAST('inf' AS DOUBLE) THEN 1 ELSE 0 END AS holes FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY low, high) = 1 AS first FROM ({_RUN})) GROUP BY field) c ON c.field = i.field GROUP BY i.field")
def coverage(spark, d):
    return analysis.coverage(_cons(spark))


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(first AS BIGINT) AS duplicate_of FROM (SELECT rule_id, min(rule_id) OVER (PARTITION BY condition) AS first FROM {values([(r.id, ir.canonical(r.condition)) for r in SET], 'rule_id, condition')}) WHERE rule_id <> first")
def duplicate_rules(spark, d):
    return analysis.duplicates(analysis.rule_table(spark, SET))


@query(f"SELECT grp, CAST(priority AS INTEGER) AS priority, count(*) AS rules, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id) AS rule_ids FROM {values([(r.id, r.group, r.priority) for r in SET], 'rule_id, grp, priority')} GROUP BY grp, priority HAVING count(*) > 1")
def priority_collisions(spark, d):
    return analysis.priority_collisions(analysis.rule_table(spark, SET))


_E = f"SELECT DISTINCT rule_id, field FROM {values([(r.id, x.field) for r in SET for x in ir.leaves(r.tree())], 'rule_id, field')}"


@query(f"SELECT field, string_agg(CAST(rule_id AS VARCHAR), ',' ORDER BY rule_id) AS rule_ids FROM ({_E}) GROUP BY field")
def constraint_graph(spark, d):
    return analysis.constraint_graph(_cons(spark))[1]


@query(f"SELECT CAST(a.rule_id AS BIGINT) AS rule1, CAST(b.rule_id AS BIGINT) AS rule2, string_agg(a.field, ',' ORDER BY a.field) AS shared FROM ({_E}) a JOIN ({_E}) b ON a.field = b.field AND a.rule_id < b.rule_id GROUP BY 1, 2")
def dependency_edges(spark, d):
    return analysis.dependency_edges(_cons(spark))


@query(f"SELECT field, count(*) AS rule_count, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pair_count FROM ({_E}) GROUP BY field HAVING count(*) > 1")
def dependency_summary(spark, d):
    return analysis.shared_fields(_cons(spark))


LONE = [*SET, Rule(9, "lonely", leaf("shoe_size", ">", 44), "note", 1, "misc")]


_L = f"SELECT DISTINCT rule_id, field FROM {values([(r.id, x.field) for r in LONE for x in ir.leaves(r.tree())], 'rule_id, field')}"


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(0 AS BIGINT) AS connections, count(*) AS field_count FROM ({_L}) a WHERE rule_id NOT IN (SELECT x.rule_id FROM ({_L}) x JOIN ({_L}) y ON x.field = y.field AND x.rule_id <> y.rule_id) GROUP BY rule_id")
def isolated_rules(spark, d):
    return analysis.connectivity(analysis.rule_table(spark, LONE), analysis.constraints(spark, LONE)).where("isolated").drop("isolated")


@query(f"SELECT CAST(n.rule_id AS BIGINT) AS rule_id, n.rule_name, count(DISTINCT b.rule_id) AS connections, any_value(f.n) AS field_count FROM {values([(r.id, r.name) for r in SET], 'rule_id, rule_name').replace('AS t(', 'AS n(')} JOIN ({_E}) a ON a.rule_id = n.rule_id LEFT JOIN ({_E}) b ON a.field = b.field AND a.rule_id <> b.rule_id JOIN (SELECT rule_id, count(*) AS n FROM ({_E}) GROUP BY rule_id) f ON f.rule_id = n.rule_id GROUP BY n.rule_id, n.rule_name ORDER BY connections DESC, field_count DESC, rule_id LIMIT 5")
def top_rules(spark, d):
    return analysis.top_rules(analysis.rule_table(spark, SET), _cons(spark), 5)


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, rule_name, CAST(score AS BIGINT) AS score FROM (SELECT rule_id, rule_name, CASE WHEN grp = 'age' THEN 30 ELSE 0 END + CASE WHEN rule_name LIKE '%teen%' OR contains('teen', rule_name) THEN 20 ELSE 0 END + 10 * has_age AS score FROM {values([(r.id, r.name, r.group, int('age' in ir.fields(r.tree()))) for r in SET], 'rule_id, rule_name, grp, has_age')}) WHERE score >= 30 ORDER BY score DESC, rule_id LIMIT 5")
def similar_rules(spark, d):
    return analysis.similar(analysis.rule_table(spark, SET), Rule(99, "teen", leaf("age", ">", 1), "x", 0, "age"))


# rules made from the parts: up to two branches, two fields, thousands of rules


def _many(spark, d):
    k, size, price, inf = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(float("inf"))

    def bound(branch, field, op, num, low, high, low_in, high_in):
        return F.struct(F.lit(branch).alias("branch"), F.lit(field).alias("field"), F.lit(op).alias("op"), num.alias("num"), low.alias("low"), high.alias("high"), F.lit(low_in).alias("low_in"), F.lit(high_in).alias("high_in"))

    top = size + (k % 4) - 1
    first = F.array(bound(0, "size", ">=", size, size, inf, True, False), bound(0, "size", "<=", top, -inf, top, False, True), bound(0, "price", ">=", price, price, inf, True, False), bound(0, "price", "<", price + 0.5, -inf, price + 0.5, False, False))
    second = F.array(bound(1, "size", "==", size, size, size, True, True))
    two = k % 3 == 0
    rows = table(spark, d, "part").select(k.alias("rule_id"), k.cast("int").alias("ordinal"), F.col("p_name").alias("rule_name"), F.col("p_brand").alias("grp"), F.col("p_type").alias("action"), F.lit(0).alias("priority"), F.when(two, 2).otherwise(1).alias("branches"), F.explode(F.when(two, F.concat(first, second)).otherwise(first)).alias("x"))
    return rows.select("rule_id", "ordinal", "rule_name", "grp", "action", "priority", "x.branch", "branches", "x.field", "x.op", "x.num", F.lit(None).cast("string").alias("txt"), "x.low", "x.high", "x.low_in", "x.high_in")


@query("SELECT p_partkey AS rule_id, 'size' AS field, 'contradictory bounds' AS reason FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 3 <> 0")
def dead_rules_or(spark, d):
    return analysis.dead_rules(_many(spark, d))


_BRANCHES = "SELECT p_partkey AS k, p_brand AS g, p_type AS a, CAST(p_size AS DOUBLE) AS s, p_size + p_partkey % 4 - 1.0::DOUBLE AS t, p_retailprice AS r, p_retailprice + 0.5::DOUBLE AS u FROM part UNION ALL SELECT p_partkey, p_brand, p_type, p_size, p_size, NULL, NULL FROM part WHERE p_partkey % 3 = 0"


@query(f"SELECT x.k AS rule1, y.k AS rule2, any_value(x.g) AS grp, CASE WHEN bool_or(x.r IS NOT NULL AND y.r IS NOT NULL) THEN 'price,size' ELSE 'size' END AS fields FROM ({_BRANCHES}) x JOIN ({_BRANCHES}) y ON x.g = y.g AND x.k < y.k AND x.a <> y.a AND greatest(x.s, y.s) <= least(x.t, y.t) AND (x.r IS NULL OR y.r IS NULL OR greatest(x.r, y.r) < least(x.u, y.u)) GROUP BY 1, 2")
def conflicts_or(spark, d):
    return analysis.conflicts(_many(spark, d))


@query(f"SELECT k AS rule_id, min(o) AS redundant_to FROM (SELECT x.k, y.k AS o, count(DISTINCT (x.r IS NULL)) AS n FROM ({_BRANCHES}) x JOIN ({_BRANCHES}) y ON x.k <> y.k AND (x.r IS NULL) = (y.r IS NULL) AND y.s <= x.s AND y.t >= x.t AND (x.r IS NULL OR (y.r <= x.r AND y.u >= x.u)) GROUP BY 1, 2) JOIN (SELECT k AS kk, count(*) AS n_all FROM ({_BRANCHES}) GROUP BY 1) ON kk = k AND n = n_all GROUP BY 1")
def redundancy_or(spark, d):
    return analysis.redundancies(_many(spark, d))


@query("""SELECT 'price' AS field, hole AS low, r AS high FROM (SELECT p_retailprice AS r, coalesce(max(p_retailprice + 0.5::DOUBLE) OVER (ORDER BY p_retailprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST('-inf' AS DOUBLE)) AS hole FROM part WHERE p_partkey % 7 = 0) WHERE hole < r
UNION ALL SELECT 'price', max(p_retailprice + 0.5::DOUBLE), CAST('inf' AS DOUBLE) FROM part WHERE p_partkey % 7 = 0 HAVING count(*) > 0""")
def gaps_many(spark, d):
    return analysis.gaps(analysis.branch_intervals(_many(spark, d).where("rule_id % 7 = 0 and field = 'price'")))


@query("SELECT p_partkey AS rule_id, first AS duplicate_of FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_type) AS first FROM part) WHERE p_partkey <> first")
def duplicate_rules_many(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_partkey").alias("ordinal"), F.concat_ws("|", "p_brand", F.col("p_size").cast("string")).alias("condition"), F.col("p_type").alias("action"))
    return analysis.duplicates(rows, with_action=True)


_TREES = [
    (1, group("OR", leaf("x", ">", 10), leaf("x", "<", 5)), True),
    (2, group("AND", leaf("y", ">", 10), group("NOT", leaf("y", "<", 5))), True),
    (3, group("AND", leaf("y", ">", 10), group("NOT", leaf("y", ">", 5))), False),
    (4, group("OR", group("AND", leaf("x", ">", 10), leaf("x", "<", 5)), group("AND", leaf("z", "==", 1), leaf("z", "==", 2))), False),
    (5, group("NOT", group("OR", leaf("x", ">", 1), leaf("x", "<=", 1))), False),
    (6, group("AND", group("OR", leaf("x", "<", 0), leaf("x", ">", 9)), leaf("x", "in", [1, 2, 10])), True),
]


@query(f"SELECT CAST(rule_id AS BIGINT) AS rule_id, satisfiable FROM {values([(i, ok) for i, _, ok in _TREES], 'rule_id, satisfiable')}")
def sat_trees(spark, d):
    return analysis.sat_report(spark, [Rule(i, f"r{i}", tree) for i, tree, _ in _TREES])


@query()
def sat_rules(spark, d):
    return analysis.sat_report(spark, SET)


@query()
def validate_candidate(spark, d):
    return analysis.validate_candidate(spark, Rule(50, "rich", leaf("income", ">", 90000), "offer", 2, "money"), SET)


# --- versions, audit, SDK ---------------------------------------------------------------------------------------------

VERSIONS = [(1, 1, "a", 5, "x > 1"), (1, 2, "a", 7, "x > 2"), (2, 1, "b", 1, "y = 1"), (1, 3, "c", 7, "x > 2")]
_V = f"SELECT CAST(rule_id AS BIGINT) AS rule_id, CAST(version AS INTEGER) AS version, name, CAST(priority AS INTEGER) AS priority, condition FROM {values(VERSIONS, 'rule_id, version, name, priority, condition')}"


def _versions(spark):
    return spark.createDataFrame(VERSIONS, "rule_id long, version int, name string, priority int, condition string")


@query(f"SELECT rule_id, version, name, priority, condition FROM ({_V}) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY version DESC) = 1")
def version_latest(spark, d):
    return catalog.latest_versions(_versions(spark))


_CELLS_OF = f"SELECT rule_id, version, unnest(['name', 'priority', 'condition']) AS field, unnest([name, CAST(priority AS VARCHAR), condition]) AS cell FROM ({_V})"


@query(f"SELECT a.rule_id, a.field, a.cell AS old, b.cell AS new FROM ({_CELLS_OF}) a JOIN ({_CELLS_OF}) b ON a.rule_id = b.rule_id AND a.field = b.field AND a.version = 1 AND b.version = 2 AND a.cell IS DISTINCT FROM b.cell")
def version_diff(spark, d):
    return catalog.version_diff(_versions(spark), 1, 2, ["name", "priority", "condition"])


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS valid, count(*) FILTER (event_id % 3 = 1) AS invalid, count(*) FILTER (event_id % 3 = 2) AS unprotected FROM (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1000)")
def audit_tally(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("create").alias("action_type"), F.lit("rule").alias("entity_type"), F.col("event_id").alias("entity_id"), "user_id", F.col("props").alias("details"), F.col("ts").cast("timestamp").alias("timestamp"))
    good = catalog.stamped(rows, "secret").withColumn("integrity_hash", F.when(F.col("id") % 3 == 0, F.col("integrity_hash")).when(F.col("id") % 3 == 1, F.lit("bad")))
    return catalog.audit_tally(good, "secret", 1000)


def _pad(byte: int) -> str:
    return bytes(b ^ byte for b in b"secret".ljust(64, b"\0")).hex()


@query(f"SELECT event_id, sha256(unhex('{_pad(0x5C)}') || unhex(sha256(unhex('{_pad(0x36)}') || encode(concat_ws('|', CAST(event_id AS VARCHAR), event_type, props))))) AS stamp FROM events")
def audit_hmac(spark, d):
    return table(spark, d, "events").select("event_id", hmac_sha256("secret", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")).alias("stamp"))


@query("SELECT CAST(user_id AS BIGINT) AS rule_id, count(*) AS hit_count, round(sum(CAST(value * 4 AS BIGINT)) / 4.0, 2) AS total_ms, max(ts) AS last_fired_at FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def rule_metrics(spark, d):
    fired = table(spark, d, "events").where("user_id is not null").select(F.col("user_id").alias("rule_id"), (F.round(F.col("value") * 4).cast("long") / 4).alias("ms"), "ts")
    return analytics.rule_hits(fired, "ms", "ts").drop("avg_ms")


# --- edges of the language --------------------------------------------------------------------------------------------

ODD = [
    Rule(1, "empty group", {"type": "group", "op": "OR", "children": []}),
    Rule(2, "nothing", None),
    Rule(3, "unknown group", {"type": "group", "op": "XOR", "children": [leaf("value", ">", 0)]}),
    Rule(4, "lower case", {"type": "group", "op": "or", "children": [leaf("value", ">", 100), leaf("value", "<", 10)]}),
    Rule(5, "needs state", group("AND", leaf("value", ">", 0), {"type": "cross_fact_join", "correlate_field": "user_id"})),
    Rule(6, "negated", group("NOT", leaf("value", ">", 100))),
]


@query("SELECT event_id, CAST(r AS BIGINT) AS rule_id FROM events, (VALUES (1), (4), (6)) t(r) WHERE r = 1 OR (r = 4 AND (value > 100 OR value < 10)) OR (r = 6 AND NOT coalesce(value > 100, false))")
def odd_trees(spark, d):
    return match(table(spark, d, "events"), ODD, "event_id").select("event_id", "rule_id")


_RENDERED = group("AND", group("OR", leaf("event_type", "in", ["click", "purchase"]), leaf("props", "starts_with", "{")), group("NOT", leaf("value", "<=", 20.5)), leaf("user_id", "exists"))


@query("SELECT event_id FROM events WHERE (event_type IN ('click', 'purchase') OR starts_with(props, '{')) AND NOT value <= 20.5 AND user_id IS NOT NULL")
def rendered_tree(spark, d):
    return table(spark, d, "events").where(F.expr(ir.render(ir.parse(_RENDERED)))).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 3 = 0")
def coerced_bools(spark, d):
    df = table(spark, d, "events").withColumn("flag", F.when(F.col("event_id") % 3 == 0, " TRUE ").when(F.col("event_id") % 3 == 1, "False").otherwise("maybe"))
    return df.where(truth(compile_tree(ir.parse(leaf("flag", "==", True)), Fields(df.schema), Flags(coerce_bool_strings=True)))).select("event_id")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(r AS BIGINT) AS rule_id FROM orders, (VALUES (1), (3)) t(r) WHERE (r = 1 AND o_totalprice > 200000) OR (r = 3 AND o_totalprice > 50000)")
def match_ids(spark, d):
    return match(table(spark, d, "orders"), THREE, "o_orderkey", ids=[1, 3]).select("o_orderkey", "rule_id")


@query("SELECT event_id FROM events WHERE user_id % 2 = 0 AND ts + INTERVAL 5 DAY <= TIMESTAMP '2024-01-20 00:00:00'")
def expired_sessions(spark, d):
    own = table(spark, d, "events").where("user_id % 2 = 0").withColumn("created_at", F.col("ts")).withColumn("updated_at", F.current_timestamp())
    return stateful.expired(own, "2024-01-20 00:00:00", 5 * 86400, sliding=False).select("event_id")


@query("SELECT user_id AS rule_id, min(event_id) AS recency FROM events WHERE user_id IS NOT NULL GROUP BY user_id HAVING bool_or(event_type = 'click')")
def cancelled_activations(spark, d):
    own = table(spark, d, "events").where("user_id is not null")
    queued = own.groupBy(F.col("user_id").alias("rule_id")).agg(F.min("event_id").alias("recency"), F.collect_list(F.struct(F.col("event_id").alias("fact_id"))).alias("matched_facts"))
    return stateful.cancelled(queued, own.where("event_type = 'click'").select(F.col("event_id").alias("fact_id"))).select("rule_id", "recency")


@query("SELECT DISTINCT p_brand AS grp FROM part")
def rule_groups(spark, d):
    return analytics.groups(table(spark, d, "part").select(F.col("p_brand").alias("grp")))


@query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 40) ")
def newest_explanations(spark, d):
    own = table(spark, d, "events").where("event_type = 'click'").select("event_id", F.struct("ts", "event_id").alias("at"), F.lit(1).alias("rule_id"), F.lit("[\u2713 a=1] [\u2717 b=2]").alias("explanation"))
    return analytics.explanation_feed(own, "at", 40, 1).where("matched[0] = 'a=1' and missing[0] = 'b=2'").select("event_id")


@query(f"SELECT rule1, rule2, grp, string_agg(field, ',' ORDER BY field) AS fields FROM (SELECT x.k AS rule1, y.k AS rule2, x.g AS grp, unnest(['price', 'size']) AS field FROM ({_BRANCHES}) x JOIN ({_BRANCHES}) y ON x.g = y.g AND x.k < y.k AND x.a <> y.a WHERE x.r IS NOT NULL AND y.r IS NOT NULL AND x.k % 5 = 0 AND y.k % 5 = 0) GROUP BY 1, 2, 3")
def conflicts_union(spark, d):
    """The compatible reading: bounds of a field are united, so two bounds that look at each other cover every number."""
    return analysis.conflicts(_many(spark, d).where("branch = 0 and rule_id % 5 = 0"), exact=False)


_US = [Rule(1, "us", group("AND", leaf("country", "==", "US"), leaf("amount", ">", 10)), "a", 1, "g"), Rule(2, "uk", group("AND", leaf("country", "==", "UK"), leaf("amount", "<", 50)), "b", 2, "g"), Rule(3, "far", group("AND", leaf("country", "==", "UK"), leaf("amount", ">", 90)), "c", 3, "g")]
_AMOUNTS = values([(r.id, x.value, 1 if x.op == ">" else -1) for r in _US for x in ir.leaves(r.tree()) if x.field == "amount"], "id, bound, side")


@query(f"SELECT CAST(a.id AS BIGINT) AS rule1, CAST(b.id AS BIGINT) AS rule2, 'g' AS grp, 'amount' AS fields FROM {_AMOUNTS.replace('AS t(', 'AS a(')} JOIN {_AMOUNTS.replace('AS t(', 'AS b(')} ON a.id < b.id AND (a.side = b.side OR a.side * a.bound < a.side * b.bound)")
def conflicts_fallback(spark, d):
    """With the fallback a number range that meets is enough, whatever the texts say."""
    return analysis.conflicts(analysis.constraints(spark, _US), fallback=True)


# --- sessions ---------------------------------------------------------------------------------------------------------

_OP = "CASE WHEN event_type = 'purchase' AND value > 150 THEN 'delete' WHEN event_type = 'click' THEN 'retract' ELSE 'assert' END"
_LOG = f"SELECT CAST(user_id AS VARCHAR) AS session, event_id AS seq, {_OP} AS op, CAST(event_id % 20 AS VARCHAR) AS fact, event_type AS payload, ts FROM events WHERE user_id IS NOT NULL"
_LIVE = f"SELECT session, max(seq) FILTER (op = 'delete') AS cut FROM ({_LOG}) GROUP BY session HAVING max(ts) >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 5 DAY AND arg_max(op, seq) <> 'delete'"


@query(f"SELECT session, fact, arg_max(payload, seq) AS payload FROM ({_LOG}) JOIN ({_LIVE}) USING (session) WHERE op <> 'delete' AND (cut IS NULL OR seq > cut) GROUP BY session, fact HAVING arg_max(op, seq) = 'assert'")
def session_facts(spark, d):
    log = table(spark, d, "events").where("user_id is not null").selectExpr("cast(user_id as string) as session", "'me' as owner", "event_id as seq", f"{_OP} as op", "cast(event_id % 20 as string) as fact", "event_type as payload", "cast(ts as timestamp) as at")
    return sessions.live_facts(log, "2024-01-30 00:00:00", 5 * 86400)


@query("SELECT CAST(user_id AS VARCHAR) AS session, event_type AS name, CAST(sum(event_id % 5) AS BIGINT) AS value FROM events GROUP BY 1, 2")
def session_counters(spark, d):
    return sessions.counters(table(spark, d, "events").selectExpr("cast(user_id as string) as session", "event_type as name", "event_id % 5 as delta"))


@query("SELECT CAST(user_id AS VARCHAR) AS session, event_type AS name, event_id AS seq, 10 + 5 * (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1) AS value FROM events")
def session_sequences(spark, d):
    return sessions.sequences(table(spark, d, "events").selectExpr("cast(user_id as string) as session", "event_type as name", "event_id as seq"), 10, 5)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY")
def retention_filter(spark, d):
    return catalog.retained(table(spark, d, "events"), "2024-01-30 00:00:00", 7, "ts").select("event_id")


HEALTH = [*SET, Rule(20, "adult", leaf("x", ">", 1), "", 0, "age"), Rule(21, "off", None, "go", 0, "age", enabled=False)]
_HEALTH = values([(r.id, r.name, r.enabled, r.condition is None, r.action) for r in HEALTH], "rule_id, rule_name, enabled, empty, action")


@query(f"SELECT 'disabled' AS issue, count(*) FILTER (NOT enabled) AS rules FROM {_HEALTH} UNION ALL SELECT 'empty_condition', count(*) FILTER (empty) FROM {_HEALTH} UNION ALL SELECT 'empty_action', count(*) FILTER (action = '') FROM {_HEALTH} UNION ALL SELECT 'duplicate_name', count(*) FROM (SELECT rule_name, count(*) OVER (PARTITION BY rule_name) AS n FROM {_HEALTH}) WHERE n > 1")
def rule_health(spark, d):
    return catalog.rule_health(analysis.rule_table(spark, HEALTH))


@query(f"SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled, count(DISTINCT grp) FILTER (grp <> '') AS groups FROM {values([(r.id, r.enabled, r.group) for r in HEALTH], 'rule_id, enabled, grp')}")
def dashboard_counts(spark, d):
    return analytics.dashboard(analysis.rule_table(spark, HEALTH))


SDK = sdk.Ruleset("orders", (sdk.Rule("big", (sdk.RuleCondition("o_totalprice", "gte", 200000),), ("review", "hold"), 5), sdk.Rule("final", (sdk.RuleCondition("o_orderstatus", "eq", "F"), sdk.RuleCondition("o_totalprice", "lt", 250000)), ("archive",), 5)))


@query("""SELECT o_orderkey, 'final' AS rule_id, 1 AS turn, coalesce(o_orderstatus = 'F' AND o_totalprice < 250000, false) AS matched FROM orders UNION ALL SELECT o_orderkey, 'big', 2, coalesce(o_totalprice >= 200000, false) FROM orders""")
def sdk_evaluate(spark, d):
    return sdk.trace(table(spark, d, "orders"), SDK, "o_orderkey").select("o_orderkey", "rule_id", "turn", "matched")


@query("SELECT * FROM (VALUES ('duplicate rule id a'), ('rule a has no conditions'), ('rule a uses unsupported operator between')) t(problem)")
def sdk_validation(spark, d):
    bad = sdk.Ruleset("x", (sdk.Rule("a"), sdk.Rule("a", (sdk.RuleCondition("f", "between", 1),))))
    return spark.createDataFrame([(p,) for p in sdk.validate(bad)], "problem string")


@query("SELECT event_id, coalesce(event_type = 'purchase' AND value > 100, false) AS hit FROM events")
def tree_as_column(spark, d):
    df = table(spark, d, "events")
    return df.select("event_id", truth(compile_tree(ir.parse(group("AND", leaf("event_type", "==", "purchase"), leaf("value", ">", 100))), Fields(df.schema))).alias("hit"))

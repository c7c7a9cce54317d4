"""Matching, stateful patterns, analysis, catalog, streams and the flat dialect on small literal inputs."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rulewright import plugins, sdk
from rulewright.functions import cron
from rulewright.functions.text import hmac_sha256, signature
from rulewright.operators import analysis, catalog, matcher, pairs, stateful
from rulewright.operators.matcher import Rule, match
from rulewright.plans import ir
from rulewright.sources import rules as source
from rulewright.streaming import engine as stream
from rulewright.streaming import sessions


def leaf(f, op, v=None):
    return {"type": "condition", "field": f, "op": op, "value": v}


def group(op, *c):
    return {"type": "group", "op": op, "children": list(c)}


def test_loan_scenario(spark):
    cols = ["Applicant.age", "Applicant.credit_score", "Applicant.income", "Applicant.country", "Loan.amount"]
    df = spark.createDataFrame([(32, 720, 65000, "NL", 15000)], cols).withColumn("k", F.lit(1))
    rules = [Rule(i, f"r{i}", group("AND", *c), "a", 100 - i) for i, c in enumerate([[leaf("Applicant.age", ">=", 18)], [leaf("Applicant.credit_score", ">", 700)], [leaf("Applicant.income", ">", 60000), leaf("Applicant.country", "in", ["NL", "BE"])], [leaf("Loan.amount", "<", 20000)], [leaf("Applicant.country", "==", "NL")], [leaf("Applicant.age", ">", 60)], [leaf("Loan.amount", ">", 50000)]], 1)]
    got = match(df, rules, "k", explain=True).orderBy("exec_order").collect()
    assert [r.rule_id for r in got] == [1, 2, 3, 4, 5]
    assert "[✓ Applicant.age=32 >= 18]" in got[0].explanation


def test_strategies_agree_and_leaves_are_shared(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 7 % 101).cast("double").alias("x"))
    rules = [Rule(i, f"r{i}", leaf("x", ">", i // 10), "a", i % 3) for i in range(100)]
    rows = [sorted(map(tuple, match(df, rules, "id", strategy=s).select("id", "rule_id", "exec_order").collect())) for s in ("wide", "params", "auto")]
    assert rows[0] == rows[1] == rows[2]
    assert matcher.compile_rules(rules).stats["alpha_nodes"] == 10


def test_accumulate_literals(spark):
    now = datetime(2026, 1, 1)
    rows = [("o-1", "Order", "A", 10.0, 60), ("o-2", "Order", "A", 20.0, 30), ("o-3", "Order", "B", 8.0, 20), ("o-4", "Order", "B", 12.0, 3)]
    df = spark.createDataFrame([(*r[:4], now - timedelta(seconds=r[4])) for r in rows], "fact_id string, type string, account_id string, amount double, inserted_at timestamp")
    acc = lambda **k: stateful.accumulate(df, {"type": "accumulate", "over": "Order", **k}, now=now).collect()
    assert acc(aggregate="count")[0]["count"] == 4
    assert acc(aggregate="count", window={"duration_seconds": 25})[0]["count"] == 2
    assert acc(aggregate="count", window={"duration_seconds": -1})[0]["count"] == 0
    out = acc(aggregate=["count", {"op": "sum", "field": "amount"}], group_by=["account_id"], constraint={"field": "sum_amount", "op": ">", "value": 20})
    assert [tuple(r) for r in out] == [("A", 2, 30.0)]
    with pytest.raises(ir.RuleError):
        acc(aggregate="median")


def test_sequence_window_and_late_facts(spark):
    t0 = datetime(2026, 1, 1)
    rows = [(1, "login", "u", 0), (2, "purchase", "u", 30), (3, "purchase", "u", 500), (4, "login", "u", 10), (5, "login", "v", 0)]
    df = spark.createDataFrame([(i, e, u, t0 + timedelta(seconds=s)) for i, e, u, s in rows], "event_id long, event string, user_id string, ts timestamp")
    spec = {"type": "sequence", "steps": [leaf("event", "==", "login"), leaf("event", "==", "purchase")], "within_window_seconds": 120, "correlate_on": ["user_id"]}
    assert [tuple(r) for r in stateful.sequence(df, spec, "ts", "event_id", "event_id").collect()] == [(1, 2)]


def test_analysis_boundaries(spark):
    a = [Rule(1, "a", leaf("x", ">", 10), "p", 1), Rule(2, "b", leaf("x", "<=", 10), "q", 1)]
    cons = analysis.constraints(spark, a)
    assert analysis.conflicts(cons).count() == 0
    assert analysis.gaps(cons, finite_only=True).count() == 0
    dead = analysis.dead_rules(analysis.constraints(spark, [Rule(3, "c", group("AND", leaf("x", "==", 18), leaf("x", ">", 18)), "z")])).collect()
    assert "lower bound" in dead[0].reason
    texts = [Rule(1, "a", group("AND", leaf("x", ">", 1), leaf("c", "==", "US")), "p"), Rule(2, "b", group("AND", leaf("x", ">", 5), leaf("c", "==", "UK")), "q")]
    cons = analysis.constraints(spark, texts)
    assert analysis.conflicts(cons).count() == 0 and analysis.conflicts(cons, fallback=True).count() == 1
    assert analysis.satisfiable(ir.parse(group("OR", leaf("x", "<", 0), group("AND", leaf("x", ">", 5), group("NOT", leaf("x", ">", 4)))))) is True
    assert analysis.satisfiable(ir.parse(group("AND", leaf("x", ">", 5), group("NOT", leaf("x", ">", 4))))) is False


def test_catalog(spark, tmp_path):
    c, at = catalog.Catalog(spark, f"file://{tmp_path}", "key"), datetime(2026, 1, 1)
    r = Rule(1, "a", leaf("x", ">", 10), "p", 1, "g")
    assert c.import_rules([r, Rule(2, "b", leaf("x", ">", 20), "q", 2, "g"), Rule(3, "c", {"type": "sequence", "steps": []}, "z")], at) == {"created": [1], "parked": [2], "errors": [(3, "$.steps: a sequence has two steps at least")]}
    c.put([Rule(1, "a2", leaf("x", ">", 11), "p", 1, "g")], at + timedelta(days=1))
    assert [x.name for x in c.rules()] == ["a2"] and c.versions(1).count() == 2
    assert catalog.version_diff(c.versions(), 1, 2, ["name", "priority"], order="current_version").collect()[0]["new"] == "a2"
    assert tuple(catalog.audit_tally(c.table("audit", catalog.AUDIT), "key").head()) == (2, 0, 0)
    assert c.parked("pending").count() == 1
    c.put([Rule(1, "a2", leaf("x", ">", 11), "p", 1, "g")], at, deleted=True)
    assert c.rules() == []


def test_functions(spark):
    assert spark.range(1).select(hmac_sha256("k" * 80, F.lit("m"))).head()[0] == signature("k" * 80, "m")
    assert cron.next_run("30 2 * * 0", datetime(2026, 1, 1)) == datetime(2026, 1, 4, 2, 30)
    with pytest.raises(ValueError):
        cron.scopes("nope")
    assert ir.lint({"type": "group", "children": [{"type": "sequence", "steps": [1]}]})[0][0]["path"] == "$.children[0].steps"


def test_csv_source(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('﻿name,action,condition_dsl,enabled,priority\na,go,"{""type"":""condition"",""field"":""x"",""op"":"">"",""value"":1}",yes,5\nb,go,nojson,1,2\n', encoding="utf-8")
    rules, errors = source.load(spark, f"file://{p}")
    assert [(r.name, r.priority, r.enabled) for r in rules] == [("a", 5, True)] and len(errors) == 1


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, i % 3, "login" if i % 2 else "buy", t0 + timedelta(seconds=i)) for i in range(30)], "event_id long, user_id long, event string, ts timestamp")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rules = [Rule(1, "a", leaf("event", "==", "buy"), "x")]

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(stream.match_stream(read(), rules, "event_id").select("event_id"), "m1") == sorted(map(tuple, match(df, rules, "event_id").select("event_id").collect()))
    spec = {"type": "sequence", "steps": [leaf("event", "==", "login"), leaf("event", "==", "buy")], "within_window_seconds": 5, "correlate_on": ["user_id"]}
    assert run(stream.sequence_stream(read(), spec, "ts", "event_id"), "m2") == sorted(map(tuple, stateful.sequence(df, spec, "ts", "event_id", "event_id").collect()))
    assert len(run(stream.cross_fact_stream(read(), "user_id", "event_id", "event_id"), "m3")) == stateful.cross_fact_count(df, "user_id", "event_id").count()


def test_sdk_and_plugins(spark):
    rs = sdk.Ruleset("approval", (sdk.Rule("approved", (sdk.RuleCondition("risk", "lte", 3),), ("approve",)),))
    s = sdk.Service(spark)
    r = s.evaluate(rs, {"risk": 2})
    assert r.actions == ["approve"] and s.explain(r.execution_id) == [{"rule_id": "approved", "matched": True}]
    with pytest.raises(ValueError):
        s.evaluate(sdk.Ruleset("x", (sdk.Rule("a", (sdk.RuleCondition("f", "between", 1),)),)), {"f": 1})
    assert plugins.execute("nope", {})["success"] is False and plugins.execute("send_alert", {})["success"] is True
    out = plugins.execute_all(spark.createDataFrame([(1, "send_email", "{}")], "rule_id long, action string, event string")).collect()
    assert out[0].success


def test_entry_has_queries():
    import __spark_entry__ as e

    assert "exec_order" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_or_and_not_in_analysis(spark, tmp_path):
    """Each branch of an OR is judged alone, and NOT turns bounds round; import writes what can fire."""
    either = Rule(1, "either", group("OR", leaf("x", ">", 10), leaf("x", "<", 5)), "a", 1)
    negated = Rule(2, "negated", group("AND", leaf("y", ">", 10), group("NOT", leaf("y", "<", 5))), "b", 2)
    never = Rule(3, "never", group("AND", leaf("y", ">", 10), group("NOT", leaf("y", ">", 5))), "c", 3)
    cons = analysis.constraints(spark, [either, negated, never])
    assert [tuple(r) for r in analysis.dead_rules(cons).collect()] == [(3, "y", "contradictory bounds")]
    assert analysis.dead_rules(analysis.constraints(spark, [either, negated, never], compat=True), compat=True).count() == 2
    store = catalog.Catalog(spark, str(tmp_path))
    at = datetime(2024, 1, 1)
    out = store.import_rules([either, negated, never, Rule(4, "late", leaf("x", ">", 20), "z", 9), Rule(5, "fine", leaf("w", ">", 20), "z", 8), Rule(6, "bad", {"type": "nonsense"})], at)
    assert (out["created"], out["parked"], [e[0] for e in out["errors"]]) == ([1, 2, 5], [3, 4], [6])
    again = store.import_rules([Rule(7, "fine", leaf("v", ">", 0), "q", 8), Rule(8, "new", leaf("w", "<", 0), "z", 7)], at)
    assert (again["created"], again["parked"]) == ([8], [7])
    assert {r["type"] for r in store.parked().where("rule_id = 7").collect()} == {"duplicate_name", "priority_collision"}
    assert store.version(5, 1).count() == 1 and store.version(5, 2).count() == 0


def test_match_takes_ids_and_group(spark):
    events = spark.createDataFrame([(1, 5.0), (2, 50.0)], "id long, x double")
    rules = [Rule(1, "a", leaf("x", ">", 1), group="g"), Rule(2, "b", leaf("x", ">", 10), group="h")]
    ids = lambda **k: sorted((r["id"], r["rule_id"]) for r in match(events, rules, "id", **k).collect())
    assert ids() == [(1, 1), (2, 1), (2, 2)] and ids(ids=[2]) == [(2, 2)] and ids(group="g") == [(1, 1), (2, 1)] and ids(ids=[]) == ids()


def test_custom_node_from_json(spark):
    plugins.register_rule_type("between", lambda spec, fields, flags: fields.get(spec["field"])[0].between(spec["low"], spec["high"]))
    events = spark.createDataFrame([(1, 5.0), (2, 50.0)], "id long, x double")
    rule = Rule(1, "mid", {"type": "between", "field": "x", "low": 1, "high": 9})
    assert [r["id"] for r in match(events, [rule], "id").collect()] == [1]


def test_session_store(spark, tmp_path):
    at = datetime(2024, 1, 1)
    later = lambda s: at + timedelta(seconds=s)
    store = sessions.SessionStore(spark, str(tmp_path), ttl=60, facts=2)
    store.create("s", "ann", at)
    store.assert_facts("s", "ann", {"a": "1", "b": "2"}, at)
    store.assert_facts("s", "ann", {"a": "3"}, later(1))
    with pytest.raises(sessions.LimitReached):
        store.assert_facts("s", "ann", {"c": "1"}, later(2))
    with pytest.raises(sessions.NotOwner):
        store.retract("s", "bob", "a", later(2))
    assert store.retract("s", "ann", "b", later(2)) and not store.retract("s", "ann", "b", later(2))
    assert [tuple(r) for r in store.facts("s", later(30)).collect()] == [("s", "a", "3")]
    assert store.facts("s", later(90)).count() == 0 and store.sessions("ann", later(30)).count() == 1
    store.assert_facts("s", "bob", {"z": "9"}, later(90))  # the old one has ended
    assert [r["fact"] for r in store.facts("s", later(91)).collect()] == ["z"] and store.sessions("bob", later(91)).count() == 1
    assert (store.accumulate("t", "n", 2, at), store.accumulate("t", "n", 3, at)) == (2.0, 5.0)
    assert (store.next_number("t", "q", at, 1, 2), store.next_number("t", "q", at, 1, 2)) == (1, 3)


def test_policies_and_reports(spark, tmp_path):
    store, at = catalog.Catalog(spark, str(tmp_path), "key"), datetime(2024, 1, 1, 0, 30)
    store.save_policy("nightly", "coverage", "0 3 * * *", at)
    with pytest.raises(ValueError):
        store.save_policy("nightly", "coverage", "0 3 * * *", at)
    store.update_policy("nightly", at, schedule="0 5 * * *")
    assert store.policies().head()["next_run_at"] == datetime(2024, 1, 1, 5) and store.due_policies(datetime(2024, 1, 1, 4)).count() == 0
    ran = datetime(2024, 1, 1, 6)
    report = store.run_policy("nightly", {"coverage": {"cold": lambda: 2, "fine": lambda: 0, "broken": lambda: 1 / 0}}, ran)
    assert {r["check"]: (r["passed"], r["count"]) for r in store.report(report).collect()} == {"cold": (False, 2), "fine": (True, 0), "broken": (False, None)}
    assert store.reports("nightly", passed=True).count() == 1 and store.reports("other").count() == 0
    assert store.policies().head()["last_run_at"] == ran and store.policies().head()["next_run_at"] == datetime(2024, 1, 2, 5)
    store.delete_policy("nightly")
    assert store.policies().count() == 0
    with pytest.raises(KeyError):
        store.run_policy("nightly", {}, ran)


def test_import_jobs(spark, tmp_path):
    jobs = catalog.ImportJobs(catalog.Catalog(spark, str(tmp_path)), 2)
    at = datetime(2024, 1, 1)
    made = [jobs.submit([Rule(10 * k + i, f"r{k}{i}", leaf(f"f{k}{i}", ">", 1), "a", 10 * k + i) for i in range(2)], at) for k in range(2)]
    assert [jobs.state(j, 120)["created"] for j in made] == [[0, 1], [10, 11]]
    bad = jobs.submit([None], at)
    assert jobs.state(bad, 60)["status"] == "failed" and jobs.catalog.current().count() == 4
    assert [r["id"] for r in jobs.catalog.table("audit", catalog.AUDIT).orderBy("id").collect()] == [1, 2, 3, 4]


def test_compiled_rules_are_kept_for_a_while(monkeypatch):
    matcher.invalidate()
    sets = [[Rule(i, "r", leaf("x", ">", i), group=f"g{i % 2}")] for i in range(40)]
    made = [matcher.compile_rules(s) for s in sets]
    assert len(matcher._CACHE) == matcher.CACHED and matcher.compile_rules(sets[-1]) is made[-1] and matcher.compile_rules(sets[0]) is not made[0]
    matcher.invalidate("g1")
    assert all(c.rules[0][0].group == "g0" for _, c in matcher._CACHE.values()) and matcher._CACHE
    monkeypatch.setattr(matcher, "CACHE_SECONDS", -1.0)
    one = matcher.compile_rules([Rule(99, "r", leaf("x", ">", 1))])
    assert matcher.compile_rules([Rule(99, "r", leaf("x", ">", 1))]) is not one
    matcher.invalidate()
    assert not matcher._CACHE


def join_rows(df):
    """The most rows that a join of the plan made when the result was collected."""
    df.collect()
    most = [0]

    def walk(p):
        if "Join" in p.nodeName() and p.metrics().contains("numOutputRows"):
            most.append(p.metrics().apply("numOutputRows").value())
        inner = [p.finalPhysicalPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if p.nodeName().endswith("QueryStage") else []
        for child in [p.children().apply(i) for i in range(p.children().size())] + inner:
            walk(child)

    walk(df._jdf.queryExecution().executedPlan())
    return max(most)


def _ranges(n, width):
    """n rules of one group: x from i to i + width, or y == i modulo 50."""
    tree = lambda i: {"type": "group", "op": "OR", "children": [{"type": "group", "op": "AND", "children": [leaf("x", ">=", i), leaf("x", "<", i + width), leaf("t", "==", "ab"[i % 2])]}, leaf("y", "==", i % 50)]}
    return [Rule(i, f"r{i}", tree(i), str(i % 3), 0, "g") for i in range(n)]


@pytest.mark.parametrize("block", [1 << 14, 300])
def test_conflicts_make_rows_of_pairs_that_conflict_alone(spark, monkeypatch, block):
    from rulewright.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", block)
    n, width = 400, 4
    got = analysis.conflicts(analysis.constraints(spark, _ranges(n, width)))
    wanted = set()
    for i in range(n):
        for j in range(i + 1, n):
            f = [("t,x", j - i < width and i % 2 == j % 2), ("y", i % 50 == j % 50)]
            if i % 3 != j % 3 and any(ok for _, ok in f):
                wanted.add((i, j, "g", ",".join(x for x, ok in f if ok)))
    assert set(map(tuple, got.collect())) == wanted and got.count() == len(wanted)
    assert join_rows(got) <= 20 * n


def test_redundancies_hold_each_branch_in_one_of_the_other_rule(spark):
    """Against every pair of rules: one and two branches, equal rules, the first in order, and rules that nothing else holds."""
    box = lambda i: (i % 7, i % 7 + i % 4, i % 5)
    trees, branches = [], []
    for i in range(120):
        low, high, y = box(i * i)
        inner = [leaf("x", ">=", low), leaf("x", "<", high + 1), leaf("c", "==", "ab"[i % 2])]
        one = group("AND", *inner) if i % 3 else group("OR", group("AND", *inner), group("AND", leaf("y", ">", y), leaf("y", "<=", y + i % 2 + 1)))
        trees.append(Rule(1000 - i, f"r{i}", one, "p", 0, "g"))
        branches.append([("x", "ab"[i % 2], low, high + 1)] + ([] if i % 3 else [("y", "", y, y + i % 2 + 1)]))
    held = lambda a, b: all(any(x[:2] == y[:2] and y[2] <= x[2] and y[3] >= x[3] for y in b) for x in a)
    wanted = {}
    for i, a in enumerate(branches):
        first = next((j for j, b in enumerate(branches) if i != j and held(a, b)), None)
        if first is not None:
            wanted[1000 - i] = 1000 - first
    assert 0 < len(wanted) < len(trees)
    assert dict(map(tuple, analysis.redundancies(analysis.constraints(spark, trees)).collect())) == wanted
    assert not analysis.redundancies(analysis.constraints(spark, trees[:1])).count()


@pytest.mark.parametrize("side", [(3,), (1, 2)])
def test_pairs_of_one_set_of_fields_are_not_sorted_one_by_one(monkeypatch, side):
    """Rules of one conjunction and the same fields each: a rule's pairs are cut from the table of who meets whom as they are."""
    own = random.Random(2)
    rules = [(own.choice(side), k, own.choice(["", "a", "b", "c"]), own.randrange(40)) for k in own.sample(range(1000), 60)]
    rows = [{"grp": "g", "side": s, "rule_id": k, "action": a, "branch": 0, "field": f, "txt": None, "low": float(v), "high": v + 20.0, "low_in": True, "high_in": False} for s, k, a, v in rules for f in ("p", "q")]
    schema = pa.schema([("grp", pa.string()), ("side", pa.int32()), ("rule_id", pa.int64()), ("action", pa.string()), ("branch", pa.int32()), ("field", pa.string()), ("txt", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("low_in", pa.bool_()), ("high_in", pa.bool_())])
    monkeypatch.setattr(pairs, "_lists", lambda *a: pytest.fail("pairs were sorted"))
    monkeypatch.setattr(pairs, "CELL", 300)
    got = [(x["own"], o, x["fields"]) for b in pairs.overlapping(pa.Table.from_pylist(rows, schema), False, True) for x in b.to_pylist() for o in x["others"]]
    meet = lambda x, y: (x[2] != y[2] or x[2] == "") and abs(x[3] - y[3]) < 20
    want = [(x[1], y[1], "p,q") for x in rules for y in rules if (x[1] < y[1] if side == (3,) else (x[0], y[0]) == (1, 2)) and meet(x, y)]
    assert sorted(got) == sorted(want) and want

"""Streams over files, run until they are read, against the same work on batches."""

import json
import time

from rulewright.functions.text import fact_bytes
from rulewright.operators.matcher import Rule, match
from rulewright.plugins import action_names
from rulewright.streaming import engine

SCHEMA = "id long, x double, at timestamp"
RULES = [Rule(1, "low", {"field": "x", "op": "<", "value": 5}), Rule(2, "high", {"field": "x", "op": ">=", "value": 5}, priority=3)]


def files(path, rows, parts=3):
    path.mkdir()
    for k in range(parts):
        (path / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k::parts]))
    return str(path)


def run(query):
    q = query.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_matches_reach_the_sink(spark, tmp_path):
    src = files(tmp_path / "in", [{"id": i, "x": i % 9, "at": f"2024-01-01T00:00:{i:02d}"} for i in range(30)])
    seen, progress = [], engine.Progress()
    spark.streams.addListener(progress)
    found = engine.match_stream(engine.event_stream(spark, src, SCHEMA, 1), RULES, "id")
    for _ in range(2):  # what is read once is not read again
        run(engine.sink(found, str(tmp_path / "out"), str(tmp_path / "mark"), lambda batch, number: seen.append(number)).queryName("matches"))
    rows = lambda df: sorted((r["id"], r["rule_id"]) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(match(spark.read.schema(SCHEMA).json(src), RULES, "id"))
    assert seen == [0, 1, 2]
    for _ in range(100):
        if progress.queries.get("matches", {}).get("rows") == 30:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.queries["matches"]["rows"] == 30 and progress.queries["matches"]["error"] is None


def test_windowed_counts(spark, tmp_path):
    src = files(tmp_path / "in", [{"id": i, "x": i % 9, "at": f"2024-01-01T00:0{i // 10}:00"} for i in range(30)])
    events = engine.event_stream(spark, src, SCHEMA)
    found = engine.match_stream(events, RULES, "id").join(spark.read.schema(SCHEMA).json(src).select("id", "at"), "id")
    run(engine.windowed_counts(found, "at", "1 minute").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "mark")))
    got = {(r["window"].start.minute, r["rule_id"]): r["hit_count"] for r in spark.table("windows").collect()}
    want = {}
    for i in range(30):
        k = (i // 10, 1 if i % 9 < 5 else 2)
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_session_stream(spark, tmp_path):
    rows = [{"session_id": "s", "fact_id": f"f{i}", "payload": "p", "retract": False, "arrival": i} for i in range(5)]
    rows += [{"session_id": "s", "fact_id": "f4", "payload": None, "retract": True, "arrival": 9}, {"session_id": "t", "fact_id": "a", "payload": "p", "retract": False, "arrival": 1}]
    facts = engine.event_stream(spark, files(tmp_path / "in", rows, 1), "session_id string, fact_id string, payload string, retract boolean, arrival long")
    run(engine.session_stream(facts, capacity=3).writeStream.outputMode("update").format("memory").queryName("memories").option("checkpointLocation", str(tmp_path / "mark")))
    assert sorted(tuple(r) for r in spark.table("memories").collect()) == [("s", 2, 2, False), ("t", 1, 0, False)]


def test_small_helpers(spark):
    assert (action_names(None), action_names("a"), action_names(("a", 1))) == ([], ["a"], ["a", "1"])
    assert [r[0] for r in spark.createDataFrame([("é", 1)], "a string, b int").select(fact_bytes("a", "b")).collect()] == [len('{"a":"é","b":1}'.encode())]

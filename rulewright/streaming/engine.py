"""Rules over streams: stateless matching, interval joins for sequences, and keyed state for what needs it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.matcher import Rule, match
from ..operators.stateful import _FLAGS
from ..plans import ir
from ..plans.compiler import Fields, compile_tree, truth


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None, form: str = "json") -> DataFrame:
    """Events that arrive as files in a folder."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def queue_stream(spark: SparkSession, servers: str, topic: str, schema: str, **options: str) -> DataFrame:
    """Events of a Kafka topic, as JSON text by schema, with the queue's own time as ``arrival``; needs Spark's Kafka package.

    Offsets are kept by the query's checkpoint, so each event is taken once."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), F.col("timestamp").alias("arrival")).select("e.*", "arrival")


def match_stream(events: DataFrame, rules: Iterable[Rule], key: str) -> DataFrame:
    """Matches of a stream: the wide plan has no state and no shuffle, so it is the same on streams and batches."""
    return match(events, rules, key, strategy="wide")


def sink(matches: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None):
    """A query that writes matches batch by batch; a batch that is run again overwrites its own folder and so adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return matches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def sequence_stream(events: DataFrame, spec: ir.Sequence | dict, time_col: str, id_col: str, delay: str = "1 hour") -> DataFrame:
    """(id_1, id_2) of two-step sequences, as an interval join of the stream with itself; the window bounds the state.

    Times must differ for order to be told; facts later than ``delay`` are dropped. Longer sequences are for batches.
    """
    spec = ir.parse(spec) if isinstance(spec, dict) else spec
    if len(spec.steps) != 2:
        raise ir.RuleError("a stream joins two steps at a time")
    fields = Fields(events.schema)

    def step(k: int) -> DataFrame:
        own = events.where(truth(compile_tree(spec.steps[k], fields, _FLAGS)))
        return own.select(F.col(id_col).alias(f"id_{k + 1}"), F.col(time_col).alias(f"t_{k}"), *[F.col(f"`{c}`").alias(f"c{i}_{k}") for i, c in enumerate(spec.correlate_on)]).withWatermark(f"t_{k}", delay)

    test = (F.col("t_0") < F.col("t_1")) & (F.col("t_0") >= F.col("t_1") - F.expr(f"interval {float(spec.within):.6f} second"))
    for i in range(len(spec.correlate_on)):
        test = test & (F.col(f"c{i}_0") == F.col(f"c{i}_1"))
    return step(0).join(step(1), test).select("id_1", "id_2")


def _later(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All facts of a key but its first; the state is one flag."""
    seen = state.get[0] if state.exists else False
    for pdf in batches:
        pdf = pdf.sort_values("arrival")
        out = pdf if seen else pdf.iloc[1:]
        seen = seen or len(pdf) > 0
        yield out[["event_id"]]
    state.update((seen,))


def cross_fact_stream(events: DataFrame, correlate: str, arrival_col: str, id_col: str) -> DataFrame:
    """(event_id) of facts that are not the first of their correlation value."""
    own = events.where(F.col(f"`{correlate}`").isNotNull()).select(F.col(f"`{correlate}`").cast("string").alias("key"), F.col(id_col).cast("long").alias("event_id"), F.col(arrival_col).alias("arrival"))
    return own.groupBy("key").applyInPandasWithState(_later, "event_id long", "seen boolean", "append", GroupStateTimeout.NoTimeout)


class SessionMemory:
    """Working memory of sessions as keyed state: upserts by fact id, oldest out beyond a capacity, gone after a time to live."""

    def __init__(self, capacity: int = 1000, ttl_ms: int | None = None):
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "facts": [0], "evicted": [0], "expired": [True]})
            return
        ids, payloads = state.get if state.exists else ([], [])
        facts, evicted = dict(zip(ids, payloads, strict=True)), 0
        for pdf in batches:
            for fact, payload, gone in pdf.sort_values("arrival")[["fact_id", "payload", "retract"]].itertuples(index=False):
                if gone:
                    facts.pop(fact, None)
                    continue
                if fact not in facts and len(facts) >= self.capacity:
                    facts.pop(next(iter(facts)))
                    evicted += 1
                facts[fact] = payload
        state.update((list(facts), list(facts.values())))
        if self.ttl_ms:
            state.setTimeoutDuration(self.ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "facts": [len(facts)], "evicted": [evicted], "expired": [False]})


def session_stream(facts: DataFrame, capacity: int = 1000, ttl_ms: int | None = None) -> DataFrame:
    """(session_id, facts, evicted, expired) after each batch, from (session_id, fact_id, payload, retract, arrival)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return facts.groupBy("session_id").applyInPandasWithState(SessionMemory(capacity, ttl_ms), "session_id string, facts long, evicted long, expired boolean", "ids array<string>, payloads array<string>", "update", timeout)


def windowed_counts(matches: DataFrame, time_col: str, width: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Hits by rule and event-time window, late rows up to a delay."""
    return matches.withWatermark(time_col, delay).groupBy(F.window(time_col, width, slide), "rule_id").agg(F.count(F.lit(1)).alias("hit_count"))


class Progress(StreamingQueryListener):
    """Counts of what streams have done, by query name: batches, rows and milliseconds; errors of those that failed."""

    def __init__(self):
        self.names: dict[str, str] = {}
        self.queries: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)
        self.queries.setdefault(self.names[str(event.id)], {"batches": 0, "rows": 0, "ms": 0, "error": None})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.queries[self.names[str(p.id)]]
        own["batches"] += 1
        own["rows"] += p.numInputRows
        own["ms"] += p.batchDuration

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.queries[self.names[str(event.id)]]["error"] = event.exception

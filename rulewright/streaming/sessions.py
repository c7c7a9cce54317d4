"""Sessions: facts, counters and sequences by session, as tables of what was asked for, in order.

The log of a session is appended to and never changed, so no request reads, changes and writes back a whole session. What holds at
a time is an aggregation over the log.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "session string, owner string, seq long, op string, fact string, payload string, at timestamp"
#: Facts that a session may hold, and how long it lives after it was last used.
FACTS = 100
TTL = 3600.0


class LimitReached(ValueError):
    """A session has as many facts as it may hold."""


class NotOwner(PermissionError):
    """A session belongs to another owner."""


def _since_delete(log: DataFrame) -> DataFrame:
    """The rows of the log from each session's last delete on."""
    cut = log.where("op = 'delete'").groupBy("session").agg(F.max("seq").alias("cut"))
    return log.join(cut, "session", "left").where("cut is null or seq >= cut").drop("cut")


def live_sessions(log: DataFrame, at, ttl: float = TTL) -> DataFrame:
    """(session, owner, used): sessions that were used within the last ttl seconds and not deleted; owner: that of the first row
    since the last delete."""
    last = _since_delete(log).groupBy("session").agg(F.min_by("owner", "seq").alias("owner"), F.max("at").alias("used"), F.max_by("op", "seq").alias("last"))
    return last.where((F.col("last") != "delete") & (F.col("used") >= F.lit(at).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {ttl})"))).select("session", "owner", "used")


def live_facts(log: DataFrame, at, ttl: float = TTL) -> DataFrame:
    """(session, fact, payload): facts asserted and not retracted since, of live sessions; what came before a delete is gone.

    A fact's newest payload counts. Each step is an aggregation, so that a session of very many requests is no task of its own.
    """
    own = _since_delete(log).where("op in ('assert', 'retract')")
    newest = own.groupBy("session", "fact").agg(F.max_by(F.struct("op", "payload"), "seq").alias("n"))
    kept = newest.where("n.op = 'assert'").select("session", "fact", F.col("n.payload").alias("payload"))
    return kept.join(live_sessions(log, at, ttl).select("session"), "session", "left_semi")


def counters(deltas: DataFrame) -> DataFrame:
    """(session, name, value): sums of what was added to each counter, from (session, name, delta)."""
    return deltas.groupBy("session", "name").agg(F.sum("delta").alias("value"))


def sequences(requests: DataFrame, start: int = 0, step: int = 1) -> DataFrame:
    """(session, name, seq, value): the number that each request for the next one of a sequence gets, in order of seq."""
    order = Window.partitionBy("session", "name").orderBy("seq")
    return requests.select("session", "name", "seq", (F.lit(start) + (F.row_number().over(order) - 1) * F.lit(step)).cast("long").alias("value"))


class SessionStore:
    """Sessions under one folder. One writer at a time: a request's number is the largest so far, plus 1."""

    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL, facts: int = FACTS):
        self.spark, self.path, self.ttl, self.limit = spark, path.rstrip("/"), ttl, facts

    def log(self) -> DataFrame:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log") if there else self.spark.createDataFrame([], LOG)

    def _append(self, rows: list[tuple], at: datetime) -> None:
        last = self.log().agg(F.max("seq")).head()[0] or 0
        full = [(session, owner, last + i, op, fact, payload, at) for i, (session, owner, op, fact, payload) in enumerate(rows, 1)]
        self.spark.createDataFrame(full, LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _owned(self, session: str, owner: str | None, at: datetime) -> bool:
        """Whether the session lives; an error if it is another owner's."""
        found = live_sessions(self.log(), at, self.ttl).where(F.col("session") == session).head()
        if found and found["owner"] != owner:
            raise NotOwner(session)
        return found is not None

    def create(self, session: str, owner: str | None, at: datetime) -> None:
        self._owned(session, owner, at)
        self._append([(session, owner, "create", None, None)], at)

    def assert_facts(self, session: str, owner: str | None, facts: dict[str, str], at: datetime) -> None:
        """Add facts (name: JSON text), or change those of their names; a session that is not there is made."""
        rows = [(session, owner, "assert", k, v) for k, v in facts.items()]
        if self._owned(session, owner, at):
            names = {r["fact"] for r in self.facts(session, at).select("fact").limit(self.limit + 1).collect()}
        else:
            names, rows = set(), [(session, owner, "delete", None, None), *rows]  # what an ended session held stays gone
        if len(names | set(facts)) > self.limit:
            raise LimitReached(f"session {session!r} holds {self.limit} facts at most")
        self._append(rows, at)

    def retract(self, session: str, owner: str | None, fact: str, at: datetime) -> bool:
        """Whether the fact was there."""
        there = self._owned(session, owner, at) and self.facts(session, at).where(F.col("fact") == fact).limit(1).count() > 0
        if there:
            self._append([(session, owner, "retract", fact, None)], at)
        return there

    def delete(self, session: str, owner: str | None, at: datetime) -> None:
        if self._owned(session, owner, at):
            self._append([(session, owner, "delete", None, None)], at)

    def facts(self, session: str, at: datetime) -> DataFrame:
        return live_facts(self.log().where(F.col("session") == session), at, self.ttl)

    def sessions(self, owner: str | None, at: datetime) -> DataFrame:
        return live_sessions(self.log(), at, self.ttl).where(F.col("owner").eqNullSafe(F.lit(owner))).select("session", "used")

    def accumulate(self, session: str, name: str, delta: float, at: datetime) -> float:
        """Add to a counter and give its value."""
        self._append([(session, None, "count", name, str(float(delta)))], at)
        own = self.log().where((F.col("session") == session) & (F.col("op") == "count") & (F.col("fact") == name))
        return counters(own.select("session", F.col("fact").alias("name"), F.col("payload").cast("double").alias("delta"))).head()["value"]

    def next_number(self, session: str, name: str, at: datetime, start: int = 0, step: int = 1) -> int:
        """The next number of a sequence; the first is start."""
        have = self.log().where((F.col("session") == session) & (F.col("op") == "next") & (F.col("fact") == name)).count()
        self._append([(session, None, "next", name, None)], at)
        return start + have * step

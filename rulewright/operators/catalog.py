"""Rule, version, conflict and audit tables: immutable Parquet snapshots, versions and audit rows appended, newest rows by id."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cron
from ..functions.text import hmac_sha256
from ..plans import ir
from . import analysis
from .matcher import Rule, invalidate

VERSIONED = ("name", "description", "grp", "priority", "enabled", "condition", "action", "metadata")
RULES = "rule_id long, name string, description string, grp string, priority int, enabled boolean, condition string, action string, metadata string, evaluation_mode string, current_version int, deleted boolean, changed_at timestamp"
PARKED = "park_id string, rule_id long, name string, condition string, action string, grp string, priority int, type string, other long, detail string, status string, submitted_at timestamp"
AUDIT = "id long, action_type string, entity_type string, entity_id long, user_id long, details string, timestamp timestamp, integrity_hash string"
POLICIES = "name string, scope string, schedule string, enabled boolean, next_run_at timestamp, last_run_at timestamp, revision long, deleted boolean"
REPORTS = "report_id string, policy string, ran_at timestamp, check string, scope string, passed boolean, count long, detail string, report_hash string"


def row_of(rule: Rule, version: int, at: datetime, deleted: bool = False) -> tuple:
    return (rule.id, rule.name, rule.description, rule.group or "default", rule.priority, rule.enabled, ir.canonical(rule.condition), rule.action, json.dumps(rule.metadata, sort_keys=True), rule.evaluation_mode, version, deleted, at)


def rule_of(row) -> Rule:
    return Rule(row["rule_id"], row["name"], json.loads(row["condition"]), row["action"], row["priority"], row["grp"], row["enabled"], row["evaluation_mode"], row["description"], json.loads(row["metadata"] or "{}"))


class Catalog:
    """Tables under one folder. Each write appends a row of a rule's next version, so nothing that a reader holds is changed."""

    def __init__(self, spark: SparkSession, path: str, secret: str = ""):
        self.spark, self.path, self.secret = spark, path.rstrip("/"), secret
        self.lock = threading.RLock()  # versions and ids follow those that are there: writers of one process take turns

    def table(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def append(self, name: str, schema: str, rows: list) -> None:
        if rows:
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def versions(self, rule_id: int | None = None) -> DataFrame:
        all_ = self.table("rules", RULES)
        return (all_ if rule_id is None else all_.where(F.col("rule_id") == rule_id)).orderBy(F.desc("current_version"))

    def version(self, rule_id: int, number: int) -> DataFrame:
        return self.table("rules", RULES).where((F.col("rule_id") == rule_id) & (F.col("current_version") == number))

    def current(self) -> DataFrame:
        return latest_versions(self.table("rules", RULES), "rule_id", "current_version").where("not deleted")

    def rules(self) -> list[Rule]:
        """All current rules on the driver: the rule set itself, which compilation needs there."""
        return [rule_of(r) for r in self.current().orderBy("rule_id").collect()]

    def list_rules(self, skip: int = 0, limit: int = 100, group: str | None = None, enabled: bool | None = None) -> DataFrame:
        out = self.current()
        out = out if group is None else out.where(F.col("grp") == group)
        out = out if enabled is None else out.where(F.col("enabled") == enabled)
        return out.orderBy("rule_id").offset(skip).limit(limit)

    def put(self, rules: Iterable[Rule], at: datetime, user: int | None = None, deleted: bool = False) -> None:
        """Create, update or delete: the next version of each rule, an audit row for each, and compiled rules are dropped."""
        with self.lock:
            self._put(list(rules), at, user, deleted)

    def _put(self, rules: list[Rule], at: datetime, user: int | None, deleted: bool) -> None:
        ids = [r.id for r in rules]
        have = {r["rule_id"]: r["v"] for r in self.table("rules", RULES).where(F.col("rule_id").isin(ids)).groupBy("rule_id").agg(F.max("current_version").alias("v")).collect()}
        self.append("rules", RULES, [row_of(r, have.get(r.id, 0) + 1, at, deleted) for r in rules])
        kind = lambda r: "delete" if deleted else "update" if r.id in have else "create"
        self.audit([(kind(r), "rule", r.id, user, r.name) for r in rules], at)
        invalidate()

    def import_rules(self, candidates: Iterable[Rule], at: datetime, user: int | None = None, blocking: frozenset = analysis.BLOCKING) -> dict:
        """Bulk creation in order: each candidate is held against what exists and what was accepted before it; the rest is parked.

        All candidates are validated in a few jobs, however many they are; only which of two new rules comes first is settled here.
        """
        with self.lock:
            return self._import(candidates, at, user, blocking)

    def _import(self, candidates: Iterable[Rule], at: datetime, user: int | None, blocking: frozenset) -> dict:
        have, good, parked, errors = self.rules(), [], [], []
        for c in candidates:
            try:
                bad, _ = ir.lint(c.condition)
                if bad:
                    raise ir.RuleError(bad[0]["message"], bad[0]["path"])
                analysis.constraint_rows([c])  # parses it, and bounds the conjunctions that it stands for
                good.append(c)
            except ValueError as e:
                errors.append((c.id, str(e)))
        dead, overlap, earlier = analysis.import_findings(self.spark, good, have) if good else ({}, {}, {})
        held: dict[tuple, dict] = {}  # what accepted rules have, with their ids

        def keys(r: Rule) -> dict:
            group = r.group or "default"
            return {"duplicate_condition": (ir.canonical(r.condition), r.action or ""), "priority_collision": (group, r.priority), "duplicate_name": r.name}

        def hold(r: Rule) -> None:
            for kind, k in keys(r).items():
                held.setdefault((kind, k), {})[r.id] = r.name

        for r in have:
            if r.enabled:
                hold(r)
        created, accepted = [], set()
        for i, c in enumerate(good):
            found = []
            for kind, k in keys(c).items():
                others = [x for x in held.get((kind, k), ()) if x != c.id]
                detail = {"duplicate_condition": "same condition and action", "priority_collision": str(c.priority), "duplicate_name": c.name}[kind]
                found += [(kind, x, detail) for x in others[:1]]
            if i in dead:
                found.append(("dead_rule", None, dead[i]))
            near = [overlap[i]] if i in overlap else [(good[e].id, f) for e, f in earlier.get(i, ()) if e in accepted and good[e].id != c.id][:1]
            found += [("overlap", other, fields) for other, fields in near]
            found = [f for f in found if f[0] in blocking]
            if found:
                parked += [(uuid.uuid4().hex, c.id, c.name, ir.canonical(c.condition), c.action, c.group or "default", c.priority, *f, "pending", at) for f in found]
            else:
                created.append(c)
                accepted.add(i)
                hold(c)
        self.put(created, at, user)
        self.append("parked", PARKED, parked)
        return {"created": [r.id for r in created], "parked": sorted({p[1] for p in parked}), "errors": errors}

    def parked(self, status: str | None = None) -> DataFrame:
        out = latest_versions(self.table("parked", PARKED), "park_id", "submitted_at")
        return (out if status is None else out.where(F.col("status") == status)).orderBy(F.desc("submitted_at"))

    def set_parked(self, park_id: str, status: str, at: datetime) -> None:
        if status not in ("pending", "approved", "dismissed", "deleted"):
            raise ValueError(f"unknown status {status!r}")
        rows = [tuple(status if k == "status" else at if k == "submitted_at" else v for k, v in r.asDict().items()) for r in self.parked().where(F.col("park_id") == park_id).collect()]
        if not rows:
            raise KeyError(park_id)
        self.append("parked", PARKED, rows)

    def resolve(self, park_id: str, changed: Rule, at: datetime) -> dict:
        """Write a parked rule after a change; it must differ from what was parked and pass validation."""
        old = self.parked().where(F.col("park_id") == park_id).head()
        if old is None:
            raise KeyError(park_id)
        if ir.content_hash(changed.condition) == ir.content_hash(old["condition"]) and changed.action == old["action"]:
            raise ValueError("the rule has not changed")
        out = self.import_rules([changed], at)
        if out["created"]:
            self.set_parked(park_id, "approved", at)
        return out

    def audit(self, entries: list[tuple], at: datetime) -> None:
        """Append (action_type, entity_type, entity_id, user_id, details) with their signatures."""
        with self.lock:
            self._audit(entries, at)

    def _audit(self, entries: list[tuple], at: datetime) -> None:
        last = self.table("audit", AUDIT).agg(F.max("id")).head()[0] or 0
        if not entries:
            return
        rows = [(last + i, *e, at, None) for i, e in enumerate(entries, 1)]
        stamped(self.spark.createDataFrame(rows, AUDIT), self.secret).coalesce(1).write.mode("append").parquet(f"{self.path}/audit")

    def policies(self) -> DataFrame:
        return latest_versions(self.table("policies", POLICIES), "name", "revision").where("not deleted")

    def _policy(self, name: str):
        found = self.policies().where(F.col("name") == name).head()
        if found is None:
            raise KeyError(name)
        return found

    def _write_policy(self, name: str, scope: str, schedule: str, enabled: bool, due: datetime, last: datetime | None, deleted: bool = False) -> None:
        revision = self.table("policies", POLICIES).where(F.col("name") == name).agg(F.max("revision")).head()[0] or 0
        self.append("policies", POLICIES, [(name, scope, schedule, enabled, due, last, revision + 1, deleted)])

    def save_policy(self, name: str, scope: str, schedule: str, at: datetime, enabled: bool = True) -> datetime:
        """Create a policy; its name must be new. Gives when it is due."""
        if self.policies().where(F.col("name") == name).limit(1).count():
            raise ValueError(f"policy {name!r} exists")
        cron.scopes(scope)
        due = cron.next_run(schedule, at)
        self._write_policy(name, scope, schedule, enabled, due, None)
        return due

    def update_policy(self, name: str, at: datetime, scope: str | None = None, schedule: str | None = None, enabled: bool | None = None) -> datetime:
        old = self._policy(name)
        scope, schedule = scope or old["scope"], schedule or old["schedule"]
        cron.scopes(scope)
        due = cron.next_run(schedule, at)
        self._write_policy(name, scope, schedule, old["enabled"] if enabled is None else enabled, due, old["last_run_at"])
        return due

    def delete_policy(self, name: str) -> None:
        old = self._policy(name)
        self._write_policy(name, old["scope"], old["schedule"], False, old["next_run_at"], old["last_run_at"], True)

    def due_policies(self, at: datetime) -> DataFrame:
        return self.policies().where(F.col("enabled") & (F.col("next_run_at") <= F.lit(at)))

    def run_policy(self, name: str, checks: dict, at: datetime) -> str:
        """Run the checks of a policy's scope, store the report and give its id; when the policy is due next is worked out anew."""
        policy, report = self._policy(name), uuid.uuid4().hex
        rows = audit_run(self.spark, checks, policy["scope"], at, self.secret)
        rows = rows.select(F.lit(report).alias("report_id"), F.lit(name).alias("policy"), F.lit(at).alias("ran_at"), "check", "scope", "passed", "count", "detail", "report_hash")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/reports")
        self._write_policy(name, policy["scope"], policy["schedule"], policy["enabled"], cron.next_run(policy["schedule"], at), at)
        return report

    def reports(self, policy: str | None = None, passed: bool | None = None, limit: int = 100) -> DataFrame:
        """The newest reports, a row for each check."""
        rows = self.table("reports", REPORTS)
        rows = rows if policy is None else rows.where(F.col("policy") == policy)
        rows = rows if passed is None else rows.where(F.col("passed") == passed)
        return rows.orderBy(F.desc("ran_at"), "report_id", "check").limit(limit)

    def report(self, report_id: str) -> DataFrame:
        return self.table("reports", REPORTS).where(F.col("report_id") == report_id)


class ImportJobs:
    """Bulk imports that run beside their caller; a job is pending, running, completed or failed."""

    def __init__(self, catalog: Catalog, workers: int = 4):
        self.catalog, self.pool = catalog, ThreadPoolExecutor(workers)
        self.jobs: dict[str, Future] = {}

    def submit(self, candidates: Iterable[Rule], at: datetime, user: int | None = None) -> str:
        job = uuid.uuid4().hex
        self.jobs[job] = self.pool.submit(self.catalog.import_rules, list(candidates), at, user)
        return job

    def state(self, job: str, wait: float | None = 0) -> dict:
        """Status of a job, with its result or its error once it has ended; wait: seconds to wait for that."""
        one = self.jobs[job]
        try:
            error = one.exception(wait)
        except TimeoutError:
            return {"status": "running" if one.running() else "pending"}
        return {"status": "failed", "error": f"{type(error).__name__}: {error}"} if error else {"status": "completed", **one.result()}


def latest_versions(versions: DataFrame, key: str = "rule_id", order: str = "version") -> DataFrame:
    """The newest row of each key, by aggregation (no sort, and partial in each task)."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*versions.columns)


def version_diff(versions: DataFrame, a: int, b: int, fields: Iterable[str], key: str = "rule_id", order: str = "version") -> DataFrame:
    """(key, field, old, new) of fields that differ between two versions; nothing unless both exist."""
    fields = list(fields)
    old = versions.where(F.col(order) == a).select(key, *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    new = versions.where(F.col(order) == b).select(key, *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields])
    out = old.join(new, key).select(key, F.explode(cells).alias("d")).select(key, "d.*")
    return out.where(~F.col("old").eqNullSafe(F.col("new")))


def _message():
    empty = F.lit("")
    return F.concat_ws("|", "action_type", "entity_type", F.coalesce(F.col("entity_id").cast("string"), empty), F.coalesce(F.col("user_id").cast("string"), empty), F.coalesce("details", empty), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def stamped(rows: DataFrame, secret: str) -> DataFrame:
    return rows.withColumn("integrity_hash", hmac_sha256(secret, _message()))


def audit_tally(rows: DataFrame, secret: str, newest: int = 1000) -> DataFrame:
    """(valid, invalid, unprotected) over the newest rows."""
    own = rows.orderBy(F.desc("id")).limit(newest)
    ok = F.col("integrity_hash") == hmac_sha256(secret, _message())
    return own.agg(F.count_if(F.col("integrity_hash").isNotNull() & ok).alias("valid"), F.count_if(F.col("integrity_hash").isNotNull() & ~ok).alias("invalid"), F.count_if(F.col("integrity_hash").isNull()).alias("unprotected"))


def retained(rows: DataFrame, now, days: int, column: str = "timestamp") -> DataFrame:
    """Rows of the last days; 0 keeps all."""
    return rows if days <= 0 else rows.where(F.col(column) >= F.lit(now).cast(rows.schema[column].dataType) - F.expr(f"interval {days} day"))


def rule_health(rules: DataFrame) -> DataFrame:
    """(issue, rules): disabled rules, empty conditions, empty actions, duplicate names."""
    named = rules.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rules")).select(F.lit("duplicate_name").alias("issue"), "rules")
    one = rules.agg(F.count_if(~F.col("enabled")).alias("disabled"), F.count_if(F.col("condition").isNull()).alias("empty_condition"), F.count_if(F.col("action") == "").alias("empty_action"))
    out = one.select(F.expr("stack(3, 'disabled', disabled, 'empty_condition', empty_condition, 'empty_action', empty_action) as (issue, rules)"))
    return out.unionByName(named.select("issue", F.col("rules").cast("long")))


def audit_run(spark: SparkSession, checks: dict, scope: str, at: datetime, secret: str = "") -> DataFrame:
    """(check, scope, passed, count, detail, report_hash): each check of a scope is run; one that fails tells so, the others go on."""
    rows = []
    for name in cron.scopes(scope):
        for title, check in checks.get(name, {}).items():
            try:
                n = int(check())
                rows.append((title, name, n == 0, n, None))
            except Exception as e:  # noqa: BLE001  an error is a finding of its own
                rows.append((title, name, False, None, f"{type(e).__name__}: {e}"))
    out = spark.createDataFrame(rows, "check string, scope string, passed boolean, count long, detail string")
    return out.withColumn("report_hash", hmac_sha256(secret, F.concat_ws("|", "check", "scope", F.col("passed").cast("string"), F.lit(at.isoformat()))))

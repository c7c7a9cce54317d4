"""What rule firings add up to: counts, hot and cold rules, coverage. Everything is derived from the table of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matcher import parse_explanation


def rule_hits(matches: DataFrame, time_col: str | None = None, fired_col: str | None = None) -> DataFrame:
    """(rule_id, hit_count[, total_ms, avg_ms][, last_fired_at])."""
    aggs = [F.count(F.lit(1)).alias("hit_count")]
    if time_col:
        aggs += [F.round(F.sum(time_col), 2).alias("total_ms"), F.round(F.avg(time_col), 2).alias("avg_ms")]
    if fired_col:
        aggs.append(F.max(fired_col).alias("last_fired_at"))
    return matches.groupBy("rule_id").agg(*aggs)


def hot_rules(hits: DataFrame, k: int = 10) -> DataFrame:
    """The k rules with most hits; ties by id."""
    return hits.orderBy(F.desc("hit_count"), "rule_id").limit(k)


def cold_rules(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """Enabled rules that never matched."""
    return rules.where("enabled").select("rule_id", "rule_name").join(matches.select("rule_id").distinct(), "rule_id", "left_anti")


def with_names(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Names on metrics; a rule that is gone has none."""
    return hits.join(rules.select("rule_id", "rule_name"), "rule_id", "left")


def coverage_summary(rules: DataFrame, matches: DataFrame) -> DataFrame:
    """(total_rules, triggered_rules, never_fired, total_hits, coverage_pct) over enabled rules."""
    hit = matches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    own = rules.where("enabled").join(hit, "rule_id", "left")
    out = own.agg(F.count(F.lit(1)).alias("total_rules"), F.count("hits").alias("triggered_rules"), F.coalesce(F.sum("hits"), F.lit(0)).cast("long").alias("total_hits"))
    return out.select("total_rules", "triggered_rules", (F.col("total_rules") - F.col("triggered_rules")).alias("never_fired"), "total_hits", F.when(F.col("total_rules") > 0, F.round(100.0 * F.col("triggered_rules") / F.col("total_rules"), 2)).otherwise(0.0).alias("coverage_pct"))


def dashboard(rules: DataFrame) -> DataFrame:
    """(total, enabled, disabled, groups)."""
    return rules.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled"), F.count_distinct(F.when(F.col("grp") != "", F.col("grp"))).alias("groups"))


def groups(rules: DataFrame) -> DataFrame:
    return rules.where("grp <> ''").select("grp").distinct()


def explanation_feed(matches: DataFrame, time_col: str, limit: int = 25, rule_id: int | None = None) -> DataFrame:
    """The newest explanations, of one rule where it is given, with their conditions taken apart."""
    own = matches if rule_id is None else matches.where(F.col("rule_id") == rule_id)
    good, bad = parse_explanation(F.col("explanation"))
    return own.orderBy(F.desc(time_col)).limit(limit).withColumn("matched", good).withColumn("missing", bad)


def structural_explanation(cons: DataFrame) -> DataFrame:
    """(rule_id, constraints): each rule's constraints as text, in order of field."""
    text = F.concat(F.col("field"), F.lit(" "), F.col("op"), F.lit(" "), F.coalesce(F.col("txt"), F.col("num").cast("string"), F.lit("NULL")))
    return cons.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_list(text)), "; ").alias("constraints"))


def engine_stats(matches: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """(evaluations, matched_events, matches)."""
    return events.agg(F.count(F.lit(1)).alias("evaluations")).crossJoin(matches.agg(F.count_distinct(key).alias("matched_events"), F.count(F.lit(1)).alias("matches")))

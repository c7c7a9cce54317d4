"""URL filters: rules on host and path, and for what no rule fits, trust and distrust that spread over links between hosts.

Hosts whose pages the rules allow are trusted seeds, those whose pages they block are blocked seeds, each by the share of its
ruled pages. Personalised PageRank from the trusted seeds runs along links; distrust runs from the blocked seeds against them,
to hosts that link to blocked ones. Both are iterations over a table of host edges in Spark. A host is blocked where distrust
outweighs trust by a threshold on their share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: The rules of the contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']?([^\"'\s>]+)"
DAMPING = 0.85
#: Propagation ends when ranks move by less than CLOSE in all, which DAMPING brings about in 60 rounds; ROUNDS bounds them.
ROUNDS = 100
CLOSE = 1e-4


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does. Ties go by text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, from (host, html); a page's links to one host count once. Only a link
    that starts with a scheme and ``//``, or with ``//``, goes to another host."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda u: u.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//")), lambda u: host_of(F.regexp_replace(u, r"^//", "http://"))))).alias("dst"))
    return links.where("dst <> '' and host <> '' and dst <> host").groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def propagate(edges: DataFrame, hosts: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from hosts (host, good, bad: seed mass, each summing to 1 or 0) and weighted edges.

    Mass at hosts without links onward goes back to the seeds, so that both keep their sums. Rounds end when ranks have settled;
    if they have not within ``rounds``, that is an error.
    """
    out, into = edges.groupBy("src").agg(F.sum("weight").alias("o")), edges.groupBy("dst").agg(F.sum("weight").alias("i"))
    both = edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("weight") / F.col("o")).alias("forth"), (F.col("weight") / F.col("i")).alias("back"))
    both = stored(both, tidy=False)
    rank = stored(hosts.select("host", "good", "bad", F.col("good").alias("trust"), F.col("bad").alias("distrust")), tidy=False)
    empty = both.limit(1).count() == 0
    if empty:
        return rank.select("host", "trust", "distrust")
    for _ in range(rounds):
        onward = both.join(rank, both.src == rank.host).groupBy(F.col("dst").alias("h")).agg(F.sum(F.col("trust") * F.col("forth")).alias("t"))
        against = both.join(rank, both.dst == rank.host).groupBy(F.col("src").alias("g")).agg(F.sum(F.col("distrust") * F.col("back")).alias("d"))
        new = rank.join(onward, rank.host == onward.h, "left").join(against, rank.host == against.g, "left")
        new = new.select("host", "good", "bad", (damping * F.coalesce("t", F.lit(0.0))).alias("t"), (damping * F.coalesce("d", F.lit(0.0))).alias("d"))
        new = stored(new, tidy=False)
        s = new.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).head()
        back = [1 - (s["t"] or 0.0), 1 - (s["d"] or 0.0)]
        old, rank = rank, stored(new.select("host", "good", "bad", (F.col("t") + back[0] * F.col("good")).alias("trust"), (F.col("d") + back[1] * F.col("bad")).alias("distrust")), tidy=False)
        was = old.select(F.col("host").alias("h"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = rank.join(was, F.col("host") == F.col("h")).agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))).alias("m")).head()["m"] or 0.0
        discard(old)
        discard(new)
        if moved < CLOSE:
            break
    else:
        raise ValueError(f"ranks have not settled within {rounds} rounds")
    discard(both)
    return rank.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every row.

    verdict is that of the longest rule that fits; else ``block`` if the host's share of distrust is above ``threshold``, else
    ``allow`` (also for hosts that neither reaches, and for urls without a host). Null urls, or urls without ://, have an empty
    host and path. Null html has no links. Repeated rows give equal rows. Other columns are ignored. Empty table: no rows.
    """
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumn("rule", rule).withColumn("ruled", verdict)
    edges = stored(host_edges(base), tidy=False)
    seeds = judged.where("host <> ''").groupBy("host").agg(F.avg((F.col("ruled") == "allow").cast("double")).alias("good"), F.avg((F.col("ruled") == "block").cast("double")).alias("bad"))
    far = edges.select(F.col("dst").alias("host"), F.lit(None).cast("double").alias("good"), F.lit(None).cast("double").alias("bad"))
    hosts = seeds.unionByName(far).groupBy("host").agg(F.coalesce(F.max("good"), F.lit(0.0)).alias("good"), F.coalesce(F.max("bad"), F.lit(0.0)).alias("bad"))
    hosts = stored(hosts, tidy=False)
    total = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).head()
    scaled = hosts.select("host", (F.col("good") / F.lit(total["g"] or 1.0)).alias("good"), (F.col("bad") / F.lit(total["b"] or 1.0)).alias("bad"))
    rank = propagate(edges, scaled, rounds)
    out = judged.drop("html").join(rank, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    method = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. Nulls, repeats, ties and empty tables: as in filter_urls()."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))

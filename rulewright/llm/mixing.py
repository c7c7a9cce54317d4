"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (how often it is taken), as close as can be, in relative entropy weighted by words, to taking all
documents once, while the words of each source meet their target and no rate exceeds a cap. The solution is an exponential
tilt, ``rate = min(cap, exp(lambda))`` with one multiplier for each source; Newton iterations on the convex dual find the
multipliers, each an aggregation over documents (pre-aggregated by source and size) in Spark, with multipliers in a table.

Rates become copies: every document is taken floor(rate) times, and those whose hashed id is below a source's threshold once
more. The threshold is where the words of the extra copies reach what is missing: it is found by a histogram of the hashes and
then within the one cell that holds it, so no task orders a source. The last document is taken in part, which meets the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: What a word is, and the weights of sources in their order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CELLS = 4096
#: Newton rounds until steps are below CLOSE; a multiplier moves by about 1 a round, so this reaches shares of e^-60.
ROUNDS = 60
CLOSE = 1e-12


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): a share of all words by weight, no source above cap times its size, excess dealt again.

    sizes: (source, source_size), a row for each source. Sources come in code point order, null last, weights repeating.
    Capping is a threshold on size / weight: sources are capped in ascending order of it for as long as they would exceed
    their cap at the rate that the others then share. It is found by running sums, without a loop.
    """
    one = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))
    s = s.withColumn("ratio", F.col("source_size") / F.col("weight"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", F.sum("source_size").over(one)).withColumn("used", cap * F.coalesce(F.sum("source_size").over(ahead), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    s = s.withColumn("rate", (share * F.col("all") - F.col("used")) / F.col("left_weight"))
    s = s.withColumn("capped", F.col("weight") * F.col("rate") > cap * F.col("source_size"))
    rate = F.coalesce(F.max(F.when(~F.col("capped"), F.col("rate"))).over(one), F.lit(0.0))  # the first that is not capped has the highest
    target = F.when(F.col("capped"), cap * F.col("source_size")).otherwise(F.col("weight") * rate)
    return s.select("source", "source_size", target.cast("double").alias("target"))


def balance(stats: DataFrame, goals: DataFrame, cap: float = 2.0, rounds: int = ROUNDS) -> DataFrame:
    """(source, source_size, target, rate): the exponentially tilted rate of each source's documents.

    stats: (source, size, docs), counts of documents by size. The dual of source s is sum(size * exp(l)) - target * l; its
    gradient and curvature are sums over documents, and a Newton step is gradient / curvature. Where the target is the cap
    the multiplier is log(cap); where it is 0, or the source has no words, the rate is 0. Steps are cut to 2 either way. If they
    have not ended within ``rounds``, that is an error.
    """
    at = stored(goals.select("source", "source_size", "target", F.lit(0.0).alias("mult")), tidy=False)
    for _ in range(rounds):
        tilted = stats.join(at, stats.source.eqNullSafe(at.source)).groupBy(at.source).agg(F.sum(stats.docs * stats.size * F.exp("mult")).alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("mult").alias("mult"))
        step = F.when((F.col("words") <= 0) | (F.col("target") <= 0), F.lit(0.0)).otherwise((F.col("words") - F.col("target")) / F.col("words"))
        new = stored(tilted.select("source", "source_size", "target", (F.col("mult") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))).alias("mult"), F.abs(step).alias("moved")), tidy=False)
        discard(at)
        at = new
        if (at.agg(F.max("moved").alias("m")).head()["m"] or 0.0) < CLOSE:
            break
    else:
        raise ValueError(f"multipliers have not settled within {rounds} rounds")
    rate = F.when((F.col("target") <= 0) | (F.col("source_size") <= 0), 0.0).otherwise(F.least(F.lit(cap), F.exp("mult")))
    return at.select("source", "source_size", "target", rate.alias("rate"))


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple = WEIGHTS, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every row.

    taken is the number of words the mix takes of the row, repeats counted: copies whole, and for one document of each source a
    part of one more. Null or blank texts have size 0 and are never taken; null sources are one source, the last. Ties of hashes
    are broken by id; repeated rows get equal shares, less at most a word each. The result depends on rows alone, so runs agree.
    Other columns are ignored. Empty table: no rows.
    """
    plan = _plan(docs, share, weights, cap, id_col, text_col, source_col)
    return plan.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("one", "times", "key")


def mix_key(id_col: str, text_col: str, source_col: str):
    """Stands for the rows of one id, text and source."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(source_col), F.col(source_col).isNull())


def _plan(docs: DataFrame, share: float, weights: tuple, cap: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """What mix_sources() gives, with key, a row for each document and how many times it stands in docs."""
    base = docs.select(mix_key(id_col, text_col, source_col).alias("key"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    base = base.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("one"), F.count(F.lit(1)).alias("times"))
    base = base.withColumn("size", F.col("one") * F.col("times"))
    # the counts stand in a small table: texts are read once
    base = stored(base.withColumn("hash", F.xxhash64(F.col("key"), F.lit(11))).withColumn("cell", F.shiftrightunsigned("hash", 52).cast("int")))
    stats = stored(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), tidy=False)
    sizes = stats.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    solved = balance(stats, targets(sizes, share, weights, cap), cap)
    discard(stats)
    # words that whole copies leave open; a target at the cap is met by whole copies of all
    solved = solved.withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("long")).withColumn("need", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))).cast("long"))
    cells = base.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("upto", F.sum("words").over(run))
    joined = cells.join(solved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("upto >= need")
    edge = joined.groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))).alias("edge")).select(F.col("source").alias("e"), F.col("edge.cell").alias("edge"), F.col("edge.before").alias("before"))
    plan = stored(solved.join(edge, F.col("source").eqNullSafe(F.col("e")), "left").select(F.col("source").alias("s"), "source_size", "target", "rate", "whole", "need", F.coalesce("edge", F.lit(CELLS)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")), tidy=False)
    rows = base.join(plan, F.col("source").eqNullSafe(F.col("s")))
    plain = rows.where("cell <> edge").withColumn("extra", F.when(F.col("cell") < F.col("edge"), F.col("size")).otherwise(0))
    inside = Window.partitionBy("source").orderBy(F.shiftleft("hash", 12), "hash", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("cell = edge").withColumn("gone", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = last.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("gone")))).drop("gone")
    taken = F.col("whole") * F.col("one") + F.floor(F.col("extra") / F.col("times"))
    copies = F.when(F.col("one") > 0, F.ceil(taken / F.col("one"))).otherwise(0)
    return plain.unionByName(last).select("key", "doc_id", "source", F.col("one").alias("size"), "source_size", "target", "rate", copies.cast("int").alias("copies"), taken.cast("long").alias("taken"), "times")


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document. Nulls, repeats and ties: as in mix_sources()."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the mix itself, a row for each copy of each document that it takes.

    Columns are those of docs and ``copy`` (from 0 on; ``mix_copy`` if docs has one of that name). Where a source ends within a
    document, its last copy has the first words of the text alone, parted by blanks. Null and blank texts are not taken, repeated
    rows each get their share. Other columns come along, whatever their names. An empty table stays empty.
    """
    plan = stored(_plan(docs, 1.5, WEIGHTS, 2.0, "doc_id", "text", "source").where("taken > 0").select("key", "copies", F.col("size").alias("words"), "taken"), tidy=False)
    whole = docs.select(mix_key("doc_id", "text", "source").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = whole.join(plan, "key").select("row", "words", "taken", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    left = F.col("taken") - F.col("copy") * F.col("words")
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    text = F.when(left < F.col("words"), part).otherwise(F.col("row.text"))
    name = "mix_copy" if "copy" in docs.columns else "copy"
    return out.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns), F.col("copy").alias(name))

"""Benchmark decontamination with DataFrame functions alone: a broadcast hash set of the benchmark's windows of words.

Every window of 13 words of a document is hashed and looked up in the set of the benchmark's window hashes (broadcast while it is
small, shuffled beyond that); hashes leave the texts behind. Documents with a hit are read again and hits verified on the words. Benchmark items of fewer words are one window of
that many words; documents are then scanned for windows of those lengths too, twelve more lengths at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: What a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text as it is.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of the benchmark, of all items, up to which their hashes are broadcast: 8 bytes each, some 30 MB in a hash table.
BROADCAST_WINDOWS = 500_000
#: Characters of these windows up to which they are broadcast themselves, to verify hits.
BROADCAST_CHARS = 64 << 20
#: Documents with hits up to which their keys, 8 bytes each, are broadcast, so that no text is exchanged to find them.
BROADCAST_KEYS = 1 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(bench: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id string, len, gram array, hash): every window of every item; an item of fewer words, but not none, is one."""
    own = bench.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("len", F.least(F.size("w"), F.lit(size)))
    own = own.select("item_id", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("at"))
    own = own.select("item_id", "len", F.slice("w", F.col("at") + 1, F.col("len")).alias("gram")).distinct()
    return own.withColumn("hash", F.xxhash64(_hashed(F.col("gram"))))


def _hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _windows(n: int) -> Column:
    """(at, len, hash) of the windows of n words of the hashes h."""
    places = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.xxhash64(F.slice("h", i + 1, n)).alias("hash")))


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def hits(docs: DataFrame, bench: DataFrame, size: int = 13, item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(row_key, at, len, item_id) of every verified occurrence of a benchmark window; docs: (row_key, text)."""
    grams = stored(benchmark_windows(bench, size, item_col, bench_text), tidy=False)
    shapes = grams.groupBy("len").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.array_join("gram", " "))).alias("chars")).collect()  # 13 rows at most
    lengths = sorted(r["len"] for r in shapes) or [size]
    table, full = grams.select("hash").distinct(), grams.select("hash", "gram", "item_id")
    if sum(r["n"] for r in shapes) <= BROADCAST_WINDOWS:
        table = F.broadcast(table)
        if sum(r["chars"] for r in shapes) <= BROADCAST_CHARS:
            full = F.broadcast(full)
    hashed = docs.select("row_key", _hashed(words(F.col("text"))).alias("h"))
    all_ = _windows(lengths[0]) if len(lengths) == 1 else F.flatten(F.array(*(_windows(n) for n in lengths)))
    found = hashed.select("row_key", F.inline(all_)).join(table, "hash", "left_semi")
    found = stored(found.groupBy("row_key").agg(F.collect_set(F.struct("at", "len", "hash")).alias("found")), tidy=False)
    again = docs.join(_few(found.select("row_key")), "row_key", "left_semi").groupBy("row_key").agg(F.first("text").alias("text"))
    again = again.join(found, "row_key").select("row_key", words(F.col("text")).alias("w"), "found")
    spelled = again.select("row_key", F.inline(F.expr("transform(found, x -> struct(x.at as at, x.len as len, x.hash as hash, slice(w, x.at + 1, x.len) as words))")))
    return spelled.join(full, "hash").where(F.col("words") == F.col("gram")).select("row_key", "at", "len", "item_id")


def contamination(docs: DataFrame, bench: DataFrame, size: int = 13, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated) of every row.

    n_hit counts words inside an occurrence of a benchmark window, items are the ids (as strings, sorted) of items with one,
    spans the merged runs (first word, words) that are hit; contaminated if words are hit and are ``percent`` of 100 or more.
    Null, empty or wordless texts have no words and are never contaminated; a null item id is left out of items but its windows
    hit. Repeated rows give equal rows; rows that share an id are judged by their own texts. Only the named columns are read.
    Empty benchmark: no hits. Empty documents: no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.select("doc_id", _key("doc_id", "text").alias("row_key"), "text")
    found = hits(own.select("row_key", "text"), bench, size, item_col, bench_text)
    per = found.groupBy("row_key", "at", "len").agg(F.collect_set("item_id").alias("items"))
    per = per.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    runs = F.expr("""aggregate(runs, cast(array() as array<struct<at:int,end:int>>), (s, x) -> if(size(s) > 0 and x.at <= element_at(s, -1).end,
        concat(slice(s, 1, size(s) - 1), array(named_struct('at', element_at(s, -1).at, 'end', greatest(element_at(s, -1).end, x.end)))), concat(s, array(named_struct('at', x.at, 'end', x.end)))))""")
    per = per.select("row_key", "items", runs.alias("spans"))
    count = own.select("doc_id", "row_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = count.join(per, "row_key", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,end:int>>)"))).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    out = out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.at)"))
    return out.select("doc_id", "row_key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def decontaminate(docs: DataFrame, bench: DataFrame, action: str = "documents", size: int = 13, percent: int = 5) -> DataFrame:
    """docs without its contaminated documents (action ``documents``), or all documents without the words that are hit (action
    ``spans``): each goes with what stands between it and the next word, and all else of the text stays as it is.

    Nulls and repeats as in contamination(): rows without words stay, repeated rows share their fate. Other columns come along,
    whatever their names. Empty tables: docs stay as they are, or empty.
    """
    judged = contamination(docs, bench, size, percent)
    whole = docs.select(_key("doc_id", "text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if action == "documents":
        bad = stored(judged.where("contaminated").select(F.col("row_key").alias("key")).distinct(), tidy=False)
        return whole.join(_few(bad), "key", "left_anti").select("row.*")
    spans = judged.where("n_hit > 0").groupBy(F.col("row_key").alias("key")).agg(F.first("spans").alias("spans"))
    out = whole.join(spans, "key", "left").select("row", "spans", F.col("row.text").cast("string").alias("text"))
    out = out.select("row", "spans", "text", F.regexp_extract_all("text", F.lit(ANY_WORD), F.lit(0)).alias("w"), F.split("text", ANY_WORD, -1).alias("gap"))
    kept = F.expr("array_join(transform(w, (x, i) -> if(exists(spans, s -> i >= s.at and i < s.end), '', concat(x, gap[i + 1]))), '')")
    text = F.when(F.col("spans").isNotNull(), F.concat(F.col("gap")[0], kept)).otherwise(F.col("text"))
    return out.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words hit, items and verdict of every document. Nulls, repeats, short and empty texts: as in contamination()."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go. Nulls, repeats, empty tables and other columns: as in decontaminate()."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM g),
s AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT s.doc_id, s.i, s.n, g.item_id FROM s JOIN g ON s.g = g.g AND s.n = g.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
 coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

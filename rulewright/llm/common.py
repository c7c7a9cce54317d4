"""Shared pieces of the operators: scratch tables, bucketed binary exchange, vectorised text hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
NULL_ID = np.iinfo(np.int64).max
#: Bytes of text that one step of a vectorised pass works on; bounds the temporaries of a task.
PIECE = 1 << 20
#: Entries that a task gathers before it hands them on.
FLUSH = 1 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rulewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, tidy: bool = True) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts the lineage; a lost executor loses none of it.

    tidy lets go of the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if tidy:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "stored_at", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size, from the files it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, factor: float = 3.0, target: int = 4 << 20) -> int:
    """Number of buckets that keeps each near target bytes, from the input's size; never under one for each shuffle partition.

    No more than that: a task sends a blob to each bucket, so blobs would else grow with tasks times buckets.
    """
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(min(1 << 24, max(at_least, plan_bytes(df) * factor // target)))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor, shift, multiply)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array end to end, and where each text starts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    ends = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def pieces(starts: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes each; a longer text is a piece of its own."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = int(np.searchsorted(starts, starts[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def ids(column: pa.Array) -> np.ndarray:
    """Integer ids; null becomes the largest number and so comes last."""
    if column.null_count:
        column = pc.fill_null(column, int(NULL_ID))
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_POW: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    have = _POW.get(kind)
    if have is None or len(have) < n:
        have = _POW[kind] = _powers(_BASE if kind == "up" else _INVERSE, max(n, PIECE + 4096) if n <= 4 * PIECE else n)
    if len(have) > 4 * PIECE:  # of one very long text; not kept
        del _POW[kind]
    return have[:n]


def word_places(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of texts laid end to end begin and end, and the number of words of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    space = _SPACE[buf]
    first = np.ones(n, bool)
    first[1:] = space[:-1]
    inner = starts[:-1][starts[:-1] < n]
    first[inner] = True
    begin = np.flatnonzero(first & ~space)
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    last[inner[inner > 0] - 1] = True
    return begin, np.flatnonzero(last & ~space) + 1, np.diff(np.searchsorted(begin, starts))


def hashes_at(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from begin to end: polynomials, taken as differences of prefix sums, so that no word is handled alone."""
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U(1)) * powers("up", n), out=total[1:])
    return mix((total[end] - total[begin]) * powers("down", n)[begin] + (end - begin).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, A-Z lower-cased, and the number of words of each text."""
    begin, end, count = word_places(buf, starts)
    if not len(buf):
        return np.zeros(0, np.uint64), count
    return hashes_at(np.where((buf >= 65) & (buf <= 90), buf + 32, buf), begin, end), count


def places(keys: np.ndarray) -> np.ndarray:
    """The place of each entry among the equal ones before it, of sorted keys."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return np.arange(len(keys)) - np.repeat(cut, np.diff(np.append(cut, len(keys))))


class Sender:
    """Gathers equal-length arrays with a bucket for each entry, and yields (bucket, blob) rows of them.

    Rows stay few and compact however many entries there are; the exchange moves blobs, not rows for single entries.
    """

    def __init__(self, kinds: list[str], limit: int = FLUSH):
        self.kinds, self.limit, self.held, self.parts = kinds, limit, 0, []

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> None:
        if len(bucket):
            self.parts.append((bucket, *columns))
            self.held += len(bucket)

    def full(self) -> bool:
        return self.held >= self.limit

    def rows(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        bucket, *columns = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        columns = [c[order].astype(k) for c, k in zip(columns, self.kinds, strict=True)]
        cut = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
        for a, b in zip(cut, [*cut[1:], len(bucket)], strict=True):
            yield int(bucket[a]), b"".join(c[a:b].tobytes() for c in columns)


def received(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The arrays that Sender put into blobs, joined."""
    widths = [np.dtype(k).itemsize for k in kinds]
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for b in blobs:
        n, at = len(b) // sum(widths), 0
        for k, w, to in zip(kinds, widths, out, strict=True):
            to.append(np.frombuffer(b, dtype=k, count=n, offset=at))
            at += n * w
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True)]


_ZSTD = pa.Codec("zstd", compression_level=1)


def packed(raw: bytes) -> bytes:
    """raw, compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpacked(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


def by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Consecutive rows with one key, of batches sorted by it, as slices; for groups of bounded size."""
    now, held = None, []
    for batch in batches:
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(k):
            continue
        cut = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for a, b in zip(cut, cut[1:], strict=False):
            if held and k[a] != now:
                yield now, held
                held = []
            now = int(k[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield now, held


def row_key(id_col: str, text_col: str):
    """A hash of id and text that stands for a row; null ids and null texts have one too (that of an empty text)."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b), for every node that an edge has.

    Each round takes the smallest label among the neighbours and then the label of that label, so that paths shorten by a
    power; labels are written to the shared folder each round. No step needs a component, or a node's edges, in one place.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), tidy=False)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), tidy=False)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("node").alias("of"), F.col("label").alias("next"))
        new = stored(step.join(jump, step.label == jump.of, "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), tidy=False)
        changed = new.where("label <> was").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels.stored_at = new.stored_at
        if not changed:
            discard(both)
            return labels

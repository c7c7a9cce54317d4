"""N-gram Jaccard join: documents whose sets of word shingles overlap by a share of their union, and the classes they form.

Filter by prefixes under several global token orders. In any order that all documents share, two sets of Jaccard ``t`` must
have a common token among the first ``n - ceil(t n) + 1`` of each. Every order here puts tokens of many documents last (by
counts over all documents) and differs in how it orders the rest. The first order gives groups of candidates; a pair goes on
only if the prefixes under each other order share a token too, which is tested on hashes of tokens before any text moves; what
is left is verified on the whole sets.

Equal sets are one node, and groups of the same nodes are one group. Pairs are spelled out in groups of at most ``SMALL`` nodes
alone. A larger group, which may hold a third of all rows, gets a pivot: the tokens that over a quarter of some of its nodes have
(the core), and in a family, where most are near the core, also those that several have, so that what is outside is shared by few. For any
set ``c``: if all that x and y share is in ``c``, then |x & y| is at most |x & c| and |y & c|. So two nodes link only if

* they share a token outside the pivot, and then also among the first ``n - ceil(t n) + 1`` of those: such tokens form the
  groups of the next round, those alone that several nodes of the group have; or
* both hold so much of the pivot that it would do (``near``). Where what x and y miss of the core together leaves enough, both
  surely link with the node that misses least among those no larger than either, so links to these few nodes stand for such
  pairs. Near nodes that are then in another class than most of their group are compared with its near nodes one by one.

A pivot is only a help: whatever it is, no link is lost. All of it is exact up to 64-bit hash collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FLUSH, NULL_ID, U, Sender, buckets_for, by_key, connected, discard, flat, mix, pieces, places, received, release, row_key, stored, word_hashes

#: Numbers that make the token orders differ: fixed values.
ORDERS = (0, 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)
#: Most tokens that the orders put last one by one; 16 bytes each when sent to executors. Any choice gives the same links.
COMMON = 1 << 20
#: Bits of a set's parities; they turn away pairs that surely differ in too many tokens before texts are moved.
BITS = 2048
#: Nodes of a group up to which its pairs are spelled out. Any choice gives the same links.
SMALL = 12
#: Nodes of a larger group that its pivot is made from, about.
VOTERS = 256
#: Tokens of a pivot, as a multiple of the voters' mean, up to which a family's takes in what several voters have.
WIDE = 2
#: Tokens of all pivots up to which they are broadcast, 8 bytes each; beyond, they are joined by exchange.
PIVOTS = 1 << 21
#: Tokens that a verifying task holds of nodes it may meet again.
KNOWN = 1 << 21


def shingle_sets(buf: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words the whole sequence is one; without words none."""
    h, count = word_hashes(buf, starts)
    at = np.concatenate([[0], np.cumsum(count)])
    keys = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(size)]
    total = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        total += h[k : k + len(total)] * keys[k]
    total = mix(total)
    begin, end = at[:-1], at[:-1] + np.maximum(count - size + 1, 0)  # shingles that cross from text to text lie between
    spans = list(zip(begin.tolist(), end.tolist(), strict=True))
    for a, b in spans:
        total[a:b].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[begin[begin < end]] = True
    again = np.flatnonzero(~fresh)
    repeats = (np.searchsorted(again, begin) < np.searchsorted(again, end)).tolist()
    out = []
    for i, n in enumerate(count.tolist()):
        a, b = spans[i]
        if n >= size:
            out.append(total[a:b][fresh[a:b]] if repeats[i] else total[a:b])
        elif n:
            own = U(n)
            with np.errstate(over="ignore"):
                for k in range(n):
                    own = own + h[a + k] * keys[k]
            out.append(mix(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _token_key(tokens: np.ndarray, n: int) -> np.ndarray:
    return (tokens % U(n)) << U(32) | tokens >> U(32)


class Common:
    """The tokens of many documents, by key, with their levels; a bitmap turns most other tokens away at once."""

    def __init__(self, keys: np.ndarray, level: np.ndarray):
        by = np.argsort(keys)
        self.keys, self.level = keys[by], level[by].astype(np.int64)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys & U(0xFFFFFFFF)) >> U(10)] = True  # the highest bits of a token

    def late(self, tokens: np.ndarray, n: int) -> np.ndarray:
        """How far back each token comes in all orders: its level, 0 for a token that is not common."""
        out = np.zeros(len(tokens), np.int64)
        if len(self.keys):
            may = np.flatnonzero(self.bits[(tokens >> U(42)).view(np.int64)])
            key = _token_key(tokens[may], n)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[may] = np.where(self.keys[at] == key, self.level[at], 0)
        return out

    def each(self, sets: list[np.ndarray], n: int) -> list[np.ndarray]:
        """late() of several sets, in one step."""
        ends = np.cumsum([len(t) for t in sets]).tolist()
        out = self.late(np.concatenate(sets), n)
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def prefix(tokens: np.ndarray, order: int, late: np.ndarray, percent: int, keep: int | None = None) -> np.ndarray:
    """The tokens that come first under an order, as many as a set of that Jaccard must share one of, or ``keep``."""
    if keep is None:
        keep = len(tokens) - -(-percent * len(tokens) // 100) + 1
    if len(tokens) <= keep:
        return tokens
    rare = tokens[late == 0]
    if len(rare) >= keep:
        return rare[:keep] if not order else rare[np.argpartition(rare * U(order | 1), keep - 1)[:keep]]
    by = tokens * U(order | 1) if order else tokens
    return tokens[np.lexsort((by, late))[:keep]]


def parity(tokens: np.ndarray) -> list[int]:
    """BITS parities of hashed tokens as 64-bit words: two sets differ in at least as many tokens as their words in bits."""
    count = np.bincount(((tokens >> U(20)) & U(BITS - 1)).view(np.int64), minlength=BITS)  # tokens are hashes
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch], size: int, n: int) -> Iterator[pa.RecordBatch]:
    """Tokens by bucket: alone if a flush has them once (kind 0), else with their count (kind 1)."""
    once, more = Sender(["u4"]), Sender(["u4", "u4"])
    held: list[np.ndarray] = []
    for b in batches:
        buf, starts = flat(b.column(0))
        for i, j in pieces(starts):
            held += shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            if sum(map(len, held)) >= 4 * FLUSH:
                yield from _counted(held, once, more, n)
                held = []
    yield from _counted(held, once, more, n)


def _counted(held: list[np.ndarray], once: Sender, more: Sender, n: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    key, count = np.unique(_token_key(np.concatenate(held), n), return_counts=True)
    bucket, token, one = (key >> U(32)).astype(np.int32), key.astype(np.uint32), count == 1
    once.add(bucket[one], token[one])
    more.add(bucket[~one], token[~one], count[~one])
    yield _blobs(once.rows())
    yield _blobs(more.rows(), 1)


def _blobs(rows, kind: int = 0) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _by_kind(group: list[pa.RecordBatch]) -> list[list[bytes]]:
    return [[x for g in group for x in g.column("blob").filter(pc.equal(g.column("kind"), kind)).to_pylist()] for kind in (0, 1)]


def _common(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for bucket, group in by_key(batches, "bucket"):
        once, more = _by_kind(group)
        (t,), (u, number) = received(once, ["u4"]), received(more, ["u4", "u4"])
        values, at = np.unique(np.concatenate([t, u]), return_inverse=True)
        count = np.bincount(at, np.concatenate([np.ones(len(t)), number]), len(values)).astype(np.int64)
        big = count >= least
        key = U(bucket) << U(32) | values[big].astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count[big])], names=["key", "docs"])


def _nodes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, starts = flat(b.column(2))
        node, num = [], []
        for i, j in pieces(starts):
            for tokens in shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size):
                node.append(node_of(tokens))
                num.append(len(tokens))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(num, pa.int64())], names=["doc_id", "row_key", "node", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, n: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """(token, node, size) by bucket of the token, two nodes of each token a flush: they show that it has several. What else
    the flush has of it (kind 1) goes by token and node, so that no token gathers its nodes in one task."""
    common = order.value
    few, rest = Sender(["u8", "i8", "u4"]), Sender(["u8", "i8", "u4"])
    held: list[tuple[np.ndarray, int, int]] = []
    seen: set[int] = set()  # nodes of what is being gathered: copies in a task count once
    total = 0
    for b in batches:
        buf, starts = flat(b.column(0))
        for i, j in pieces(starts):
            sets = shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            for tokens, late in zip(sets, common.each(sets, n), strict=True):
                node = node_of(tokens)
                if not len(tokens) or node in seen:
                    continue
                seen.add(node)
                held.append((prefix(tokens, ORDERS[0], late, percent), node, len(tokens)))
                total += len(held[-1][0])
            if total >= FLUSH:
                yield from _sent(held, few, rest, n)
                held, total = [], 0
                seen.clear()
    yield from _sent(held, few, rest, n)


def _sent(held: list[tuple[np.ndarray, int, int]], few: Sender, rest: Sender, n: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    first, nodes, sizes = zip(*held, strict=True)
    each = [len(x) for x in first]
    token, node, num = np.concatenate(first), np.repeat(np.array(nodes, np.int64), each), np.repeat(np.array(sizes, np.int64), each)
    by = np.argsort(token, kind="stable")
    token, node, num = token[by], node[by], num[by]
    shown = places(token) > 1
    few.add((token[~shown] % U(n)).astype(np.int32), token[~shown], node[~shown], num[~shown])
    rest.add((mix(token[shown] ^ mix(node[shown].view(np.uint64))) % U(n)).astype(np.int32), token[shown], node[shown], num[shown])
    yield _blobs(few.rows())
    yield _blobs(rest.rows(), 1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the (token, node, size) rows of tokens that several nodes have in their prefixes."""
    for _, group in by_key(batches, "bucket"):
        for kind, blobs in enumerate(_by_kind(group)):
            token, node, num = received(blobs, ["u8", "i8", "u4"])
            order = np.lexsort((node, token))
            token, node, num = token[order], node[order], num[order]
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, num = token[once], node[once], num[once]
            _, at, count = np.unique(token, return_inverse=True, return_counts=True)
            many = (count[at] > 1) | bool(kind)
            yield pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(node[many]), pa.array(num[many].astype(np.int64))], names=["g", "node", "n"])


def _texts(batches: Iterator[pa.RecordBatch], size: int, n: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """Beside each node's text its parities and, for each order but the first, its prefix as 32-bit hashes."""
    common = order.value
    for b in batches:
        buf, starts = flat(b.column(1))
        bits, first = [], [[] for _ in ORDERS[1:]]
        for i, j in pieces(starts):
            sets = shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            for t, late in zip(sets, common.each(sets, n), strict=True):
                bits.append(parity(t))
                for o, to in zip(ORDERS[1:], first, strict=True):
                    to.append(prefix(t, o, late, percent).astype(np.uint32).view(np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(bits, pa.int64()), *(_lists(x, pa.int32()) for x in first)], names=["node", "text", "bits", *(f"first{k}" for k in range(1, len(ORDERS)))])


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else [], kind))


def _verify(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that link: 100 |a & b| >= percent |a | b|."""
    known: dict[int, np.ndarray] = {}
    held = 0
    for b in batches:
        at = [b.column("a").to_pylist(), b.column("b").to_pylist()]
        for side, name in enumerate(("text_a", "text_b")):
            new = {node: row for row, node in enumerate(at[side]) if node not in known}
            buf, starts = flat(b.column(name).take(pa.array(list(new.values()), pa.int64())))
            own = iter(new)
            for i, j in pieces(starts):
                for tokens in shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size):
                    known[next(own)] = tokens
                    held += len(tokens)
        ok = []
        for x, y in zip(*at, strict=True):
            s, t = known[x], known[y]
            both = len(np.intersect1d(s, t, assume_unique=True))
            ok.append(100 * both >= percent * (len(s) + len(t) - both))
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([b.column("a").take(keep), b.column("b").take(keep)], names=["a", "b"])
        if held > KNOWN:
            known, held = {}, 0


def _pivots(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of each group, the tokens that over a quarter of its voters have (core), and those with what else is its pivot; both sorted."""
    longs = pa.list_(pa.int64())
    for g, group in by_key(batches, "g"):
        held, least = [], group[0].column("least")[0].as_py()
        for b in group:
            buf, starts = flat(b.column("text"))
            for i, j in pieces(starts):
                held += shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
        tokens, at, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        own = 4 * count > len(held)
        core = tokens[own]
        sizes = np.array([len(x) for x in held])
        both = np.bincount(np.repeat(np.arange(len(held)), sizes), own[at], len(held))
        if 4 * np.count_nonzero(_enough(both, sizes + least, percent)) >= 3 * len(held):
            # a family: near nodes are nearly all by the core already, so that more tokens add few pairs to compare
            more = np.flatnonzero(~own & (count > 1))
            more = more[np.argsort(-count[more], kind="stable")[: max(0, int(WIDE * sizes.mean()) - len(core))]]
            own[more] = True
        cells = [pa.array([x.view(np.int64)], longs) for x in (core, tokens[own])]
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), *cells], names=["g", "core", "pivot"])


def _measured(batches: Iterator[pa.RecordBatch], size: int, n: int, percent: int, order) -> Iterator[pa.RecordBatch]:
    """(g, node, n, least n of the group, common with the pivot, common with its core, the core's size, first tokens outside the
    pivot) of nodes with their group's pivot. A node that links with one of ``least`` tokens or more shares so many that few first
    tokens are enough. Without a core the pivot is one."""
    common = order.value
    longs = pa.list_(pa.int64())
    for b in batches:
        buf, starts = flat(b.column("text"))
        pivots, least = b.column("pivot"), b.column("least").to_pylist()
        cores = b.column("core") if "core" in b.schema.names else pivots
        inter, of_core, of, outside = [], [], [], []
        row = 0
        for i, j in pieces(starts):
            sets = shingle_sets(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            for tokens, late in zip(sets, common.each(sets, n), strict=True):
                pivot, core = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in (pivots[row], cores[row]))
                rest = ~_among(tokens, pivot)
                inter.append(len(tokens) - np.count_nonzero(rest))
                of_core.append(np.count_nonzero(_among(tokens, core)))
                of.append(len(core))
                other = max(least[row], -(-percent * len(tokens) // 100))  # a set that links has no fewer
                shared = -(-percent * (len(tokens) + other) // (100 + percent))
                outside.append(prefix(tokens[rest], ORDERS[0], late[rest], percent, len(tokens) - shared + 1).view(np.int64))
                row += 1
        counts = (pa.array(x, pa.int64()) for x in (inter, of_core, of))
        names = ["g", "node", "n", "least", "both", "both_core", "of", "outside"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), *counts, _lists(outside, pa.int64())], names=names)


def _among(tokens: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which tokens are among sorted others."""
    if not len(others):
        return np.zeros(len(tokens), bool)
    return others[np.minimum(np.searchsorted(others, tokens), len(others) - 1)] == tokens


def _outside(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """First tokens outside the pivots as (token of a group, node, size) by bucket, for _groups(): a hash of both is the token."""
    few, rest = Sender(["u8", "i8", "u4"]), Sender(["u8", "i8", "u4"])
    held: list[tuple[np.ndarray, int, int]] = []
    total = 0
    for b in batches:
        tokens = b.column("outside")
        of = mix(b.column("g").to_numpy().view(np.uint64))
        cut = tokens.offsets.to_numpy()
        flat_ = mix(tokens.values.to_numpy().view(np.uint64) ^ np.repeat(of, np.diff(cut)))
        for i, (node, num) in enumerate(zip(b.column("node").to_pylist(), b.column("n").to_pylist(), strict=True)):
            held.append((flat_[cut[i] : cut[i + 1]], node, num))
        total += len(flat_)
        if total >= FLUSH:
            yield from _sent(held, few, rest, n)
            held, total = [], 0
    yield from _sent(held, few, rest, n)


def classes(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, node, n) of every row, and (node, label) of the nodes that a group has, labels equal where links join.

    Nodes stand for different shingle sets; a node without a label is a class of its own, one of n = 0 links with nothing.
    """
    spark = docs.sparkSession
    doc = F.col(id_col).cast("long")
    base = docs.select(doc.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text")
    n = buckets_for(docs)
    rows = stored(base.mapInArrow(partial(_nodes, size=size), "doc_id long, row_key long, node long, n long"))

    counted = base.select("text").mapInArrow(partial(_counts, size=size, n=n), "bucket int, kind int, blob binary")
    counted = stored(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_common, least=4), "key long, docs long"))
    levels = counted.groupBy(F.floor(4 * F.log2("docs")).alias("level")).count().orderBy(F.desc("level")).collect()  # some 200 rows at most
    least, have = 1 << 62, 0
    for r in levels:
        if have + r["count"] > COMMON:
            break
        have, least = have + r["count"], r["level"]
    top = counted.where(F.floor(4 * F.log2("docs")) >= F.lit(least)).select("key", F.floor(4 * F.log2("docs")).alias("level")).toArrow()
    keys, level = top.column("key").to_numpy().view(np.uint64), top.column("level").to_numpy()
    order = spark.sparkContext.broadcast(Common(keys, level))
    discard(counted)

    found = base.select("text").mapInArrow(partial(_prefixes, size=size, n=n, percent=percent, order=order), "bucket int, kind int, blob binary")
    groups = stored(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "g long, node long, n long"))
    wanted = rows.join(groups.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
    sketch = partial(_texts, size=size, n=n, percent=percent, order=order)
    # joined by exchange at every size; rows repeated whole then lie side by side
    texts = base.select("row_key", "text").join(wanted.hint("merge"), "row_key").dropDuplicates(["row_key"]).select("node", "text")
    texts = stored(texts.mapInArrow(sketch, "node long, text string, bits array<long>, first1 array<int>, first2 array<int>"))
    label = _merge(groups, texts, size, percent, partial(_measured, size=size, n=n, percent=percent, order=order))
    for t in (groups, texts):
        discard(t)
    return rows, label


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the class of each document under links of Jaccard ``percent`` / 100 or more.

    component_id is the smallest id reachable by links, itself included. Null or blank texts have no shingles and link with
    nothing, not even each other. A text of fewer words than ``size`` is one shingle. Null ids come after all others (a class
    of null ids alone has a null component_id). Repeated rows give repeated rows of one class; rows that share an id are in
    the classes of their texts. Other columns are ignored, whatever their names. Empty table: no rows.
    """
    rows, label = classes(docs, size, percent, id_col, text_col)
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first")).join(label, "node", "left").select("node", "first", F.coalesce("label", "node").alias("label"))
    nodes = stored(nodes, tidy=False)
    component = nodes.join(nodes.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("node", "component_id")
    full = rows.where("n > 0").join(component, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _merge(groups: DataFrame, texts: DataFrame, size: int, percent: int, measure) -> DataFrame:
    """(node, label) of all nodes in groups (g, node, n), labels equal where links join them."""
    label = stored(groups.select("node").distinct().select("node", F.col("node").alias("label")), tidy=False)
    near, spent, first = None, [], True
    while True:
        open_, large = _open(groups, label, first)
        pairs = _small_pairs(open_, percent)
        if near is not None:
            pairs = pairs.unionByName(_near_pairs(near, label, percent))
        links = _verified(pairs, texts.hint("merge") if first else texts, size, percent)  # the first round has pairs of most texts
        old, near = near, None
        if large.limit(1).count():
            rows = _with_pivots(large, texts, size, percent, measure)
            near = rows.where(_enough(F.col("both"), F.col("n") + F.col("least"), percent)).select("g", "node", "n", "both", "both_core", "of")
            near = stored(near, tidy=False)
            links = links.unionByName(_sure_links(near, percent))
            n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            sent = rows.select("g", "node", "n", "outside").mapInArrow(partial(_outside, n=n), "bucket int, kind int, blob binary")
            groups = stored(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_groups, "g long, node long, n long"), tidy=False)
            spent.append(groups)
            discard(rows)
        new = _joined(label, links)
        for t in (open_, large, links, label, old):
            if t is not None:
                discard(t)
        release(label.sparkSession)  # what the round has exchanged
        label, first = new, False
        if near is None:
            for t in spent:
                discard(t)
            return label


def _enough(both, sizes, percent: int):
    """Whether sets of so many tokens together link if they share so many."""
    return (100 + percent) * both >= percent * sizes


def _open(groups: DataFrame, label: DataFrame, first: bool) -> tuple[DataFrame, DataFrame]:
    """Groups that hold several classes, those of equal nodes once: (g, node, n, label) of small ones, (g, node, n) of large ones.

    Large groups whose nodes have the same smallest hash become one in the first round: those of a family of copies are many.
    """
    whole = (lambda df: df.hint("merge")) if first else (lambda df: df)  # the first round is large at every size
    rows = groups.withColumn("label", F.col("node")) if first else groups.join(label, "node")
    sign = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in range(2)]
    head = F.min(F.struct(F.xxhash64("node", F.lit(9)).alias("h"), "node")).alias("head")
    sets = rows.groupBy("g").agg(F.count(F.lit(1)).alias("k"), *sign, head, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    sets = stored(sets.groupBy("k", "s0", "s1").agg(F.min("g").alias("g"), F.min("head.node").alias("head")).select("g", "k", "head"), tidy=False)
    own = stored(rows.join(whole(sets), "g").select("g", "node", "n", "label", "k", "head"), tidy=False)
    small = whole(own.where(F.col("k") <= SMALL).select("g", "node", "n", "label"))
    large = own.where(F.col("k") > SMALL).select(F.col("head" if first else "g").alias("g"), "node", "n")
    large = stored(large.groupBy("g", "node").agg(F.first("n").alias("n")), tidy=False)
    discard(sets)
    small.stored_at = own.stored_at
    return small, large


def _small_pairs(small: DataFrame, percent: int) -> DataFrame:
    other = small.select("g", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("to"))
    fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")
    return small.join(other, "g").where((F.col("node") < F.col("b")) & (F.col("label") != F.col("to")) & fits).select(F.col("node").alias("a"), "b", "n", "m")


def _near_pairs(near: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs of near nodes of a group in different classes that what they hold of the pivot would do for."""
    rows = near.join(label, "node")
    largest = rows.groupBy("g", "label").count().groupBy("g").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    rows = stored(rows.join(largest, "g"), tidy=False)
    other = rows.where("label <> largest").select("g", F.col("node").alias("b"), F.col("n").alias("m"), F.col("both").alias("both_b"), F.col("label").alias("to"))
    apart = (F.col("label") != F.col("to")) & ((F.col("label") == F.col("largest")) | (F.col("node") < F.col("b")))
    pairs = rows.join(other, "g").where(apart & _enough(F.least("both", "both_b"), F.col("n") + F.col("m"), percent))
    return pairs.select(F.col("node").alias("a"), "b", "n", "m")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.first(F.col("n") + F.col("m")).alias("sizes"))
    firsts = [f"first{k}" for k in range(1, len(ORDERS))]
    for k in "ab":
        pairs = pairs.join(texts.select(F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("bits", *firsts))), k)
    shared = F.lit(True)
    for c in firsts:
        shared &= F.arrays_overlap(f"{c}_a", f"{c}_b")
    # exact: of both sizes together, at least percent / (100 + percent) are common, so no more than the rest differ
    differ = F.expr("aggregate(zip_with(bits_a, bits_b, (x, y) -> cast(bit_count(x ^ y) as int)), 0, (s, x) -> s + x)")
    pairs = stored(pairs.where(shared & (differ * (100 + percent) <= F.col("sizes") * (100 - percent))).select("a", "b"))
    for k in "ab":
        full = (pairs if k == "a" else full).join(texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")), k)
    links = stored(full.sortWithinPartitions("b").mapInArrow(partial(_verify, size=size, percent=percent), "a long, b long"))
    discard(pairs)
    return links


def _with_pivots(large: DataFrame, texts: DataFrame, size: int, percent: int, measure) -> DataFrame:
    text = texts.select("node", "text")
    sizes = large.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    voters = large.join(sizes, "g").where(F.pmod(F.xxhash64("node", F.lit(11)), "k") < VOTERS).select("g", "least", "node")
    pivots = voters.join(text, "node").select("g", "least", "text").repartition("g").sortWithinPartitions("g").mapInArrow(partial(_pivots, size=size, percent=percent), "g long, core array<long>, pivot array<long>")
    made = pivots = stored(sizes.join(pivots, "g", "left").select("g", "least", "core", "pivot"), tidy=False)
    if (pivots.agg(F.sum(F.greatest(F.size("core") + F.size("pivot"), F.lit(1)))).head()[0] or 0) <= PIVOTS:
        pivots = F.broadcast(pivots)
    rows = large.join(text, "node").join(pivots, "g").select("g", "node", "n", "least", "text", "core", "pivot")
    rows = stored(rows.mapInArrow(measure, "g long, node long, n long, least long, both long, both_core long, of long, outside array<long>"), tidy=False)
    discard(made)
    return rows


def _sure_links(near: DataFrame, percent: int) -> DataFrame:
    """Links of near nodes with those that miss least of their group's core among nodes of their size or less.

    They share what neither misses, so no text is needed where that is enough."""
    miss = F.col("of") - F.col("both_core")
    best = near.groupBy("g", "n").agg(F.min(F.struct(miss.alias("miss"), "node")).alias("z")).select("g", F.col("n").alias("m"), F.col("z.miss").alias("miss"), F.col("z.node").alias("z"))
    before = F.min("miss").over(Window.partitionBy("g").orderBy("m").rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("before", before).where("before is null or miss < before").select("g", "m", "miss", "z")
    sure = near.join(best, "g").where((F.col("m") <= F.col("n")) & (F.col("node") != F.col("z")) & _enough(F.col("both_core") - F.col("miss"), F.col("n") + F.col("m"), percent))
    return sure.select(F.col("node").alias("a"), F.col("z").alias("b")).distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels, those that links join made equal."""
    left, right = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    pairs = links.join(left, "a").join(right, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    joined = connected(pairs)
    new = label.join(joined.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    new = stored(new, tidy=False)
    discard(joined)
    return new


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Shingles and class of every document: words of five, Jaccard 0.75. Nulls, empty texts, repeats and ties: as in jaccard_classes()."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one document stays, that of the smallest id (nulls last, ties by a hash of id and text).

    Texts without shingles (null or blank) are copies of nothing and stay. Rows of one id and text are one document: one of them
    stays if it does. Other columns come along as they are, whatever their names. An empty table stays empty.
    """
    rows, label = classes(docs)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "row_key")).alias("first")
    nodes = rows.where("n > 0").groupBy("node").agg(first).join(label, "node", "left")
    keep = nodes.groupBy(F.coalesce("label", "node")).agg(F.min("first").alias("first")).select(F.col("first.row_key").alias("key"))
    keep = stored(keep.unionByName(rows.where("n = 0").select(F.col("row_key").alias("key")).distinct()), tidy=False)
    whole = docs.select(row_key("doc_id", "text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return whole.join(keep, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""

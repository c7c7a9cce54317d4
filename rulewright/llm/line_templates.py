"""Line dedup by a log-template tree of fixed depth.

The first level of the tree is a line's number of tokens, the next ``depth`` levels its leading tokens, with fields that vary
(tokens with a digit, links, addresses) as ``<*>``. Inside a leaf the template is generalised by position: a token that fewer
than ``min_docs`` documents have there is a variable field. Lines of one leaf with the same template are one template. A template
of ``min_docs`` documents or more recurs if most of it is constant: of its lines the one in the smallest document id stays (in
that document, the first), the others are dropped. Counting documents rather than lines, no order of insertion into the tree
matters, so it can be built by exchanges.

A line of over ``LONG_WORDS`` words holds enough to be a template by itself: where ``long_docs`` is set, so many documents with
such a line are enough. It stands for its tokens with varying fields as ``<*>``, or for its own words where fields are too many
of them for ``constant``.

Tokens leave the texts as 32-bit hashes, each different line of a flush once and with at most ``min_docs`` of its documents: more
are not needed to tell that it recurs, so a line of very many documents is a few rows. Leaves meet in buckets. A leaf that holds a
large share of all lines (``HOT``) is counted by Spark, position by position, instead. What comes back to the documents are ids of
lines that recur; texts are never exchanged for this. All is exact up to collisions: of 32 bits for tokens of one leaf and place,
else of 64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U, buckets_for, by_key, discard, flat, hashes_at, ids, mix, pieces, places, row_key, stored, word_places

#: Fields without a digit that vary from line to line.
VARIABLE = re.compile(rb"^[^A-Za-z0-9_]*(?:[A-Za-z]+://\S+|\S+@\S+\.\S+)[^A-Za-z0-9_]*$")
FIELD = U(0x452821E638D01377)
DEPTH = 3
MIN_DOCS = 5
CONSTANT = 0.6
#: Lines of over so many words recur if so many documents have them.
LONG_WORDS = 50
LONG_DOCS = 2
#: A leaf of so many different lines, and of more than a hundred thousandth of all, is not put into one bucket.
HOT = 20_000
#: Tokens that a task gathers before it hands their lines on.
FLUSH_TOKENS = 1 << 21

_K = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Lines:
    """The lines with tokens of texts laid end to end: row and number of each, leaf, id, tokens; ids of long templates.

    A leaf is a hash of the number of tokens and the leading ones, an id one of all tokens.
    """

    def __init__(self, buf: np.ndarray, starts: np.ndarray, depth: int, constant: float):
        feed = np.flatnonzero(buf == 10)
        begins = np.sort(np.concatenate([starts[:-1], feed + 1]))
        begin, end, count = word_places(buf, np.append(begins, len(buf)))
        full = np.flatnonzero(count)
        self.size = count[full]
        at = begins[full]
        self.row = np.searchsorted(starts, at, side="right") - 1
        self.number = np.searchsorted(feed, at) - np.searchsorted(feed, starts[self.row])
        word = hashes_at(buf, begin, end)
        self.token = np.where(_varies(buf, begin, end), FIELD, word)
        self.cut = np.concatenate([[0], np.cumsum(self.size)])
        leaf = mix(self.size.astype(np.uint64) * _K[0])
        for k in range(depth):
            has = self.size > k
            leaf[has] = mix(leaf[has] ^ (self.token[self.cut[:-1][has] + k] + U((k + 1) * int(_K[1]) % (1 << 64))))
        self.leaf = leaf
        self.pos = np.arange(len(self.token)) - np.repeat(self.cut[:-1], self.size)
        self.id = self._named(self.token)
        field = np.add.reduceat(self.token == FIELD, self.cut[:-1], dtype=np.int64) if len(full) else np.zeros(0, np.int64)
        plain = np.where(field <= (1 - constant) * self.size, self.id, mix(self._named(word) ^ _K[3]))
        self.long = np.flatnonzero(self.size > LONG_WORDS)
        self.long_id = mix(plain[self.long] ^ _K[2])

    def _named(self, token: np.ndarray) -> np.ndarray:
        if not len(self.size):
            return np.zeros(0, np.uint64)
        place = mix(self.pos.astype(np.uint64) * _K[3] + U(1))
        return mix(np.add.reduceat(mix(token ^ place), self.cut[:-1]) + self.size.astype(np.uint64))


def _varies(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    def has(marks: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks)])
        return total[end] > total[begin]

    out = has((buf >= 48) & (buf <= 57))
    colon = np.zeros(len(buf), bool)
    if len(buf) > 2:
        colon[:-2] = (buf[:-2] == 58) & (buf[1:-1] == 47) & (buf[2:] == 47)
    for k in np.flatnonzero(has((buf == 64) | colon) & ~out).tolist():
        out[k] = bool(VARIABLE.match(buf[begin[k] : end[k]].tobytes()))
    return out


def _parts(batches: Iterator[pa.RecordBatch], depth: int, constant: float) -> Iterator[tuple[Lines, np.ndarray, np.ndarray]]:
    """Lines of about a megabyte of texts, with doc_id and row_key of the rows they count from; batches: (doc_id, row_key, text)."""
    for b in batches:
        doc, key = ids(b.column(0)), b.column(1).to_numpy()
        buf, starts = flat(b.column(2))
        for i, j in pieces(starts):
            yield Lines(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], depth, constant), doc[i:j], key[i:j]


class Held:
    """Lines of a flush: each id once with its tokens, and at most ``most`` of the documents that have it, the smallest."""

    def __init__(self, most: int):
        self.most, self.tokens, self.parts = most, 0, []

    def add(self, x: Lines, doc: np.ndarray, key: np.ndarray, long: bool, skip: np.ndarray) -> None:
        if len(skip):
            own = np.flatnonzero(~np.isin(x.leaf, skip))
        else:
            own = np.arange(len(x.leaf))
        token = (x.token >> U(32)).astype(np.uint32)
        size, at = x.size[own], x.cut[:-1][own]
        self.parts.append((x.leaf[own], x.id[own], size, _ragged(token, at, size), doc[x.row[own]], key[x.row[own]], x.number[own]))
        self.tokens += int(size.sum())
        if long and len(x.long):
            none = np.zeros(len(x.long), np.int64)
            self.parts.append((x.long_id, x.long_id, none, token[:0], doc[x.row[x.long]], key[x.row[x.long]], x.number[x.long]))

    def full(self) -> bool:
        return self.tokens >= FLUSH_TOKENS or len(self.parts) >= 4096

    def taken(self):
        """leaf, id, size, tokens of the different lines; then line, doc, key, number of their places."""
        leaf, name, size, token, doc, key, number = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.tokens = [], 0
        order = np.lexsort((number, key, doc, name))
        n, k = name[order], key[order]
        new = np.ones(len(n), bool)
        new[1:] = n[1:] != n[:-1]
        once = np.ones(len(n), bool)
        once[1:] = new[1:] | (k[1:] != k[:-1])
        lines = order[new]
        line = np.cumsum(new) - 1
        kept = np.flatnonzero(once)
        kept = kept[places(line[kept]) < self.most]
        cut = np.concatenate([[0], np.cumsum(size)])
        place = order[kept]
        return leaf[lines], name[lines], size[lines], _ragged(token, cut[lines], size[lines]), line[kept], doc[place], key[place], number[place]


def _ragged(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[a : a + s] of all (a, s), end to end."""
    total = int(size.sum())
    if not total:
        return values[:0]
    return values[np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(total)]


def _gathered(batches: Iterator[pa.RecordBatch], depth: int, constant: float, n: int, min_docs: int, long: bool, hot) -> Iterator[pa.RecordBatch]:
    held = Held(min_docs)
    for x, doc, key in _parts(batches, depth, constant):
        held.add(x, doc, key, long, hot)
        if held.full():
            yield _blobs(held.taken(), n)
    if held.parts:
        yield _blobs(held.taken(), n)


_KINDS = ("u8", "u8", "u4", "u4", "u4", "i8", "i8", "i4")


def _blobs(entries: tuple, n: int) -> pa.RecordBatch:
    """A blob of lines and places for each bucket of leaves."""
    leaf, name, size, token, line, doc, key, number = entries
    bucket = (leaf % U(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    bucket, cut = bucket[order], np.concatenate([[0], np.cumsum(size)])
    token = _ragged(token, cut[order], size[order])
    by = np.argsort(back[line], kind="stable")
    line = back[line][by]
    a = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    z = np.append(a[1:], len(bucket))[: len(a)]
    size, leaf, name, doc, key, number = size[order], leaf[order], name[order], doc[by], key[by], number[by]
    cut, at = np.concatenate([[0], np.cumsum(size)]), np.searchsorted(line, np.arange(len(bucket) + 1))
    out = []
    for i, j in zip(a.tolist(), z.tolist(), strict=True):
        columns = (leaf[i:j], name[i:j], size[i:j], token[cut[i] : cut[j]], line[at[i] : at[j]] - i, *(c[at[i] : at[j]] for c in (doc, key, number)))
        head = np.array([j - i, cut[j] - cut[i], at[j] - at[i]], "u4").tobytes()
        out.append(head + b"".join(c.astype(k).tobytes() for c, k in zip(columns, _KINDS, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array(bucket[a].astype(np.int32)), pa.array(out, pa.binary())], names=["bucket", "blob"])


def _read(blobs: list[bytes]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in _KINDS]
    lines = 0
    for b in blobs:
        n, tokens, entries = np.frombuffer(b, "u4", 3).tolist()
        at = 12
        for column, kind, count in zip(out, _KINDS, (n, n, n, tokens, entries, entries, entries, entries), strict=True):
            column.append(np.frombuffer(b, kind, count, at))
            at += column[-1].nbytes
        out[4][-1] = out[4][-1].astype(np.int64) + lines
        lines += n
    return [np.concatenate(x) for x in out]


def _recurring(batches: Iterator[pa.RecordBatch], min_docs: int, long_docs: int | None, constant: float) -> Iterator[pa.RecordBatch]:
    """(id, template, row key and number of its first line) of the lines of each bucket whose template recurs."""
    for _, group in by_key(batches, "bucket"):
        leaf, name, size, token, line, doc, key, number = _read([x for g in group for x in g.column("blob").to_pylist()])
        # lines that several flushes have become one
        _, first, at = np.unique(name, return_index=True, return_inverse=True)
        line = at[line]
        cut = np.concatenate([[0], np.cumsum(size.astype(np.int64))])[first]
        leaf, name, size = leaf[first], name[first], size[first].astype(np.int64)
        order = np.lexsort((number, key, doc, line))
        once = np.ones(len(order), bool)
        once[1:] = (line[order][1:] != line[order][:-1]) | (key[order][1:] != key[order][:-1])
        order = order[once]
        line, doc, key, number = line[order], doc[order], key[order], number[order]
        # a leaf that fewer documents have holds no template that recurs
        live = _docs(leaf[line], key) >= min_docs
        template = np.where(size == 0, name, U(0))
        own = np.flatnonzero(live & (size[line] > 0))
        if len(own):
            some = np.unique(line[own])
            index = np.full(len(leaf), -1)
            index[some] = np.arange(len(some))
            t, s = _ragged(token, cut[some], size[some]), size[some]
            pos = np.arange(len(t)) - np.repeat(np.concatenate([[0], np.cumsum(s)[:-1]]), s)
            where = mix(np.repeat(leaf[some], s) ^ mix((pos.astype(np.uint64) << U(32)) | t))
            # each place of a line brings its document to each of the line's tokens
            begin = np.concatenate([[0], np.cumsum(s)])[:-1]
            i = index[line[own]]
            fixed = _frequent(_ragged(where, begin[i], s[i]), np.repeat(key[own], s[i]), min_docs)
            spot = np.minimum(np.searchsorted(fixed, where), max(len(fixed) - 1, 0))
            stands = (fixed[spot] == where if len(fixed) else np.zeros(len(where), bool)) & (t != (FIELD >> U(32)).astype(np.uint32))
            share = np.add.reduceat(stands, begin, dtype=np.int64) / s
            shape = mix(np.add.reduceat(np.where(stands, mix(where + _K[1]), U(0)), begin) ^ mix(leaf[some])) | U(1)
            template[some] = np.where(share >= constant, shape, U(0))
        # a template's documents and its first line
        of = template[line]
        own = np.flatnonzero(of != 0)
        order = own[np.lexsort((number[own], key[own], doc[own], of[own]))]
        values, first, at = np.unique(of[order], return_index=True, return_inverse=True)
        least = np.where(size[line[order[first]]] == 0, long_docs or 0, min_docs)
        recurs = (_docs(at, key[order])[first] >= least) if len(order) else np.zeros(0, bool)
        lines, one = np.unique(line[order], return_index=True)
        j = at[one]
        lines, j = lines[recurs[j]], j[recurs[j]]
        yield pa.RecordBatch.from_arrays([pa.array(name[lines].view(np.int64)), pa.array(key[order[first[j]]]), pa.array(number[order[first[j]]].astype(np.int32))], names=["id", "first_key", "first_line"])


def _docs(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The number of different documents of each entry's group."""
    _, g = np.unique(group, return_inverse=True)
    pair = np.unique(mix(g.astype(np.uint64) * _K[0] ^ mix(key.view(np.uint64))), return_index=True)[1]
    return np.bincount(g[pair], minlength=int(g.max(initial=-1)) + 1)[g]


def _frequent(where: np.ndarray, key: np.ndarray, least: int) -> np.ndarray:
    """The values, sorted, that so many different documents have."""
    pair = np.unique(mix(where ^ mix(key.view(np.uint64) + _K[0])), return_index=True)[1]
    values, count = np.unique(where[pair], return_counts=True)
    return values[count >= least]


def _placed(batches: Iterator[pa.RecordBatch], depth: int, constant: float, short: bool, long: bool) -> Iterator[pa.RecordBatch]:
    """(id, row_key, line) of every line with tokens, and of long lines under the ids of their templates."""
    for x, _, key in _parts(batches, depth, constant):
        for name, at in ((x.id, np.arange(len(x.id))),) * short + ((x.long_id, x.long),) * long:
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(key[x.row[at]]), pa.array(x.number[at].astype(np.int32))], names=["id", "row_key", "line"])


def _large_leaves(batches: Iterator[pa.RecordBatch], depth: int, constant: float) -> Iterator[pa.RecordBatch]:
    """(leaf, different lines) of the leaves that have a thousandth of a flush, or 8 lines, and under a null leaf the lines of all."""
    held, tokens = [], 0

    def out():
        leaf, name = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.uint64),) * 2
        pair = leaf[np.unique(mix(leaf ^ mix(name)), return_index=True)[1]]
        leaf, count = np.unique(pair, return_counts=True)
        big = count >= max(8, len(pair) // 1000)
        return pa.RecordBatch.from_arrays([pa.array([None, *leaf[big].view(np.int64).tolist()], pa.int64()), pa.array([len(pair), *count[big].tolist()], pa.int64())], names=["leaf", "lines"])

    for x, _, _ in _parts(batches, depth, constant):
        held.append((x.leaf, x.id))
        tokens += len(x.token)
        if tokens >= FLUSH_TOKENS:
            yield out()
            held, tokens = [], 0
    yield out()


def hot_leaves(base: DataFrame, depth: int, constant: float, hot: int) -> np.ndarray:
    """Leaves of more than ``hot`` lines and a hundred thousandth of all: so many at most reach the driver."""
    counts = stored(base.mapInArrow(partial(_large_leaves, depth=depth, constant=constant), "leaf long, lines long").groupBy("leaf").agg(F.sum("lines").alias("lines")), tidy=False)
    total = counts.where("leaf is null").agg(F.sum("lines").alias("n")).head()["n"] or 0
    found = counts.where("leaf is not null").where(F.col("lines") > max(hot, total // 100_000)).select("leaf").toArrow()
    discard(counts)
    return np.sort(found.column("leaf").to_numpy().view(np.uint64))


def _spelled(batches: Iterator[pa.RecordBatch], depth: int, constant: float, hot) -> Iterator[pa.RecordBatch]:
    """Lines of hot leaves with their token hashes."""
    for x, doc, key in _parts(batches, depth, constant):
        own = np.flatnonzero(np.isin(x.leaf, hot))
        token = _ragged((x.token >> U(32)).astype(np.uint32).view(np.int32), x.cut[:-1][own], x.size[own])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(x.size[own])]).astype(np.int32)), pa.array(token))
        columns = [pa.array(c) for c in (x.leaf[own].view(np.int64), x.id[own].view(np.int64), doc[x.row[own]], key[x.row[own]], x.number[own].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, lists], names=["leaf", "id", "doc_id", "row_key", "line", "tokens"])


def _recurring_hot(lines: DataFrame, min_docs: int, constant: float) -> DataFrame:
    """What _recurring() gives, of leaves that no task takes whole: every count is summed up in its tasks before it is exchanged."""
    own = ["leaf", "pos", "token"]
    field = int((FIELD >> U(32)).astype(np.uint32).view(np.int32))
    places_of = lines.groupBy("id", "row_key").agg(F.min(F.struct("doc_id", "row_key", "line")).alias("first"))
    tokens = lines.select("leaf", "row_key", F.posexplode("tokens").alias("pos", "token")).where(F.col("token") != field)
    kept = tokens.groupBy(*own, "row_key").agg(F.lit(1).alias("one")).groupBy(*own).agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select(*own)
    kept = stored(kept, tidy=False)
    different = stored(lines.groupBy("leaf", "id").agg(F.first("tokens").alias("tokens")).select("leaf", "id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "token")), tidy=False)
    stands = F.sort_array(F.collect_list(F.struct("pos", "token")))
    shape = different.join(kept, own).groupBy("leaf", "id").agg(F.first("n").alias("n"), stands.alias("stands"))
    shape = stored(shape.where(F.size("stands") >= F.lit(constant) * F.col("n")).select("id", F.xxhash64("leaf", "stands").alias("template")), tidy=False)
    by_doc = places_of.join(shape, "id").groupBy("template", "row_key").agg(F.min("first").alias("first"))
    recur = by_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)
    out = shape.join(recur, "template").select("id", F.col("first.row_key").alias("first_key"), F.col("first.line").alias("first_line"))
    out = stored(out, tidy=False)
    for t in (kept, different, shape):
        discard(t)
    return out


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_docs: int | None = MIN_DOCS, constant: float = CONSTANT, id_col: str = "doc_id", text_col: str = "text", long_docs: int | None = None, hot: int = HOT) -> DataFrame:
    """(row_key, lines array<int>): the lines of each row that a recurring template takes away. min_docs None: long lines alone.

    Nulls, empty tables and repeats: as in line_dedup().
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short, long = min_docs is not None, long_docs is not None
    sort = partial(_gathered, depth=depth, constant=constant, n=buckets_for(docs), min_docs=max(min_docs or 0, long_docs or 0), long=long)
    if short:
        large = hot_leaves(base, depth, constant, hot)
    else:
        sort = partial(_gathered_long, constant=constant, n=buckets_for(docs), long_docs=long_docs)
        large = np.zeros(0, np.uint64)
    found = base.mapInArrow(partial(sort, hot=large) if short else sort, "bucket int, blob binary")
    judge = partial(_recurring, min_docs=min_docs or 0, long_docs=long_docs, constant=constant)
    recur = stored(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, "id long, first_key long, first_line int"))
    spent = [recur]
    if len(large):
        sent = "leaf long, id long, doc_id long, row_key long, line int, tokens array<int>"
        lines = stored(base.mapInArrow(partial(_spelled, depth=depth, constant=constant, hot=large), sent), tidy=False)
        more = _recurring_hot(lines, min_docs, constant)
        discard(lines)
        spent.append(more)
        recur = recur.unionByName(more)
    placed = base.mapInArrow(partial(_placed, depth=depth, constant=constant, short=short, long=long), "id long, row_key long, line int")
    gone = placed.join(recur, "id").where((F.col("row_key") != F.col("first_key")) | (F.col("line") != F.col("first_line")))
    out = stored(gone.groupBy("row_key").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    for t in spent:
        discard(t)
    return out


def _gathered_long(batches: Iterator[pa.RecordBatch], constant: float, n: int, long_docs: int) -> Iterator[pa.RecordBatch]:
    held = Held(long_docs)
    nothing = np.zeros(0, np.int64)
    for x, doc, key in _parts(batches, 1, constant):
        if len(x.long):
            at = x.row[x.long]
            held.parts.append((x.long_id, x.long_id, np.zeros(len(at), np.int64), nothing.astype(np.uint32), doc[at], key[at], x.number[x.long]))
        if held.full():
            yield _blobs(held.taken(), n)
    if held.parts:
        yield _blobs(held.taken(), n)


def line_dedup(docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, constant: float = CONSTANT, id_col: str = "doc_id", text_col: str = "text", long_docs: int | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): texts less the lines of recurring templates, the first of which stays. With long_docs,
    lines of over LONG_WORDS words need only so many documents.

    Lines end at line feeds, tokens at ASCII blanks; blank lines are never dropped. A null text stays null, with no lines; an empty
    one is one blank line. Null ids come last. Repeated rows are one document: they count once, and they lose the same lines.
    Other columns are ignored, whatever their names. An empty table gives no rows. Texts and lines of any length are taken whole.
    """
    gone = recurring_lines(docs, depth, min_docs, constant, id_col, text_col, long_docs, hot)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"))
    out = base.join(gone.hint("merge"), "row_key", "left")  # gone grows with docs: one plan at every size
    lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))).otherwise(0)
    return out.select("doc_id", _left("text", "lines").alias("text"), lines.cast("long").alias("n_lines"), F.coalesce(F.size(F.col("lines")), F.lit(0)).cast("long").alias("n_dropped")).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))


def _left(text: str, gone: str):
    """The text without the lines of these numbers."""
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines dropped and a digest of the text kept, of every document. Nulls, empty texts, repeats and ties: as in line_dedup()."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), long_docs=LONG_DOCS)
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines of recurring templates go, but for the first of each; n_chars follows where it is a column.

    Long lines in a few documents are left to drop_long_lines(): taken here, copies would no longer look like copies. Nulls,
    empty texts and repeats: as in line_dedup(). No row goes; other columns come along, whatever their names."""
    return _without(docs, recurring_lines(docs))


def drop_long_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline step behind near_duplicates: lines of over LONG_WORDS words in LONG_DOCS documents or more go, but for the first.
    Nulls, repeats and other columns: as in drop_repeated_lines()."""
    return _without(docs, recurring_lines(docs, min_docs=None, long_docs=LONG_DOCS))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    whole = docs.select(row_key("doc_id", "text").alias("row_key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = whole.join(gone.hint("merge"), "row_key", "left").select("row", "lines", F.col("row.text").alias("text"))
    out = out.select("row", "lines", _left("text", "lines").alias("text"))
    kind = dict(docs.dtypes)

    def now(c: str):
        if c == "text":
            return F.col("text")
        old = F.col("row").getField(c)
        return F.when(F.col("lines").isNull(), old).otherwise(F.length("text").cast(kind[c])) if c == "n_chars" else old

    return out.select(*(now(c).alias(c) for c in docs.columns))

"""Suffix-array dedup: bytes covered by a string that an earlier document also has.

The suffix array is built by the difference-cover algorithm (sorted triples of sampled positions, recursion on their names,
merge with the remaining suffixes) and neighbours in it are compared over ``min_bytes`` bytes. It is distributed by content:
each window of ``min_bytes`` bytes belongs to the smallest hash among the k-grams inside it, so equal windows always meet in
one bucket, and each bucket sorts only its own windows. Windows whose smallest hash occurs in one document alone cannot
repeat; an exact first pass leaves them out. A hash of very many documents (``hot``) sends its windows to buckets of their own
content instead, so no bucket takes a whole hot passage with all its surroundings.

Stages: scan for hashes -> exchange -> hashes of two documents or more -> exchange with the texts -> stretches of text ->
exchange -> suffix arrays -> exchange with the texts -> results. All exchanged rows are compact blobs by bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, U, Sender, buckets_for, by_key, discard, flat, ids, mix, packed, pieces, received, stored, unpacked

_B = 0x2545F4914F6CDD1D | 1
#: Documents of one smallest hash from which on its windows are dealt out singly.
HOT = 50_000


def rolling(buf: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-byte strings, joined from those of lengths that are powers of two."""
    have, length, out, done = buf.astype(np.uint64) + U(1), 1, None, 0
    left = k
    while left:
        if left & 1:
            if out is None:
                out, done = have, length
            else:
                m = len(buf) - done - length + 1
                out = out[:m] * U(pow(_B, length, 1 << 64)) + have[done : done + m]
                done += length
        left >>= 1
        if left:
            m = len(buf) - 2 * length + 1
            have = have[:m] * U(pow(_B, length, 1 << 64)) + have[length : length + m]
            length *= 2
    return mix(out)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    step = 1
    out = h
    while 2 * step <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = w - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def windows(buf: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their smallest hash: row, first window's place in the row, number of windows, hash."""
    k = size // 2 - 1
    none = np.zeros(0, np.int64)
    if len(buf) < size:
        return none, none, none, np.zeros(0, np.uint64)
    m = sliding_min(rolling(buf, k), size - k + 1)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(m)]
    at = np.arange(len(m))
    ok = at + size <= starts[doc + 1]
    new = ok.copy()
    new[1:] &= (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
    begin = np.flatnonzero(new)
    if not len(begin):
        return none, none, none, np.zeros(0, np.uint64)
    total = np.concatenate([[0], np.cumsum(ok)])
    count = np.diff(np.append(total[begin], total[-1]))
    return doc[begin], begin - starts[doc[begin]], count, m[begin]


def _scan(batches: Iterator[pa.RecordBatch], size: int, n: int) -> Iterator[pa.RecordBatch]:
    send = Sender(["u4", "i8"])
    for b in batches:
        doc = ids(b.column(0))
        buf, starts = flat(b.column(1))
        for i, j in pieces(starts):
            row, _, _, h = windows(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i], size)
            pair = _unique_pairs(h, row)
            send.add((pair[0] % U(n)).astype(np.int32), pair[0] >> U(32), doc[i:j][pair[1]])
            if send.full():
                yield _blobs(send.rows())
    yield _blobs(send.rows())


def _unique_pairs(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def _blobs(rows, kind: int = 0) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([packed(r[1]) for r in rows], pa.binary())], names=["bucket", "kind", "blob"])


def _repeated(batches: Iterator[pa.RecordBatch], n: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the (document, hash) pairs whose hash two documents have; one bit tells that very many have it.

    A bucket's number and 32 bits stand for a hash: buckets are of bounded size, and a chance match only adds to what is sorted.
    """
    send = Sender(["i8", "u8", "u1"])
    for bucket, group in by_key(batches, "bucket"):
        h, doc = received([unpacked(x) for g in group for x in g.column("blob").to_pylist()], ["u4", "i8"])
        doc = doc.copy()
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low, high = np.minimum.reduceat(doc, cut), np.maximum.reduceat(doc, cut)
        size = np.diff(np.append(cut, len(h)))
        two = np.repeat(low < high, size)
        big = np.repeat((size > hot).astype(np.uint8), size)
        h, doc, big = h[two].astype(np.uint64) << U(32) | U(bucket), doc[two], big[two]
        send.add(_bucket(doc, n), doc, h, big)
        if send.full():
            yield _blobs(send.rows())
    yield _blobs(send.rows())


def _bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64) + U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int32)


def _keyed(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their bucket, in the columns of the blobs that they meet."""
    for b in batches:
        doc = ids(b.column(0))
        key = b.column(2)
        yield pa.RecordBatch.from_arrays([pa.array(_bucket(doc, n)), pa.array(np.ones(len(doc), np.int32)), pa.array([packed(x.as_buffer().to_pybytes()) for x in b.column(1).cast(pa.binary())], pa.binary()), b.column(0), key], names=["bucket", "kind", "blob", "doc_id", "row_key"])


def _with_blobs(batches: Iterator[pa.RecordBatch], kinds: list[str]):
    """Batches of documents, each with the entries of its bucket sorted by their first array."""
    now, blobs, have = None, [], None
    for bucket, group in by_key(batches, "bucket"):
        if bucket != now:
            now, blobs, have = bucket, [], None
        for g in group:
            kind = g.column("kind").to_numpy()
            cut = int(np.searchsorted(kind, 1))
            blobs += g.column("blob").slice(0, cut).to_pylist()
            if cut < len(kind):
                if have is None:
                    have = received([unpacked(x) for x in blobs], kinds)
                    order = np.argsort(have[0], kind="stable")
                    have, blobs = [x[order] for x in have], []
                rest = g.slice(cut)
                text = pa.array([unpacked(x) for x in rest.column("blob").to_pylist()], pa.binary())
                yield rest.append_column("text", text), have


def _stretches(batches: Iterator[pa.RecordBatch], size: int, n: int) -> Iterator[pa.RecordBatch]:
    """Stretches of text whose windows share a repeated hash: (doc, row key, start, length) and bytes, equal ones of a task once."""
    held: dict[int, dict[bytes, tuple[int, list]]] = {}
    count = 0

    def out():
        rows = []
        for bucket, texts in held.items():
            sizes = np.array([len(t) for t in texts], "u4")
            keys = np.array([k for k, _ in texts.values()], "u4")
            members = np.array([len(m) // 3 for _, m in texts.values()], "u4")
            flatm = np.array([x for _, m in texts.values() for x in m], "i8")
            rows.append((bucket, np.array([len(sizes)], "u4").tobytes() + sizes.tobytes() + members.tobytes() + keys.tobytes() + flatm.tobytes() + b"".join(texts)))
        held.clear()
        return _blobs(rows)

    for b, (of, h, big) in _with_blobs(batches, ["i8", "u8", "u1"]):
        doc = ids(b.column("doc_id"))
        key = b.column("row_key").to_numpy()
        buf, starts = flat(b.column("text"))
        for i, j in pieces(starts):
            part = buf[starts[i] : starts[j]]
            row, at, num, mh = windows(part, starts[i : j + 1] - starts[i], size)
            raw = part.tobytes()
            for r in range(i, j):
                a, z = np.searchsorted(of, [doc[r], doc[r]], side="left")[0], np.searchsorted(of, doc[r], side="right")
                if a == z:
                    continue
                own = slice(*np.searchsorted(row, [r - i, r - i + 1]))
                known = np.sort(h[a:z])
                short = mh[own] >> U(32) << U(32) | mh[own] % U(n)
                pos = np.minimum(np.searchsorted(known, short), len(known) - 1)
                found = np.flatnonzero(known[pos] == short)
                wide = set(h[a:z][big[a:z] > 0].tolist())
                base, d, k = int(starts[r] - starts[i]), int(doc[r]), int(key[r])
                for s, c, v in zip(at[own][found].tolist(), num[own][found].tolist(), short[found].tolist(), strict=True):
                    if wide and v in wide:
                        for x in range(s, s + c):
                            t = raw[base + x : base + x + size]
                            deal = int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")
                            held.setdefault(deal % n, {}).setdefault(t, (deal >> 32, []))[1].extend((d, k, x))
                        count += c
                    else:
                        held.setdefault(v & 0xFFFFFFFF, {}).setdefault(raw[base + s : base + s + c + size - 1], (v >> 32, []))[1].extend((d, k, s))
                        count += 1
            if count > 150_000:
                yield out()
                count = 0
    yield out()


def suffix_array(text: np.ndarray, reach: int) -> np.ndarray:
    """Positions of text ordered by the ``reach`` bytes or more from there on, by the difference cover {1, 2} modulo 3."""
    return _order(_ranks(text.astype(np.int64) + 1, reach))


def _ranks(s: np.ndarray, reach: int) -> np.ndarray:
    """Ranks of all suffixes of s by at least their first ``reach`` symbols (equal there: equal ranks or neighbours)."""
    n = len(s)
    if reach <= 1 or n < 2:
        return _names(s)
    p = np.concatenate([s, np.zeros(5, np.int64)])
    one, two, zero = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([one, two])
    names = _triples(p, sample)
    if reach > 3 and len(sample) and names.max() + 1 < len(names):
        # the string of names: first those of positions 1 mod 3, a separator, then those of 2 mod 3
        deep = _ranks(np.concatenate([names[: len(one)] + 1, [0], names[len(one) :] + 1]), -(-reach // 3))
        names = _names(np.concatenate([deep[: len(one)], deep[len(one) + 1 :]]))
    rank = np.zeros(n + 5, np.int64)
    rank[sample] = names + 1
    # order of the remaining suffixes: a symbol, then the rank of the sampled suffix behind it
    width = int(rank.max()) + 1
    k0 = p[zero] * width + rank[zero + 1]
    k1 = p[one] * width + rank[one + 1]  # against positions 1 mod 3
    alpha = int(p.max()) + 1
    compact = _names(np.concatenate([p[zero] * alpha + p[zero + 1], p[two] * alpha + p[two + 1]])) if alpha < 1 << 31 else _pairs(p, np.concatenate([zero, two]))
    k02 = compact[: len(zero)] * width + rank[zero + 2]
    k2 = compact[len(zero) :] * width + rank[two + 2]  # against positions 2 mod 3
    order0 = _order(k0)
    before = np.searchsorted(np.sort(k1), k0[order0]) + np.searchsorted(np.sort(k2), k02[order0])
    place = np.arange(len(zero)) + np.maximum.accumulate(before) if len(zero) else np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    out[zero[order0]] = place
    free = np.ones(n, bool)
    free[place] = False
    out[sample[_order(names)]] = np.flatnonzero(free)
    # suffixes that cannot be told apart so far share a rank, as names of the level above need it
    sa = _order(out)
    same = _alike(p, rank, sa, n)
    name = np.cumsum(~same) - 1
    out[sa] = name
    return out


def _alike(p: np.ndarray, rank: np.ndarray, sa: np.ndarray, n: int) -> np.ndarray:
    """Whether each suffix in order equals the one before it as far as is known: by the cover, some shift samples both."""
    a, b = np.concatenate([[-1], sa[:-1]]), sa
    same = np.zeros(len(sa), bool)
    i, j = a[1:], b[1:]
    mi, mj = i % 3, j % 3
    both = (mi > 0) & (mj > 0)
    by_one = ~both & (mi != 2) & (mj != 2)
    e = np.where(both, rank[i] == rank[j], False)
    e = np.where(by_one, (p[i] == p[j]) & (rank[np.minimum(i + 1, n + 4)] == rank[np.minimum(j + 1, n + 4)]), e)
    e = np.where(~both & ~by_one, (p[i] == p[j]) & (p[i + 1] == p[j + 1]) & (rank[i + 2] == rank[j + 2]), e)
    same[1:] = e
    return same


def _order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of numbers from 0 up; where value and place fit 63 bits, by a plain sort of both in one number."""
    bits = max(1, len(x) - 1).bit_length()
    if not len(x) or int(x.max()) >> (62 - bits):
        return np.argsort(x, kind="stable")
    return np.sort((x << bits) | np.arange(len(x))) & ((1 << bits) - 1)


def _names(x: np.ndarray) -> np.ndarray:
    """Ranks of values among the distinct ones, by one sort."""
    if not len(x):
        return x.astype(np.int64)
    order = _order(x)
    sorted_x = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (sorted_x[1:] != sorted_x[:-1]).astype(np.int64)]))
    return out


def _pairs(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    second = _names(p[at + 1])
    return _names(_names(p[at]) * (int(second.max(initial=0)) + 1) + second)


def _triples(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the triples of symbols at sampled positions, in sorted order."""
    top = int(p.max(initial=0)) + 1
    if top**3 < 1 << 40:
        return _names((p[at] * top + p[at + 1]) * top + p[at + 2])
    third = _names(p[at + 2])
    return _names(_pairs(p, at) * (int(third.max(initial=0)) + 1) + third)


def _suffixes(batches: Iterator[pa.RecordBatch], size: int, n: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket: sort the suffixes of its stretches, compare neighbours, give (row key, start, end) of what repeats."""
    send = Sender(["i8", "i8", "i8", "i8"])
    for _, group in by_key(batches, "bucket"):
        texts: dict[bytes, list[np.ndarray]] = {}
        share: list[int] = []  # what each distinct stretch shares with those that could have a window in common with it
        for blob in (unpacked(x) for g in group for x in g.column("blob").to_pylist()):
            count = int(np.frombuffer(blob, "u4", 1)[0])
            sizes, members, keys = np.frombuffer(blob, "u4", 3 * count, 4).reshape(3, count)
            flatm = np.frombuffer(blob, "i8", 3 * int(members.sum()), 4 + 12 * count).reshape(-1, 3)
            at, m = 4 + 12 * count + flatm.nbytes, 0
            for s, c, k in zip(sizes.tolist(), members.tolist(), keys.tolist(), strict=True):
                own = texts.setdefault(blob[at : at + s], [])
                if not own:
                    share.append(k)
                own.append(flatm[m : m + c])
                at, m = at + s, m + c
        member = [np.concatenate(m) if len(m) > 1 else m[0] for m in texts.values()]
        lowest = np.array([m[:, 0].min() for m in member], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        # a stretch that shares its hash with no other one has no window of another: only the rest is sorted
        _, which, sharing = np.unique(np.array(share, np.int64), return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(sharing[which] > 1)
        whole = np.frombuffer(b"".join(texts), np.uint8)
        part = _ranges(begin[mixed], lengths[mixed])
        hit = np.zeros(len(whole), bool)
        hit[part] = _repeats_of(whole[part], lengths[mixed], lowest[mixed], size)
        # places of a stretch in other documents than its first go whole, those in its first where a window repeats
        of = np.repeat(np.arange(len(member)), [len(m) for m in member])
        doc, key, start = np.concatenate(member).T
        late = doc > lowest[of]
        own = np.flatnonzero(~late)
        edge = np.zeros(len(whole) + 1, bool)
        edge[begin] = True
        x = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
        y = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
        u = np.searchsorted(begin, x, side="right") - 1
        count = np.bincount(of[own], minlength=len(member))
        row = own[_ranges((np.cumsum(count) - count)[u], count[u])]
        x, y = (np.repeat(v - begin[u], count[u]) for v in (x, y))
        out = [np.concatenate(c) for c in zip((doc[late], key[late], start[late], start[late] + lengths[of[late]]), (doc[row], key[row], start[row] + x, start[row] + y + size), strict=True)]
        send.add(_bucket(out[0], n), *out)
        if send.full():
            yield _blobs(send.rows())
    yield _blobs(send.rows())


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from a on, s of them, of all (a, s), end to end."""
    before = np.cumsum(size) - size
    return np.repeat(at - before, size) + np.arange(int(size.sum()))


def _repeats_of(text: np.ndarray, lengths: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """repeats() of stretches of these lengths. Only what windows cover whose hash several owners have is sorted: others cannot repeat."""
    hit = np.zeros(len(text), bool)
    if len(text) < size:
        return hit
    h = rolling(text, size)
    end = np.cumsum(lengths)
    of = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(np.arange(len(h)) + size <= end[of[: len(h)]])
    order = at[np.argsort(h[at])]
    cut = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]])[: len(order)])
    if not len(cut):
        return hit
    own = owner[of[order]]
    several = np.repeat(np.minimum.reduceat(own, cut) < np.maximum.reduceat(own, cut), np.diff(np.append(cut, len(order))))
    starts, ends = (np.bincount(order[several] + k, minlength=len(text) + 1) for k in (0, size))
    depth = starts - ends
    kept = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
    new = np.ones(len(kept), bool)
    new[1:] = (np.diff(kept) > 1) | (of[kept[1:]] != of[kept[:-1]])
    first = np.flatnonzero(new)
    hit[kept] = repeats(text[kept], np.append(first, len(kept)), owner[of[kept[first]]], size)
    return hit


def repeats(text: np.ndarray, begin: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    """Which positions of stretches laid end to end start a window that a stretch of a smaller owner also has."""
    hit = np.zeros(len(text), bool)
    if len(text) < size:
        return hit
    sa = suffix_array(text, size)
    of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    sa = sa[sa + size <= begin[of[sa] + 1]]
    if not len(sa):
        return hit
    same = np.ones(len(sa) - 1, bool)
    packed = np.zeros(len(text), np.uint64)
    for k in range(8):
        packed[: len(text) - 7] |= text[k : len(text) - 7 + k].astype(np.uint64) << U(8 * k)
    for k in sorted({*range(0, size - 7, 8), max(size - 8, 0)}):
        same &= packed[sa[:-1] + k] == packed[sa[1:] + k]
    cut = np.flatnonzero(np.concatenate([[True], ~same]))
    own = owner[of[sa]]
    low = np.repeat(np.minimum.reduceat(own, cut), np.diff(np.append(cut, len(sa))))
    hit[sa] = own > low
    return hit


def _apply(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b, (of, key, start, end) in _with_blobs(batches, ["i8", "i8", "i8", "i8"]):
        doc, row_key = ids(b.column("doc_id")), b.column("row_key").to_numpy()
        buf, starts = flat(b.column("text"))
        kept, spans_a, spans_z = [], [], []
        for r in range(len(doc)):
            text = buf[starts[r] : starts[r + 1]]
            a, z = np.searchsorted(of, doc[r], "left"), np.searchsorted(of, doc[r], "right")
            own = key[a:z] == row_key[r]
            if not own.any():
                kept.append(text.tobytes()), spans_a.append([]), spans_z.append([])
                continue
            depth = np.zeros(len(text) + 1, np.int64)
            np.add.at(depth, start[a:z][own], 1)
            np.add.at(depth, end[a:z][own], -1)
            gone = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
            spans_a.append(np.flatnonzero(gone[1:] & ~gone[:-1]).tolist())
            spans_z.append(np.flatnonzero(gone[:-1] & ~gone[1:]).tolist())
            kept.append(text[~gone[1:-1]].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(starts)), pa.array(kept, pa.binary()), pa.array(spans_a, pa.list_(pa.int64())), pa.array(spans_z, pa.list_(pa.int64()))], names=names)


def suffix_dedup(docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept binary, span_starts, span_ends): each text less the bytes that an earlier document has too.

    A byte goes if a string of ``min_bytes`` bytes that covers it also starts in a document with a smaller id. Texts are judged
    as given, on UTF-8 bytes. Null or empty text: nothing to remove, kept is empty. Texts under ``min_bytes`` bytes are kept
    whole. Null ids come after all others and never count as smaller than each other; neither do rows that share an id.
    Repeated rows give repeated, equal rows. Other columns are ignored, whatever their names. Empty table: no rows.
    """
    if min_bytes < 16:
        raise ValueError("min_bytes must be 16 at least")
    doc = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(doc.alias("doc_id"), text.alias("text"))
    keyed = base.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(NULL_ID)), "text").alias("row_key"))
    n = buckets_for(docs)
    blobs = "bucket int, kind int, blob binary"
    rows = "doc_id long, row_key long"
    first = base.mapInArrow(partial(_scan, size=min_bytes, n=n), blobs)
    pairs = stored(_met(first).mapInArrow(partial(_repeated, n=n, hot=hot), blobs))
    with_bucket = keyed.mapInArrow(partial(_keyed, n=n), f"{blobs}, {rows}")
    joined = _met(with_bucket.unionByName(pairs, allowMissingColumns=True))
    found = stored(_met(joined.mapInArrow(partial(_stretches, size=min_bytes, n=n), blobs)).mapInArrow(partial(_suffixes, size=min_bytes, n=n), blobs))
    discard(pairs)
    out = ["doc_id", "n_bytes", "kept", "span_starts", "span_ends"]
    return _met(with_bucket.unionByName(found, allowMissingColumns=True)).mapInArrow(partial(_apply, names=out), "doc_id long, n_bytes long, kept binary, span_starts array<long>, span_ends array<long>")


def _met(df: DataFrame) -> DataFrame:
    """Rows of a bucket together, blobs before documents."""
    return df.repartition("bucket").sortWithinPartitions("bucket", "kind")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What goes of every document, and a digest of the rest. Nulls, short and empty texts, repeats and ties: as in suffix_dedup()."""
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All 50-byte strings with the smallest document that has each; a document's bytes covered by an earlier one's go.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
s AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM n)),
m AS (SELECT w, min(doc_id) AS first FROM s GROUP BY w HAVING min(doc_id) < max(doc_id)),
k AS (SELECT s.doc_id, s.p FROM s JOIN m ON s.w = m.w AND s.doc_id > m.first),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM k)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, run),
x AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM r),
y AS (SELECT x.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last_z, string_agg(substr(h, CAST(2 * was + 1 AS BIGINT), CAST(2 * (a - was) AS BIGINT)), '' ORDER BY a) AS head FROM x JOIN n USING (doc_id) GROUP BY x.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(y.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(y.n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(coalesce(y.head, '') || substr(n.h, CAST(2 * coalesce(y.last_z, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM n LEFT JOIN y USING (doc_id)
"""

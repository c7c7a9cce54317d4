"""Pairs of conjunctions, compared block by block in numpy: each pair of blocks of a group is one unit of work and holds only both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Constraints of a block of rules, about.
BLOCK = 1 << 14
#: Pairs that are compared at once.
CELL = 1 << 20
ROW = ("grp", "rule_id", "action", "branch", "field", "txt", "low", "high", "low_in", "high_in")
FOUND = "grp string, own long, fields string, others array<long>"


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Numbers of the different values, and the values; null is a value."""
    one = column.combine_chunks().dictionary_encode(null_encoding="encode")
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    return one.indices.to_numpy(zero_copy_only=False).astype(np.int64), one.dictionary.to_pylist()


def _ends(low: np.ndarray, high: np.ndarray, low_in: np.ndarray, high_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends as whole numbers: intervals share a value if and only if each one's low is at most the other's high."""
    _, at = np.unique(np.concatenate([low, high]), return_inverse=True)
    lo, hi = 2 * at[: len(low)] + ~low_in, 2 * at[len(low) :] - ~high_in
    none = lo > hi
    return np.where(none, 1 << 30, lo).astype(np.int32), np.where(none, -1, hi).astype(np.int32)


def _slots(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple]:
    """(rows, low ends, high ends) of the first interval of each row, of the second of those that have one, and so on."""
    by = np.argsort(row, kind="stable")
    row, lo, hi = row[by], lo[by], hi[by]
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
    return [(row[place == k], lo[place == k], hi[place == k]) for k in range(place.max() + 1)]


def _part(slots: list[tuple], first: int, last: int) -> list[tuple]:
    """The slots of rows from first up to last, rows counted from first."""
    cut = [(s, *np.searchsorted(s[0], (first, last))) for s in slots]
    return [(s[0][a:b] - first, s[1][a:b], s[2][a:b]) for s, a, b in cut if a < b]


def _meet(x: list[tuple], y: list[tuple]) -> np.ndarray:
    """Whether an interval of a row of x and one of a row of y share a value, for rows of their first slots."""
    met = (x[0][1][:, None] <= y[0][2]) & (y[0][1] <= x[0][2][:, None])
    for k, a in enumerate(x):
        for m, b in enumerate(y):
            if k or m:
                at = np.ix_(np.searchsorted(x[0][0], a[0]), np.searchsorted(y[0][0], b[0]))
                met[at] |= (a[1][:, None] <= b[2]) & (b[1] <= a[2][:, None])
    return met


def _where(x: np.ndarray, y: np.ndarray):
    """An index of rows x and columns y: slices, which need no copy, if both follow one another."""
    if x[-1] - x[0] + 1 == len(x) and y[-1] - y[0] + 1 == len(y):
        return slice(x[0], x[-1] + 1), slice(y[0], y[-1] + 1)
    return np.ix_(x, y)


class _Side:
    """The conjunctions of one block: those of a rule lie in one chunk, and equal sets of fields side by side in it."""

    def __init__(self, rows: np.ndarray, conj: np.ndarray, rule: np.ndarray, act: np.ndarray, mask: np.ndarray, chunk: int | None):
        own = np.unique(conj[rows])
        self.cut = [0, len(own)]
        part = np.zeros(len(own), np.int64)
        if chunk is not None:
            own = own[np.argsort(rule[own], kind="stable")]
            start = np.flatnonzero(np.concatenate([[True], rule[own][1:] != rule[own][:-1]]))
            begin = np.maximum.accumulate(np.where(np.isin(np.arange(len(own)), start), np.arange(len(own)), 0))
            _, part = np.unique(begin // chunk, return_inverse=True)
            self.cut = np.searchsorted(part, np.arange(part.max() + 2)).tolist()
        own = own[np.lexsort((*mask[own].T, part))]
        self.rule, self.act, self.mask = rule[own], act[own], mask[own]
        at = np.full(len(rule), -1)
        at[own] = np.arange(len(own))
        self.row = at[conj[rows]]


def overlapping(t: pa.Table, fallback: bool, ordered: bool) -> Iterator[pa.RecordBatch]:
    """(grp, own, fields, others) of rules that conflict, from rows (grp, i, j, side, rule_id, action, branch, field, txt, low, high,
    low_in, high_in) of a group. side: 1 and 2 for both blocks, 3 where they are one; ordered: rules of one table, each pair once."""
    side, ids, branch = (t[c].to_numpy() for c in ("side", "rule_id", "branch"))
    number = t["txt"].is_null().to_numpy()
    action, actions = _codes(t["action"])
    field, fields = _codes(t["field"])
    text, _ = _codes(t["txt"])
    values, rule = np.unique(ids, return_inverse=True)
    _, branch = np.unique(branch, return_inverse=True)
    # kinds of constraints: numbers of a field, and texts of a field
    names = sorted({(fields[f], bool(n)) for f, n in set(zip(field.tolist(), number.tolist(), strict=True))})
    code = {x: k for k, x in enumerate(names)}
    kind = np.array([[code.get((f, False), 0), code.get((f, True), 0)] for f in fields])[field, number.astype(int)]
    key = ((rule * len(actions) + action) * (branch.max() + 1) + branch) * 4 + side
    _, first, conj = np.unique(key, return_index=True, return_inverse=True)
    words = (len(names) + 63) // 64
    mask = np.zeros((len(first), words), np.uint64)
    np.bitwise_or.at(mask, (conj, kind // 64), np.uint64(1) << (kind % 64).astype(np.uint64))
    lo, hi = _ends(*(t[c].to_numpy() for c in ("low", "high")), *(t[c].to_numpy().astype(bool) for c in ("low_in", "high_in")))
    lo, hi = np.where(number, lo, text).astype(np.int32), np.where(number, hi, text).astype(np.int32)
    in_x, in_y = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    if not len(in_x) or not len(in_y):
        return
    act = np.where(action[first] == (actions.index("") if "" in actions else -1), -1, action[first])
    of = rule[first]
    y = _Side(in_y, conj, of, act, mask, None)
    x = _Side(in_x, conj, of, act, mask, max(1, CELL // len(y.rule)))
    slots = []
    for k, (_, is_number) in enumerate(names):
        a, b = in_x[kind[in_x] == k], in_y[kind[in_y] == k]
        if len(a) and len(b):
            slots.append((k, is_number, _slots(x.row[kind[in_x] == k], lo[a], hi[a]), _slots(y.row[kind[in_y] == k], lo[b], hi[b])))
    several = fallback or any(len(np.unique(s.rule)) < len(s.rule) for s in (x, y))
    plain = not several and bool((y.mask == y.mask[0]).all())
    one_block = bool((side == 3).any())
    grp = t["grp"][0].as_py()
    for a, b in zip(x.cut[:-1], x.cut[1:], strict=True):
        free = x.act[a:b, None] != y.act
        free[np.ix_(x.act[a:b] == -1, y.act == -1)] = True
        if one_block:
            free &= x.rule[a:b, None] < y.rule
        elif not ordered:
            free &= x.rule[a:b, None] != y.rule
        share, apart, found = np.zeros(free.shape, bool), np.zeros(free.shape, bool), []
        for k, is_number, own, other in slots:
            own = _part(own, a, b)
            if not own:
                continue
            at = _where(own[0][0], other[0][0])
            met = _meet(own, other)
            apart[at] |= ~met
            if is_number:
                share[at] = True
                if fallback:
                    r, c = np.nonzero(met & free[at])
                    bit = np.zeros((len(r), words), np.uint64)
                    bit[:, k // 64] = np.uint64(1) << np.uint64(k % 64)
                    found.append((own[0][0][r], other[0][0][c], bit))
        free &= share & ~apart
        if plain and (x.mask[a:b] == x.mask[a]).all():
            if free.any():
                yield _rows(grp, x.rule[a:b], values[y.rule], free, x.mask[a] & y.mask[0], values, names)
            continue
        r, c = np.divmod(np.flatnonzero(free), len(y.rule))
        found.append((r, c, x.mask[a:b][r] & y.mask[c]))
        r, c, bits = (np.concatenate(z) for z in zip(*found, strict=True))
        if len(r):
            yield _lists(grp, x.rule[a:b][r], y.rule[c], bits, several, values, names)


def _names(bits: np.ndarray, names: list) -> str:
    return ",".join(sorted({names[k][0] for k in range(len(names)) if int(bits[k // 64]) >> (k % 64) & 1}))


def _rows(grp: str, own: np.ndarray, other: np.ndarray, met: np.ndarray, bits: np.ndarray, values: np.ndarray, names: list) -> pa.RecordBatch:
    """Pairs of rules that have a conjunction each and one set of fields: a row of met is that of a rule."""
    count = np.count_nonzero(met, axis=1)
    at = np.flatnonzero(met)
    at -= np.repeat(np.arange(len(own)) * met.shape[1], count)
    some = np.flatnonzero(count)
    others = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, count[some])), pa.int32()), pa.array(other[at]))
    return pa.RecordBatch.from_arrays([pa.array([grp] * len(some), pa.string()), pa.array(values[own[some]]), pa.array([_names(bits, names)] * len(some), pa.string()), others], names=["grp", "own", "fields", "others"])


def _lists(grp: str, own: np.ndarray, other: np.ndarray, bits: np.ndarray, several: bool, values: np.ndarray, names: list) -> pa.RecordBatch:
    """Pairs by rule and set of fields; several: pairs that recur are one, with all their fields."""
    if several:
        key = own * len(values) + other
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bits = np.bitwise_or.reduceat(bits[by], start, axis=0)
        own, other = np.divmod(key[start], len(values))
    if (bits == bits[0]).all():
        sets, which = bits[:1], np.zeros(len(own), np.int64)
    elif bits.shape[1] == 1:
        sets, which = np.unique(bits[:, 0], return_inverse=True)
        sets = sets[:, None]
    else:
        sets, which = np.unique(bits, axis=0, return_inverse=True)
    key = own * len(sets) + which.ravel()
    if (key[1:] < key[:-1]).any():
        by = np.argsort(key, kind="stable")
        key, other = key[by], other[by]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own, which = np.divmod(key[start], len(sets))
    text = [_names(s, names) for s in sets]
    others = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pa.array(values[other]))
    return pa.RecordBatch.from_arrays([pa.array([grp] * len(own), pa.string()), pa.array(values[own]), pa.array(text).take(pa.array(which)), others], names=["grp", "own", "fields", "others"])


#: Kinds of a zone.
KINDS = 1 << 12
ZONE = "shape string, zone string, low_least array<double>, low_most array<double>, high_least array<double>, high_most array<double>, blob binary"
HELD = "a_kind string, b_kind string, size long, ordinal long, rule long"


def zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts of sorted kinds, each of one shape, with the range of their ends by field."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        _, start = np.unique(np.array(b.column("shape").to_pylist(), object), return_index=True)
        start = sorted(start.tolist())
        for i, j in zip(start, [*start[1:], b.num_rows], strict=True):
            part = b.slice(i, j - i)
            if held and held[0].column("shape")[0] != part.column("shape")[0]:
                yield _zone(held)
                held = []
            while part.num_rows:
                free = KINDS - sum(x.num_rows for x in held)
                held.append(part.slice(0, free))
                part = part.slice(free)
                if sum(x.num_rows for x in held) == KINDS:
                    yield _zone(held)
                    held = []
    if held:
        yield _zone(held)


def _zone(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    low, high = _wide(t["low"], t.num_rows), _wide(t["high"], t.num_rows)
    ends = [np.fmin.reduce(low), low.max(0), np.fmin.reduce(high), high.max(0)]  # NaN is above all numbers
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    names = ["shape", "zone", "low_least", "low_most", "high_least", "high_most", "blob"]
    return pa.RecordBatch.from_arrays([pa.array([t["shape"][0].as_py()]), pa.array([t["kind"][0].as_py()]), *(pa.array([e.tolist()], pa.list_(pa.float64())) for e in ends), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=names)


def _wide(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of zones: the kinds of b that hold one of a, or the first two of their rules."""
    for b in batches:
        for x, y in zip(b.column(0), b.column(1), strict=True):
            yield from _held(*(pa.ipc.open_stream(z.as_buffer()).read_all() for z in (x, y)))


def _held(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
    nx, ny = x.num_rows, y.num_rows
    ends = []
    for f in range(_wide(x["low"], nx).shape[1]):
        for c, sign in (("low", -1), ("high", 1)):
            u, v = _wide(x[c], nx)[:, f], _wide(y[c], ny)[:, f]
            _, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            reach = sign * 2 * at + np.concatenate([_wide(x[f"{c}_in"], nx)[:, f], _wide(y[f"{c}_in"], ny)[:, f]])
            ends.append((reach[:nx].astype(np.int32), reach[nx:].astype(np.int32)))  # y holds x if it reaches as far on each side
    kind, to, size = x["kind"].combine_chunks(), y["kind"].combine_chunks(), y["size"].to_numpy()
    single, several = (x[c].to_numpy().astype(bool) for c in ("single", "several"))
    # rules of y in order, each with the row of its kind
    row = np.repeat(np.arange(ny), [len(r) for r in y["rules"].to_pylist()])
    rule, ordinal = (y[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("rules", "ordinals"))
    by = np.lexsort((rule, ordinal))
    row, rule, ordinal = row[by], rule[by], ordinal[by]
    for a in range(0, nx, 256):
        z = slice(a, min(a + 256, nx))
        inside = np.ones((z.stop - a, ny), bool)
        for u, v in ends:
            inside &= u[z, None] <= v
        r, c = np.nonzero(inside & several[z, None])
        if len(r):
            yield _found(kind.take(pa.array(a + r)), to.take(pa.array(c)), size[c], None, None)
        mine = np.flatnonzero(single[z] & inside.any(1))
        if len(mine):
            m = inside[np.ix_(mine, row)]
            first = m.argmax(1)
            yield _found(kind.take(pa.array(a + mine)), None, None, ordinal[first], rule[first])
            m &= rule != rule[first][:, None]
            first = m.argmax(1)
            ok = m[np.arange(len(mine)), first]
            yield _found(kind.take(pa.array(a + mine[ok])), None, None, ordinal[first[ok]], rule[first[ok]])


def _found(a_kind: pa.Array, b_kind, size, ordinal, rule) -> pa.RecordBatch:
    n = len(a_kind)
    long = [pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()) for v in (size, ordinal, rule)]
    return pa.RecordBatch.from_arrays([a_kind, pa.nulls(n, pa.string()) if b_kind is None else b_kind, *long], names=["a_kind", "b_kind", "size", "ordinal", "rule"])

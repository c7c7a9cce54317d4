"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from a window on both sides, the token itself masked: embeddings of the two tokens before
and the two after are each mapped, added, and passed through tanh; a two-level softmax (class of the token, then token within
the class) gives its conditional probability. A document's score is the sum of the log-probabilities of its tokens.

Tokens are lower-cased words. Those most frequent in the corpus, by counts over all documents, have an id of their own; others
share ids by their hash, and the network gives the chance of the id. It is times the word's share of its id's tokens, from a
written table of the counts of all words, which grows with the corpus; counts of the rarer words reach the documents by an
exchange, those of some HEAD frequent ones by broadcast. As context, a word outside the vocabulary is its id only.

Training covers all documents: in each round, tasks start from the current weights, take gradient steps over their own texts
in numpy, and their weights are averaged by tokens, chunk by chunk, in an exchange. The sum that is exchanged therefore grows
with the input, while the driver only ever holds one set of weights (about a megabyte).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FLUSH, U, Sender, buckets_for, by_key, discard, flat, mix, pieces, received, stored, word_hashes

SIDE = 2  # tokens on either side
DIM = 24
CLASSES, WITHIN = 32, 32
VOCABULARY = CLASSES * WITHIN
HASHED = 64  # ids that tokens outside the vocabulary share
HEAD = 1 << 16  # words whose counts are broadcast; no count is left out, those of other words are exchanged
STEP_TOKENS = 4096
ROUNDS = 2
CHUNK = 4096
LEAST = float(np.log(1e-30))  # of a token's log-probabilities
#: Parts in which weights are averaged before these averages are.
FAN = 64


class Weights:
    """All parameters in one flat float32 array, with views by name."""

    SHAPES = {
        "embed": (VOCABULARY + 1, DIM),  # the last row stands for what lies outside a text
        "mix": (2 * SIDE, DIM, DIM),
        "bias": (DIM,),
        "top": (DIM, CLASSES),
        "top_bias": (CLASSES,),
        "low": (CLASSES, DIM, WITHIN),
        "low_bias": (CLASSES, WITHIN),
    }

    def __init__(self, flat_values: np.ndarray | None = None):
        size = sum(int(np.prod(s)) for s in self.SHAPES.values())
        if flat_values is None:
            rng = np.random.default_rng(17)
            flat_values = (rng.standard_normal(size) * 0.1).astype(np.float32)
        self.flat, at = flat_values, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at : at + n].reshape(shape))
            at += n


def contexts(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ids of the tokens around each one, in its own text; VOCABULARY where the text ends."""
    n = len(tokens)
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = np.full((n, 2 * SIDE), VOCABULARY, np.int64)
    for k, shift in enumerate([s for s in range(-SIDE, SIDE + 1) if s]):
        at = np.arange(n) + shift
        ok = (at >= 0) & (at < n)
        ok[ok] &= of[at[ok]] == of[ok]
        out[ok, k] = tokens[at[ok]]
    return out


def _bounded(z: np.ndarray) -> np.ndarray:
    """In place. Bounds on z stand for its greatest value, which would be a slow pass: within them no sum of powers overflows."""
    return np.clip(z, -60, 60, out=z)


def _sums_of_powers(z: np.ndarray) -> np.ndarray:
    """By row; z becomes its powers."""
    np.exp(z, out=z)
    return z @ np.ones(z.shape[1], z.dtype)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z /= _sums_of_powers(z)[:, None]
    return z


def by_class(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts tokens of one class together, and where each class starts in it."""
    cls = (tokens // WITHIN).astype(np.int16)  # short numbers sort by counting
    order = np.argsort(cls, kind="stable")
    return order, np.searchsorted(cls[order], np.arange(CLASSES + 1))


def mapped(w: Weights) -> np.ndarray:
    """Each embedding mapped for each place around a token: a table of all ids costs less than a product for each token."""
    return np.matmul(w.embed, w.mix)


def logits(w: Weights, table: np.ndarray, tokens: np.ndarray, around: np.ndarray, cut: np.ndarray):
    """Hidden layer and logits of both levels, bounded, of tokens that stand by class. table: mapped(w)."""
    hidden = table[0].take(around[:, 0], axis=0)
    for k in range(1, 2 * SIDE):
        hidden += table[k].take(around[:, k], axis=0)
    hidden += w.bias
    np.tanh(hidden, out=hidden)
    top = hidden @ w.top
    top += w.top_bias
    low = np.empty((len(tokens), WITHIN), np.float32)
    for c in range(CLASSES):
        rows = slice(cut[c], cut[c + 1])
        if cut[c] < cut[c + 1]:
            np.matmul(hidden[rows], w.low[c], out=low[rows])
            low[rows] += w.low_bias[c]
    return hidden, _bounded(top), _bounded(low)


def forward(w: Weights, tokens: np.ndarray, around: np.ndarray, cut: np.ndarray):
    """The mapped embeddings, hidden layer and both levels of probabilities of tokens that stand by class."""
    table = mapped(w)
    hidden, top, low = logits(w, table, tokens, around, cut)
    return table, hidden, _softmax(top), _softmax(low)


def log_probs(w: Weights, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log-probability of every token given the tokens around it."""
    out = np.empty(len(tokens))
    around, table = contexts(tokens, starts), mapped(w)
    for a in range(0, len(tokens), 2 * STEP_TOKENS):
        t = tokens[a : a + 2 * STEP_TOKENS]
        order, cut = by_class(t)
        t, i = t[order], np.arange(len(t))
        _, top, low = logits(w, table, t, around[a : a + len(t)][order], cut)
        own = top[i, t // WITHIN] + low[i, t % WITHIN]
        out[a + order] = np.maximum(own - np.log(_sums_of_powers(top)) - np.log(_sums_of_powers(low)), LEAST)
    return out


def train_step(w: Weights, memory: np.ndarray, tokens: np.ndarray, around: np.ndarray, rate: float) -> None:
    """One step with per-parameter rates (squared gradients summed in memory), in place."""
    n = len(tokens)
    order, cut = by_class(tokens)
    tokens, around = tokens[order], around[order]
    _, hidden, p_top, p_low = forward(w, tokens, around, cut)
    g = Weights(np.zeros_like(w.flat))
    i = np.arange(n)
    p_top[i, tokens // WITHIN] -= 1
    p_low[i, tokens % WITHIN] -= 1
    back = p_top @ w.top.T
    g.top[:] = hidden.T @ p_top
    g.top_bias[:] = p_top.sum(0)
    for c in range(CLASSES):
        rows = slice(cut[c], cut[c + 1])
        if cut[c] < cut[c + 1]:
            g.low[c] = hidden[rows].T @ p_low[rows]
            back[rows] += p_low[rows] @ w.low[c].T
    full = np.flatnonzero(cut[1:] > cut[:-1])
    g.low_bias[full] = np.add.reduceat(p_low, cut[full], axis=0)
    back *= 1 - hidden * hidden
    g.bias[:] = back.sum(0)
    # sums over the tokens that share a neighbour come first, so that only these are multiplied
    for k in range(2 * SIDE):
        seen = around[:, k].astype(np.int16)
        by = np.argsort(seen, kind="stable")
        seen = seen[by]
        first = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
        ids, total = seen[first], np.add.reduceat(back.take(by, axis=0), first, axis=0)
        g.embed[ids] += total @ w.mix[k].T
        g.mix[k] = w.embed[ids].T @ total
    g.flat /= n
    memory += g.flat * g.flat
    w.flat -= rate * g.flat / (np.sqrt(memory) + 1e-6)


def encode(texts: pa.Array, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Token ids of texts by pieces: (ids, starts, hashes). known: sorted hashes and their ids."""
    keys, number = known
    buf, starts = flat(texts)
    for i, j in pieces(starts):
        h, count = word_hashes(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        h = h.view(np.int64)
        ids = (mix(h.view(np.uint64)) % U(HASHED)).astype(np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ids = np.where(keys[at] == h, number[at], ids)
        yield ids, np.concatenate([[0], np.cumsum(count)]), h


def _summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the sum of each one's values."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[cut], np.add.reduceat(value, cut) if len(cut) else value


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key.view(np.uint64) + U(0x9E3779B97F4A7C15)) % U(n)).astype(np.int32)


def _blobs(send: Sender) -> pa.RecordBatch:
    rows = list(send.rows())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    send = Sender(["i8", "i8"])
    for b in batches:
        buf, starts = flat(b.column(0))
        held, size = [], 0
        for i, j in pieces(starts):
            h, _ = word_hashes(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            held.append(np.unique(h.view(np.int64), return_counts=True))
            size += len(held[-1][0])
            if size >= FLUSH or j == len(starts) - 1:
                word, have = _summed(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                send.add(_bucket(word, n), word, have)
                held, size = [], 0
                if send.full():
                    yield _blobs(send)
    yield _blobs(send)


def _sums(batches: Iterator[pa.RecordBatch], value: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    for _, group in by_key(batches, "bucket"):
        key, total = _summed(*received([x for g in group for x in g.column("blob").to_pylist()], ["i8", value]))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], names=names)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A written table (word, n): the hash of every word of all documents and how often it stands there."""
    texts = docs.select(F.col(text_col).cast("string").alias("t"))
    found = texts.mapInArrow(partial(_count, n=buckets_for(docs)), "bucket int, blob binary")
    return stored(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_sums, value="i8", names=["word", "n"]), "word long, n long"))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words (their hashes, sorted) and their ids; ties go by hash."""
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - HASHED).collect()
    keys = np.array([r["word"] for r in top], np.int64)
    order = np.argsort(keys)
    return keys[order], np.arange(HASHED, HASHED + len(keys))[order]


def _shared(batches: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    total = np.zeros(HASHED, np.int64)
    for b in batches:
        word, n = (c.to_numpy() for c in b.columns)
        own = ~np.isin(word, known.value[0])
        np.add.at(total, (mix(word[own].view(np.uint64)) % U(HASHED)).astype(np.int64), n[own])
    yield pa.RecordBatch.from_arrays([pa.array(range(HASHED), pa.int32()), pa.array(total)], names=["id", "n"])


def shares(counts: DataFrame, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent words (hashes, sorted) outside the vocabulary, the logarithms of their counts, and of the tokens of each shared id."""
    level = F.floor(4 * F.log2("n"))
    least, have = 1 << 62, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some 200 rows at most
        if have + r["count"] > HEAD:
            break
        have, least = have + r["count"], r["level"]
    head = counts.where(level >= F.lit(least)).select("word", "n").toArrow()
    word, n = head.column("word").to_numpy(), head.column("n").to_numpy()
    own = ~np.isin(word, known[0])
    word, n = word[own], n[own]
    order = np.argsort(word)
    total = np.zeros(HASHED)
    sent = counts.sparkSession.sparkContext.broadcast(known)
    for r in counts.mapInArrow(partial(_shared, known=sent), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r["id"]] = r["n"]
    return word[order], np.log(n[order]), np.log(np.maximum(total, 1))


def _train(batches: Iterator[pa.RecordBatch], start, known, rate: float) -> Iterator[pa.RecordBatch]:
    """Gradient steps over the texts of a task; its weights, times its tokens, in chunks."""
    w = Weights(start.value.copy())
    memory = np.full_like(w.flat, 1e-4)
    seen = 0
    for b in batches:
        for tokens, starts, _ in encode(b.column(0), known.value):
            around = contexts(tokens, starts)
            for a in range(0, len(tokens), STEP_TOKENS):
                t = tokens[a : a + STEP_TOKENS]
                train_step(w, memory, t, around[a : a + len(t)], rate)
            seen += len(tokens)
    if seen:
        cut = range(0, len(w.flat), CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(list(cut), pa.int32()), pa.array([float(seen)] * len(cut)), pa.array([w.flat[a : a + CHUNK].tobytes() for a in cut], pa.binary())], names=["chunk", "tokens", "weights"]).append_column("part", pa.array([TaskContext.get().partitionId() % FAN] * len(cut), pa.int32()))


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of tasks, averaged by their tokens, chunk by chunk; only sums are held."""
    total: dict[int, list] = {}
    for b in batches:
        for c, n, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
            one = total.setdefault(c, [0.0, 0.0])
            one[0] = one[0] + n
            one[1] = one[1] + n * np.frombuffer(raw, np.float32).astype(np.float64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v[0] for v in total.values()], pa.float64()), pa.array([(v[1] / v[0]).astype(np.float32).tobytes() for v in total.values()], pa.binary())], names=["chunk", "tokens", "weights"])


def train(docs: DataFrame, known, text_col: str = "text", rounds: int = ROUNDS, rate: float = 0.1) -> np.ndarray:
    """Weights after ``rounds`` passes, each an average over tasks. Every document takes part; null and empty texts add nothing."""
    sc = docs.sparkSession.sparkContext
    sent, w = sc.broadcast(known), Weights().flat
    form = "chunk int, tokens double, weights binary"
    parted = f"{form}, part int"
    for r in range(rounds):
        start = sc.broadcast(w)
        parts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(partial(_train, start=start, known=sent, rate=rate / (1 + r)), parted)
        first = parts.repartition("chunk", "part").drop("part").mapInArrow(_average, form)
        got = first.repartition("chunk").mapInArrow(_average, form).collect()  # one set of weights
        if not got:
            return w
        w = np.concatenate([np.frombuffer(x["weights"], np.float32) for x in sorted(got, key=lambda x: x["chunk"])])
    return w


def _score(batches: Iterator[pa.RecordBatch], weights, known, shared, n: int) -> Iterator[pa.RecordBatch]:
    """Scores by row, in which a word that is not broadcast counts as if it stood once; such words and their rows, by bucket."""
    w, (head, log_n, log_total) = Weights(weights.value), shared.value
    send = Sender(["i8", "i8"])
    names = ["row", "doc_id", "n_tokens", "log_likelihood", "bucket", "blob"]
    row, kind = TaskContext.get().partitionId() << 40, None

    def rest() -> pa.RecordBatch:
        bucket, blob = _blobs(send).columns
        none = [pa.nulls(len(bucket), t) for t in (pa.int64(), kind, pa.int64(), pa.float64())]
        return pa.RecordBatch.from_arrays([*none, bucket, blob], names=names)

    for b in batches:
        kind = b.column(0).type
        count, total, first = [], [], row
        for tokens, starts, h in encode(b.column(1), known.value):
            lp = log_probs(w, tokens, starts)
            at = np.flatnonzero(tokens < HASHED)
            word, add = h[at], -log_total[tokens[at]]
            place = np.minimum(np.searchsorted(head, word), max(len(head) - 1, 0))
            met = head[place] == word if len(head) else np.zeros(len(word), bool)
            add[met] += log_n[place[met]]
            lp[at] += add
            rare = np.flatnonzero(~met)
            send.add(_bucket(word[rare], n), word[rare], row + np.searchsorted(starts, at[rare], side="right") - 1)
            lp = np.concatenate([[0.0], np.cumsum(lp)])
            count += np.diff(starts).tolist()
            total += (lp[starts[1:]] - lp[starts[:-1]]).tolist()
            row += len(starts) - 1
            if send.full():
                yield rest()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, row)), b.column(0), pa.array(count, pa.int64()), pa.array(total, pa.float64()), pa.nulls(len(count), pa.int32()), pa.nulls(len(count), pa.binary())], names=names)
    if kind is not None:
        yield rest()


def _rarer(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Logarithms of the counts of the words of a bucket, for each row that has them, by bucket of the row."""
    send = Sender(["i8", "f8"])
    for _, group in by_key(batches, "bucket"):
        word, row = received([x for g in group for x in g.column("blob").to_pylist()], ["i8", "i8"])
        _, at, count = np.unique(word, return_inverse=True, return_counts=True)
        many = count[at] > 1  # the logarithm of 1 adds nothing
        row, add = _summed(row[many], np.log(count[at[many]]))
        send.add(_bucket(row, n), row, add)
        if send.full():
            yield _blobs(send)
    yield _blobs(send)


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_prob) of every row, by a network trained on the same rows.

    Null or wordless texts have no tokens, a sum of 0 and a null mean. Repeated rows train as often as they stand there and get
    one score, equal up to rounding. Other columns are ignored. An empty table gives no rows. Texts of any length are taken whole.
    Tasks train on their own texts and are averaged, so scores move a little with how the table is cut into partitions; reruns over
    the same files agree but for the order of sums.
    """
    sc, n = docs.sparkSession.sparkContext, buckets_for(docs)
    counts = word_counts(docs, text_col)
    known = vocabulary(counts)
    shared = shares(counts, known)
    discard(counts)
    weights = train(docs, known, text_col, rounds)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    score = partial(_score, weights=sc.broadcast(weights), known=sc.broadcast(known), shared=sc.broadcast(shared), n=n)
    found = stored(base.mapInArrow(score, f"row long, doc_id {kind}, n_tokens long, log_likelihood double, bucket int, blob binary"))
    rarer = found.where("bucket is not null").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_rarer, n=n), "bucket int, blob binary")
    rarer = rarer.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(partial(_sums, value="f8", names=["row", "more"]), "row long, more double")
    out = found.where("bucket is null").join(rarer, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """Score of every document by a network trained on all of them. Nulls, empty texts and repeats: as in lm_score()."""
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

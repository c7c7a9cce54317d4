"""Language ID by hierarchical discrimination: the language family first, then one-versus-one linear support vector machines.

Features are hashed byte trigrams of the whole text (A-Z lower-cased, other cased letters as they are, ASCII digits and marks as
blanks), square roots of their counts, scaled to length one. A one-versus-rest linear SVM picks the family; inside a family of
several languages each pair of languages has its own linear SVM, and votes, then summed margins, decide. Families of closely
related languages are a fixed table; a language outside it is a family of its own.

Training rows are drawn by the order of a hash of the id, at most ``per_language`` for each language (the bound on what reaches
the driver); predictions read every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import U, flat, mix, pieces

#: Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb"),
    "scandinavian": ("da", "sv", "no", "nb", "nn", "is", "fo"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "pl", "cs", "sk"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "ur", "bn", "pa"),
}
BITS = 13
UNKNOWN = "und"


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def features(buf: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: hashed feature numbers in ascending order and their weights. Two blanks stand behind each text, so that
    none depends on its neighbours."""
    b = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    other = (b < 97) | ((b > 122) & (b < 128))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    pad = np.full(len(b) + 2 * len(starts), 32, np.uint64)
    pad[np.arange(len(b)) + 2 * row] = np.where(other, 32, b)
    tri = pad[:-2] << U(16) | pad[1:-1] << U(8) | pad[2:]
    number = (mix(tri + U(1)) >> U(64 - BITS)).astype(np.int64)
    blank = (pad[:-2] == 32) & (pad[1:-1] == 32)
    for r, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        own = slice(a + 2 * r, z + 2 * r)
        count = np.bincount(number[own][~blank[own]], minlength=1 << BITS)
        at = np.flatnonzero(count)
        w = np.sqrt(count[at])
        yield at, w / (np.sqrt((w * w).sum()) or 1.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, starts = flat(b.column(1))
        at, weight = [], []
        for i, j in pieces(starts):
            for a, w in features(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i]):
                at.append(a.astype("u2").tobytes())
                weight.append(w.astype("f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], names=["lang", "at", "weight"])


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 150) -> np.ndarray:
    """Weights, the bias last, of a linear SVM with squared hinge loss, by accelerated gradient steps on the whole sample."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))  # classes count alike
    w = np.zeros(x.shape[1])
    at, t = w, 1.0
    step = 1 / (1 / cost + 2 * 2.0)  # rows have length sqrt(2) at most
    for _ in range(rounds):
        margin = np.maximum(0, 1 - y * (x @ at.astype(x.dtype)))  # one copy of x is all that is held
        grad = at / cost - 2 * ((share * y * margin).astype(x.dtype) @ x)
        new = at - step * grad
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / u * (new - w), new, u
    return w


class Model:
    """Family weights, pair weights, and their languages; a few hundred kilobytes."""

    def __init__(self, x: np.ndarray, lang: list[str], cost: float = 10.0):
        self.langs = sorted(set(lang))
        y = np.array(lang)
        self.families = sorted({family_of(v) for v in self.langs})
        fam = np.array([family_of(v) for v in lang])
        many = len(self.families) > 1
        self.family = np.stack([svm(x, np.where(fam == f, 1.0, -1.0), cost) if many else np.zeros(x.shape[1] + 1) for f in self.families]) if len(lang) else np.zeros((0, x.shape[1] + 1))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                own = (y == a) | (y == b)
                self.pairs[a, b] = svm(x[own], np.where(y[own] == a, 1.0, -1.0), cost)

    def predict(self, at: np.ndarray, w: np.ndarray) -> tuple[str, float]:
        f = self.family[:, at] @ w + self.family[:, -1]
        best = int(np.argmax(f))
        rest = np.delete(f, best)
        sure = _chance(f[best] - rest.max()) if len(rest) else 1.0
        members = self.members[self.families[best]]
        if len(members) == 1:
            return members[0], sure
        votes, margin = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            v = self.pairs[a, b]
            m = float(v[at] @ w + v[-1])
            votes[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        lang = max(members, key=lambda v: (votes[v], margin[v], v))
        return lang, sure * _chance(2 * margin[lang] / (len(members) - 1))


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))))


def _judged(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[str, float]]:
    """Language and score of each row of a batch with columns text and letter."""
    letter = batch.column("letter").to_pylist()
    buf, starts = flat(batch.column("text"))
    for i, j in pieces(starts):
        for k, (at, w) in enumerate(features(buf[starts[i] : starts[j]], starts[i : j + 1] - starts[i]), i):
            yield model.predict(at, w) if letter[k] and model.langs else (UNKNOWN, 0.0)


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lang, score = zip(*_judged(b, model.value), strict=True) if len(b) else ((), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def train(labelled: DataFrame, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from (id, text, lang) rows; those of null lang are left out. Of each language the rows whose hashed ids are
    smallest are taken, at most ``per_language``, so that the sample does not depend on the order or number of partitions."""
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l is not null")
    spread = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(7)), F.lit(1 << 20))
    # a threshold on the hash for each language leaves few more rows than are needed
    most = F.least(F.lit(1.0), F.lit(1.5 * per_language + 50) / F.col("count")) * (1 << 20)
    counts = rows.groupBy("l").count().select("l", most.cast("long").alias("most"))
    near = rows.withColumn("s", spread).join(F.broadcast(counts), "l").where("s < most")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("s", "i", F.xxhash64("t")))).where(F.col("r") <= per_language)
    got = near.orderBy("l", "r").select("l", F.coalesce("t", F.lit("")).alias("t")).mapInArrow(_vectors, "lang string, at binary, weight binary").collect()
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for k, r in enumerate(got):
        x[k, np.frombuffer(r["at"], "u2").astype(np.int64)] = np.frombuffer(r["weight"], "f4")
    return Model(x, [r["lang"] for r in got])


def _text(column: str) -> list:
    """The text, and whether it has a letter."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return [text.alias("text"), text.rlike(r"\p{L}").alias("letter")]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row. lang_pred is ``und`` and score 0 where the text is null or has no
    letter, or where nothing could be learned. A row's result depends on its text alone: equal texts, repeated rows among them,
    get equal ones. Texts of any length are taken whole, other columns are ignored, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held = held_out if held_out is not None else F.lit(False)
    base = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), *_text(text_col))
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(partial(_predict, model=sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def held_out(column):
    """Rows that the contract keeps from training: crc32 of the id as text leaves 2 when divided by 4. A null id counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that the contract lets. Nulls, empty texts and repeats: as in identify()."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"))
    return identify(docs, train(docs.where(~held)), held_out=held)


#: Scores of texts that are kept in the pipeline. A score is the product of two chances that are a half at least, so this takes
#: texts out for which both levels are all but undecided.
LEAST = 0.3


def drop_unidentified(spark, docs: DataFrame, sf_dir: str, least: float = LEAST) -> DataFrame:
    """Pipeline stage: documents go whose text is null or has no letters, or whose most likely language scores under ``least``.

    Where no language could be learned all texts with letters stay. Repeated rows share their fate; null ids and languages are
    no reason to go; other columns come along, whatever their names. An empty table stays empty."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    sent = spark.sparkContext.broadcast(model)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_text("text"))
    return whole.mapInArrow(partial(_keep, model=sent, least=least), StructType([StructField("row", docs.schema)])).select("row.*")


def _keep(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        letter = b.column("letter").to_pylist()
        keep = [have and (not model.value.langs or score >= least) for have, (_, score) in zip(letter, _judged(b, model.value), strict=True)]
        yield b.select(["row"]).filter(pa.array(keep, pa.bool_()))

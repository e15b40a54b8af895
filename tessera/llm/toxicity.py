"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are hashed: whether a text has a word, or a word that begins with given 4, 5 or 6
bytes (runs of ASCII letters and of bytes from 0x80, A-Z lower-cased). The model is a
logistic regression with an L1 penalty. For each training text that names a group, a twin
is made in which every identity term is swapped for the next of its list, and the squared change of
the score's logit between the two is penalised, so that naming a group alone moves no score.

Training takes at most ``most_toxic`` + ``most_clean`` labelled rows, the first by hash of
doc_id; rows are weighted back to the labels' own shares. Of their features, counted as a
table, the ``most_features`` enter the model whose shares differ most between the classes
and that ``least_texts`` texts or more have; only these come to the driver, so that it holds at
most rows x ``most_features`` marks whatever the length of the texts. Scoring is one pass over whole texts, without a shuffle.

Defined cases: null and empty texts get the score of a text without features; labels that
are null are no labels, and of several labels for a document the largest counts; without
labelled rows of both kinds every score is the share of label 1 (0 without any); repeated
rows and very long texts are ordinary; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import keep, lean
from tessera.llm.textnum import LETTERS, U64, lowered, mix, runs, slices, span_hash, text_buffer

#: Lists of terms that stand for one another in swapped twins.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("old", "young"),
    ("deaf", "blind", "disabled"),
)
_BEGINNINGS = (4, 5, 6)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all features of each text, with repeats."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = lowered(data)
    starts, ends, rows = runs(low, offsets, LETTERS)
    found, where = [span_hash(low, starts, ends)], [rows]
    for k in _BEGINNINGS:
        on = ends - starts >= k
        found.append(mix(span_hash(low, starts[on], starts[on] + k) + U64(k)))
        where.append(rows[on])
    return np.concatenate(found), np.concatenate(where)


def swapped(text: str, lists: Sequence[Sequence[str]]) -> str | None:
    """The text with each identity term replaced by the next of its list; None if it has none."""
    import re

    follows = {t: terms[(i + 1) % len(terms)] for terms in lists for i, t in enumerate(terms)}
    found = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, follows), key=len, reverse=True)) + r")\b", re.IGNORECASE)
    new, n = found.subn(lambda m: follows[m[0].lower()], text)
    return new if n else None


def _training(lists: Sequence[Sequence[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct(texts: list[str]) -> list[bytes]:
            out = []
            for x in texts:
                data, off = text_buffer(pa.array([x], pa.string()))
                out.append(np.unique(features(data, off)[0]).tobytes())
            return out

        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            twins = [swapped(x, lists) for x in texts]
            twin_features = iter(distinct([t for t in twins if t is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(distinct(texts), pa.binary()), pa.array([None if t is None else next(twin_features) for t in twins], pa.binary())], ["toxic", "own", "twin"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, feature) of each feature of each row."""
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        flat = data.view(np.int64)
        toxic = np.repeat(np.asarray(batch.column(0)), np.diff(off) // 8)
        for i in range(0, len(flat), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(toxic[i : i + (1 << 18)], pa.int32()), pa.array(flat[i : i + (1 << 18)])], ["toxic", "feature"])


def _only(keys: np.ndarray):
    """Rows of ``_training`` with the features of ``keys`` alone."""

    def some(col: pa.Array) -> pa.Array:
        return pa.array([None if x is None else (f := np.frombuffer(x, np.uint64))[np.isin(f, keys)].tobytes() for x in col.to_pylist()], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), some(batch.column(1)), some(batch.column(2))], ["toxic", "own", "twin"])

    return run


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        logit = np.full(n, self.bias)
        if len(self.keys):
            h, rows = features(data, offsets)
            maybe = np.zeros(1 << 20, bool)
            maybe[(self.keys >> U64(44)).astype(np.int64)] = True
            on = maybe[(h >> U64(44)).astype(np.int64)]
            h, rows = h[on], rows[on]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            on = self.keys[at] == h
            pair = np.unique(rows[on] * len(self.keys) + at[on])
            logit += np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], minlength=n)
        return 1 / (1 + np.exp(-logit.clip(-500, 500)))


def fit(own: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, twins: list[tuple[int, np.ndarray]], l1: float = 1e-4, swap: float = 1.0, steps: int = 800) -> Model:
    """L1 logistic regression over the features given, by accelerated proximal gradient steps, with the twins' penalty."""
    share = np.average(toxic, weights=weight)
    flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    keys, col = np.unique(flat, return_inverse=True)
    m = len(keys)
    # A twin's row holds the differences of its features to the original's.
    t_row, t_col, t_val = [], [], []
    for k, (i, twin) in enumerate(twins):
        for a, b, sign in ((own[i], twin, 1.0), (twin, own[i], -1.0)):
            gone = np.setdiff1d(a, b, assume_unique=True)
            at = np.minimum(np.searchsorted(keys, gone), max(m - 1, 0))
            at = at[keys[at] == gone] if m else at[:0]
            t_row.append(np.full(len(at), k))
            t_col.append(at)
            t_val.append(np.full(len(at), sign))
    t_row, t_col, t_val = (np.concatenate(x) if x else np.zeros(0, int) for x in (t_row, t_col, t_val))
    weight = weight / weight.sum()
    size = np.bincount(row, minlength=len(own))
    rate = 1 / (0.25 * float((weight * (size + 1)).sum()) + 2 * swap * (float(len(t_row)) / max(len(twins), 1)) + 1e-9) * 4
    w, b = np.zeros(m), float(np.log(share / (1 - share)))
    v, vb, t = w.copy(), b, 1.0

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        z = b + np.bincount(row, w[col], minlength=len(own))
        d = np.bincount(t_row, t_val * w[t_col], minlength=len(twins)) if len(twins) else np.zeros(0)
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + swap * (d**2).sum() / max(len(twins), 1)), z, d

    for _ in range(steps):
        f, z, d = loss(v, vb)
        g = weight * (1 / (1 + np.exp(-z)) - toxic)
        grad = np.bincount(col, g[row], minlength=m) if m else np.zeros(0)
        if len(twins):
            grad += 2 * swap / len(twins) * np.bincount(t_col, t_val * d[t_row], minlength=m)
        while True:
            x = v - rate * grad
            x, xb = np.sign(x) * np.maximum(np.abs(x) - rate * l1, 0), vb - rate * g.sum()
            dx, db = x - v, xb - vb
            if loss(x, xb)[0] <= f + grad @ dx + g.sum() * db + ((dx**2).sum() + db**2) / (2 * rate) + 1e-12:
                break
            rate /= 2
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, w, b, t = x + (t - 1) / t2 * (x - w), xb + (t - 1) / t2 * (xb - b), x, xb, t2
    some = np.flatnonzero(w)
    return Model(keys[some], w[some], b)


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 3000, most_clean: int = 6000, most_features: int = 2000, least_texts: int = 4, lists: Sequence[Sequence[str]] = IDENTITY_TERMS) -> Model:
    """Model from ``labels(doc_id, toxic)`` joined with ``docs(doc_id, text)``."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    total = {int(r.toxic): r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        p = float(total.get(1, 0) > 0)
        return Model(np.zeros(0, np.uint64), np.zeros(0), 500.0 if p else -500.0)
    by = (F.xxhash64("doc_id"), "doc_id")
    ids = known.where("toxic = 1").orderBy(*by).limit(most_toxic).unionByName(known.where("toxic = 0").orderBy(*by).limit(most_clean))
    # At most most_toxic + most_clean ids are broadcast, and as many feature lists come back.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    rows = keep(rows.mapInArrow(lean(_training(lists)), "toxic int, own binary, twin binary"), "training")
    hot, cold = (float(n) for n in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    each = rows.select("toxic", "own").mapInArrow(lean(_spread), "toxic int, feature long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    lift = F.abs(F.col("a") / hot - (F.col("n") - F.col("a")) / cold)
    chosen = each.where(F.col("n") >= least_texts).withColumn("lift", lift).where("lift > 0").orderBy(F.desc("lift"), "feature").limit(most_features)
    keys = np.sort(np.array([r.feature for r in chosen.select("feature").collect()], np.int64).view(np.uint64))
    got = rows.mapInArrow(lean(_only(keys)), "toxic int, own binary, twin binary").toArrow().combine_chunks()
    by_content = sorted(range(len(got)), key=lambda i: (got["toxic"][i].as_py(), got["own"][i].as_py(), got["twin"][i].as_py() or b""))
    own = [np.frombuffer(got["own"][i].as_py(), np.uint64) for i in by_content]
    toxic = np.array([got["toxic"][i].as_py() for i in by_content], float)
    twins = [(k, np.frombuffer(t, np.uint64)) for k, i in enumerate(by_content) if (t := got["twin"][i].as_py()) is not None]
    weight = np.where(toxic > 0, total[1] / max(toxic.sum(), 1), total[0] / max((1 - toxic).sum(), 1))
    return fit(own, toxic, weight, twins)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(data[off[i] : off[j]], off[i : j + 1] - off[i]))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs(doc_id, text)``."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_score(model)), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Summaries of single documents (L7-L11, O16-O17), one pass without a shuffle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
_WORD = re.compile(r"[^\W_]+")
MOST_CHARS = 2000


def sentences(text: str) -> list[str]:
    return [s.strip() for s in _SENTENCE.split(text) if s.strip()]


def _matrix(parts: list[str]) -> np.ndarray:
    """Rows: (1 + ln c) * ln(S / n) of each term of a sentence; terms of all sentences weigh nothing."""
    counts = [Counter(w.lower() for w in _WORD.findall(p)) for p in parts]
    terms = sorted(set().union(*counts)) if counts else []
    at = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(parts), len(terms)))
    for i, c in enumerate(counts):
        for t, n in c.items():
            x[i, at[t]] = 1 + np.log(n)
    return x * np.log(len(parts) / np.maximum((x > 0).sum(0), 1)) if len(terms) else x


def centroid(parts: list[str]) -> np.ndarray:
    """Cosine of each sentence to the mean sentence."""
    x = _matrix(parts)
    c = x.mean(0)
    bottom = np.linalg.norm(x, axis=1) * np.linalg.norm(c)
    return np.divide(x @ c, bottom, out=np.zeros(len(parts)), where=bottom > 0)


def weighted(parts: list[str]) -> np.ndarray:
    """Sentences are taken greedily by similarity to a centroid that early sentences weigh more in; what a taken one says is taken off."""
    x = _matrix(parts)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    c = ((1 / (1 + np.arange(len(parts)) ** 0.8))[:, None] * x).sum(0)
    c = c / max(np.linalg.norm(c), 1e-12)
    score, left = np.zeros(len(parts)), np.ones(len(parts), bool)
    for _ in range(len(parts)):
        s = np.where(left, x @ c, -1)
        i = int(s.argmax())
        if s[i] <= 0:
            break
        score[i], left[i] = s[i], False
        c = c - c * x[i]
    return score


def graph(parts: list[str]) -> np.ndarray:
    """Ten power steps over the sentences' distortions, later sentences damped by 1 / (1 + i^0.4)."""
    x = _matrix(parts)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    seen = (x > 0).astype(np.float64)
    square, size = (x * x).sum(1), seen.sum(1)
    r = np.ones(len(parts)) / max(len(parts), 1)
    for _ in range(10):
        new = np.empty(len(parts))
        for i in range(0, len(parts), 256):  # rows of the distortions are made anew, never all of them
            some = slice(i, i + 256)
            far = np.maximum(square[some, None] + square[None, :] - 2 * x[some] @ x.T, 0)
            own = size[some, None] + size[None, :] - 2 * seen[some] @ seen.T
            new[some] = np.divide(far, own, out=np.zeros_like(far), where=own > 0) @ r
        r = new / max(new.sum(), 1e-300)
    return r / (1 + np.arange(len(parts)) ** 0.4)


METHODS = {"centroid": centroid, "weighted": weighted, "graph": graph}


def summary(text: str, method: str = "centroid", most_chars: int = MOST_CHARS) -> str:
    """The best sentences within a length, in their order; scores are compared at nine places."""
    parts = sentences(text)
    score = METHODS[method](parts).round(9) if parts else np.zeros(0)
    taken, used = [], 0
    for i in np.argsort(-score, kind="stable"):
        if used + len(parts[i]) <= most_chars or not taken:
            taken.append(int(i))
            used += len(parts[i])
    return " ".join(parts[i] for i in sorted(taken))


def summarize(docs: DataFrame, method: str = "centroid", most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, summary); null and empty texts have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([summary(x or "", method, most_chars) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "summary"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, summary string")

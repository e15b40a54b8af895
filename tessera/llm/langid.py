"""Language identification with interpolated Kneser-Ney character models.

Texts become sequences of symbols: the UTF-16 units of lower-cased letters of any script, and
one space for each run of other characters. One model per language holds, for each order,
sorted arrays of n-gram hashes with discounted probabilities and of context hashes with back-off
weights. A text gets the language of the lowest cross-entropy per symbol. Its score is the
posterior at a temperature.

Rejection is calibrated on texts held out: one in ``folds`` labelled texts, by a hash of the text,
is scored by models of the others. Per language and per length (powers of two of
symbols) the median and the 90th percentile of these cross-entropies give a bound, ``reject_width`` times
their distance (and ``least_gap``) above the median; a text above the bound of its
language and length is rejected. Lengths without ``least_texts`` such texts take the bound of the nearest
length that has them, and languages without any the largest bound of the others. The
final models learn from all labelled texts.

Plan: n-grams of all training texts are counted in numpy per task, packed, and summed by (language,
n-gram); the distinct ones come to the driver, whose number is bound by the variety of a
language's letter sequences and not by its documents. Calibration runs over all held-out texts and returns
aggregates. The model goes to the tasks, and prediction is one pass without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected;
a table without labelled texts gives ``und`` for all; equal entropies go to the smaller
language name; repeated rows, repeated or null doc_ids and very long texts are ordinary rows; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import keep, lean
from tessera.llm.textnum import mix, slices, text_buffer

BITS = 16
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each UTF-16 unit (0 for what is no letter), and which code points beyond U+FFFF are letters."""
    if not _TABLES:
        unit = np.zeros(1 << 16, np.uint64)
        for c in range(1 << 16):
            if chr(c).isalpha():
                low = chr(c).lower()
                unit[c] = ord(low) if len(low) == 1 else c
        _TABLES.extend((unit, np.fromiter((chr(c).isalpha() for c in range(1 << 16, 0x110000)), bool)))
    return _TABLES[0], _TABLES[1]


def _symbols(data: np.ndarray) -> np.ndarray:
    units = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16)
    letter, far = _tables()
    out = letter[units]
    pair = np.flatnonzero((units >= 0xD800) & (units < 0xDC00))
    pair = pair[far[((units[pair].astype(np.int64) - 0xD800) << 10) + units[pair + 1] - 0xDC00]]
    out[pair], out[pair + 1] = units[pair], units[pair + 1]
    return out


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, row) of each n-gram: every symbol of a text with the ``order - 1`` before it.

    Texts begin after spaces and end with one. A text without a letter has no n-grams.
    """
    if not 1 <= order <= 4:
        raise ValueError("a code of 64 bits holds 1 to 4 symbols")
    symbol = _symbols(data)
    starts = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80).astype(np.int64) + (data >= 0xF0))))[offsets]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(starts))
    letters = np.bincount(row[symbol > 0], minlength=len(offsets) - 1)
    ok = letters[row] > 0
    new = np.ones(len(row), bool)
    new[1:] = row[1:] != row[:-1]
    same = np.zeros(len(row), bool)
    same[1:] = (symbol[1:] == 0) & (symbol[:-1] == 0) & ~new[1:]
    lead = new & (symbol == 0)  # a leading run of spaces is what a text begins after anyway
    on = ok & ~same & ~lead
    symbol, row = symbol[on], row[on]
    if not len(symbol):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.append(row[1:] != row[:-1], True) & (symbol > 0)
    ends = np.flatnonzero(last) + 1
    symbol, row = np.insert(symbol, ends, 0), np.insert(row, ends, row[ends - 1])
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    at = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    code = symbol.astype(np.uint64)
    for k in range(1, order):
        back = np.zeros(len(row), np.uint64)
        back[k:] = symbol[:-k]
        back[at < k] = 0
        code |= back << np.uint64(BITS * k)
    return code, row


def _packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes as differences, and their counts, byte by byte of their numbers, deflated."""
    steps = np.diff(codes, prepend=codes[:1]).astype("<u8")
    steps[0] = codes[0]
    both = np.concatenate((steps.view(np.uint8).reshape(-1, 8).T.reshape(-1), counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.reshape(-1)))
    return zlib.compress(both.tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(x.T).view("<u8")[:, 0] for x in both)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


_PARTS = 16


def _count(order: int):
    """(lang, held, part, grams): the n-grams of texts (text, lang, held), of a task, dealt by hash and packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            data, off = text_buffer(batch.column(0))
            for i, j in slices(off, _SLICE):
                code, row = grams(data[off[i] : off[j]], off[i : j + 1] - off[i], order)
                kinds = sorted(set(names[i:j]))
                kind = np.array([kinds.index(x) for x in names[i:j]])
                for k, name in enumerate(kinds):
                    u, n = np.unique(code[(kind == k)[row]], return_counts=True)
                    seen[name] = _summed([seen[name], (u, n)]) if name in seen else (u, n)
        for (name, held), (u, n) in sorted(seen.items()):
            part = mix(u) % np.uint64(_PARTS)
            for p in np.unique(part).tolist():
                on = part == p
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([held]), pa.array([p], pa.int32()), pa.array([_packed(u[on], n[on])], pa.binary())], ["lang", "held", "part", "grams"])

    return run


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    u, at = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return u, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, held, code, n) of packed n-grams that come sorted by (lang, held, part)."""
    key, held, size = None, [], 0

    def out() -> Iterator[pa.RecordBatch]:
        u, n = _summed(held)
        for i in range(0, len(u), 1 << 16):
            m = len(u[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * m), pa.array([key[1]] * m), pa.array(u[i : i + m].view(np.int64)), pa.array(n[i : i + m])], ["lang", "held", "code", "n"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if held and row[:3] != key:
                yield from out()
                held, size = [], 0
            key = row[:3]
            held.append(_unpacked(row[3]))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [_summed(held)]
                size = 0
    if held:
        yield from out()


class KneserNey:
    """One language: interpolated Kneser-Ney over n-gram codes, in sorted hash arrays."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int, symbols: int) -> None:
        self.levels, self.symbols = [], symbols
        for n in range(order, 0, -1):
            mask = np.uint64((1 << (BITS * n)) - 1)
            if n < order:  # continuation counts: distinct symbols before the shorter n-gram
                codes, counts = np.unique(codes & mask, return_counts=True)
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context, at = np.unique(codes >> np.uint64(BITS), return_inverse=True)
            total = np.bincount(at, counts)
            kinds = np.bincount(at)
            p = np.maximum(counts - d, 0) / total[at]
            self.levels.append((*self._sorted(codes, p), *self._sorted(context, d * kinds / total)))
        self.levels.reverse()

    @staticmethod
    def _sorted(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = mix(codes)
        by = np.argsort(key)
        return key[by], values[by]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, codes: np.ndarray, missing: float) -> np.ndarray:
        want = mix(codes)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return np.where(keys[at] == want, values[at], missing)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each code's last symbol after the ones before it."""
        p = np.full(len(codes), 1.0 / self.symbols)  # all symbols met, and one for the others
        for n, (keys, values, contexts, weights) in enumerate(self.levels, 1):
            c = codes & np.uint64((1 << (BITS * n)) - 1)
            p = self._find(keys, values, c, 0.0) + self._find(contexts, weights, c >> np.uint64(BITS), 1.0) * p
        return np.log(p)


@dataclass
class LanguageModel:
    """All languages, with the calibrated temperature and rejection bounds by language and length."""

    langs: list[str]
    models: list[KneserNey]
    order: int
    temperature: float = 0.05
    bound: np.ndarray = field(default_factory=lambda: np.zeros((0, _LENGTHS)))
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) cross-entropy per symbol, and the symbols of each text."""
        n = len(offsets) - 1
        code, row = grams(data, offsets, self.order)
        size = np.bincount(row, minlength=n)
        u, at = np.unique(code, return_inverse=True)
        table = self._known(u)
        total = np.stack([np.bincount(row, table[:, k][at], minlength=n) for k in range(len(self.langs))], 1)
        return -total / np.maximum(size, 1)[:, None], size

    def _known(self, u: np.ndarray) -> np.ndarray:
        """Scores of distinct codes; a process remembers some that it has met."""
        codes, scores = _MET.get(self.token, (np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))))
        at, new = np.zeros(len(u), np.int64), np.ones(len(u), bool)
        if len(codes):
            at = np.minimum(np.searchsorted(codes, u), len(codes) - 1)
            new = codes[at] != u
        if new.any():
            more = np.stack([m.log_prob(u[new]) for m in self.models], 1)
            codes, scores = np.concatenate((codes, u[new])), np.concatenate((scores, more))
            by = np.argsort(codes, kind="stable")
            codes, scores = codes[by], scores[by]
            _MET.clear()
            if len(codes) <= _REMEMBERED:
                _MET[self.token] = codes, scores
            at = np.searchsorted(codes, u)
        return scores[at]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, rejected, entropy, symbols)."""
        h, size = self.entropies(data, offsets)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        score = 1 / np.exp(-(h - low[:, None]) * size[:, None] * self.temperature).sum(1)
        return best, score, low > self.bound[best, lengths(size)], low, size


_LENGTHS = 40
_SLICE = 1 << 19
_REMEMBERED = 1 << 18


def lengths(size: np.ndarray) -> np.ndarray:
    """The class of each number of symbols: its power of two."""
    return np.minimum(np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1, _LENGTHS - 1)


_MET: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.langs, object)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, _SLICE):
                best, score, out, low, size = model.predict(data[off[i] : off[j]], off[i : j + 1] - off[i])
                none = size == 0
                lang = np.where(none, "und", names[best])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(out | none), pa.array(np.where(none, 0.0, low)), pa.array(size.astype(np.int64))], ["doc_id", "lang_pred", "score", "rejected", "entropy", "n_symbols"])

    return run


_TEMPERATURES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


def _calibrate(model: LanguageModel):
    """(lang, length, entropy, losses) of texts (text, lang) with a letter: of the own language, and per temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            names = batch.column(1).to_pylist()
            for i, j in slices(off, _SLICE):
                h, size = model.entropies(data[off[i] : off[j]], off[i : j + 1] - off[i])
                on = np.flatnonzero((size > 0) & np.array([x in model.langs for x in names[i:j]]))
                true = np.array([model.langs.index(names[i + k]) for k in on], np.int64)
                h, size = h[on], size[on]
                gap = (h - h.min(1, keepdims=True, initial=np.inf)) * size[:, None]
                loss = np.stack([gap[np.arange(len(on)), true] * t + np.log(np.exp(-gap * t).sum(1)) for t in _TEMPERATURES], 1)
                yield pa.RecordBatch.from_arrays([pa.array(true, pa.int32()), pa.array(lengths(size), pa.int32()), pa.array(h[np.arange(len(on)), true]), pa.array(list(loss), pa.list_(pa.float64()))], ["lang", "length", "entropy", "losses"])

    return run


def _models(counts: pd.DataFrame, langs: list[str], order: int, symbols: int) -> list[KneserNey]:
    out = []
    for name in langs:
        mine = counts[counts["lang"] == name]
        code, at = np.unique(mine["code"].to_numpy().view(np.uint64), return_inverse=True)
        out.append(KneserNey(code, np.bincount(at, mine["n"].to_numpy()).astype(np.int64), order, symbols))
    return out


def train(labelled: DataFrame, order: int = 4, folds: int = 10, reject_width: float = 8.0, least_gap: float = 0.5, least_texts: int = 20) -> LanguageModel | None:
    """Models of all languages of ``labelled(doc_id, text, lang)``; None if it has no letters."""
    rows = labelled.where("lang is not null and text is not null").select("text", "lang", (F.pmod(F.xxhash64("text"), F.lit(folds)) == 0).alias("held"))
    counted = rows.mapInArrow(lean(_count(order)), "lang string, held boolean, part int, grams binary")
    dealt = counted.repartition(_PARTS, "lang", "held", "part").sortWithinPartitions("lang", "held", "part")
    counts = dealt.mapInArrow(lean(_merge), "lang string, held boolean, code long, n long").toPandas()
    if not len(counts):
        return None
    langs = sorted(counts["lang"].unique())
    symbols = len(np.unique(counts["code"].to_numpy() & ((1 << BITS) - 1))) + 1
    model = LanguageModel(langs, _models(counts, langs, order, symbols), order, bound=np.full((len(langs), _LENGTHS), np.inf))
    rest = counts[~counts["held"]]
    known = sorted(rest["lang"].unique())
    if not known:
        return model
    part = LanguageModel(known, _models(rest, known, order, symbols), order, bound=np.full((len(known), _LENGTHS), np.inf))
    seen = keep(rows.where("held").select("text", "lang").mapInArrow(lean(_calibrate(part)), "lang int, length int, entropy double, losses array<double>"), "calibration")
    total = seen.agg(*[F.sum(F.col("losses")[i]) for i in range(len(_TEMPERATURES))]).first()
    if total[0] is not None:
        model.temperature = min(zip(total, _TEMPERATURES))[1]
    mid, high = (F.percentile_approx("entropy", F.lit(q)) for q in (0.5, 0.9))
    # One row a language and power of two.
    stats = seen.groupBy("lang", "length").agg(F.count("*").alias("n"), mid.alias("mid"), high.alias("high")).collect()
    for k, name in enumerate(known):
        mine = {r["length"]: r for r in stats if r["lang"] == k}
        enough = [x for x in mine if mine[x]["n"] >= least_texts] or list(mine)
        for x in range(_LENGTHS):
            if enough:
                r = mine[min(enough, key=lambda y: (abs(y - x), y))]
                model.bound[langs.index(name), x] = r["mid"] + reject_width * (r["high"] - r["mid"]) + least_gap
    finite = np.where(np.isfinite(model.bound), model.bound, -np.inf).max(0)
    model.bound = np.where(np.isfinite(model.bound) | ~np.isfinite(finite), model.bound, finite)
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected, entropy, n_symbols for every row of ``docs(doc_id, text)``."""
    if model is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("n_symbols"))
    return docs.select("doc_id", "text").mapInArrow(lean(_predict(model)), "doc_id long, lang_pred string, score double, rejected boolean, entropy double, n_symbols long")


def recognised(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text the models do not reject; no shuffle."""
    if model is None:
        return docs.where("false")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(place))
            for i, j in slices(off, _SLICE):
                _, _, out, _, size = model.predict(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield batch.slice(i, j - i).filter(pa.array(~out & (size > 0)))

    return docs.mapInArrow(lean(run), docs.schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds

"""Hashes, packed numbers and small codecs."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as K


def web_base64(text: Column) -> Column:
    """base64 that may stand in a url."""
    return F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+/", "-_"), "=|\\s", "")


def web_unbase64(text: Column) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    return F.unbase64(padded).cast("string")


def delta(values: Column) -> Column:
    """M7: first value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(values, F.greatest(i, F.lit(1)))))


def undelta(values: Column) -> Column:
    """Running sums, in one walk."""
    sums = F.aggregate(values, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum")), lambda a, x: F.struct(F.array_append(a["out"], a["sum"] + x).alias("out"), (a["sum"] + x).alias("sum")))
    return sums["out"]


def queue_weight(weight: Column, depth: Column) -> Column:
    """24 bits of weight over 8 bits of inverted depth."""
    return F.shiftleft(F.least(weight.cast("long"), F.lit((1 << 24) - 1)), 8) + (255 - F.least(depth.cast("long"), F.lit(255)))


def queue_unweight(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 8), 255 - packed.bitwiseAND(255)


def metric_int(text: Column) -> Column:
    """An integer with a suffix K, M, G or T."""
    number = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("long")
    suffix = F.upper(F.regexp_extract(text, r"^\s*\d+\s*([KMGTkmgt])", 1))
    factor = F.when(suffix == "K", 10**3).when(suffix == "M", 10**6).when(suffix == "G", 10**9).when(suffix == "T", 10**12).otherwise(1)
    return number * factor.cast("long")


def partition_of(key: Column, partitions: int) -> Column:
    """M4: partition of a key by the first 7 hex digits of its md5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long") % partitions


def url_base64(raw: Column) -> Column:
    """base64 of bytes without padding, with - and _."""
    return F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "=|\\s", "")


def web_encode(text: Column) -> Column:
    """Base64 that may stand in a form: . ~ _ in place of + = /."""
    return F.regexp_replace(F.translate(F.base64(text.cast("binary")), "+=/", ".~_"), r"\s", "")


def web_decode(code: Column) -> Column:
    return F.unbase64(F.translate(code, ".~_", "+=/")).cast("string")


def _half(text: Column, first: int) -> Column:
    """16 digits of a text's md5 as a signed long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 16), 16, -10).cast("long")


def crawl_hash(text: Column) -> Column:
    """M1: both halves of the md5 by exclusive or, eight bytes as url-safe base64."""
    both = _half(text, 1).bitwiseXOR(_half(text, 17))
    return url_base64(F.unhex(F.lpad(F.hex(both), 16, "0")))


def word_key(term: Column) -> Column:
    """M2: eight bytes of the md5, a zero byte, the first eleven bytes of the word; zeros to 20 bytes."""
    raw = F.hex(F.substring(term.cast("binary"), 1, 11))
    return url_base64(F.unhex(F.rpad(F.concat(F.substring(F.md5(term.cast("binary")), 1, 16), F.lit("00"), raw), 40, "0")))


def path_key(path: Column) -> Column:
    """M3: key of a phrase: its first word's and the whole phrase's keys, side by side."""
    return F.concat(word_key(F.element_at(F.split(path, " "), 1)), F.lit("."), crawl_hash(path))


def byte_string(text: Column, kind: str) -> Column:
    """The bytes of a text as two hex digits, three decimal digits or eight binary digits each, with a space after each."""
    raw = F.hex(text.cast("binary"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(raw) / 2, F.lit(1)).cast("int")), lambda i: F.substring(raw, 2 * i - 1, F.lit(2)))
    shown = {"hex": lambda x: x, "int": lambda x: F.lpad(F.conv(x, 16, 10), 3, "0"), "bin": lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")}[kind]
    return F.when(F.length(raw) == 0, "").otherwise(F.concat(F.array_join(F.transform(pairs, shown), " "), F.lit(" ")))


def metric_text(number: Column) -> Column:
    """A whole number with the largest suffix of K, M, G, T that it is a multiple of."""
    out = number.cast("string")
    for power, suffix in ((1, "K"), (2, "M"), (3, "G"), (4, "T")):
        unit = 1000**power
        out = F.when((number != 0) & (number % unit == 0), F.concat((number / unit).cast("long").cast("string"), F.lit(suffix))).otherwise(out)
    return out


#: Pixels of a unit.
UNIT_PIXELS = {"cm": 28, "pt": 28, "em": 6, "pc": 6, "ex": 12, "in": 72, "mm": 2.8, "px": 1}


def pixels(length: Column) -> Column:
    """A CSS length in pixels; per cent of 800, at most all of it."""
    number = F.coalesce(F.regexp_extract(length, r"^\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    share = F.when(number > 0, F.floor(8 * F.least(number, F.lit(100.0)))).otherwise(0)
    out = F.when(length.endswith("%"), share)
    for unit, size in UNIT_PIXELS.items():
        out = out.when(length.endswith(unit), (number * size).cast("long"))
    return out.otherwise(number.cast("long"))


def merged_weight(packed: Sequence[Column] | Column) -> tuple[Column, Column]:
    """Aggregates of packed queue weights: the sum of weights within 24 bits, and the least depth."""
    weight, depth = queue_unweight(packed)
    return F.least(F.sum(weight), F.lit((1 << 24) - 1)), F.min(depth)


def varbyte(values: Column) -> Column:
    """M9: hex of whole numbers in groups of seven bits, lowest first; every byte but a number's first has its high bit set."""
    def one(v: Column) -> Column:
        groups = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("i"), F.floor(v / F.pow(F.lit(128), i)).cast("long").alias("q"))), lambda g: (g["i"] == 0) | (g["q"] > 0))
        return F.array_join(F.transform(groups, lambda g: F.lpad(F.hex(g["q"] % 128 + F.when(g["i"] > 0, 128).otherwise(0)), 2, "0")), "")

    return F.array_join(F.transform(values, one), "")


def unvarbyte(code: Column) -> Column:
    """The numbers of ``varbyte``."""
    raw = F.transform(F.sequence(F.lit(1), F.greatest(F.length(code) / 2, F.lit(1)).cast("int")), lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(1).cast("bigint").alias("unit"))

    def step(s: Column, b: Column) -> Column:
        more = b >= 128
        last = F.coalesce(F.try_element_at(s["out"], F.lit(-1)), F.lit(0)) + (b - 128) * s["unit"] * 128
        grown = F.concat(F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(last))
        return F.struct(F.when(more, grown).otherwise(F.concat(s["out"], F.array(b))).alias("out"), F.when(more, s["unit"] * 128).otherwise(F.lit(1).cast("bigint")).alias("unit"))

    return F.when(F.length(code) == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(raw, start, step, lambda s: s["out"]))


def divergence_to_mean(shares: Column) -> Column:
    """Mean Kullback-Leibler divergence of Bernoulli shares to their mean."""
    tiny = 1e-8
    clip = lambda p: F.least(F.greatest(p, F.lit(tiny)), F.lit(1 - tiny))
    n = F.size(shares)
    mean = clip(F.aggregate(shares, F.lit(0.0), lambda a, p: a + p) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a + clip(p) * F.log(clip(p) / mean) + (1 - clip(p)) * F.log((1 - clip(p)) / (1 - mean))) / n


def private_count(count: Column, uniform: Column, epsilon: float = 0.5) -> Column:
    """A count with noise of two-sided exponential fall, kept within 0 and twice the count; ``uniform`` is a random share of 0 to 1."""
    side = uniform - 0.5
    noise = -F.signum(side) * F.log(F.greatest(1 - 2 * F.abs(side), F.lit(1e-12))) / epsilon
    return F.least(F.greatest(F.round(count + noise), F.lit(0)), 2 * count).cast("long")


#: Fixed values of the word format: numbers in a word, bits of each, code of the word's first byte.
MODIFIED9 = ((24, 1, 63), (12, 2, 62), (7, 3, 60), (6, 4, 56), (5, 5, 52), (4, 6, 48), (3, 9, 32), (2, 14, 16), (1, 28, 0))


def pack_words(values: Sequence[int]) -> bytes:
    """M6: positive numbers below 2**28 in words of four bytes, each filled with as many as fit at one width."""
    words, at = [], 0
    while at < len(values):
        for count, bits, code in MODIFIED9:
            some = values[at : at + count]
            if len(some) == count and max(some) < 1 << bits:
                break
        words.append((code << 24) + sum(v << (bits * (count - 1 - i)) for i, v in enumerate(some)))
        at += count
    marks = [0] if len(words) == 1 else [3, *[2] * (len(words) - 2), 1]
    return b"".join((w | m << 30).to_bytes(4, "big") for w, m in zip(words, marks))


def unpack_words(raw: bytes) -> list[int]:
    out: list[int] = []
    for i in range(0, len(raw), 4):
        word = int.from_bytes(raw[i : i + 4], "big") & (1 << 30) - 1
        count, bits, _ = next(x for x in MODIFIED9 if word >> 24 & x[2] == x[2])
        out += [word >> (bits * (count - 1 - k)) & (1 << bits) - 1 for k in range(count)]
    return out


def pack_posting(doc_index: int, positions: Sequence[int]) -> bytes:
    """M8: a document's number (from 0) and the differences of its positions."""
    return pack_words([doc_index + 1, *[b - a for a, b in zip([0, *positions], positions)]])


def unpack_posting(raw: bytes) -> tuple[int, list[int]]:
    first, *steps = unpack_words(raw)
    return first - 1, list(itertools.accumulate(steps))


@F.pandas_udf(K.BinaryType())
def packed_postings(doc_index: pd.Series, positions: pd.Series) -> pd.Series:
    return pd.Series([pack_posting(int(d), [int(x) for x in p]) for d, p in zip(doc_index, positions)])


@F.pandas_udf(K.StructType([K.StructField("doc_index", K.LongType()), K.StructField("positions", K.ArrayType(K.LongType()))]))
def unpacked_postings(raw: pd.Series) -> pd.DataFrame:
    rows = [unpack_posting(x) for x in raw]
    return pd.DataFrame({"doc_index": [d for d, _ in rows], "positions": [p for _, p in rows]})

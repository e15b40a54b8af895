"""Vectorised text kernels shared by the operators of this folder.

Everything works on the raw UTF-8 buffer of an Arrow string column: the texts of a
batch stay one ``uint8`` array with offsets, and no Python object is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: a bijection that spreads every input bit."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
INK = np.ones(256, bool)
INK[[9, 10, 11, 12, 13, 32]] = False
#: ASCII letters, and all bytes of other characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        off_t = np.int64
    else:
        off_t = np.int32
    n = len(col)
    if n == 0 or pa.types.is_null(col.type):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, off_t)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if col.null_count and (np.diff(o)[np.asarray(col.is_null())]).any():
        return text_buffer(col.fill_null(""))
    return raw[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a single longer text gets its own range."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)
_LONG = 512


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).tobytes()
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each data[start:end]: length and seed, then eight bytes at a time, each step a bijective mix.

    No step is linear in the bytes, so texts of a regular build collide no oftener than
    others; hashes of two seeds are independent. Spans above 512 bytes go through BLAKE2b.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) * U64(0x9FB21C651E98DF25) ^ mix(np.array([seed], np.uint64)))
    if not len(size):
        return out
    wide = eights(data)
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    step = 0
    while len(at):
        left = size[at] - step
        block = wide[starts[at] + step]
        short = np.flatnonzero(left < 8)
        block[short] &= _LOW_BYTES[left[short]]
        out[at] = mix(out[at] ^ block)
        at = at[left > 8]
        step += 8
    for i in np.flatnonzero(size > _LONG).tolist():
        raw = data[starts[i] : ends[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def gram_hash(data: np.ndarray, doublings: int = 3) -> np.ndarray:
    """Hash of the 8 * 2**doublings bytes from each position on that has as many."""
    n = len(data) - (8 << doublings) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.array(eights(data)[: len(data) - 7])
    h = mix(h)
    for k in range(doublings):
        w = 8 << k
        h = (h[:-w] ^ (h[:-w] >> U64(29))) * U64(0xBF58476D1CE4E5B9) + h[w:]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(31))


def same_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[start : start + size] equals data[other : other + size], span by span."""
    out = np.ones(len(starts), bool)
    wide = eights(data)
    at = np.flatnonzero((size > 0) & (starts != other))
    step = 0
    while len(at) > 64:
        left = size[at] - step
        differ = wide[starts[at] + step] ^ wide[other[at] + step]
        short = np.flatnonzero(left < 8)
        differ[short] &= _LOW_BYTES[left[short]]
        out[at] = differ == 0
        at = at[(left > 8) & out[at]]
        step += 8
    for i in at.tolist():
        out[i] = out[i] and bool((data[starts[i] + step : starts[i] + size[i]] == data[other[i] + step : other[i] + size[i]]).all())
    return out


def runs(data: np.ndarray, offsets: np.ndarray, ink: np.ndarray = INK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of ``ink`` bytes; runs end with their text."""
    n = len(data)
    on = ink[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    prev, nxt = np.zeros(n, bool), np.zeros(n, bool)
    prev[1:], nxt[:-1] = on[:-1], on[1:]
    starts = np.flatnonzero(on & (~prev | cut[:n]))
    ends = np.flatnonzero(on & (~nxt | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bincount(runs(data, offsets)[2], minlength=len(offsets) - 1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, row) of the distinct ``k``-word shingles of each text, by row, then hash.

    A text of fewer than ``k`` words, and at least one, has its whole sequence as one shingle.
    The second hash comes from word hashes of another seed, so that both together have 128 bits.
    """
    starts, ends, rows = runs(data, offsets)
    low = _LOWER[data]
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), rows
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    at = np.arange(n) - first[rows]
    left = count[rows] - at
    pos = np.flatnonzero((left >= k) | (at == 0))
    width = np.minimum(left[pos], k)
    found = []
    for seed in (0, 1):
        h = span_hash(low, starts, ends, seed)
        out = np.zeros(len(pos), np.uint64)
        for j in range(k):
            on = width > j
            out[on] = mix(out[on] * U64(0xD6E8FEB86659FD93) + h[pos[on] + j])
        found.append(mix(out + width.astype(np.uint64)))
    out, second = found
    r = rows[pos]
    order = np.lexsort((out, r))
    out, second, r = out[order], second[order], r[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (r[1:] != r[:-1])
    return out[new], second[new], r[new]

"""Suffix array by the difference-cover (skew) algorithm, vectorised in numpy."""

from __future__ import annotations

import numpy as np

_BITS = 21
#: Texts of more symbols must be sorted in pieces: names of a piece have to fit _BITS.
MOST = (1 << _BITS) - 8


def _packed(*parts: np.ndarray) -> np.ndarray:
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = key << _BITS | p
    return key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of ``s`` (symbols from 1 to below 2**21) in order.

    Suffixes at positions 1 and 2 modulo 3 are sorted by triples, which are named in order; if
    names repeat, the string of names is sorted the same way. The suffixes at positions 0 modulo 3 then follow from their first symbol and
    the rank of the next suffix, and both lists are merged.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    x = np.concatenate((s.astype(np.int64), np.zeros(4, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    triple = _packed(x[sample], x[sample + 1], x[sample + 2])
    order = np.argsort(triple, kind="stable")
    step = np.ones(len(order), np.int64)
    step[1:] = triple[order][1:] != triple[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(step)
    if step.sum() < len(order):
        order = suffix_array(names)
    rank = np.zeros(n + 4, np.int64)
    by_rank = sample[order]
    rank[by_rank] = np.arange(1, len(order) + 1)
    rank[n:] = 0
    zero = np.arange(0, n, 3)
    zero_key = _packed(x[zero], rank[zero + 1])
    at = np.argsort(zero_key, kind="stable")
    zero = zero[at]
    by_rank = by_rank[by_rank < n]
    first, second = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    below = np.searchsorted(_packed(x[first], rank[first + 1]), zero_key[at])
    below += np.searchsorted(_packed(x[second], x[second + 1], rank[second + 2]), _packed(x[zero], x[zero + 1], rank[zero + 2]))
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + below] = zero
    out[out < 0] = by_rank
    return out


def repeated_starts(text: np.ndarray, ends: np.ndarray, length: int, place: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Marks positions of ``text`` whose ``length`` bytes, inside their string, start at two places or more.

    ``text`` holds strings ending at ``ends``. ``place`` tells the place of each position in the
    corpus (strings may overlap there), and ``many`` whether its string stands at several places.
    """
    n = len(text)
    found = np.zeros(n, bool)
    # A string ends in the smallest symbol, which no byte equals.
    s = np.insert(text.astype(np.int64) + 2, ends, 1)
    shift = np.searchsorted(ends, np.arange(n), "right")
    room = ends[np.minimum(shift, len(ends) - 1)] - np.arange(n) >= length
    back = np.full(len(s), -1, np.int64)
    back[np.arange(n) + shift] = np.arange(n)
    at = back[suffix_array(s)]
    at = at[at >= 0]
    at = at[room[at]]
    if not len(at):
        return found
    # Adjacent prefixes, eight bytes at a time; pairs that differ drop out.
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    wide = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    pair = np.arange(len(at) - 1)
    for k in [*range(0, length - 7, 8), length - 8]:
        same = wide[at[pair] + k].copy().view(np.uint64)[:, 0] == wide[at[pair + 1] + k].copy().view(np.uint64)[:, 0]
        pair = pair[same]
    head = np.ones(len(at), bool)
    head[pair + 1] = False
    first = np.flatnonzero(head)
    p = place[at]
    again = (np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first)) | np.logical_or.reduceat(many[at], first)
    found[at[again[np.cumsum(head) - 1]]] = True
    return found

"""Whole-text token encoding that runs the tokenizer once per distinct chunk.

A chunk ends only where the tokenizer itself must end a token, so the ids of a text are
the ids of its chunks one after another. Each distinct chunk is encoded by the tokenizer
library; numpy then lays the ids out in text order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

from tessera.llm.textnum import same_spans, span_hash


class ChunkEncoder:
    """Encodes batches of texts given a cutter and an encoder of distinct chunks.

    ``cut(data)`` marks bytes before which a token boundary is certain;
    ``encode(list[str])`` returns one id list per string. At most ``most`` chunks are
    remembered, by their bytes; the memory is emptied when it is full, which changes no
    result. Where a text holds one of ``literals`` (the leftmost first, of those the longest),
    it is one chunk. ``mark``, if given, gives a number for each distinct chunk and its ids;
    ``flags`` then has the sum over the chunks of each text of the last batch.
    """

    def __init__(self, cut: Callable[[np.ndarray], np.ndarray], encode: Callable[[list[str]], list[list[int]]], most: int = 200_000, literals: Iterable[str] = (), mark: Callable[[list[str], list[list[int]]], list[int]] | None = None) -> None:
        self.cut, self.encode, self.most, self.mark = cut, encode, most, mark
        found = sorted((x.encode() for x in literals), key=len, reverse=True)
        self.literal = re.compile(b"|".join(map(re.escape, found))) if found else None
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flagged = np.zeros(1 << 12, np.int64)
        self.start, self.length, self.pool, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    def _learn(self, chunks: list[bytes]) -> None:
        texts = [c.decode() for c in chunks]
        ids = self.encode(texts)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(size.sum()))
        n, m = len(self.known), len(chunks)
        while n + m > len(self.start):
            self.start, self.length, self.flagged = (np.resize(x, 2 * len(x)) for x in (self.start, self.length, self.flagged))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.start[n : n + m] = self.used + np.cumsum(size) - size
        self.length[n : n + m] = size
        self.flagged[n : n + m] = self.mark(texts, ids) if self.mark else 0
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(chunks, range(n, n + m)))

    def _keep_literals(self, raw: bytes, offsets: list[int], at: np.ndarray) -> None:
        if not self.literal.search(raw):
            return
        for i, j in zip(offsets, offsets[1:]):
            for m in self.literal.finditer(raw, i, j):
                at[m.start() : m.end()] = False
                at[m.start()] = True
                if m.end() < len(at):
                    at[m.end()] = True

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets per text)."""
        if not len(data):
            self.flags = np.zeros(len(offsets) - 1, np.int64)
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        at = self.cut(data)
        at[offsets[:-1][offsets[:-1] < len(data)]] = True
        if self.literal:
            self._keep_literals(data.tobytes(), offsets.tolist(), at)
        starts = np.flatnonzero(at)
        ends = np.append(starts[1:], len(data))
        seed = 0
        while True:  # chunks that are told alike by hash are compared byte by byte; another seed would part them
            _, first, inverse = np.unique(span_hash(data, starts, ends, seed), return_index=True, return_inverse=True)
            if same_spans(data, starts, starts[first][inverse], ends - starts).all():
                break
            seed += 1
        if len(self.known) + len(first) > self.most:
            self._clear()
        raw = data.tobytes()
        chunks = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if new := [c for c in chunks if c not in self.known]:
            self._learn(new)
        slot = [self.known[c] for c in chunks]
        entry = np.array(slot)[inverse]
        size = self.length[entry]
        upto = np.concatenate(([0], np.cumsum(size)))
        index = np.repeat(self.start[entry] - upto[:-1], size)
        index += np.arange(len(index))
        text = np.searchsorted(starts, offsets)
        if self.mark:
            self.flags = np.diff(np.concatenate(([0], np.cumsum(self.flagged[entry])))[text])
        return self.pool[index], upto[text]


def _plain(data: np.ndarray) -> np.ndarray:
    """Marks the last bytes of characters that are certainly no white space: ASCII ink and
    two-byte characters from U+00C0 on."""
    ink = (data > 0x20) & (data < 0x7F)
    ink[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    return ink


_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 other ink but the apostrophe; ASCII only
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x27] = 0


def cut_byte_level(data: np.ndarray) -> np.ndarray:
    """Certain boundaries of the byte-level pattern ``... ?\\p{L}+| ?\\p{N}+|...|\\s+(?!\\S)|\\s+``.

    A single space between ink opens the next token; a single line feed between ink is a
    token of its own; ASCII letters, digits and other signs part from each other, but for
    what follows an apostrophe. All other white space stays inside a chunk.
    """
    at = np.zeros(len(data), bool)
    if len(data) < 2:
        return at
    kind = _CLASS[data]
    at[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    at[1:] |= (data[1:] == 0x27) & ((kind[:-1] == 1) | (kind[:-1] == 2))
    before = _plain(data)[:-2]
    follows = ((data[2:] > 0x20) & (data[2:] < 0x7F)) | ((data[2:] >= 0xC3) & (data[2:] < 0xE0))
    alone = before & follows
    at[1:-1] |= alone & ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A))
    at[2:] |= alone & (data[1:-1] == 0x0A)
    return at


def cut_by_pieces(pieces: list[str], meta: str) -> Callable[[np.ndarray], np.ndarray]:
    """Boundaries between two characters that stand side by side in no piece.

    Decided for ASCII pairs, and for any character before a space; a literal ``meta`` in a
    text counts as a space and is never cut at. ``pieces`` use ``meta`` for the space.
    """
    joined = np.ones((256, 256), bool)
    joined[:128, :128] = False
    joined[128:, 0x20] = any(a not in (" ", meta) and not a.isascii() and b == meta for p in pieces for a, b in zip(p, p[1:]))
    for p in pieces:
        p = p.replace(meta, " ")
        for a, b in zip(p, p[1:]):
            if a.isascii() and b.isascii():
                joined[ord(a), ord(b)] = True
    joined[ord(meta[-1:].encode("utf-8")[-1:]), 0x20] = True

    def cut(data: np.ndarray) -> np.ndarray:
        at = np.zeros(len(data), bool)
        at[1:] = ~joined[data[:-1], data[1:]]
        return at

    return cut

"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is parsed here; normaliser, metaspace marker, piece scores and byte
fallback are rebuilt as a ``tokenizers`` pipeline: a unigram model from its scores, a BPE
model from merges ordered by the score of the merged piece. All ids are those of the rebuilt
pipeline, which encodes and decodes batches of distinct chunks on several threads. Every distinct chunk is encoded by the sentencepiece library, too, and ``n_differing``
counts the chunks of a document for which its ids are others (parity).

Defined cases: null and empty texts have no ids and decode to an empty text; repeated rows
and null doc_ids are kept as they come; very long texts are cut only at certain piece boundaries;
an empty table gives no rows; extra columns, also one called ``ids``, are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkEncoder, cut_by_pieces
from tessera.llm.shared import lean
from tessera.llm.textnum import slices, text_buffer

META = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = raw[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(raw):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield tag >> 3, raw[i : i + n]
        i += n


@dataclass
class Model:
    """What a SentencePiece model file holds that encoding needs."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    unk_id: int = 0


def parse(raw: bytes) -> Model:
    m = Model()
    for number, value in _fields(raw):
        if number == 1:
            p = dict(_fields(value))
            m.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            m.kind, m.byte_fallback, m.unk_id = t.get(3, UNIGRAM), bool(t.get(35, 0)), t.get(40, 0)
        elif number == 3:
            t = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.squeeze = t.get(2, b""), bool(t.get(3, 1)), bool(t.get(4, 1))
    return m


def _merges(vocab: dict[str, int], scores: dict[str, float]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best merged score first."""
    found = []
    for piece, score in scores.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in scores and b in scores:
                found.append((-score, vocab[a], vocab[b], a, b))
    return [(a, b) for _, _, _, a, b in sorted(found)]


def build(m: Model, prefix: bool = True):
    """The tokenizers pipeline of a model; without ``prefix`` texts get no dummy prefix."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    if m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], m.unk_id, m.byte_fallback))
    elif m.kind == BPE:
        scores = {p: s for p, s, k in m.pieces if k in (NORMAL, USER)}
        t = Tokenizer(models.BPE(vocab, _merges(vocab, scores), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    else:
        raise ValueError(f"model type {m.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if prefix and m.dummy_prefix:
        steps.append(normalizers.Prepend(META))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", META)])
    t.decoder = decoders.Sequence([decoders.Replace(META, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


def separable(m: Model) -> bool:
    """Whether texts may be cut between characters: the normaliser keeps each of them."""
    return not m.charsmap and not m.squeeze


class Codec:
    """Encodes and decodes batches of UTF-8 buffers with one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        with open(path, "rb") as f:
            raw = f.read()
        self.model = parse(raw)
        self.cuts = separable(self.model)
        self.tokenizer = build(self.model, prefix=not self.cuts)
        # The dummy prefix is put before whole texts, not before chunks: a second normaliser
        # message at the end of a protobuf overrides that one field.
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw + (b"\x1a\x02\x18\x00" if self.cuts else b""))
        used = [p for p, _, k in self.model.pieces if k in (NORMAL, USER)]
        cut = cut_by_pieces(used, META) if self.cuts else lambda data: np.zeros(len(data), bool)
        self.encoder = ChunkEncoder(cut, self._encode, 250_000, mark=self._checked)
        # Decoded behind a letter a chunk keeps a space it begins with.
        self.letter = next((i, p) for i, (p, _, k) in enumerate(self.model.pieces) if k in (NORMAL, USER) and p.isascii() and p.isalpha())

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _checked(self, texts: list[str], ids: list[list[int]]) -> list[int]:
        """Per chunk 1 if the library's ids are others, and 2**32 if its own do not decode to it."""
        theirs = self.reference.encode(texts, num_threads=2)
        first, letter = self.letter
        back = self.tokenizer.decode_batch([[first, *i] for i in ids], skip_special_tokens=False)
        return [(a != b) + ((letter + t != x) << 32) for a, b, t, x in zip(ids, theirs, texts, back)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets per text); ``encoder.flags`` then has the sums of ``_checked`` per text."""
        if self.cuts and self.model.dummy_prefix:
            some = np.flatnonzero(np.diff(offsets) > 0)
            data = np.insert(data, offsets[some], 0x20)
            offsets = offsets + np.searchsorted(some, np.arange(len(offsets)))
        return self.encoder(data, offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts, without the dummy prefix."""
        flat, at = ids.tolist(), offsets.tolist()
        return self.tokenizer.decode_batch([flat[a:b] for a, b in zip(at, at[1:])], skip_special_tokens=False)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _run(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, 1 << 20):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, at = c.encode(d, o)
                view = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(c.encoder.flags >> 32 == 0), pa.array(c.encoder.flags & 0xFFFFFFFF)]
                names = ["doc_id", "n_ids", "ids_crc32", "round_trip", "n_differing"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_documents(docs: DataFrame, model: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (of uint32 little-endian ids), round_trip, n_differing[, ids].

    round_trip tells whether the decoded ids equal the text byte for byte: every distinct chunk is decoded
    by the pipeline's decoder, and a text is its chunks one after another; n_differing is the
    number of the document's chunks to which the sentencepiece library gives other ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lean(_run(model, with_ids)), "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, n_differing long" + ", ids array<int>" * with_ids)

"""Token ids in binary files: frequency-ranked, byte-aligned variable-length code.

Each id becomes its rank by corpus frequency, and each rank takes 1 to 4 bytes. Two bits
per rank, four to a control byte, give the length; control and data bytes are separate
(Stream VByte; Lemire, Kurz, Rupp, 2018). Decoding looks four lengths up per control byte
in a 256 x 4 table.

File: ``TESSTOK1``, uint32 size of the vocabulary, uint32[size] ids by rank, then blocks.
Block: uint32 number of texts, uint64 number of ids, int64[texts] doc_id, uint8[texts] 1 where
doc_id is null, uint32[texts] ids per text, control bytes, uint64 number of data bytes, data bytes. All little-endian. Files
hold whole texts in ascending doc_id order, and file order is doc_id order.

Plan: encode (no shuffle) -> id frequencies over all texts (one count per id and task) ->
range partitioning by doc_id -> one file per partition in the shared folder, written under
a task-attempt name and then renamed, so a lost executor costs only its partitions.
Only the rank table, bounded by the vocabulary, reaches the driver.

Defined cases: the literal of an added token in a text has that token's id, as in the
library's own call; null or empty text has only the end id; rows without doc_id come first, rows of
one doc_id are ordered by their ids, so that reruns agree; an empty table writes no file and reads
back as no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.chunks import ChunkEncoder, cut_byte_level
from tessera.llm.shared import discard, folder, keep, lean
from tessera.llm.textnum import slices, text_buffer

MAGIC = b"TESSTOK1"
END_ID = 0
_LENGTHS = np.array([[1 + (c >> (2 * k) & 3) for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = values.astype(np.uint32)
    size = 1 + (v > 0xFF).astype(np.int64) + (v > 0xFFFF) + (v > 0xFFFFFF)
    pad = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    pad[: len(v)] = size - 1
    control = (pad[0::4] | pad[1::4] << 2 | pad[2::4] << 4 | pad[3::4] << 6).astype(np.uint8)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        on = size > k
        out[at[on] + k] = (v[on] >> np.uint32(8 * k)).astype(np.uint8)
    return control, out


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    size = _LENGTHS[control].reshape(-1)[:n].astype(np.int64)
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        on = size > k
        out[on] |= data[at[on] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def _letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_level_encoder(path: str) -> ChunkEncoder:
    """Encoder of a byte-level BPE file of the tokenizers library.

    Runs of letters go straight to the library's BPE model; chunks with other white space or
    mixed kinds go through its whole pipeline. Added tokens are met in texts as the library
    meets them: each literal is one chunk. Where one takes in white space, asks for word
    boundaries or is sought in normalized text, texts are not cut.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    added = t.get_added_tokens_decoder().values()
    literals = {a.content for a in added}
    model, letter = t.model, str.maketrans({chr(b): c for b, c in _letters().items()})

    def one(x: str) -> list[int]:
        bare = x[1:] if x[0] == " " else x
        if bare.isalpha() and x not in literals:
            return [k.id for k in model.tokenize(x.encode().decode("latin-1").translate(letter))]
        return t.encode(x, add_special_tokens=False).ids

    if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in added):
        return ChunkEncoder(lambda data: np.zeros(len(data), bool), lambda texts: [t.encode(x, add_special_tokens=False).ids for x in texts], 10_000)
    return ChunkEncoder(cut_byte_level, lambda texts: [one(x) for x in texts], 500_000, literals)


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = byte_level_encoder(path)
    return _ENCODERS[path]


def _encode(path: str, wide: bool):
    kind = np.uint32 if wide else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, 2 << 20):
                ids, at = encode(data[off[i] : off[j]], off[i : j + 1] - off[i])
                raw = ids.astype(kind).tobytes()
                o = (at * kind(0).itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(o.tobytes()), pa.py_buffer(raw)])], ["doc_id", "ids"])

    return run


def _counts(wide: bool, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            data, _ = text_buffer(batch.column(0))
            total += np.bincount(data.view(np.uint32 if wide else np.uint16), minlength=vocab)
            total[END_ID] += batch.num_rows
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int64()), pa.array(total[on])], ["id", "n"])

    return run


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else "file://" + os.path.abspath(path))


def _write(folder: str, by_rank: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        rank = np.zeros(len(by_rank), np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        system, base = _filesystem(folder)
        name = f"{base}/ids-{task.partitionId():08d}.bin"
        part = f"{name}.{task.taskAttemptId()}"
        out, docs, total = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = system.open_output_stream(part)
                out.write(MAGIC + np.uint32(len(by_rank)).tobytes() + by_rank.astype("<u4").tobytes())
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off, 2 << 20):
                ids = data[off[i] : off[j]].view(np.uint32 if wide else np.uint16)
                ends = (off[i + 1 : j + 1] - off[i]) // (4 if wide else 2)
                ids = np.insert(ids.astype(np.uint32), ends, END_ID)
                size = np.diff(off[i : j + 1]) // (4 if wide else 2) + 1
                control, packed = pack(rank[ids])
                ours = batch.column(0).slice(i, j - i)
                doc, none = np.asarray(ours.fill_null(0)), np.asarray(ours.is_null()).astype(np.uint8)
                out.write(np.uint32(j - i).tobytes() + np.uint64(len(ids)).tobytes() + doc.astype("<i8").tobytes() + none.tobytes() + size.astype("<u4").tobytes() + control.tobytes() + np.uint64(len(packed)).tobytes() + packed.tobytes())
                docs, total = docs + j - i, total + len(ids)
        if out is not None:
            out.close()
            system.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([f"ids-{task.partitionId():08d}.bin"]), pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    return run


def read_blocks(stream: io.RawIOBase) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids per text, ids) of each block of a file."""

    def take(n: int, kind: str) -> np.ndarray:
        raw = stream.read(n * np.dtype(kind).itemsize)
        if len(raw) != n * np.dtype(kind).itemsize:
            raise ValueError("token file ends early")
        return np.frombuffer(raw, kind)

    if stream.read(8) != MAGIC:
        raise ValueError("not a token file")
    by_rank = take(int(take(1, "<u4")[0]), "<u4")
    while head := stream.read(4):
        n, total = int(np.frombuffer(head, "<u4")[0]), int(take(1, "<u8")[0])
        doc = pa.array(take(n, "<i8"), mask=take(n, "u1") > 0)
        size, control = take(n, "<u4"), take(-(-total // 4), "u1")
        yield doc, size, by_rank[unpack(control, take(int(take(1, "<u8")[0]), "u1"), total)]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_input_stream(f"{base}/{file}", buffer_size=1 << 20) as stream:
                    for doc, size, ids in read_blocks(stream):
                        ends = np.cumsum(size.astype(np.int64))
                        raw = memoryview(ids.astype("<u4").tobytes())
                        begin = ends - size
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist())]
                        offs = np.concatenate(([0], ends * 4)).astype(np.int32)
                        held = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw)])
                        yield pa.RecordBatch.from_arrays([doc, pa.array(begin + start), pa.array(size.astype(np.int64)), pa.array(crc, pa.int64()), held], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                        start += int(ends[-1])

    return run


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=END_ID) + 1


def write_token_files(docs: DataFrame, tokenizer: str, place: str) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write files to ``place``; returns the manifest (part, file, n_docs, n_ids)."""
    spark = docs.sparkSession
    vocab = vocabulary_size(tokenizer)
    wide = vocab > 1 << 16
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = keep(docs.mapInArrow(lean(_encode(tokenizer, wide)), "doc_id long, ids binary"), "ids")
    freq = ids.select("ids").mapInArrow(_counts(wide, vocab), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = [r.id for r in freq.orderBy(F.desc("n"), "id").select("id").collect()]  # at most ``vocab`` rows
    on = np.zeros(vocab, bool)
    on[seen] = True
    by_rank = np.concatenate((np.array(seen, np.int64), np.flatnonzero(~on)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    _filesystem(place)[0].create_dir(_filesystem(place)[1], recursive=True)
    manifest = keep(dealt.mapInArrow(lean(_write(place, by_rank, wide)), "part long, file string, n_docs long, n_ids long"), "manifest")
    discard(ids)
    return manifest


def read_token_files(manifest: DataFrame, place: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (uint32 bytes) from the files of a manifest."""
    # One row per file: the running total needs one small partition.
    before = F.coalesce(F.sum("n_ids").over(_before()), F.lit(0))
    files = manifest.select("part", "file", before.alias("start"))
    # As many tasks as files: a number given is not merged again.
    dealt = files.repartitionByRange(max(1, manifest.count()), "part").select("file", "start")
    return dealt.mapInArrow(lean(_read(place)), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _before():
    from pyspark.sql import Window

    return Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, then read back, in a new folder of the session's shared directory."""
    place = f"{folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, tokenizer, place), place)

"""Removal of repeated byte strings with a distributed difference-cover suffix sort.

Each byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or
another document, is removed. Sorting every suffix of the corpus is not needed for that:

1. In every window of ``length`` bytes the position of its smallest 64-byte hash is its anchor.
   Equal windows have equal anchors, so windows meet only under a common anchor, and
   anchors that occur once rule their windows out. No window is lost.
2. The windows of an anchor are parted by their distance to it, ``CLASS`` starts to a piece. All
   windows of a piece share a core of 166 bytes, which is a closer key than the anchor: cores
   that occur once rule their windows out, too. Equal pieces are kept once with their
   number, and all windows of a piece that occurs again repeat.
3. Cores with several different pieces are left. Those pieces are dealt by core, and the
   suffixes of each task's pieces are sorted by the skew algorithm: sampled triples, recursion
   on their names, merge of the rest. Neighbours are then compared over ``length`` bytes.
4. A core of more than ``most`` different pieces would be too much for a task; its windows are
   instead grouped one by one by a 128-bit hash, counted before the shuffle.

Texts are shuffled once, by document; the documents with repeated anchors are written as a
bucketed table, so that later joins leave them in place.

Hashes are of eight bytes at a time (``textnum.span_hash``); equal pieces are told by two of
independent seeds, 128 bits.

Defined cases: null and empty texts have 0 bytes and the hash of no bytes; texts below
``length`` lose nothing; rows that share a doc_id or have none are texts of their own, which may repeat each other;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import discard, folder, keep, lean
from tessera.llm.suffix_array import MOST, repeated_starts
from tessera.llm.textnum import U64, gram_hash, mix, slices, span_hash, text_buffer

GRAM = 64
CLASS = 35


def _sliding(x: np.ndarray, width: int, op, fill: int) -> np.ndarray:
    """op over x[i : i + width] for every i with a full window, by block prefixes and suffixes."""
    m = len(x) - width + 1
    pad = np.concatenate((x, np.full(-len(x) % width + width, fill, x.dtype))).reshape(-1, width)
    prefix = op.accumulate(pad, 1).reshape(-1)
    suffix = op.accumulate(pad[:, ::-1], 1)[:, ::-1].reshape(-1)
    return op(suffix[:m], prefix[width - 1 : width - 1 + m])


def _hashes(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash at each position, smallest hash of the window that starts there; 0 where none lies inside a text)."""
    width = length - GRAM + 1
    h = gram_hash(data) | U64(1)
    low = _sliding(h, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    low[ends < np.arange(len(low)) + length] = 0
    return h, low


def _runs(low: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) window of each run with one anchor; windows outside texts are in none."""
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])  # a window that starts at its anchor is that anchor's last
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(low)) - 1
    on = low[first] > 0
    return first[on], last[on]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first window, anchor hash) of each run of windows with one anchor."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, low = _hashes(data, offsets, length)
    first, _ = _runs(low, h)
    return first, low[first]


def pieces(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, core start, class) of the pieces of the runs that begin at ``wanted``."""
    h, low = _hashes(data, offsets, length)
    first, last = _runs(low, h)
    on = np.isin(first, wanted)
    first, last = first[on], last[on]
    value = low[first]
    # The anchor of a run is the first position from its last window on with the smallest hash.
    anchor = last.copy()
    left = np.flatnonzero(h[anchor] != value)
    while len(left):
        anchor[left] += 1
        left = left[h[anchor[left]] != value[left]]
    out = []
    for c in range(-(-(length - GRAM + 1) // CLASS)):
        a = np.maximum(first, anchor - (CLASS * c + CLASS - 1))
        b = np.minimum(last, anchor - CLASS * c)
        some = a <= b
        out.append((a[some], (b - a + 1)[some], anchor[some] - CLASS * c, np.full(int(some.sum()), c)))
    parts = [np.concatenate(x) for x in zip(*out)]
    by = np.argsort(parts[0], kind="stable")
    return tuple(x[by] for x in parts)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), values)


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                pos, h = anchors(d, o, length)
                row = np.searchsorted(o, pos, "right") - 1
                n = np.bincount(row, minlength=j - i)
                raw = d.tobytes()
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(o)), pa.array(sha), _lists(n, pa.array((pos - o[row]).astype(np.int32))), _lists(n, pa.array(h.view(np.int64)))], ["rid", "n_bytes", "sha", "pos", "hash"])

    return run


def _flat(batch: pa.RecordBatch, text: int, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(bytes, offsets, row of each list entry, entries) of a batch."""
    data, off = text_buffer(batch.column(text))
    col = batch.column(lists)
    size = np.asarray(col.value_lengths().fill_null(0))
    return data, off, np.repeat(np.arange(len(size)), size), col.flatten()


def _hash_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, off = text_buffer(whole.column(1))
            for i, j in slices(off):
                batch = whole.slice(i, j - i)
                data, o, row, entries = _flat(batch, 1, 2)
                at, n, core, kind = pieces(data, o, np.asarray(entries).astype(np.int64) + o[row], length)
                ca, cb = (span_hash(data, at, at + n + length - 1, seed) for seed in (0, 1))
                key = mix(span_hash(data, core, core + length - CLASS + 1) + kind.astype(np.uint64))
                where = np.searchsorted(o, at, "right") - 1
                size = np.bincount(where, minlength=j - i)
                cols = [_lists(size, pa.array(v)) for v in ((at - o[where]).astype(np.int32), n.astype(np.int32), ca.view(np.int64), cb.view(np.int64), key.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["rid", "text", "pos", "w", "ca", "cb", "key"])

    return run


def _cut(length: int):
    """Rows (key, rid, pos, n, w, piece) of the representatives in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, off = text_buffer(whole.column(1))
            for i, j in slices(off, 1 << 20):
                batch = whole.slice(i, j - i)
                data, o, row, entries = _flat(batch, 1, 2)
                pos = np.asarray(entries.field("pos")).astype(np.int64) + o[row]
                a, size = pos, np.asarray(entries.field("w")).astype(np.int64) + length - 1
                upto = np.concatenate(([0], np.cumsum(size)))
                index = np.repeat(a - upto[:-1], size)
                index += np.arange(len(index))
                texts = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data[index].tobytes())])
                rid = batch.column(0).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([entries.field("key"), rid, entries.field("pos"), entries.field("n"), entries.field("w"), texts], ["key", "rid", "pos", "n", "w", "piece"])

    return run


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _sort(length: int):
    """Marks the repeated windows of pieces that come by key: (rid, pos, w, marks)."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, off = text_buffer(t.column(5))
        size = np.diff(off)
        single = np.asarray(t.column(3)) == 1
        begin = np.asarray(t.column(2)).astype(np.int64)
        place = np.repeat(mix(np.asarray(t.column(1)).astype(np.uint64)), size) + (np.repeat(begin - off[:-1], size) + np.arange(len(data))).astype(np.uint64)
        found = repeated_starts(data, off[1:], length, place, np.repeat(~single, size))
        marks, rows = [], []
        for r in np.flatnonzero(single & (np.add.reduceat(found, off[:-1]) > 0)):
            rows.append(r)
            marks.append(_bits(found[off[r] : off[r + 1]]))
        take = pa.array(np.array(rows, np.int64))
        return pa.RecordBatch.from_arrays([t.column(1).take(take), t.column(2).take(take), t.column(4).take(take), pa.array(marks, pa.binary())], ["rid", "pos", "w", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        used = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, off = text_buffer(batch.column(5))
            key = np.asarray(batch.column(0))
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            begin = 0
            for h in [*heads.tolist()[1:], batch.num_rows]:
                # Rows of one key stay together; a full piece is sorted at the next change of key.
                size = int(off[h] - off[begin]) + (h - begin)
                if held and used + size > MOST and (begin in heads) and not (begin == 0 and int(held[-1].column(0)[-1].as_py()) == int(key[0])):
                    yield solve(held)
                    held, used = [], 0
                held.append(batch.slice(begin, h - begin))
                used += size
                begin = h
        if held:
            yield solve(held)

    return run


def _windows(length: int):
    """(rid, pos, w, start, wa, wb, n) of each window of a piece, by 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(5))
            n = np.maximum(np.diff(off) - length + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            a = off[row] + start
            wa, wb = (span_hash(data, a, a + length, seed) for seed in (0, 1))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (1, 2, 4)), pa.array(start.astype(np.int32)), pa.array(wa.view(np.int64)), pa.array(wb.view(np.int64)), batch.column(3).take(take)], ["rid", "pos", "w", "start", "wa", "wb", "n"])

    return run


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            rows = []
            for r, (rid, marks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                raw = data[off[r] : off[r + 1]]
                cover = np.zeros(len(raw) + 1, np.int32)
                pos = np.asarray(marks.values.field("pos")).astype(np.int64)
                bits = marks.values.field("marks")
                windows = np.asarray(marks.values.field("w")).astype(np.int64)
                none = np.asarray(bits.is_null())
                # A whole piece repeats: all its windows, one unbroken run of bytes.
                np.add.at(cover, pos[none], 1)
                np.add.at(cover, pos[none] + windows[none] + length - 1, -1)
                for k in np.flatnonzero(~none):
                    on = np.flatnonzero(np.unpackbits(np.frombuffer(bits[int(k)].as_buffer(), np.uint8))) + pos[k]
                    np.add.at(cover, on, 1)
                    np.add.at(cover, on + length, -1)
                gone = np.cumsum(cover[:-1]) > 0
                left = raw[~gone].tobytes()
                spans = int((gone & ~np.append(False, gone[:-1])).sum())
                rows.append((rid, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["rid", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, most: int = 4096, with_text: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, changed, kept_text].

    kept_text is null for texts that lose nothing; characters cut apart are dropped from it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder(spark)  # sets the session's batch size
    clash = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").take(1)
    if clash:  # then rows get numbers of their own, and are written so that these stay
        docs = keep(docs.withColumn("rid", F.monotonically_increasing_id()), "rows")
    else:
        docs = docs.withColumn("rid", F.col("doc_id"))
    found = keep(docs.select("rid", "text").mapInArrow(lean(_find(length)), "rid long, n_bytes long, sha string, pos array<int>, hash array<long>"), "anchors")
    each = found.select("rid", F.explode(F.arrays_zip("pos", "hash")).alias("a")).select("rid", "a.pos", "a.hash")
    again = keep(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "again")
    at = each.join(again, "hash").groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("pos"))
    table = f"tessera_repeats_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = docs.select("rid", "text").join(at, "rid").mapInArrow(lean(_hash_pieces(length)), "rid long, text string, pos array<int>, w array<int>, ca array<long>, cb array<long>, key array<long>")
    near.write.bucketBy(parts, "rid").option("compression", "zstd").format("parquet").saveAsTable(table)
    near = spark.table(table)

    each = near.select("rid", F.explode(F.arrays_zip("pos", "w", "ca", "cb", "key")).alias("c")).select("rid", "c.pos", "c.w", "c.ca", "c.cb", "c.key")
    kinds = keep(each.groupBy("ca", "cb").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "w", "key")).alias("r")).select("ca", "cb", "n", "r.*"), "pieces")
    # A core needs a sort if it has several pieces, and one of them only once.
    cores = keep(kinds.groupBy("key").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("key", "c"), "cores")
    picked = kinds.join(cores, "key").select("rid", F.struct("pos", "w", "key", "n").alias("r")).groupBy("rid").agg(F.sort_array(F.collect_list("r")).alias("reps"))
    cut = near.select("rid", "text").join(picked, "rid").mapInArrow(lean(_cut(length)), "key long, rid long, pos int, n long, w int, piece binary")
    hot = keep(cores.where(F.col("c") > most).select("key"), "hot")
    if hot.take(1):
        cut = keep(cut, "cut")
        few, many = cut.join(hot, "key", "left_anti"), cut.join(hot, "key", "left_semi")
    else:
        few, many = cut, None
    marked = few.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(_sort(length)), "rid long, pos int, w int, marks binary")
    if many is not None:
        w = keep(many.select("key", "rid", "pos", "n", "w", "piece").mapInArrow(_windows(length), "rid long, pos int, w int, start int, wa long, wb long, n long"), "windows")
        twice = keep(w.groupBy("wa", "wb").agg(F.count("*").alias("m"), F.max("n").alias("n")).where("m > 1 or n > 1").select("wa", "wb"), "twice")
        starts = w.where("n = 1").join(twice, ["wa", "wb"]).groupBy("rid", "pos", "w").agg(F.collect_set("start").alias("starts"))
        marked = marked.unionByName(starts.mapInArrow(_as_bits, "rid long, pos int, w int, marks binary"))
    whole = each.join(kinds.where("n > 1").select("ca", "cb"), ["ca", "cb"]).select("rid", "pos", "w", F.lit(None).cast("binary").alias("marks"))
    marked = keep(whole.unionByName(marked), "marks")
    marks = marked.groupBy("rid").agg(F.collect_list(F.struct("pos", "w", "marks")).alias("marks"))
    text = ", kept_text string"
    done = near.select("rid", "text").join(marks, "rid").mapInArrow(lean(_remove(length)), "rid long, n_removed long, n_spans long, kept_sha256 string" + text)
    if not with_text:
        done = done.drop("kept_text")
    done = keep(done, "removed")
    spark.sql(f"DROP TABLE {table}")  # nothing reads these any more
    discard(again, kinds, cores, hot, marked)
    done = done.withColumnRenamed("kept_sha256", "kept")
    out = found.select("rid", "n_bytes", "sha").join(done, "rid", "left")
    if clash:
        out = out.join(docs.select("rid", "doc_id"), "rid")
    else:
        out = out.withColumn("doc_id", F.col("rid"))
    cols = ["doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256")]
    return out.select(*cols, *(["rid", "kept_text"] if with_text else []))


def _as_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = []
        for s in batch.column(3).to_pylist():
            flags = np.zeros(max(s) + 1, bool)
            flags[s] = True
            marks.append(_bits(flags))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(marks, pa.binary())], ["rid", "pos", "w", "marks"])

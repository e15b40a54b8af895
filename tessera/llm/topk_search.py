"""Exact top-k inner-product search with block-at-a-time pruning.

Components are quantised to integers. Candidates are stored by document range: ``group`` blocks
of ``rows`` vectors that follow each other form a group, and each block has its forward index (the
integer rows) and the largest and smallest value of every component (term). For a query,
the bound of a block or a group is the sum over terms of the larger of weight x maximum and weight
x minimum. Within a group, blocks are scored in falling order of bound until it falls
below the query's k-th best score so far.

Plan: rows are range-partitioned by vec_id and numbered into groups; one summary row a group
holds its term maxima and minima. Queries meet the summaries first, in chunks, and
work goes in rounds: in the first each query is sent to the one group of the highest bound,
whose k-th score is a floor of the final one; in the second it is sent to just those other
groups whose bound reaches the floor. A task streams one group, then the queries
sent to it, and returns at most k rows a query; Spark merges these by query. No group, block or
query is ever joined by a key that many share.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no
part; components of any finite size are exact, and a score beyond the range of a long is returned
as its nearest end, ranked by the exact value within a group; vectors of different length never
meet; with fewer than k candidates all are returned; ties go to the smaller vec_id; repeated
rows are candidates each, and queries each, whose ranks follow one another by ``query_row``; a row is no
candidate for its own vec_id; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import keep, lean
from tessera.llm.vectors import matrices

_EXACT = float(1 << 53)
_NONE = -(1 << 62)  # below any score of the fast path; its negative is a number, too
_NOBODY = np.iinfo(np.int64).max
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): int64 where all fit into 52 bits, else Python integers."""
    if np.abs(x).max(initial=0) * scale < _EXACT / 2:
        return np.floor(scale * x).astype(np.int64)
    whole = int(scale)  # a power of two: beyond 2**53 every component is a whole number
    flat = [int(v) * whole if abs(v) > _EXACT else int(np.floor(scale * v)) for v in x.reshape(-1).tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(x.shape)


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point only where every partial sum is exact."""
    if queries.dtype != object and rows.dtype != object:
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
        if most < _EXACT:
            return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
        if most < -_NONE / 2:
            return queries @ rows.T
    out = np.empty((len(queries), len(rows)), object)
    right = [[int(v) for v in r] for r in rows]
    for i, q in enumerate(queries):
        q = [int(v) for v in q]
        out[i] = [sum(a * b for a, b in zip(q, r)) for r in right]
    return out


def bounds(queries: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """(queries x ranges) largest possible scores, rounded up; ranges have maxima ``hi`` and minima ``lo``."""
    q = queries.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        out = q.clip(min=0) @ hi.T + q.clip(max=0) @ lo.T
        size = np.abs(q) @ np.maximum(np.abs(hi), np.abs(lo)).T
    return np.where(np.isfinite(size) & np.isfinite(out), np.where(size < _EXACT, out, out + size * 1e-12), np.inf)


def search(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of the k best over ``blocks`` of (ids, values, maxima, minima).

    ``floor`` holds a score per query that k candidates are known to reach; blocks bounded
    below it are not scored.
    """
    n = len(queries)
    bound = bounds(queries, *(np.stack([b[c].astype(np.float64) for b in blocks]) for c in (2, 3)))
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s, best_i = np.full((n, k), _NONE), np.full((n, k), _NOBODY)
    if any(b[1].dtype == object for b in blocks) or queries.dtype == object or (np.abs(bound) >= -_NONE / 2).any():
        best_s = np.full((n, k), -(1 << 4000), object)
    none = best_s[0, 0] if n else _NONE
    kth = floor.copy()
    for step in range(len(blocks)):
        which = order[:, step]
        go = bound[np.arange(n), which] >= kth
        if not go.any():
            break  # bounds only fall from here, and the k-th scores only rise
        for b in np.unique(which[go]):
            q = np.flatnonzero(go & (which == b))
            ids, values, _, _ = blocks[b]
            s = scores(queries[q], values)
            own = ids[None, :] == query_ids[q][:, None]
            s = np.concatenate((best_s[q], np.where(own, none, s)), 1)
            i = np.concatenate((best_i[q], np.where(own, _NOBODY, np.broadcast_to(ids, s[:, k:].shape))), 1)
            if s.dtype != object and s.shape[1] > 4 * k:  # what is below the k-th score can't be among the k
                cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                width = int((s >= cut[:, None]).sum(1).max())
                at = np.argpartition(-s, min(width, s.shape[1]) - 1, axis=1)[:, :width]
                s, i = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
            if s.dtype == object:
                at = np.array([sorted(range(s.shape[1]), key=lambda j: (-s[r, j], i[r, j]))[:k] for r in range(len(s))])
            else:
                at = np.lexsort((i, -s), axis=1)[:, :k]
            best_s[q], best_i[q] = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
            low = np.array([float(min(max(v, _LEAST), _MOST)) for v in best_s[q, -1]]) if s.dtype == object else best_s[q, -1].astype(np.float64)
            kth[q] = np.maximum(kth[q], np.where(best_i[q, -1] == _NOBODY, -np.inf, np.nextafter(low, -np.inf)))
    r, c = np.nonzero(best_i != _NOBODY)
    return r, best_i[r, c], np.array([min(max(int(v), _LEAST), _MOST) for v in best_s[r, c]], np.int64)


def _binary(x: np.ndarray) -> pa.Array:
    """One binary value a row."""
    size = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _float_rows(col: pa.Array) -> np.ndarray:
    """The matrix of a column of ``_binary``."""
    n = len(col)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int32)[col.offset : col.offset + n + 1]
    return np.frombuffer(data, np.float64, (o[-1] - o[0]) // 8, o[0]).reshape(n, -1)


def _number(group_rows: int):
    """(dim, grp, vec_id, vals): rows as they come, ``group_rows`` of a length to a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, named = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            for ids, x in matrices(batch.column(0), batch.column(1)):
                d = x.shape[1]
                at = (seen.get(d, 0) + np.arange(len(ids))) // group_rows
                seen[d] = seen.get(d, 0) + len(ids)
                # Groups are numbered within the task, over all lengths.
                grp = np.array([named.setdefault((d, g), len(named)) for g in at.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), d), pa.int32()), pa.array((part << 32) + grp), pa.array(ids), _binary(x)], ["dim", "grp", "vec_id", "vals"])

    return run


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, grp, hi, lo) of the rows of each group in a batch."""
    for batch in batches:
        grp = np.asarray(batch.column(1))
        for g in np.unique(grp):
            on = pa.array(np.flatnonzero(grp == g))
            x = _float_rows(batch.column(2).take(on))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on).slice(0, 1), pa.array([g]), pa.array([x.max(0)], pa.list_(pa.float64())), pa.array([x.min(0)], pa.list_(pa.float64()))], ["dim", "grp", "hi", "lo"])


def _choose(scale: float, first: bool):
    """Queries (qrow, qid, vals, floor, skip) that meet a chunk of summaries: those of them to go to which group.

    In the first round it is each query's best group of the chunk; later every group but the one it
    has met whose bound reaches the floor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column("chunk")) * (1 << 20) + np.asarray(batch.column("dim"))
            cuts = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(a, b - a)
                groups = np.asarray(part.column("grps")[0].values)
                hi, lo = (np.floor(scale * np.asarray(part.column(c)[0].values).reshape(len(groups), -1)) for c in ("hi", "lo"))
                for i in range(0, b - a, 256):
                    some = part.slice(i, 256)
                    bound = bounds(np.floor(scale * _float_rows(some.column("vals"))), hi, lo)
                    if first:
                        r, c = np.arange(len(bound)), bound.argmax(1)
                    else:
                        floor, skip = np.asarray(some.column("floor")), np.asarray(some.column("skip"))
                        r, c = np.nonzero((bound >= floor[:, None]) & (groups[None, :] != skip[:, None]))
                    at = pa.array(r)
                    yield pa.RecordBatch.from_arrays([*(some.column(x).take(at) for x in ("qrow", "qid", "vals", "floor")), pa.array(groups[c]), pa.array(bound[r, c])], ["qrow", "qid", "vals", "floor", "grp", "bound"])

    return run


RESULT = "query_row long, query_id long, vec_id long, score long, grp long"


def _answer(scale: float, k: int, rows: int):
    """Streams (grp, is_query, id, vals, floor, qrow): a group's candidates by vec_id, then the queries sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, blocks = None, [], None
        for batch in batches:
            grp, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = (np.flatnonzero((grp[1:] != grp[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(grp)]):
                if a == b:
                    continue
                ids, x = np.asarray(batch.column(2))[a:b], batch.column(3).slice(a, b - a)
                if not asks[a]:
                    if int(grp[a]) != at:
                        at, held, blocks = int(grp[a]), [], None
                    held.append((ids, _float_rows(x)))
                    continue
                if blocks is None:
                    ids_, x_ = (np.concatenate(c) for c in zip(*held))
                    held, blocks = [], []
                    for i in range(0, len(ids_), rows):
                        v = quantised(x_[i : i + rows], scale)
                        blocks.append((ids_[i : i + rows], v, v.max(0), v.min(0)))
                floor, qrow = np.asarray(batch.column(4).fill_null(0.0))[a:b], np.asarray(batch.column(5).fill_null(0))[a:b]
                for i in range(0, b - a, 512):
                    q = quantised(_float_rows(x.slice(i, 512)), scale)
                    r, vec, s = search(ids[i : i + 512], q, blocks, k, floor[i : i + 512].copy())
                    yield pa.RecordBatch.from_arrays([pa.array(qrow[i + r]), pa.array(ids[i + r]), pa.array(vec), pa.array(s), pa.array(np.full(len(r), at))], ["query_row", "query_id", "vec_id", "score", "grp"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, rows: int = 4096, group: int = 16, chunk: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score, query_row over ``vectors(vec_id long, embedding array)``; queries are its rows where ``is_query``.

    A task holds one group (``rows`` x ``group`` vectors), or one chunk of summaries.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vectors.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    cands = keep(dealt.mapInArrow(lean(_number(rows * group)), "dim int, grp long, vec_id long, vals binary"), "candidates")
    asked = vectors.where(is_query).mapInArrow(lean(_number(1 << 62)), "dim int, grp long, vec_id long, vals binary")
    asked = keep(asked.select("dim", F.monotonically_increasing_id().alias("qrow"), F.col("vec_id").alias("qid"), "vals"), "asked")
    found = cands.select("dim", "grp", "vals").mapInArrow(lean(_summaries), "dim int, grp long, hi array<double>, lo array<double>")
    best = lambda c, f: F.reduce(F.collect_list(c), F.lit(None).cast("array<double>"), lambda a, v: F.when(a.isNull(), v).otherwise(F.zip_with(a, v, f)))
    found = found.groupBy("dim", "grp").agg(best("hi", lambda a, b: F.greatest(a, b)).alias("hi"), best("lo", lambda a, b: F.least(a, b)).alias("lo"))
    place = (F.row_number().over(Window.partitionBy("dim", F.shiftright("grp", 32)).orderBy("grp")) - 1) / chunk
    found = found.withColumn("chunk", F.shiftright("grp", 32) * (1 << 20) + F.floor(place))
    each = F.sort_array(F.collect_list(F.struct("grp", "hi", "lo")))
    chunks = found.groupBy("dim", "chunk").agg(each.alias("g"))
    chunks = keep(chunks.select("dim", F.row_number().over(Window.partitionBy("dim").orderBy("chunk")).alias("chunk"), F.col("g.grp").alias("grps"), F.flatten("g.hi").alias("hi"), F.flatten("g.lo").alias("lo")), "chunks")
    numbers = chunks.groupBy("dim").agg(F.max("chunk").alias("chunks"))

    def sent(queries: DataFrame, first: bool) -> DataFrame:
        """Queries by the chunks of their length, each copy under a key of its own chunk."""
        copies = queries.join(numbers, "dim").withColumn("chunk", F.explode(F.sequence(F.lit(1), F.col("chunks"))))
        met = copies.join(chunks, ["dim", "chunk"]).select("chunk", "dim", "qrow", "qid", "vals", "floor", "skip", "grps", "hi", "lo")
        return met.mapInArrow(lean(_choose(scale, first)), "qrow long, qid long, vals binary, floor double, grp long, bound double")

    def answers(pairs: DataFrame) -> DataFrame:
        rows_ = cands.select("grp", F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "vals", F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("qrow"))
        needed = rows_.join(pairs.select("grp").distinct(), "grp", "left_semi")
        asks = pairs.select("grp", F.lit(True).alias("asks"), F.col("qid").alias("id"), "vals", "floor", "qrow")
        both = needed.unionByName(asks).repartition(parts, "grp").sortWithinPartitions("grp", "asks", "id")
        return both.mapInArrow(lean(_answer(scale, k, rows)), RESULT)

    low = F.lit(float("-inf"))
    start = sent(asked.withColumns({"floor": low, "skip": F.lit(-1).cast("long")}), True)
    start = keep(start.groupBy("qrow").agg(F.max_by(F.struct("qid", "vals", "floor", "grp"), F.struct("bound", F.negate("grp"))).alias("q")).select("qrow", "q.*"), "first")
    one = keep(answers(start), "round1")
    kth = one.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("low"))
    kth = kth.select(F.col("query_row").alias("qrow"), F.when((F.col("n") >= k) & (F.abs("low") < _EXACT), F.col("low")).otherwise(low).alias("floor"))
    again = asked.join(start.select("qrow", F.col("grp").alias("skip")), "qrow").join(kth, "qrow", "left").withColumn("floor", F.coalesce("floor", low))
    two = answers(keep(sent(again, False).drop("bound"), "pairs"))
    by = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    out = one.unionByName(two).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score", "query_row")

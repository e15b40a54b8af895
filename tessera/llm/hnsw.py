"""Embedding near-dedup with a hierarchical navigable small-world graph per shard.

Graph (Malkov, Yashunin, 2018): each vector gets a level by its hash; neighbours are chosen
by the diversity rule; upper levels are descended greedily and level 0 by beam search. Here
vectors are inserted, and queries run, many at a time: one numpy step moves every beam.

Plan: equal vectors form one class, held by its smallest row. Classes are dealt to shards by
hash and each shard's graph is built in one task, then audited: probes at the threshold, made
by turning sampled members just so far, must find their member, and sampled members their
true links by brute force over the shard; the beam is widened until both do. Graphs are
written in parts to the shared folder. Every block of queries then meets every shard as
a stream: a task loads one graph and passes its queries by it. A query whose beam is full of links
is continued: dense queries near one member share one walk of the graph over all
that lies within twice the threshold's angle of it, and are compared with what it met.
Similarities are confirmed in double precision. A task returns the number of links of each
query and a spanning forest of them, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, and so do vectors of different length; any finite size of components is
allowed; rows that share a vec_id or have none are vectors of their own, a component is
named by its smallest non-null vec_id (null if there is none) and one row of it is kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import by_name, components, discard, keep, lean, numbered, reach
from tessera.llm.textnum import U64, mix
from tessera.llm.vectors import matrices

_SLACK = 1e-5  # of float32 similarities; what lies within is decided in double precision


class Graph:
    """HNSW over unit vectors."""

    def __init__(self, x: np.ndarray, m: int = 16, width: int = 64, seed: int = 7) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        u = (mix(np.arange(n, dtype=np.uint64) + U64(seed)) >> U64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 8)
        order = np.argsort(-level, kind="stable")  # higher levels first: every level grows from its top
        self.x, self.order, level = self.x[order], order, level[order]
        self.m = m
        self.count = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        self.links = [np.full((c, 2 * m if k == 0 else m), -1, np.int32) for k, c in enumerate(self.count)]
        done, step = min(n, 1), 1
        while done < n:
            step = min(512, max(1, done // 2), n - done)
            self._insert(done, done + step, level, width)
            done += step

    def _insert(self, a: int, b: int, level: np.ndarray, width: int) -> None:
        q = self.x[a:b]
        entry = np.zeros((b - a, 1), np.int32)
        for k in range(len(self.links) - 1, -1, -1):
            known = min(a, self.count[k])
            if not known:
                continue
            ids, sims = self._beam(q, entry, k, width if k == 0 or (level[a:b] >= k).any() else 1, known)
            entry = ids[:, : max(1, min(4, ids.shape[1]))]
            on = np.flatnonzero(level[a:b] >= k)
            if not len(on):
                continue
            # The rows of this batch are candidates of one another, too.
            near = q[on] @ q[on].T
            np.fill_diagonal(near, -2)
            cand = np.concatenate((ids[on], np.broadcast_to((a + on).astype(np.int32), (len(on), len(on)))), 1)
            near = np.concatenate((sims[on], near), 1)
            keep_n = min(width, cand.shape[1])
            at = np.argsort(-near, axis=1, kind="stable")[:, :keep_n]
            cand, near = np.take_along_axis(cand, at, 1), np.take_along_axis(near, at, 1)
            cand = np.where(near <= -2, -1, cand)
            chosen = self._diverse(cand, near, self.m)
            rows = a + on
            self.links[k][rows, : chosen.shape[1]] = chosen
            self._back(k, rows, chosen)

    def _diverse(self, cand: np.ndarray, near: np.ndarray, m: int) -> np.ndarray:
        """Candidates in falling similarity that are nearer to the row than to any one chosen; then the best of the rest."""
        n, c = cand.shape
        v = self.x[np.maximum(cand, 0)]
        between = v @ v.transpose(0, 2, 1)
        taken = np.zeros((n, c), bool)
        for j in range(c):
            clash = (taken & (between[:, j, :] > near[:, j, None])).any(1)
            taken[:, j] = (cand[:, j] >= 0) & ~clash & (taken.sum(1) < m)
        rank = np.where(taken, 0, 1) + np.where(cand < 0, 2, 0)
        at = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(cand, at, 1)

    def _back(self, k: int, rows: np.ndarray, chosen: np.ndarray) -> None:
        links = self.links[k]
        src = np.repeat(rows, chosen.shape[1]).astype(np.int32)
        dst = chosen.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.zeros(0, int)
        nodes, size = dst[first], np.diff(np.append(first, len(dst)))
        free = (links[nodes] < 0).sum(1)
        fits = size <= free
        for i in np.flatnonzero(fits):
            at = links.shape[1] - free[i]
            links[nodes[i], at : at + size[i]] = src[first[i] : first[i] + size[i]]
        full = np.flatnonzero(~fits)
        if not len(full):
            return
        wide = links.shape[1] + int(size[full].max())
        cand = np.full((len(full), wide), -1, np.int32)
        cand[:, : links.shape[1]] = links[nodes[full]]
        for r, i in enumerate(full):
            cand[r, links.shape[1] : links.shape[1] + size[i]] = src[first[i] : first[i] + size[i]]
        near = np.where(cand >= 0, np.einsum("ncd,nd->nc", self.x[np.maximum(cand, 0)], self.x[nodes[full]]), -3)
        at = np.argsort(-near, axis=1, kind="stable")[:, : 3 * links.shape[1]]
        cand, near = np.take_along_axis(cand, at, 1), np.take_along_axis(near, at, 1)
        for i in range(0, len(full), 256):
            links[nodes[full[i : i + 256]]] = self._diverse(cand[i : i + 256], near[i : i + 256], links.shape[1])

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, width: int, known: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of each query's beam on level k, best first; -1 where it has fewer."""
        n = len(q)
        links, rows = self.links[k], np.arange(n)[:, None]
        seen = np.zeros((n, known + 1), bool)
        seen[:, known] = True
        e = np.where((entry >= 0) & (entry < known), entry, known)
        e = np.sort(e, axis=1)
        e[:, 1:][e[:, 1:] == e[:, :-1]] = known
        sims = np.where(e < known, np.einsum("ncd,nd->nc", self.x[np.minimum(e, known - 1)], q), -3).astype(np.float32)
        seen[rows, e] = True
        ids, spent = e, e == known
        while True:
            open_s = np.where(spent, -3, sims)
            take = min(at_once, open_s.shape[1])
            pick = np.argpartition(-open_s, take - 1, axis=1)[:, :take]
            good = np.take_along_axis(open_s, pick, 1) > -3
            live = np.flatnonzero(good.any(1))
            if not len(live):
                break
            spent[rows, pick] = True
            nodes = np.where(good, np.take_along_axis(ids, pick, 1), known)[live]
            near = links[np.minimum(nodes, known - 1)]
            near[nodes == known] = -1
            near = near.reshape(len(live), -1)
            near = np.where((near < 0) | (near >= known), known, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = known
            near[seen[live[:, None], near]] = known
            seen[live[:, None], near] = True
            s = np.full(near.shape, -3, np.float32)
            r, c = np.nonzero(near < known)
            s[r, c] = np.einsum("nd,nd->n", self.x[near[r, c]], q[live[r]])
            more_i, more_s = np.full((n, near.shape[1]), known, ids.dtype), np.full((n, near.shape[1]), -3, np.float32)
            more_i[live], more_s[live] = near, s
            ids, sims, spent = np.concatenate((ids, more_i), 1), np.concatenate((sims, more_s), 1), np.concatenate((spent, more_i == known), 1)
            if ids.shape[1] > width:
                at = np.argpartition(-sims, width - 1, axis=1)[:, :width]
                ids, sims, spent = (np.take_along_axis(y, at, 1) for y in (ids, sims, spent))
        at = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
        return np.where(ids == known, -1, ids), sims

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the original matrix, similarities) of the ``width`` best found for each query."""
        q = np.ascontiguousarray(q, np.float32)
        entry = np.zeros((len(q), 1), np.int32)
        for k in range(len(self.links) - 1, 0, -1):
            entry = self._beam(q, entry, k, 4, self.count[k])[0][:, :4]
        ids, sims = self._beam(q, entry, 0, width, self.count[0])
        return np.where(ids < 0, -1, self.order[ids]), sims

    def around(self, hub: int, least: float) -> np.ndarray:
        """Nodes at similarity ``least`` or more to a node that level 0 reaches from it over such nodes."""
        seen = np.zeros(len(self.x), bool)
        seen[hub] = True
        found, front, v = [np.array([hub])], np.array([hub]), self.x[hub]
        while len(front):
            near = np.unique(self.links[0][front])
            near = near[near >= 0]
            near = near[~seen[near]]
            seen[near] = True
            front = near[self.x[near] @ v >= least]
            found.append(front)
        return np.concatenate(found)

    def within(self, q: np.ndarray, least: float, width: int, batch: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, rows of the matrix) of what is found at similarity ``least`` or more, in pieces."""
        q = np.ascontiguousarray(q, np.float32)
        dense, hubs = [np.zeros(0, int)], [np.zeros(0, int)]
        for i in range(0, len(q), batch):
            part = q[i : i + batch]
            entry = np.zeros((len(part), 1), np.int32)
            for k in range(len(self.links) - 1, 0, -1):
                entry = self._beam(part, entry, k, 4, self.count[k])[0][:, :4]
            ids, sims = self._beam(part, entry, 0, width, self.count[0])
            hit = (sims >= least) & (ids >= 0)
            full = hit.all(1) & (ids.shape[1] >= width) & (width < len(self.x))
            r, c = np.nonzero(hit & ~full[:, None])
            yield i + r, self.order[ids[r, c]]
            dense.append(i + np.flatnonzero(full))
            hubs.append(ids[full, 0].astype(int))
        left, hub = np.concatenate(dense), np.concatenate(hubs)
        wide = 2 * least * least - 1 - _SLACK  # the cosine of twice the angle
        while len(left):
            near = q[left] @ self.x[hub[0]] >= least
            near[0] = True
            nodes = self.around(int(hub[0]), wide)
            mine = left[near]
            for i in range(0, len(mine), 512):
                r, c = np.nonzero(q[mine[i : i + 512]] @ self.x[nodes].T >= least)
                yield mine[i : i + 512][r], self.order[nodes[c]]
            left, hub = left[~near], hub[~near]


def audited_width(g: Graph, least: float, target: float, sample: int = 512, width: int = 32) -> int:
    """The beam at which probes at the threshold find their member, and sampled members their links, at rate ``target``."""
    n, d = g.x.shape
    rows = np.unique(np.linspace(0, n - 1, min(n, sample)).astype(int))
    own = g.x[rows].astype(np.float64)
    turn = np.random.default_rng(11).normal(size=own.shape)
    turn -= (turn * own).sum(1, keepdims=True) * own
    size = np.linalg.norm(turn, axis=1, keepdims=True)
    near = min(1.0, least + 2e-3)
    probes = near * own + np.sqrt(1 - near * near) * turn / np.where(size > 0, size, 1)
    true = int((g.x[rows] @ g.x.T >= least).sum())
    while width < n:
        met = sum(int((g.order[rows[a]] == b).sum()) for a, b in g.within(probes, least, width))
        links = sum(len(a) for a, _ in g.within(own, least, width))
        if (d == 1 or met >= target * len(rows)) and links >= target * true:
            break
        width *= 2
    return width


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever the size of finite components."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(least: float, target: float, part: int = 16 << 20):
    def solve(dim: int, shard: int, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        ids, weight, x = (np.concatenate(c) for c in zip(*held))
        g = Graph(_units(x).astype(np.float32))
        width = audited_width(g, least - _SLACK, target)
        blob = pickle.dumps((g, x, ids, weight, width), 5)
        for i in range(0, len(blob), part):
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([i // part], pa.int32()), pa.array([blob[i : i + part]], pa.binary())], ["dim", "shard", "part", "graph"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        at = None
        for batch in batches:
            dim, shard = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1])) + 1
            for i, j in zip([0, *cuts], [*cuts, len(dim)]):
                if j == i:
                    continue
                if at is not None and at != (int(dim[i]), int(shard[i])):
                    yield from solve(*at, held)
                    held = []
                at = int(dim[i]), int(shard[i])
                _, x = matrices(batch.column(2).slice(i, j - i), batch.column(4).slice(i, j - i))[0]
                exact = x.astype(np.float32)
                held.append((np.asarray(batch.column(2))[i:j], np.asarray(batch.column(3))[i:j], exact if (exact == x).all() else x))
        if held:
            yield from solve(*at, held)

    return run


FOUND = "a long, b long, n long"


def _query(least: float):
    """Passes query rows by the graph whose parts come before them."""

    def answer(graph: tuple, qid: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        g, x, ids, weight, width = graph
        q = _units(q)
        n = np.zeros(len(qid), np.int64)
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in g.within(q, least - _SLACK, width):
            step = max(64, (1 << 21) // q.shape[1])
            for i in range(0, len(a), step):
                s, t = a[i : i + step], b[i : i + step]
                other = qid[s] != ids[t]
                s, t = s[other], t[other]
                ok = np.einsum("nd,nd->n", q[s], _units(x[t])) >= least
                s, t = s[ok], t[ok]
                n += np.bincount(s, weight[t], minlength=len(n)).astype(np.int64)
                p, r = reach(qid[s], ids[t])
                u.append(p[p != r])
                v.append(r[p != r])
        p, r = reach(np.concatenate(u), np.concatenate(v))
        on = np.flatnonzero(n)
        tree = p != r
        columns = (np.concatenate((qid[on], p[tree])), np.concatenate((np.full(len(on), -1), r[tree])), np.concatenate((n[on], np.zeros(int(tree.sum()), np.int64))))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, graph = None, [], None
        for batch in batches:
            dim, shard, block = (np.asarray(batch.column(c)) for c in range(3))
            is_graph = np.asarray(batch.column(4).is_valid())
            change = (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (block[1:] != block[:-1]) | (is_graph[1:] != is_graph[:-1])
            cuts = (np.flatnonzero(change) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(dim)]):
                if i == j:
                    continue
                here = int(dim[i]), int(shard[i]), int(block[i])
                if is_graph[i]:
                    if here != at:
                        at, parts, graph = here, [], None
                    parts += batch.column(4).slice(i, j - i).to_pylist()
                elif here == at:  # else no class of this length fell into the shard
                    if graph is None:
                        graph, parts = pickle.loads(b"".join(parts)), []
                    yield answer(graph, *matrices(batch.column(5).slice(i, j - i), batch.column(6).slice(i, j - i))[0])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.95, shard_rows: int = 200_000, shard_values: int = 1 << 24, least_shards: int = 4, block_rows: int = 1 << 18, target: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id long, embedding array)``.

    A shard has about ``shard_rows`` classes, or as many as have ``shard_values`` components;
    a block of queries has at most about ``block_rows``.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    every, other = numbered(vectors, "vec_id")
    rows = keep(every.where(usable).select("rid", "embedding", F.sha2(F.array_join("embedding", ","), 256).alias("key")), "vectors")
    classes = keep(rows.groupBy("key").agg(F.min("rid").alias("rid"), F.first("embedding").alias("embedding"), F.count("*").alias("n")), "classes")
    count, widest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    shards = max(least_shards, -(-count // shard_rows), -(-count * widest // shard_values))
    blocks = max(1, -(-count // block_rows), -(-2 * spark.sparkContext.defaultParallelism // shards))
    dealt = classes.select(F.size("embedding").alias("dim"), F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), "rid", "n", "embedding")
    built = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "rid")
    graphs = keep(built.mapInArrow(lean(_build(least, target)), "dim int, shard int, part int, graph binary"), "graphs")
    nothing = F.lit(None)
    asked = dealt.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), nothing.cast("int").alias("part"), nothing.cast("binary").alias("graph"), "rid", "embedding")
    loaded = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "graph", nothing.cast("long").alias("rid"), nothing.cast("array<double>").alias("embedding"))
    met = loaded.unionByName(asked).repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block"))
    met = met.sortWithinPartitions("dim", "shard", "block", F.col("part").asc_nulls_last())
    found = keep(met.mapInArrow(lean(_query(least)), FOUND), "found")
    discard(graphs)
    joined = components(found.where("n = 0").select("a", "b"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("others"))
    named = classes.select("key", "rid", "n").join(joined.withColumnRenamed("id", "rid"), "rid", "left").join(counts.withColumnRenamed("a", "rid"), "rid", "left")
    named = keep(named.select("key", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rid").alias("component_id")), "named")
    out = every.select("rid").join(rows.select("rid", "key").join(named, "key"), "rid", "left")
    out = out.select("rid", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "rid").alias("component_id"))
    if other:
        return by_name(out, every, "vec_id").select("vec_id", "n_links", "component_id", "kept")
    return out.select(F.col("rid").alias("vec_id"), "n_links", "component_id", (F.col("component_id") == F.col("rid")).alias("kept"))

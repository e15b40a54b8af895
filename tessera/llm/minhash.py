"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup, 2017): a set is thrown into ``bins`` bins by rounds of
fresh hash functions. Random rounds drop each shingle into one hashed bin; if after
``bins`` rounds a bin were still empty, round ``bins + i`` would throw every shingle into
bin i, so each coordinate fills. A coordinate is the smallest (round, hash) it received.

Plan: one pass over whole texts gives set size, 128-bit set identity and band keys. Equal
sets form one class, held by its smallest doc_id. Classes that share a band key are
gathered into candidate families (components over bucket minima, never pairs). Full
shingle sets are then compared by blocks of at most ``block`` classes, and each block
returns a spanning forest of its true links, so no group is ever expanded into pairs:

1. every block against itself; this decides families of one block;
2. larger families: every block against one member of the family's largest group so far;
3. what that left outside the largest group, in blocks, against all other blocks.

Nothing is capped: each pair of classes that shares a band and could still connect two
groups is compared on its full sets. Bands are derived from the threshold, so that a pair
exactly at it shares no band with a chance of at most 2e-7 by the formula for independent
coordinates (``banding``); above the threshold the chance is smaller.

Shingles are told by 64-bit hashes that no regular text pattern makes collide, equal sets
by 128 bits from two independent word hashes.

Defined cases: null or empty text has n_shingles 0 and links with nothing; fewer than ``k``
words form one shingle; rows that share a doc_id or have none are documents of their own,
a component is named by its smallest non-null doc_id (null if there is none), and just one row of it is kept; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import by_name, components, keep, lean, numbered
from tessera.llm.textnum import U64, mix, shingle_hashes, slices, text_buffer

_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def sketch(hashes: np.ndarray, rows: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """(n_rows, bins) coordinates of fast similarity sketching; rows without hashes stay at the largest value."""
    out = np.full((n_rows, bins), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    h, r = hashes, rows
    for i in range(2 * bins):
        if not len(h):
            break
        v = mix(h ^ mix(np.array([i + 1], np.uint64)))
        b = (v % U64(bins)).astype(np.int64) if i < bins else np.full(len(v), i - bins)
        # The round stands above the hash, so a later round never displaces an earlier one.
        value = (U64(i) << U64(48)) | (v >> U64(16))
        np.minimum.at(flat, r * bins + b, value)
        full = (out != _EMPTY).all(axis=1)
        go = ~full[r]
        h, r = h[go], r[go]
    return out


def _features(k: int, bands: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                n = j - i
                o = off[i : j + 1] - off[i]
                h, second, r = shingle_hashes(data[off[i] : off[j]], o, k)
                size = np.bincount(r, minlength=n)
                a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(a, r, mix(h))
                np.add.at(b, r, mix(second))
                s = sketch(h, r, n, bands * width)
                keys = np.zeros((n, bands), np.uint64)
                for w in range(width):
                    keys = mix(keys * U64(0xD6E8FEB86659FD93) + s[:, w::width])
                keys = mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                flat = pa.array(keys.reshape(-1), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array(size, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], ["doc_id", "n_shingles", "ida", "idb", "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            for i, j in slices(off):
                h, _, r = shingle_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                o = np.searchsorted(r, np.arange(j - i + 1)) * 8
                sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(o.astype(np.int32).tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), sets], ["doc_id", "family", "shingles"])

    return run


def linked_pairs(sets: list[np.ndarray], percent: int, wide: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all pairs with 100 * |intersection| >= percent * |union|."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    on = shared[inverse]
    row, col = row[on], column[inverse[on]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int(shared.sum()), wide):
        part = (col >= start) & (col < start + wide)
        m = np.zeros((len(sets), min(wide, int(shared.sum()) - start)), np.float32)
        m[row[part], col[part] - start] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu((100 * both >= percent * union) & (size[:, None] > 0) & (size[None, :] > 0), 1))
    return i, j


def _forest(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("doc_id").sort_values("doc_id", ignore_index=True)  # doc_id: the row's number
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        ids = group["doc_id"].to_numpy()
        root = list(range(len(ids)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for i, j in zip(*linked_pairs(sets, percent)):
            x, y = top(int(i)), top(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
                a.append(ids[i])
                b.append(ids[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def miss_rate(percent: int, bands: int, width: int) -> float:
    """Chance that a pair of exactly ``percent`` per cent similarity shares no band."""
    return (1 - (percent / 100) ** width) ** bands


def banding(percent: int, most: float = 2e-7, bands: int = 40) -> tuple[int, int]:
    """(bands, width): the widest bands that miss a pair at the threshold with a chance of at most ``most``.

    Low thresholds take bands of one coordinate, and as many more of them as that needs.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    width = max((w for w in range(1, 9) if miss_rate(percent, bands, w) <= most), default=1)
    while miss_rate(percent, bands, width) > most:
        bands += 1
    return bands, width


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int | None = None, width: int | None = None, block: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept, rid (its row's number).

    ``bands`` and ``width`` come from ``percent`` (``banding``) unless both are given.

    class_id is the smallest doc_id with the same shingle set (the number of its row where
    doc_ids are not unique); component_id the smallest reachable over links of at least
    ``percent`` per cent similarity.
    """
    if bands is None or width is None:
        bands, width = banding(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, other = numbered(docs, "doc_id")
    docs = rows.select(F.col("rid").alias("doc_id"), "text")
    feats = keep(docs.mapInArrow(lean(_features(k, bands, width)), "doc_id long, n_shingles long, ida long, idb long, bands array<long>"), "minhash")
    ident = ["ida", "idb", "n_shingles"]
    classes = keep(feats.where("n_shingles > 0").groupBy(*ident).agg(F.min("doc_id").alias("class_id")), "classes")
    reps = feats.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    reps = keep(reps, "bands")
    low = keep(reps.groupBy("band").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low"), "buckets")
    family = keep(components(reps.join(low, "band").where("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct()), "families")
    sizes = keep(family.groupBy("component").agg(F.count("*").alias("size")), "sizes")

    sets = keep(docs.join(family.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("family"), "text").mapInArrow(lean(_sets(k)), "doc_id long, family long, shingles binary"), "sets")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / block)).cast("int")
    dealt = sets.join(sizes.select(F.col("component").alias("family"), blocks.alias("blocks")), "family").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    links = keep(dealt.groupBy("family", "at").applyInPandas(_forest(percent), "a long, b long"), "forest")
    large = keep(dealt.where("blocks > 1"), "large")
    if large.take(1):
        links = _across(large, links, percent)
    joined = components(links)
    named = classes.join(joined.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(*ident, "class_id", F.coalesce("component", "class_id").alias("component_id"))
    named = keep(named, "named")
    out = feats.select("doc_id", *ident).join(named, ident, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    if other:
        out = by_name(out.withColumnRenamed("doc_id", "rid"), rows, "doc_id")
        return out.select("doc_id", "n_shingles", "class_id", "component_id", "kept", "rid")
    return out.withColumn("kept", F.col("component_id") == F.col("doc_id")).withColumn("rid", F.col("doc_id"))


def _across(large: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links between the blocks of the families that have more than one."""

    def grouped(found: DataFrame) -> DataFrame:
        c = components(found).withColumnRenamed("id", "doc_id")
        return keep(large.select("doc_id", "family").join(c, "doc_id", "left").select("doc_id", "family", F.coalesce("component", "doc_id").alias("grp")), "grouped")

    now = grouped(links)
    count = now.groupBy("family", "grp").agg(F.count("*").alias("n"))
    main = count.groupBy("family").agg(F.max_by("grp", F.struct("n", F.negate("grp"))).alias("hub"))
    hubs = keep(main.join(large.select("doc_id", "shingles", "blocks"), F.col("hub") == F.col("doc_id")).select("family", "doc_id", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")), "hubs")
    rows = large.select("family", "at", "doc_id", "shingles").unionByName(hubs.select("family", "at", "doc_id", "shingles"))
    links = keep(links.unionByName(rows.groupBy("family", "at").applyInPandas(_forest(percent), "a long, b long")), "forest")

    now = grouped(links)
    hub_grp = hubs.select("family", "doc_id").distinct().join(now, ["family", "doc_id"]).select("family", F.col("grp").alias("main"))
    side = keep(now.join(hub_grp, "family").withColumn("rest", F.col("grp") != F.col("main")).select("doc_id", "rest"), "sides")
    rows = large.join(side, "doc_id")
    left = keep(rows.where("rest").groupBy("family").agg(F.collect_set("at").alias("ats"), F.first("blocks").alias("blocks")), "rest")
    # Side r<at> holds what is outside the main group; it meets every block of the family.
    ins = rows.join(left.select("family", "ats"), "family")
    as_rest = ins.where("rest").select("family", "doc_id", "shingles", F.col("at").alias("r"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    as_other = ins.select("family", "doc_id", "shingles", F.explode("ats").alias("r"), F.col("at").alias("o"))
    met = as_rest.unionByName(as_other).groupBy("family", "r", "o").applyInPandas(_forest(percent), "a long, b long")
    return keep(links.unionByName(met), "forest")

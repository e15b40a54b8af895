"""Tables in the folder that all executors share, and connected components over links."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in a local session without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def folder(spark: SparkSession) -> str:
    """The session's own folder in the shared one; it is deleted when the driver's process ends."""
    found = getattr(spark, "_tessera_folder", None)
    if found is None:
        found = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        spark._tessera_folder = found
        # A batch is what a Python worker holds at once; rows may hold long texts.
        if not spark.sparkContext.getConf().contains(_BATCH):
            spark.conf.set(_BATCH, str(8 << 20))

        def clean() -> None:
            try:
                _delete(spark, found)
            except Exception:  # the session's JVM has gone
                pass

        atexit.register(clean)
    return found


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``keep`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._tessera_path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives the memory it has freed back to the system when it ends; workers are used again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not the GNU C library

    return task


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """``df`` with ``rid``, a number of its own for each row, and whether it is another than ``key``.

    Where ``key`` is unique and never null it is the number itself; else rows are numbered and
    written, so that numbers stay.
    """
    if df.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).take(1):
        return keep(df.withColumn("rid", F.monotonically_increasing_id()), "rows"), True
    return df.withColumn("rid", F.col(key)), False


def by_name(out: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows (rid, component_id, ...) told by ``key``: adds it, and names each component by its smallest non-null key.

    kept: the first row of its component, by key (nulls last), then by number. A component
    without any key has a null component_id.
    """
    named = out.join(rows.select("rid", key), "rid")
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("name"), F.col("rid").alias("row")))
    heads = named.groupBy(F.col("component_id").alias("part")).agg(first.alias("h"))
    named = named.join(heads, named["component_id"] == heads["part"])
    return named.withColumn("kept", F.col("rid") == F.col("h.row")).withColumn("component_id", F.col("h.name")).drop("part", "h")


def reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id reachable) over the links a[i] - b[i]."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    low = np.arange(len(ids))
    while True:
        m = np.minimum(low[u], low[v])
        new = low.copy()
        for end in (u, v):
            np.minimum.at(new, end, m)
            np.minimum.at(new, low[end], m)
        new = new[new]
        if (new == low).all():
            return ids, ids[low]
        low = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, reduced to one per id; reduced again whenever a million have come."""
    held, n = [], 0
    for batch in batches:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        n += batch.num_rows
        if n > 1 << 20:
            held = [reach(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0])
    if held:
        u, v = reach(*(np.concatenate(x) for x in zip(*held)))
        on = u != v
        yield pa.RecordBatch.from_arrays([pa.array(u[on]), pa.array(v[on])], ["u", "v"])


def components(links: DataFrame, at_once: int = 2_000_000) -> DataFrame:
    """(id, component) of every linked id in ``links(a long, b long)``; component: the smallest id reachable.

    Each task first reduces its links to a spanning forest. Forests of at most ``at_once``
    links together (32 MB) are joined in one more such task; beyond that, large-star and small-star
    steps alternate (Kiveris et al., 2014) until the links no longer change. There, minima
    are written before they are joined back, so that both sides of the join are plain
    exchanges and a hub with many links can be split among tasks.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long"), "links")
    if edges.count() <= at_once:
        edges = keep(edges.coalesce(1).mapInArrow(_contract, "u long, v long"), "links")
    else:
        edges = _stars(edges)
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> DataFrame:
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large, "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            return edges
        state = tuple(row)

"""Streams of timed events: dedup, hourly windows, throttling.

Every stream takes event time from the rows and never the clock, so a bounded run
(``availableNow``) gives the batch twin's rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "7 days"


def read(spark: SparkSession, path: str, per_batch: int = 8) -> DataFrame:
    """A stream over a Parquet file, or the files of a folder; ``ts`` becomes an instant."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        stream, path = stream.option("pathGlobFilter", at.getName()), at.getParent().toString()
    rows = stream.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(rows: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """The first row of each key; keys are forgotten once they are ``late``."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def hourly(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key and hour."""
    return rows.groupBy(F.window("ts", "1 hour"), *keys).agg(F.count("*").alias("num_views"))


def sliding(rows: DataFrame, keys: list[str], length: str = "24 hours", step: str = "1 hour") -> DataFrame:
    """R6."""
    return rows.groupBy(F.window("ts", length, step), *keys).agg(F.count("*").alias("num_views"))


def throttle(rows: DataFrame, key: str, first_delay: int = 1, forget: int = 604_800, late: str = LATE) -> DataFrame:
    """Per key a delay that doubles, up to ``forget``, with every visit within it.

    Output per key and micro-batch: visits so far, the delay in seconds, and when it ends (epoch seconds). A key's state goes
    once the watermark has passed the end of its delay by ``forget`` seconds.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        visits, delay, end = state.get if state.exists else (0, 0, 0)
        times = sorted(t for b in batches for t in b["t"])
        for t in times:
            if visits and t > end + forget:
                visits, delay = 0, 0
            delay = min(delay * 2, forget) if visits and t <= end else first_delay
            visits, end = visits + 1, t + delay
        state.update((visits, delay, end))
        over = (end + forget) * 1000
        if over > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(over)
        else:
            state.remove()
        yield pd.DataFrame({key: [k[0]], "visits": [visits], "delay": [delay], "until": [end]})

    timed = rows.withWatermark("ts", late).select(key, "ts", F.unix_timestamp("ts").alias("t"))
    kind = dict(rows.dtypes)[key]
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, visits long, delay long, until long", "visits long, delay long, until long", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all there is, and returns its result table (for bounded runs and tests)."""
    name = f"drained_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A running append to a Parquet table, exactly once by its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).start()

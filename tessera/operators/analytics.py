"""Rollups, trends, ledgers and relational patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY, WEEK, MONTH, YEAR = 3600, 86_400, 604_800, 2_592_000, 31_536_000


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def bucket(seconds: Column, period: int) -> Column:
    """Start of the period that holds a time in epoch seconds."""
    return F.floor(seconds / period) * period


def rollup(events: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    """Views per key and period from raw events(t epoch seconds)."""
    return events.groupBy(*keys, bucket(F.col("t"), period).alias("bucket")).agg(F.count("*").alias("num_views"))


def cascade(rolled: DataFrame, keys: Sequence[str], period: int) -> DataFrame:
    """A coarser rollup from a finer one."""
    return rolled.groupBy(*keys, bucket(F.col("bucket"), period).alias("bucket")).agg(F.sum("num_views").alias("num_views"))


def look_back(rolled: DataFrame, keys: Sequence[str], now: int, period: int, buckets: int) -> DataFrame:
    """Sums over the last ``buckets`` whole periods before the one of ``now``, and that one."""
    start = now // period * period - period * (buckets - 1)
    return rolled.where((F.col("bucket") >= start) & (F.col("bucket") <= now)).groupBy(*keys).agg(F.sum("num_views").alias("num_views"))


def decayed(terms: DataFrame, keys: Sequence[str], now: int, most_hours: int = 24) -> DataFrame:
    """Sum of weight * occurrences / max(age in hours rounded up, 1), of what is at most ``most_hours`` old."""
    age = F.ceil((F.lit(now) - F.col("t")) / HOUR)
    fresh = terms.where((F.col("t") <= now) & (F.col("t") >= now - most_hours * HOUR))
    return fresh.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("occ") / F.greatest(age, F.lit(1))).alias("score"))


def top_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def latest(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Rows whose time is the latest of their key."""
    newest = rows.groupBy(*keys).agg(F.max(at).alias(at))
    return rows.join(newest, [*keys, at], "left_semi")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str) -> DataFrame:
    """Running balance."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum(amount).over(w))


def normalized(rows: DataFrame, weight: str, total: float) -> DataFrame:
    """Weights scaled to a total; the sum is one row, joined by broadcast."""
    whole = rows.agg(F.sum(weight).alias("whole"))
    return rows.join(F.broadcast(whole)).withColumn("normal", F.col(weight) * total / F.col("whole")).drop("whole")


def where(rows: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Conditions (column, comparison, value) joined by AND; comparisons as in the search forms."""
    for name, kind, value in conditions:
        c = F.col(name)
        text = str(value)
        low, high = value if isinstance(value, (tuple, list)) else (None, None)
        between = F.lit(True)
        if low is not None:
            between = between & (c >= low)
        if high is not None:
            between = between & (c <= high)
        rows = rows.where(
            {
                "=": lambda: c == value,
                "!=": lambda: c != value,
                "<": lambda: c < value,
                ">": lambda: c > value,
                "<=": lambda: c <= value,
                ">=": lambda: c >= value,
                "CONTAINS": lambda: F.contains(F.lower(c), F.lit(text.lower())),
                "BEGINS WITH": lambda: F.startswith(F.lower(c), F.lit(text.lower())),
                "ENDS WITH": lambda: F.endswith(F.lower(c), F.lit(text.lower())),
                "BETWEEN": lambda: between,
                "NOT_BETWEEN": lambda: ~between,
            }[kind]()
        )
    return rows


def page(rows: DataFrame, order: Sequence[Column | str], offset: int, most: int) -> DataFrame:
    """O5/S37."""
    return rows.orderBy(*order).offset(offset).limit(most)


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table with those new rows whose key it doesn't have."""
    return table.unionByName(new.dropDuplicates(list(keys)).join(table.select(*keys), list(keys), "left_anti"))


def within_quota(visits: DataFrame, key: str, quota: int) -> DataFrame:
    """Per key and hour, the first ``quota`` visits in order of time."""
    w = Window.partitionBy(key, bucket(F.col("t"), HOUR)).orderBy("t", "event_id")
    return visits.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= quota)


def slots(urls: DataFrame, delay: Column, spacing: int = 100) -> DataFrame:
    """Places in a fetch batch: the n-th url of a host waits n * ceil(delay / 5) * spacing places."""
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("weight"), "url")) - 1
    return urls.withColumn("slot", nth * F.ceil(delay / 5) * spacing)

"""The stored index that queries read.

``build`` tokenises a corpus once and writes

* ``postings``: (term, doc_id, tf, positions, doc_len, doc_index, generation) in folders by a
  hash of the term, sorted by term, so that a word's postings are one folder and few row groups;
* ``dictionary``: (term, num_docs, num_occ) laid out the same way;
* ``documents``: all columns of the corpus with doc_len, doc_index and generation, in folders
  ("shelves") of consecutive documents, so that the few rows of a result are found by pruning;
* ``totals``: one row.

What a query needs of a document's statistics stands in each posting, so matching and scoring are one
shuffle of the query words' postings and no join.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import index as I


#: Of the folders' layout.
VERSION = 1


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only in a local session without one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def kept(rows: DataFrame) -> DataFrame:
    """Rows written to the folder that executors share, until the driver's process ends."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/tessera-kept-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        except Exception:  # the session's JVM has gone
            pass

    atexit.register(clean)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        # One row: the totals of the corpus.
        row = spark.read.parquet(f"{path}/totals").first()
        self.docs, self.average, self.buckets = row["docs"], row["average"], row["buckets"]

    def _of(self, name: str, terms: Sequence[str]) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        places = self.spark.range(1).select(*[_bucket(F.lit(t), self.buckets) for t in terms]).first() if terms else ()
        return rows.where(F.col("bucket").isin(*set(places)) & F.col("term").isin(*terms)).drop("bucket")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """The postings of some words; folders and row groups of other words are not read."""
        return self._of("postings", list(dict.fromkeys(terms)))

    def dictionary(self, terms: Sequence[str] | None = None) -> DataFrame:
        """(term, num_docs, num_occ), of some words or of all."""
        return self.spark.read.parquet(f"{self.path}/dictionary").drop("bucket") if terms is None else self._of("dictionary", list(terms))

    def num_docs(self, terms: Sequence[str]) -> dict[str, int]:
        """Documents that have each word; one row a word comes to the driver."""
        found = {r["term"]: r["num_docs"] for r in self.dictionary(terms).collect()}
        return {t: found.get(t, 0) for t in terms}

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")

    def summaries(self, top: DataFrame) -> DataFrame:
        """The stored rows of ``top(doc_id, shelf, ...)``, a few ranked rows; other shelves are pruned."""
        return self.documents().join(F.broadcast(top), ["shelf", "doc_id"])


def build(corpus: DataFrame, path: str, per_generation: int = I.GENERATION, buckets: int | None = None, shelves: int = 1000) -> Index:
    """K1-K9: writes the index of ``corpus(doc_id, text, ...)`` and opens it."""
    spark = corpus.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or max(parts, 8)
    count = corpus.count()
    per_shelf = max(1000, -(-count // shelves))
    stats = I.doc_stats(corpus, per_generation)
    stored = corpus.join(stats, "doc_id").withColumn("shelf", F.floor(F.col("doc_index") / per_shelf).cast("int"))
    stored.repartitionByRange(parts, "shelf", "doc_id").sortWithinPartitions("shelf", "doc_id").write.partitionBy("shelf").parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    slim = docs.select("doc_id", "doc_len", "doc_index", "generation", "shelf", T.tokens(F.col("text")).alias("terms"))
    # Positions of a document's words are gathered within its row: nothing is shuffled but finished postings.
    each = slim.select("doc_id", "doc_len", "doc_index", "generation", "shelf", F.posexplode("terms").alias("pos", "term"))
    posts = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list(F.col("pos") + 1)).alias("positions"), *[F.first(c).alias(c) for c in ("doc_len", "doc_index", "generation", "shelf")])
    posts = posts.withColumn("bucket", _bucket(F.col("term"), buckets))
    posts.repartition(parts, "bucket").sortWithinPartitions("bucket", "term", "doc_index").write.partitionBy("bucket").parquet(f"{path}/postings")
    words = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.count("*").alias("num_docs"), F.sum("tf").alias("num_occ"))
    words.repartition(parts, "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/dictionary")
    totals = docs.agg(F.count("*").alias("docs"), F.coalesce(F.avg("doc_len"), F.lit(0.0)).alias("average")).withColumn("buckets", F.lit(buckets))
    totals.write.parquet(f"{path}/totals")
    return Index(spark, path)


def append(index: Index, more: DataFrame, path: str) -> Index:
    """K2: the index of a corpus with further documents, whose doc indexes follow those it has."""
    old = index.documents()
    names = [c for c in old.columns if c not in ("doc_len", "doc_index", "generation", "shelf")]
    return build(old.select(*names).unionByName(more.select(*names)), path)


def opened(spark: SparkSession, key: str, corpus: Callable[[], DataFrame]) -> Index:
    """The session's index of a named corpus, built at first use."""
    known = getattr(spark, "_tessera_indexes", None)
    if known is None:
        known = spark._tessera_indexes = {}
    if key not in known:
        known[key] = build(corpus(), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return known[key]

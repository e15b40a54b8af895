"""Inverted index tables.

corpus(doc_id, text, ...) -> tokens -> postings; every table is a plain DataFrame that can
be written partitioned by generation and read with term predicates pushed down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

GENERATION = 10_000


def tokens(corpus: DataFrame) -> DataFrame:
    """(doc_id, lang, pos from 1, term)."""
    return corpus.select("doc_id", "lang", F.posexplode(T.tokens(F.col("text"))).alias("p", "term")).select("doc_id", "lang", (F.col("p") + 1).alias("pos"), "term")


def postings(toks: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions ascending)."""
    return toks.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def postings_of(corpus: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of some terms only; the filter runs before the explode and the shuffle."""
    words = F.filter(F.transform(T.tokens(F.col("text")), lambda t, i: F.struct((i + 1).alias("pos"), t.alias("term"))), lambda x: x["term"].isin(*terms))
    found = corpus.select("doc_id", F.explode(words).alias("t")).select("doc_id", "t.term", "t.pos")
    return postings(found)


def term_frequencies(toks: DataFrame) -> DataFrame:
    """A5."""
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def dictionary(toks: DataFrame) -> DataFrame:
    """(term, num_docs, num_occ), by two partial counts instead of a distinct."""
    return term_frequencies(toks).groupBy("term").agg(F.count("*").alias("num_docs"), F.sum("tf").alias("num_occ"))


def bands(rows: DataFrame, name: str, count: int) -> DataFrame:
    """``rows`` with ``band``, from 0: ranges of the column ``name`` of about equal numbers of rows, nulls first.

    The bounds are one row of ``count`` quantiles, joined by broadcast; equal values share a band.
    """
    cuts = [i / count for i in range(1, count)] or [0.5]
    bounds = rows.agg(F.percentile_approx(name, F.array(*map(F.lit, cuts)), F.lit(100 * count)).alias("bounds"))
    band = F.coalesce(F.size(F.filter("bounds", lambda b: b <= F.col(name))), F.lit(0))
    return rows.join(F.broadcast(bounds)).withColumn("band", band).drop("bounds")


def doc_stats(corpus: DataFrame, generation: int = GENERATION, count: int | None = None) -> DataFrame:
    """(doc_id, doc_len, doc_index, generation); doc_index counts documents by doc_id.

    Documents are ranked within bands of doc_ids of about equal size, as many as there are shuffle
    partitions, and the bands' counts are added up: whatever the doc_ids, no task sees all of them.
    """
    count = count or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = corpus.select("doc_id", F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)).alias("doc_len"))
    placed = bands(sized, "doc_id", count)
    inside = F.row_number().over(Window.partitionBy("band").orderBy("doc_id")) - 1
    before = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # one row a band
    counts = bands(corpus.select("doc_id"), "doc_id", count).groupBy("band").agg(F.count("*").alias("n"))
    counts = counts.select("band", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = placed.withColumn("inside", inside).join(F.broadcast(counts), "band")
    index = F.col("before") + F.col("inside")
    return out.select("doc_id", "doc_len", index.alias("doc_index"), F.floor(index / generation).alias("generation"))


def shard_stats(stats: DataFrame) -> DataFrame:
    """Counters of each generation."""
    return stats.groupBy("generation").agg(F.count("*").alias("num_docs"), F.sum("doc_len").alias("len_all_docs"))


def discounted_num_docs(by_generation: DataFrame) -> DataFrame:
    """Sum of num_docs / max(generation + 1, i) over a term's generations, i from 1."""
    i = F.row_number().over(Window.partitionBy("term").orderBy("generation"))
    part = F.col("num_docs") / F.greatest(F.col("generation") + 1, i)
    return by_generation.withColumn("part", part).groupBy("term").agg(F.sum("part").alias("discounted"))

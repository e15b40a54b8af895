"""A training-corpus pipeline: each stage takes the documents its predecessor kept.

language ID (rejected documents go) -> MinHash near-dedup (one document of a group stays) ->
suffix-array dedup (repeated passages are cut out) -> mixing (documents are taken 0 to 3
times) -> SentencePiece ids.

Stages decide by row: rows that share a doc_id, or have none, are documents of their own. Null and
empty texts and texts without a letter are rejected by the first stage; null langs teach it nothing, and null
sources are a source of their own. An empty table gives an empty table at every stage, and extra
columns of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, minhash, mixing, sentencepiece_io, suffix_dedup
from tessera.llm.shared import keep, numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with a row number, and the same under that number in place of their doc_id."""
    rows = numbered(docs.select(*COLUMNS), "doc_id")[0]
    return rows, rows.withColumn("doc_id", F.col("rid")).drop("rid")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language the models recognise; they learn from all labelled ones."""
    docs = docs.select(*COLUMNS)
    return langid.recognised(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, similarity 0.8).

    It is the one of the smallest doc_id, or of the smallest row number where doc_ids are not unique.
    """
    rows, by_row = _rows(docs)
    kept = minhash.near_duplicates(by_row, k=5, percent=80).where("kept").select(F.col("doc_id").alias("rid"))
    return rows.join(kept, "rid", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what 200-byte strings that occur elsewhere cover; documents left without text go."""
    rows, by_row = _rows(docs)
    cut = suffix_dedup.remove_repeats(by_row, with_text=True).where("n_removed > 0").select(F.col("doc_id").alias("rid"), "kept_text")
    out = rows.join(cut, "rid", "left").withColumn("text", F.coalesce("kept_text", "text"))
    return out.where("kept_text is null or trim(kept_text) <> ''").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks for."""
    rows, by_row = _rows(docs)
    copies = mixing.mix(by_row).where("copies > 0").select(F.col("doc_id").alias("rid"), "copies")
    return rows.join(copies, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document taken."""
    import public_tokenizers

    out = sentencepiece_io.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", "ids_crc32", "round_trip", "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("cut_repeats", cut_repeats), ("mix_sources", mix_sources), ("encode", encode)]

#: No stage but the mix's sizes can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

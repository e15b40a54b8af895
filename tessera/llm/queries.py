"""The registered queries of this folder: opN_<name>(spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, hnsw, langid, minhash, mixing, sentencepiece_io, suffix_dedup, tokenbin, topk_search, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0).select("query_id", "rank", "vec_id", "score")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.fold(F.col("doc_id"), 5) != 0))
    out = langid.identify(docs, model).withColumn("held_out", langid.fold(F.col("doc_id"), 5) == 0)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected", "entropy")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(langid.fold(F.col("doc_id"), 3) != 1)
    out = toxicity.score(docs, toxicity.train(docs, labels)).withColumn("held_out", langid.fold(F.col("doc_id"), 3) == 1)
    return out.select("doc_id", "held_out", "score", "predicted")


def op6_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_io.encode_documents(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), with_ids=False)


def op9_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokenbin.token_files(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_topk_search": op1_exact_topk_search,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece_coding": op6_sentencepiece_coding,
    "op7_chat_formatting": op7_chat_formatting,
    "op9_token_binary_output": op9_token_binary_output,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
}

_LINKS = """link(a, b) AS ({links}),
reach(id, root) AS (SELECT DISTINCT a, a FROM link UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.id),
part AS (SELECT id, min(root) AS low FROM reach GROUP BY 1)"""

_TOP = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

# Bytes are told as pairs of hexadecimal digits.
_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
c AS (SELECT doc_id, b, substring(h, 2 * b + 1, 1422) AS p FROM (SELECT doc_id, h, unnest(range(0, n - 199, 512)) AS b FROM d)),
w AS (SELECT doc_id, b + i AS i, md5_number(substring(p, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, b, p, unnest(range(0, least(length(p) // 2 - 199, 512))) AS i FROM c)),
again AS (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS head FROM w JOIN again USING (k)),
island AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM island GROUP BY 1),
edge AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM island UNION ALL SELECT doc_id, max(b), max(n) FROM island JOIN d USING (doc_id) GROUP BY 1),
rest AS (SELECT doc_id, string_agg(substring(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS h FROM edge JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)"""

_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS gs FROM w),
size AS (SELECT doc_id, len(gs) AS n FROM g), one AS (SELECT doc_id, unnest(gs) AS s FROM g),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM one x JOIN one y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
""" + _LINKS.format(links="SELECT a, b FROM both_ JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)") + """
SELECT doc_id, n AS n_shingles, coalesce(low, doc_id) AS component_id, coalesce(low, doc_id) = doc_id AS kept FROM size LEFT JOIN part ON id = doc_id"""

_COSINE = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
""" + _LINKS.format(links="SELECT x.vec_id, y.vec_id FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95") + """,
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN part ON part.id = vec_id"""

#: Models, tokenizers, repairs and roundings can't be told in SQL; tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk_search": _TOP,
    "op2_suffix_array_dedup": _REPEATS,
    "op8_minhash_near_dedup": _NEAR,
    "op10_embedding_near_dedup": _COSINE,
}

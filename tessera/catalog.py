"""The engine's registered queries over the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import codecs as C
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.functions.sheet import cell, range_aggregate
from tessera.functions.stem import stem_terms
from tessera.functions.wiki import to_html
from tessera.operators import analytics as A
from tessera.operators import index as I
from tessera.operators import learn as L
from tessera.operators import recommend as R
from tessera.operators import scoring as S
from tessera.operators.store import Index, opened
from tessera.operators.rules import apply_rules, word_filter as filter_words
from tessera.operators.summarize import summarize
from tessera.plans import search as P
from tessera.plans.parser import Conjunct, mix, parse
from tessera.sources import pages as H
from tessera.streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its timestamps are read as instants in UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, k in df.dtypes if k == "timestamp_ntz"})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Shared SQL: tokens with places, and URL parts.
TOKS = r"""toks AS (SELECT doc_id, lang, source, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM documents),
tok AS (SELECT doc_id, lang, source, unnest(ts) AS term, unnest(range(1, len(ts) + 1)) AS pos FROM toks)"""
STATS = r""", st AS (SELECT doc_id, len(ts) AS doc_len, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM toks),
dstat AS (SELECT doc_id, doc_len, doc_index, floor(doc_index / 10000)::BIGINT AS generation FROM st)"""
HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
PATH = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
EDGES = r"edges AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages)"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out anew if it has fewer splits than there are cores; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def index(spark: SparkSession, d: str, source: str | None = None) -> Index:
    """The session's stored index of the documents, or of one source's."""
    rows = lambda: docs(spark, d) if source is None else docs(spark, d).where(F.col("source") == source)
    return opened(spark, f"{d}/documents/{source}", rows)


def toks(spark: SparkSession, d: str) -> DataFrame:
    return I.tokens(docs(spark, d))


# Index tables


def index_postings(spark, d):
    """All postings of the stored index."""
    return spark.read.parquet(f"{index(spark, d).path}/postings")


@query(with_(TOKS) + "SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2")
def tok_tf(spark, d):
    return index_postings(spark, d).select("doc_id", "term", "tf")


@query(with_(TOKS) + "SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY 1, 2")
def tok_positions(spark, d):
    return I.postings(toks(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(with_(TOKS) + "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(term) - 5 + 2, 2)), lambda i: substring(term, i, 5))) AS gram FROM tok) GROUP BY 1")
def char_ngrams(spark, d):
    return toks(spark, d).select(F.explode(T.char_ngrams(F.col("term"), 5)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(with_(TOKS) + "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(ts), 1)), lambda i: ts[i] || ' ' || ts[i + 1])) AS gram FROM toks) GROUP BY 1")
def word_bigrams(spark, d):
    terms = docs(spark, d).select(T.tokens(F.col("text")).alias("terms"))  # once a text, not once a gram
    grams = terms.select(F.explode(T.word_ngrams(F.col("terms"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query(with_(TOKS) + "SELECT term, count(DISTINCT doc_id) AS num_docs, count(*) AS num_occ FROM tok GROUP BY 1")
def dictionary_df(spark, d):
    return index(spark, d).dictionary()


@query("WITH " + TOKS + STATS + " SELECT doc_id, doc_len, doc_index, generation FROM dstat")
def doc_stats(spark, d):
    return docs_stored(spark, d)


@query("WITH " + TOKS + STATS + " SELECT floor(doc_index / 100)::BIGINT AS generation, count(*) AS num_docs, sum(doc_len)::BIGINT AS len_all_docs FROM dstat GROUP BY 1")
def shard_stats(spark, d):
    return I.shard_stats(I.doc_stats(docs(spark, d), 100))


@query("WITH " + TOKS + STATS + """, g AS (SELECT term, floor(doc_index / 100)::BIGINT AS gen, count(DISTINCT doc_id) AS nd FROM tok JOIN dstat USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY gen) AS i FROM g) SELECT term, round(sum(nd / greatest(gen + 1, i)), 6) AS discounted FROM r GROUP BY 1""")
def discounted_docs(spark, d):
    tf = index_postings(spark, d).select("term", F.floor(F.col("doc_index") / 100).alias("generation"))
    return I.discounted_num_docs(tf.groupBy("term", "generation").agg(F.count("*").alias("num_docs"))).withColumn("discounted", F.round("discounted", 6))


# Boolean search

_HAS = "(SELECT DISTINCT doc_id FROM tok WHERE term = '{}')"


@query(with_(TOKS) + f"SELECT doc_id FROM {_HAS.format('the')} JOIN {_HAS.format('and')} USING (doc_id)")
def q_and(spark, d):
    return P.matches(index(spark, d), Conjunct(terms=("the", "and"))).select("doc_id")


@query(with_(TOKS) + "SELECT DISTINCT doc_id FROM tok WHERE term IN ('der', 'les')")
def q_or(spark, d):
    q = parse("der | les", guesses=False)
    parts = [P.matches(index(spark, d), c).select("doc_id") for c in q.blocks[0].disjuncts]
    return parts[0].unionByName(parts[1]).distinct()


@query(with_(TOKS) + f"SELECT doc_id FROM documents WHERE doc_id NOT IN {_HAS.format('the')}")
def q_not(spark, d):
    return P.matches(index(spark, d), Conjunct(without=("the",))).select("doc_id")


@query(with_(TOKS) + f"SELECT doc_id FROM {_HAS.format('and')} WHERE doc_id NOT IN {_HAS.format('thing')}")
def q_and_not(spark, d):
    return P.matches(index(spark, d), parse("and -thing").blocks[0].disjuncts[0]).select("doc_id")


@query(with_(TOKS) + "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the'")
def q_phrase(spark, d):
    return P.matches(index(spark, d), parse('"of the"').blocks[0].disjuncts[0]).select("doc_id")


@query(with_(TOKS) + "SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos >= a.pos + 2 WHERE a.term = 'of' AND b.term = 'en'")
def q_phrase_gap(spark, d):
    return P.matches(index(spark, d), parse('"of * en"').blocks[0].disjuncts[0]).select("doc_id")


@query(with_(TOKS) + f"SELECT doc_id FROM {_HAS.format('de')} JOIN documents USING (doc_id) WHERE lang = 'fr'")
def q_meta_lang(spark, d):
    return P.matches(index(spark, d), parse("de lang:fr").blocks[0].disjuncts[0]).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE floor(n_chars / 5000) * 5000 = 5000")
def q_meta_size(spark, d):
    x = docs(spark, d)
    return P.conjunct_docs(x, parse("size:5000").blocks[0].disjuncts[0]).join(x.select("doc_id", "n_chars"), "doc_id")


@query("SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05'")
def q_meta_date(spark, d):
    return table(spark, d, "events").where(P.field_condition("date", "2024-01-05", [])).select("event_id")


@query(f"SELECT page_id FROM pages WHERE {HOST} = 'example.com' OR {HOST} LIKE '%.example.com'")
def q_meta_site(spark, d):
    return table(spark, d, "pages").where(P.field_condition("site", "example.com", [])).select("page_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC")
def q_scan_all_desc(spark, d):
    return P.conjunct_docs(docs(spark, d), Conjunct()).orderBy(F.desc("doc_id"))


@query("SELECT doc_id, 'a' AS part FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, 'b' FROM documents WHERE source = 'src2'")
def q_disjoint_merge(spark, d):
    x = docs(spark, d)
    return x.where("source = 'src1'").select("doc_id", F.lit("a").alias("part")).unionByName(x.where("source = 'src2'").select("doc_id", F.lit("b").alias("part"))).orderBy("doc_id")


# Scoring


_BM = "0.5 * ln(({n} - {df} + 0.5) / ({df} + 0.5)) * 3 * {occ} / ({occ} + 0.5 + 1.5 * {len} / {avg}) * {w}"


def _search_sql(blocks: list[tuple[int, list[tuple[list[str], str, str, str, float]]]], most: int) -> str:
    """SQL of a ranked search: blocks of (results, [(words, condition on postings, condition on documents, corpus, weight)])."""
    parts = [TOKS.replace("\n", " ")]
    tops = []
    for b, (n, disjuncts) in enumerate(blocks):
        rows = []
        for i, (words, also, where, corpus, weight) in enumerate(disjuncts):
            k = f"{b}_{i}"
            terms = ", ".join(f"'{w}'" for w in words)
            last = ", ".join(f"max(CASE WHEN term = '{w}' THEN pos END) OVER w AS l{j}" for j, w in enumerate(words))
            left = "least(" + ", ".join(f"l{j}" for j in range(len(words))) + ")" if len(words) > 1 else "l0"
            whole = " AND ".join(f"l{j} IS NOT NULL" for j in range(len(words)))
            parts += [
                f"st{k} AS (SELECT doc_id, len(ts) AS doc_len, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM toks JOIN documents USING (doc_id) WHERE {corpus})",
                f"tot{k} AS (SELECT count(*) AS n, avg(doc_len) AS av FROM st{k})",
                f"t{k} AS (SELECT tok.doc_id, term, pos FROM tok JOIN st{k} USING (doc_id) WHERE term IN ({terms}))",
                f"p{k} AS (SELECT doc_id, term, count(*) AS tf, count(*) FILTER (pos <= 50)::DOUBLE AS ti FROM t{k} GROUP BY 1, 2)",
                f"df{k} AS (SELECT term, count(*) AS df FROM p{k} GROUP BY 1)",
                f"r{k} AS (SELECT doc_id, count(*) AS words, sum(" + _BM.format(n="n", df="df", occ="ti", len="50.0", avg="50.0", w="4") + " + " + _BM.format(n="n", df="df", occ="(tf - ti)", len="greatest(doc_len - 50, 1)", avg="greatest(av - 50, 1.0)", w="1") + f") AS rel FROM p{k} JOIN df{k} USING (term) JOIN st{k} USING (doc_id), tot{k} GROUP BY 1)",
                f"c{k} AS (SELECT doc_id, pos, CASE WHEN {whole} THEN {left} END AS l FROM (SELECT doc_id, pos, {last} FROM t{k} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)))",
                f"x{k} AS (SELECT doc_id, sum(CASE WHEN pos < 50 THEN 4.0 ELSE 1.0 END / (pos - l + 1)) AS prox FROM (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c{k}) WHERE l IS NOT NULL AND (before IS NULL OR l > before) GROUP BY 1)",
            ]
            prox = "coalesce(prox, 0)" if len(words) > 1 else "1.0"
            rows.append(f"SELECT doc_id, {i} AS branch, round((10 - log10(doc_index + 1 + 250000 * floor(doc_index / 10000))) * {weight}, 9) AS a, round(rel * {weight}, 9) AS r, round({prox} * {weight}, 9) AS p FROM r{k} JOIN st{k} USING (doc_id) LEFT JOIN x{k} USING (doc_id) JOIN documents USING (doc_id) WHERE words = {len(words)} AND {where} AND {also}")
        parts.append(f"u{b} AS (" + " UNION ALL ".join(rows) + ")")
        parts.append(f"m{b} AS (SELECT doc_id, arg_max(a, branch) AS a, arg_max(r, branch) AS r, arg_max(p, branch) AS p FROM u{b} GROUP BY 1)")
        ranks = " + ".join(f"200.0 / (58 + dense_rank() OVER (ORDER BY {c} DESC))" for c in "arp")
        parts.append(f"f{b} AS (SELECT {b} AS block, doc_id, {ranks} AS score, a AS doc_rank, r AS relevance, p AS proximity FROM m{b} ORDER BY score DESC, doc_id LIMIT {n})")
        tops.append(f"SELECT * FROM f{b}")
    parts.append("top AS (SELECT *, row_number() OVER (ORDER BY block, score DESC, doc_id)::INTEGER AS rank FROM (" + " UNION ALL ".join(tops) + f") QUALIFY rank <= {most})")
    return "WITH " + ", ".join(parts)


_PHRASE = "doc_id IN (SELECT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the')"
_NO_THING = "doc_id NOT IN (SELECT doc_id FROM tok WHERE term = 'thing')"


def docs_stored(spark, d):
    return index(spark, d).documents().select("doc_id", "doc_len", "doc_index", "generation")


_REL = "WITH " + TOKS + STATS + """, p AS (SELECT doc_id, term, count(*) AS tf, count(*) FILTER (pos <= 50)::DOUBLE AS ti FROM tok WHERE term IN ({terms}) GROUP BY 1, 2),
df0 AS (SELECT term, count(*) AS df FROM p GROUP BY 1), tot AS (SELECT count(*) AS n, avg(doc_len) AS av FROM dstat),
df AS (SELECT term, CASE WHEN df > n THEN 0.5 * n ELSE df END AS df FROM df0, tot),
rel AS (SELECT p.doc_id, p.term, """ + _BM.format(n="n", df="df", occ="ti", len="50.0", avg="50.0", w="4") + " + " + _BM.format(n="n", df="df", occ="(tf - ti)", len="greatest(doc_len - 50, 1)", avg="greatest(av - 50, 1.0)", w="1") + " AS r FROM p JOIN df USING (term) JOIN dstat USING (doc_id), tot)"


@query(_REL.replace("{terms}", "'the', 'thing'") + " SELECT doc_id, term, round(r, 6) AS relevance FROM rel")
def score_bm25f(spark, d):
    posts = index(spark, d).postings(["the", "thing"])
    return S.relevance(posts, docs_stored(spark, d)).withColumn("relevance", F.round("relevance", 6))


@query("WITH " + TOKS + STATS + " SELECT doc_id, round(10 - log10(doc_index + 1 + 25 * 100 * floor(doc_index / 100)), 6) AS doc_rank FROM dstat")
def score_docrank(spark, d):
    s = I.doc_stats(docs(spark, d), 100)
    return s.select("doc_id", F.round(S.doc_rank(F.col("doc_index"), F.col("generation"), 100), 6).alias("doc_rank"))


@query(_search_sql([(1 << 40, [(["the", "and"], "true", "true", "true", 1.0)])], 1 << 40) + " SELECT doc_id, round(proximity, 6) AS proximity FROM top")
def score_proximity(spark, d):
    return P.conjunct_scores(index(spark, d), Conjunct(terms=("the", "and"))).select("doc_id", F.round("proximity", 6).alias("proximity"))


_FUSED = _REL.replace("{terms}", "'the'") + """, m AS (SELECT doc_id, round(10 - log10(doc_index + 1 + 250000 * generation), 9) AS a, round(r, 9) AS b FROM rel JOIN dstat USING (doc_id)),
f AS (SELECT doc_id, 300.0 / (58 + dense_rank() OVER (ORDER BY a DESC)) + 300.0 / (58 + dense_rank() OVER (ORDER BY b DESC)) AS s FROM m)"""


@query(_FUSED + " SELECT doc_id, round(s, 6) AS score FROM f")
def rank_fusion(spark, d):
    rows = P.conjunct_scores(index(spark, d), Conjunct(terms=("the",)))
    rows = rows.withColumns({c: F.round(c, 9) for c in ("doc_rank", "relevance")})
    return S.fuse(rows, ("doc_rank", "relevance"), rows=index(spark, d).num_docs(["the"])["the"]).select("doc_id", F.round("score", 6).alias("score"))


@query(_FUSED + " SELECT doc_id, round(s, 6) AS score, lang, source FROM f JOIN documents USING (doc_id) ORDER BY round(s, 6) DESC, doc_id LIMIT 10")
def topk_materialize(spark, d):
    top = rank_fusion(spark, d).orderBy(F.desc("score"), "doc_id").limit(10)
    shelf = index(spark, d).documents().select("doc_id", "shelf").join(F.broadcast(top), "doc_id")
    return index(spark, d).summaries(shelf).select("doc_id", "score", "lang", "source")


_SNIPPET = r"regexp_extract_all(text, '(?is).{0,20}\b(?:{words})\b.{0,40}')"


@query(_search_sql([(20, [(["and", "of", "the"], _PHRASE + " AND " + _NO_THING, "lang = 'en'", "true", 1.0)])], 20) + r""" SELECT doc_id, lang, source, array_to_string(list_transform((SNIP)[1:3], lambda x: trim(x)), ' ... ') AS snippet,
rank, round(score, 6) AS score, round(doc_rank, 6) AS doc_rank, round(relevance, 6) AS relevance, round(proximity, 6) AS proximity FROM top JOIN documents USING (doc_id)""".replace("SNIP", _SNIPPET.replace("{words}", "and|of|the")))
def search_ranked(spark, d):
    out = P.search(index(spark, d), '"of the" and lang:en -thing', most=20)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "doc_rank", "relevance", "proximity")})


@query(_search_sql([(3, [(["der"], "true", "true", "true", 1.0), (["die"], "true", "true", "true", 1.0)]), (2, [(["les"], "true", "true", "true", 1.0)])], 10) + " SELECT rank, doc_id, round(score, 6) AS score FROM top")
def q_blocks(spark, d):
    return P.search(index(spark, d), "#3# der | die #2# les", most=10).select("rank", "doc_id", F.round("score", 6).alias("score"))


@query(_search_sql([(5, [(["the"], "true", "true", "documents.source = 'src1'", 1.0), (["the"], "true", "true", "documents.source = 'src2'", 0.5)])], 5) + " SELECT rank, doc_id, round(score, 6) AS score FROM top")
def q_mix_weighted(spark, d):
    corpora = {None: index(spark, d), "a": index(spark, d, "src1"), "b": index(spark, d, "src2")}
    return P.search(corpora, mix("the", [(5, [("a", 1.0, ""), ("b", 0.5, "")])]), most=5).select("rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH i AS (SELECT page_id, md5({HOST}) AS h, md5({HOST} || ({PATH})) AS u, (page_id % 7)::DOUBLE AS rank, (page_id % 5)::DOUBLE AS rel, (page_id % 3)::DOUBLE AS prox, md5(html) AS c FROM pages),
k AS (SELECT *, row_number() OVER (PARTITION BY u, h ORDER BY rank DESC, page_id) - 1 AS k FROM i), a AS (SELECT *, pow(0.5, k) * CASE WHEN u = h THEN 2 ELSE 1 END AS al FROM k),
g AS (SELECT u, sum(al * rank) AS rank, sum(al * rel) AS rel, max(prox) AS prox, min(c) AS c FROM a GROUP BY 1)
SELECT c AS hash, round(sum(rank), 6) AS rank, round(sum(rel), 6) AS relevance, max(prox) AS proximity FROM g GROUP BY 1""")
def group_by_url(spark, d):
    u, h = F.col("url"), U.host_name(F.col("url"))
    n = F.col("page_id")
    items = table(spark, d, "pages").select(n.alias("item_id"), F.md5(h.cast("binary")).alias("host_hash"), F.md5(F.concat(h, U.path(u)).cast("binary")).alias("url_hash"), (n % 7).cast("double").alias("rank"), (n % 5).cast("double").alias("relevance"), (n % 3).cast("double").alias("proximity"), F.md5(F.col("html").cast("binary")).alias("hash"))
    out = S.group_by_url(items)
    return out.select("hash", F.round("rank", 6).alias("rank"), F.round("relevance", 6).alias("relevance"), "proximity")


@query("SELECT md5(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_hash(spark, d):
    return docs(spark, d).groupBy(F.md5(F.col("text").cast("binary")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(with_(TOKS) + "SELECT doc_id, rank, term FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank FROM tok GROUP BY 1, 2) WHERE rank <= 3")
def related_terms(spark, d):
    return A.top_per(tok_tf(spark, d), ["doc_id"], [F.desc("tf"), F.col("term")], 3).select("doc_id", "rank", "term")


@query()
def snippet(spark, d):
    return docs(spark, d).select("doc_id", T.snippet(F.col("text"), ["the", "der"]).alias("snippet"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\b(der|the)\b', '<b>\1</b>', 'gi')) AS bold FROM documents WHERE lang = 'en'")
def bold(spark, d):
    # Whole words are told by ASCII letters in both engines.
    return docs(spark, d).where("lang = 'en'").select("doc_id", F.md5(T.bold(F.col("text"), ["the", "der"]).cast("binary")).alias("bold"))


@query(r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+|\n\s*\n', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS n FROM documents")
def sentence_split(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.sentences(F.col("text"))).alias("n"))


@query(with_(TOKS) + "SELECT doc_id, count(*) AS n FROM tok WHERE term NOT IN ('the', 'and', 'of', 'der', 'die', 'les', 'de') GROUP BY 1")
def stop_words_removed(spark, d):
    kept = T.without_stop_words(T.tokens(F.col("text")), ["the", "and", "of", "der", "die", "les", "de"])
    return docs(spark, d).select("doc_id", F.size(kept).cast("long").alias("n")).where("n > 0")


STOPS = {"de": ("der", "die", "und", "das"), "en": ("the", "and", "of", "in"), "es": ("el", "los", "que", "en"), "fr": ("les", "et", "la", "des")}


@query(with_(TOKS) + ", s(l, w) AS (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in STOPS.items() for w in ws) + "), c AS (SELECT doc_id, l, count(*) AS n FROM tok JOIN s ON term = w GROUP BY 1, 2) SELECT doc_id, arg_min(l, (-n, l)) AS guess FROM c GROUP BY 1")
def lang_guess(spark, d):
    counts = [F.size(F.filter(T.tokens(F.col("text")), (lambda ws: lambda t: t.isin(*ws))(ws))).alias(k) for k, ws in STOPS.items()]
    rows = docs(spark, d).select("doc_id", *counts)
    best = F.array_min(F.array(*[F.struct((-F.col(k)).alias("n"), F.lit(k).alias("l")) for k in sorted(STOPS)]))
    return rows.withColumn("b", best).where("b.n < 0").select("doc_id", F.col("b.l").alias("guess"))


UNSAFE = ("thing", "thein", "heat")


@query(with_(TOKS) + f"SELECT doc_id, round(count(DISTINCT term) FILTER (term IN {UNSAFE}) * count(*) FILTER (term IN {UNSAFE}) / (count(*) + 1), 6) AS score, count(DISTINCT term) FILTER (term IN {UNSAFE}) * count(*) FILTER (term IN {UNSAFE}) / (count(*) + 1) >= 0.012 AS unsafe FROM tok GROUP BY 1")
def safe_score(spark, d):
    terms = T.tokens(F.col("text"))
    bad = F.filter("terms", lambda t: t.isin(*UNSAFE))
    rows = docs(spark, d).select("doc_id", terms.alias("terms")).where(F.size("terms") > 0)
    score = F.size(F.array_distinct(bad)) * F.size(bad) / (F.size("terms") + 1)
    return rows.select("doc_id", F.round(score, 6).alias("score"), (score >= 0.012).alias("unsafe"))


# URLs, links, pages

@query(f"SELECT page_id, {HOST} AS host, {PATH} AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", U.host_name(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.fragment(u).alias("fragment"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS h, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS ps FROM pages)
SELECT page_id, unnest(list_concat([h], list_transform(range(1, len(ps) + 1), lambda n: h || '/' || array_to_string(ps[1:n], '/')))) AS prefix FROM p""")
def url_host_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.host_paths(F.col("url"))).alias("prefix"))


@query(f"WITH p AS (SELECT page_id, string_split({HOST}, '.') AS ps FROM pages) SELECT page_id, unnest(list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[i:len(ps)], '.'))) AS suffix FROM p")
def url_subdomains(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(U.subdomains(F.col("url"))).alias("suffix"))


@query(f"WITH p AS (SELECT page_id, string_split({HOST}, '.') AS ps FROM pages) SELECT page_id, array_to_string(ps[greatest(len(ps) - CASE WHEN len(ps) >= 3 AND length(ps[len(ps)]) = 2 AND length(ps[len(ps) - 1]) <= 3 THEN 2 ELSE 1 END, 1):len(ps)], '.') AS cld FROM p")
def url_cld(spark, d):
    return table(spark, d, "pages").select("page_id", U.company_domain(F.col("url")).alias("cld"))


@query(f"SELECT page_id, CASE WHEN regexp_extract({PATH}, '[^/][.]([A-Za-z0-9]+)$', 1) = '' THEN 'html' ELSE lower(regexp_extract({PATH}, '[^/][.]([A-Za-z0-9]+)$', 1)) END AS ext FROM pages")
def url_ext(spark, d):
    return table(spark, d, "pages").select("page_id", U.extension(F.col("url")).alias("ext"))


def edges(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", "url", F.explode(links).alias("link"))


@query(with_(EDGES) + "SELECT page_id, link, count(*) AS n FROM edges GROUP BY 1, 2")
def link_edges(spark, d):
    return edges(spark, d).groupBy("page_id", "link").agg(F.count("*").alias("n"))


#: The parts of a joined path are walked from the last to the first: a part stays if no ".." after it takes it away.
_RESOLVED = with_(EDGES) + r""", l AS (SELECT DISTINCT page_id, url, link, regexp_replace(link, '#.*$', '') AS rest, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root, {path} AS p FROM edges),
j AS (SELECT *, CASE WHEN starts_with(rest, '/') THEN rest ELSE regexp_replace(p, '[^/]*$', '') || rest END AS joined FROM l),
k AS (SELECT *, list_filter(string_split(joined, '/'), lambda x: x <> '' AND x <> '.') AS ps FROM j),
f AS (SELECT *, list_reduce(list_concat(['|'], list_transform(ps, lambda x: replace(x, '|', chr(1)))), lambda a, x: CASE WHEN a IS NULL THEN NULL WHEN x <> '..' THEN a || x || '|' WHEN a = '|' THEN NULL ELSE regexp_replace(a, '[^|]*[|]$', '') END) AS st FROM k)
SELECT page_id, link, CASE WHEN regexp_matches(rest, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN rest WHEN starts_with(rest, '//') THEN lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || ':' || rest
  WHEN st IS NULL THEN NULL ELSE root || '/' || replace(replace(trim(st, '|'), '|', '/'), chr(1), '|') || CASE WHEN ends_with(joined, '/') AND st <> '|' THEN '/' ELSE '' END END AS target FROM f""".replace("{path}", PATH)


@query(_RESOLVED)
def canonical_links(spark, d):
    e = edges(spark, d).distinct()
    return e.select("page_id", "link", U.resolve(F.col("link"), F.col("url")).alias("target"))


@query(with_(EDGES) + "SELECT page_id, count(*) AS n, count(DISTINCT link) AS distinct_links FROM edges GROUP BY 1")
def outdegree(spark, d):
    return edges(spark, d).groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("link").alias("distinct_links"))


@query(with_(EDGES) + ", x AS (SELECT page_id, link, count(*) OVER (PARTITION BY page_id) AS n FROM edges) SELECT link, sum(floor(100 / (2 * n)))::BIGINT AS weight FROM x GROUP BY 1")
def weight_one_hop(spark, d):
    e = edges(spark, d)
    share = e.join(e.groupBy("page_id").agg(F.count("*").alias("n")), "page_id").withColumn("w", F.floor(100 / (2 * F.col("n"))))
    return share.groupBy("link").agg(F.sum("w").alias("weight"))


@query(f"""SELECT 'host' AS family, {HOST} AS value, count(*) AS n FROM pages GROUP BY 2 UNION ALL
SELECT 'filetype', CASE WHEN regexp_extract({PATH}, '[^/][.]([A-Za-z0-9]+)$', 1) = '' THEN 'html' ELSE lower(regexp_extract({PATH}, '[^/][.]([A-Za-z0-9]+)$', 1)) END, count(*) FROM pages GROUP BY 2 UNION ALL
SELECT 'size', (floor(length(html) / 5000) * 5000)::BIGINT::VARCHAR, count(*) FROM pages GROUP BY 2 UNION ALL
SELECT 'scheme', lower(regexp_extract(url, '^([A-Za-z]+):', 1)), count(*) FROM pages GROUP BY 2""")
def crawl_stats(spark, d):
    u = F.col("url")
    pairs = {"host": U.host_name(u), "filetype": U.extension(u), "size": (F.floor(F.length("html") / 5000) * 5000).cast("string"), "scheme": U.scheme(u)}
    families = F.array(*[F.struct(F.lit(k).alias("family"), v.alias("value")) for k, v in pairs.items()])
    return table(spark, d, "pages").select(F.inline(families)).groupBy("family", "value").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, ({PATH}) LIKE '/de/%' OR NOT (({PATH}) LIKE '/%/%' OR regexp_matches({PATH}, '[.]pdf$')) AS allowed FROM pages")
def robots_rules(spark, d):
    return table(spark, d, "pages").select("page_id", U.robots_allowed(U.path(F.col("url")), ["/de/"], ["/*/", "/*.pdf$"]).alias("allowed"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_title_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("lang"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', '', 'g')) AS hash FROM pages")
def hash_page(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_hash(F.col("html")).alias("hash"))


@query(r"SELECT doc_id, email, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+')) AS email FROM documents) GROUP BY 1, 2")
def email_phone_extract(spark, d):
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+"), F.lit(0))
    return docs(spark, d).select("doc_id", F.explode(found).alias("email")).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


@query(with_(TOKS) + "SELECT doc_id FROM tok GROUP BY 1 HAVING count(*) FILTER (term = 'the') >= 5 AND count(*) FILTER (term = 'thing') = 0")
def word_filter(spark, d):
    terms = T.tokens(F.col("text"))
    count = lambda w: F.size(F.filter(terms, lambda t: t == w))
    return docs(spark, d).where((count("the") >= 5) & (count("thing") == 0)).select("doc_id")


# Relational analytics

def events(spark, d):
    return table(spark, d, "events").withColumn("t", A.epoch(F.col("ts")))


_E = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)"


@query(with_(_E) + "SELECT user_id, event_type, t // 3600 * 3600 AS bucket, count(*) AS num_views FROM e GROUP BY ALL")
def impr_hour(spark, d):
    return A.rollup(events(spark, d), ["user_id", "event_type"], A.HOUR)


@query(with_(_E) + "SELECT user_id, event_type, t // 86400 * 86400 AS bucket, count(*) AS num_views FROM e GROUP BY ALL")
def impr_day(spark, d):
    return A.cascade(A.rollup(events(spark, d), ["user_id", "event_type"], A.HOUR), ["user_id", "event_type"], A.DAY)


@query(with_(_E) + "SELECT event_type, t // 2592000 * 2592000 AS bucket, count(*) AS num_views FROM e GROUP BY ALL")
def impr_cascade(spark, d):
    hour = A.rollup(events(spark, d), ["event_type"], A.HOUR)
    return A.cascade(A.cascade(hour, ["event_type"], A.DAY), ["event_type"], A.MONTH)


@query("SELECT user_id, max(ts) AS last_view FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def impr_recent(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_view")).orderBy(F.desc("last_view"), "user_id").limit(20).withColumn("last_view", F.col("last_view").cast("timestamp_ntz"))


@query("SELECT event_type, rank, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 5")
def impr_top(spark, d):
    n = events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return A.top_per(n, ["event_type"], [F.desc("n"), F.col("user_id")], 5).select("event_type", "rank", "user_id", "n")


NOW = 1_705_000_000


@query(with_(_E) + f"SELECT event_type, count(*) AS num_views FROM e WHERE t // 3600 * 3600 >= {NOW} // 3600 * 3600 - 3600 * 23 AND t // 3600 * 3600 <= {NOW} GROUP BY 1")
def impr_lookback(spark, d):
    return A.look_back(A.rollup(events(spark, d), ["event_type"], A.HOUR), ["event_type"], NOW, A.HOUR, 24)


@query(with_(_E) + "SELECT * FROM (SELECT t // 3600 * 3600 AS bucket, event_type AS term, count(*) AS occ, row_number() OVER (PARTITION BY t // 3600 * 3600 ORDER BY count(*) DESC, event_type) AS rank FROM e GROUP BY 1, 2) WHERE rank <= 3")
def trend_hour(spark, d):
    n = events(spark, d).groupBy(A.bucket(F.col("t"), A.HOUR).alias("bucket"), F.col("event_type").alias("term")).agg(F.count("*").alias("occ"))
    return A.top_per(n, ["bucket"], [F.desc("occ"), F.col("term")], 3)


@query(with_(_E) + f"SELECT event_type, round(sum(1.0 / greatest(ceil(({NOW} - t) / 3600), 1)), 6) AS score FROM e WHERE t <= {NOW} AND t >= {NOW} - 86400 GROUP BY 1")
def trend_decay(spark, d):
    rows = events(spark, d).withColumns({"weight": F.lit(1.0), "occ": F.lit(1)})
    return A.decayed(rows, ["event_type"], NOW).withColumn("score", F.round("score", 6))


@query(with_(_E) + "SELECT event_type, t // 86400 * 86400 AS bucket, count(*) AS num_views FROM e WHERE t // 86400 = (SELECT max(t // 86400) FROM e) GROUP BY ALL")
def trend_latest(spark, d):
    day = A.rollup(events(spark, d), ["event_type"], A.DAY)
    newest = day.agg(F.max("bucket").alias("bucket"))
    return day.join(F.broadcast(newest), "bucket", "left_semi")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS balance FROM orders")
def ledger_running(spark, d):
    return A.running(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_custkey", "o_orderkey", F.round("balance", 2).alias("balance"))


@query("SELECT o_custkey, max(o_orderdate) AS last_date, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def ledger_latest(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max("o_orderdate").cast("timestamp_ntz").alias("last_date"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))


@query("SELECT p_brand, l_shipdate::DATE AS day, greatest(round(sum(l_extendedprice), 2), 1) AS bids FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def ads_bid_totals(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand", F.to_date("l_shipdate").alias("day")).agg(F.greatest(F.round(F.sum("l_extendedprice"), 2), F.lit(1.0)).alias("bids"))


@query("SELECT conv_id, count(DISTINCT turn) AS posts, min(turn) AS first_turn, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def threads_summary(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("turn").alias("posts"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA') ON c_nationkey = n_nationkey")
def left_join_nested(spark, d):
    inner = table(spark, d, "nation").join(table(spark, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(inner, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def in_subselect(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) LIKE '%build%' AND c_acctbal BETWEEN 0 AND 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def rows_filter_sort_page(spark, d):
    rows = A.where(table(spark, d, "customer"), [("c_mktsegment", "CONTAINS", "build"), ("c_acctbal", "BETWEEN", (0, 5000))])
    return A.page(rows, [F.desc("c_acctbal"), "c_custkey"], 5, 20).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE 'large%' AND lower(p_name) NOT LIKE '%gear' AND NOT (p_size BETWEEN 10 AND 20)")
def rows_like_not_between(spark, d):
    rows = A.where(table(spark, d, "part"), [("p_name", "BEGINS WITH", "LARGE"), ("p_size", "NOT_BETWEEN", (10, 20))])
    return rows.where(~F.endswith(F.lower("p_name"), F.lit("gear"))).select("p_partkey")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def set_ops(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    k = F.col("o_custkey").alias("k")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.select(k)).unionByName(o.where("o_totalprice > 300000").select(k).intersect(o.where("o_orderstatus = 'F'").select(k)))


# Recommendations: items are conversations, users are events' users; an item is viewed when event_id % items names it.

_REC = r"""it AS (SELECT conv_id AS item_id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM conversations),
tf AS (SELECT item_id, term, count(*) AS freq FROM it GROUP BY 1, 2), n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
ids AS (SELECT conv_id AS item_id, row_number() OVER (ORDER BY conv_id) - 1 AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
v AS (SELECT user_id, item_id, count(*) AS c FROM events JOIN ids ON k = event_id % (SELECT n FROM n) GROUP BY 1, 2),
ut AS (SELECT user_id, term, sum(freq * c)::BIGINT AS freq FROM tf JOIN v USING (item_id) GROUP BY 1, 2),
idf AS (SELECT term, log10((SELECT n FROM n) / (count(DISTINCT item_id) + 1)) AS idf FROM tf GROUP BY 1),
iw AS (SELECT item_id, term, (1 + log10(freq)) * idf AS w FROM tf JOIN idf USING (term) WHERE idf <> 0),
uw AS (SELECT user_id, term, (1 + log10(freq)) * idf AS w FROM ut JOIN idf USING (term) WHERE idf <> 0)"""


def _items(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "item_id")
    return c, R.item_tf(c.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")))


def _views(spark, d, c):
    ids = c.select("item_id").distinct().withColumn("k", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long"))
    n = ids.agg(F.count("*").alias("n"))
    return table(spark, d, "events").join(F.broadcast(n)).withColumn("k", F.col("event_id") % F.col("n")).join(ids, "k").select("user_id", "item_id")


@query("WITH " + _REC + " SELECT item_id, term, freq, round(1 + log10(freq), 6) AS log_freq FROM tf")
def rec_item_tf(spark, d):
    return _items(spark, d)[1].withColumn("log_freq", F.round("log_freq", 6))


@query("WITH " + _REC + " SELECT user_id, term, freq FROM ut")
def rec_user_tf(spark, d):
    c, tf = _items(spark, d)
    return R.user_tf(tf, _views(spark, d, c)).select("user_id", "term", "freq")


@query("WITH " + _REC + " SELECT term, round(idf, 6) AS idf FROM idf WHERE idf <> 0")
def rec_idf(spark, d):
    return R.idf(_items(spark, d)[1], "item_id", 1 << 30).withColumn("idf", F.round("idf", 6))


_COS = ", cs AS (SELECT user_id, item_id, sum(u.w * i.w) / (sqrt(sum(u.w * u.w)) * sqrt(sum(i.w * i.w))) AS s FROM uw u JOIN iw i USING (term) GROUP BY 1, 2)"


def _similar(spark, d, unseen=None):
    c, tf = _items(spark, d)
    views = _views(spark, d, c)
    return R.similar(tf, views, unseen), views


@query("WITH " + _REC + _COS + " SELECT user_id, item_id, round(s, 6) AS similarity FROM cs")
def rec_cosine(spark, d):
    return _similar(spark, d)[0].withColumn("similarity", F.round("similarity", 6))


@query("WITH " + _REC + _COS + " SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 6) DESC, item_id) AS rank FROM cs ANTI JOIN v USING (user_id, item_id)) WHERE rank <= 3")
def rec_topk(spark, d):
    similar, views = _similar(spark, d, 3)
    return R.top_items(similar.withColumn("similarity", F.round("similarity", 6)), views).select("user_id", "item_id", "rank")


# Vectors, codecs, learning

@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)
SELECT vec_id, round(list_dot_product(e, q), 6) AS dot, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(list_cosine_similarity(e, q), 6) AS cosine, round(list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2]))), 6) AS l1 FROM v""")
def vec_measures(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("e").alias("q")).limit(1))
    a, b = F.col("e"), F.col("q")
    return e.join(q).select("vec_id", F.round(V.dot(a, b), 6).alias("dot"), F.round(V.norm(a), 6).alias("norm"), F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.distance(a, b, 1), 6).alias("l1"))


@query("SELECT page_id, ('0x' || substring(md5(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), 1, 7))::BIGINT % 16 AS part FROM pages")
def hash_partition(spark, d):
    return table(spark, d, "pages").select("page_id", C.partition_of(U.host(F.col("url")), 16).alias("part"))


@query("SELECT page_id, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS code FROM pages")
def base64_code(spark, d):
    return table(spark, d, "pages").select("page_id", C.web_base64(F.col("url")).alias("code"))


@query("SELECT page_id, least(length(html), 16777215) * 256 + 255 - least(page_id, 255) AS packed FROM pages")
def queue_weight(spark, d):
    return table(spark, d, "pages").select("page_id", C.queue_weight(F.length("html"), F.col("page_id")).alias("packed"))


@query(with_(TOKS) + "SELECT doc_id, string_agg((pos - p)::VARCHAR, ',' ORDER BY pos) AS deltas FROM (SELECT doc_id, pos, coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS p FROM tok WHERE term = 'the') GROUP BY 1")
def delta_list(spark, d):
    return index(spark, d).postings(["the"]).select("doc_id", F.array_join(C.delta(F.col("positions")).cast("array<string>"), ",").alias("deltas"))


_LABELLED = with_(TOKS) + ", ft AS (SELECT DISTINCT doc_id, term FROM tok), s0 AS (SELECT term, sum(toxic) AS tl, sum(1 - toxic) AS tnl FROM ft JOIN labels USING (doc_id) GROUP BY 1), s AS (SELECT term, tl, tnl, (SELECT sum(toxic) FROM labels) AS pos, (SELECT sum(1 - toxic) FROM labels) AS neg FROM s0)"


def _features(spark, d):
    features = index_postings(spark, d).select("doc_id", "term")
    return features, table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("label"))


@query(_LABELLED + " SELECT term, round(pow(tl * (neg - tnl) - tnl * (pos - tl), 2) / ((tl + tnl) * (pos - tl + neg - tnl)), 6) AS chi2 FROM s WHERE pos - tl + neg - tnl > 0")
def ml_chi2(spark, d):
    return L.chi2(L.stats(*_features(spark, d))).where("chi2 is not null").withColumn("chi2", F.round("chi2", 6))


@query(_LABELLED + " SELECT term, round(ln((tl + 1) / (tnl + 1)) - ln((pos + 1) / (neg + 1)), 6) AS b FROM s")
def ml_nb_logodds(spark, d):
    return L.naive_bayes(L.stats(*_features(spark, d))).select("term", F.round("b", 6).alias("b"))


@query(_LABELLED + ", m AS (SELECT term, ln((pos + 1) / (neg + 1)) AS b0, ln((tl + 1) / (tnl + 1)) - ln((pos + 1) / (neg + 1)) AS b FROM s) SELECT doc_id, round(1 / (1 + exp(-(max(b0) + sum(b)))), 6) AS p FROM ft JOIN m USING (term) GROUP BY 1")
def ml_nb_classify(spark, d):
    features, labels = _features(spark, d)
    return L.classify(features, L.naive_bayes(L.stats(features, labels))).withColumn("p", F.round("p", 6))


@query(with_(TOKS) + ", tf AS (SELECT doc_id, term, count(*) AS f FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1), r AS (SELECT doc_id, term, (1 + ln(f)) * ln(((SELECT count(*) FROM documents) + 1) / (n + 1)) AS w FROM tf JOIN df USING (term)) SELECT doc_id, term, round(w / l, 6) AS weight FROM r JOIN (SELECT doc_id, sqrt(sum(w * w)) AS l FROM r GROUP BY 1) USING (doc_id) WHERE l > 0")
def ml_tfidf(spark, d):
    tf = index_postings(spark, d).select("doc_id", "term", "tf")
    return L.tf_idf(tf, index(spark, d).docs).withColumn("weight", F.round("weight", 6))


@query("SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY floor(epoch(ts)), event_id) AS nth FROM events) WHERE nth <= 2")
def quota(spark, d):
    return A.within_quota(events(spark, d), "user_id", 2).select("event_id", "nth")


@query(f"SELECT page_id, (row_number() OVER (PARTITION BY {HOST} ORDER BY length(html) DESC, url) - 1) * 2 * 100 AS slot FROM pages")
def fetch_batch_slots(spark, d):
    rows = table(spark, d, "pages").select("page_id", "url", U.host_name(F.col("url")).alias("host"), F.length("html").alias("weight"))
    return A.slots(rows, F.lit(7)).select("page_id", "slot")


@query("SELECT page_id, round(length(html) * 1000.0 / (SELECT sum(length(html)) FROM pages), 6) AS normal FROM pages")
def queue_normalize(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.length("html").alias("w"))
    return A.normalized(rows, "w", 1000.0).select("page_id", F.round("normal", 6).alias("normal"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1 HAVING line NOT IN (SELECT unnest(string_split(text, chr(10))) FROM benchmark)")
def diff_lines(spark, d):
    line = F.explode(F.split("text", "\n")).alias("line")
    return docs(spark, d).select(line).join(table(spark, d, "benchmark").select(line), "line", "left_anti").groupBy("line").agg(F.count("*").alias("n"))


# Pages, summaries, stems, streams

#: Titles as the HTML standard reads them: entities of the five signs, white space squeezed.
_TITLES = r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1) AS lang FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS title, lang FROM t"""

@query(_TITLES)
def html_summary(spark, d):
    return H.html_pages(table(spark, d, "pages")).select("page_id", "title", F.coalesce("lang", F.lit("")).alias("lang"))


@query(r"""SELECT page_id, regexp_extract(x, 'href=\"([^\"]+)\"', 1) AS href, trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS anchor
FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>', '', 'g'), '(?s)<a [^>]*href=\"[^\"]+\"[^>]*>.*?</a>')) AS x FROM pages)""")
def html_links(spark, d):
    return H.html_pages(table(spark, d, "pages")).select("page_id", F.inline("links"))


@query()
def sum_centroid(spark, d):
    return summarize(docs(spark, d), "centroid", 500)


@query()
def sum_weighted(spark, d):
    return summarize(docs(spark, d), "weighted", 500)


@query()
def sum_graph(spark, d):
    return summarize(docs(spark, d), "graph", 500)


@query()
def stem_en(spark, d):
    terms = docs(spark, d).where("lang = 'en'").select("doc_id", stem_terms(T.tokens(F.col("text"))).alias("s"))
    return terms.select("doc_id", F.explode("s").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(with_(_E) + "SELECT t // 3600 * 3600 AS bucket, event_type, count(*) AS num_views FROM e GROUP BY ALL")
def stream_hourly(spark, d):
    rows = E.deduplicated(E.read(spark, f"{d}/events.parquet"), "event_id")
    out = E.drain(E.hourly(rows, ["event_type"]), "complete")
    return out.select(F.unix_timestamp("window.start").alias("bucket"), "event_type", "num_views")


@query("WITH RECURSIVE " + _E + """, n AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
r AS (SELECT user_id, i, 3600::BIGINT AS delay, t + 3600 AS until FROM n WHERE i = 1 UNION ALL
SELECT n.user_id, n.i, CASE WHEN n.t <= r.until THEN least(r.delay * 2, 1099511627776) ELSE 3600 END, n.t + CASE WHEN n.t <= r.until THEN least(r.delay * 2, 1099511627776) ELSE 3600 END FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT user_id, max(i) AS visits, arg_max(delay, i) AS delay, arg_max(until, i) AS until FROM r GROUP BY 1""")
def stream_throttle(spark, d):
    rows = E.read(spark, f"{d}/events.parquet")
    out = E.drain(E.throttle(rows, "user_id", 3600, forget=1 << 40), "update")
    return out.groupBy("user_id").agg(F.max(F.struct("visits", "delay", "until")).alias("s")).select("user_id", "s.*")


@query("SELECT c_custkey, 'x' AS tag FROM customer WHERE c_custkey > 10 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey <= 10")
def insert_ignore(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    return A.insert_ignore(c.where("c_custkey <= 10").withColumn("tag", F.lit("old")), c.withColumn("tag", F.lit("x")), ["c_custkey"])


@query(r"SELECT item_id, count(*) AS n FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s FROM benchmark) WHERE trim(s) <> '' GROUP BY 1")
def src_delimited(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("s")).where(F.trim("s") != "").groupBy("item_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, doc_id || ',' || lang || ',' || source || ',' || n_chars AS line FROM documents")
def sink_csv(spark, d):
    return docs(spark, d).select("doc_id", F.to_csv(F.struct("doc_id", "lang", "source", "n_chars")).alias("line"))


# Rules, sheets, markup

@query("SELECT doc_id, 'x-' || source AS tag, string_split(lang || ',' || source, ',') AS parts, ['u:tag:x-' || source] AS meta FROM documents")
def page_rules(spark, d):
    program = "tag = 'x-'\ntag .= source\naddMetaWord(tag)\nparts = lang\nparts .= ','\nparts .= source\ntoArray(parts)"
    out = apply_rules(docs(spark, d).withColumn("meta", F.array().cast("array<string>")), program)
    return out.select("doc_id", "tag", "parts", "meta")


@query(with_(TOKS) + ", c AS (SELECT doc_id, len(list_filter(ts, lambda t: t = 'the')) AS a, len(list_filter(ts, lambda t: t = 'der')) AS b, len(ts) AS n FROM toks) SELECT doc_id, list_filter([CASE WHEN a >= 3 AND b = 0 THEN 'KEEP' END, CASE WHEN b > 0 AND b >= 0.01 * n THEN 'GERMAN' END], lambda x: x IS NOT NULL) AS actions FROM c")
def word_filter_rules(spark, d):
    return filter_words(docs(spark, d), [("the#3,-der", "KEEP"), ("der#0.01", "GERMAN")]).select("doc_id", "actions")


@query("SELECT sum(l_quantity) AS sum, avg(l_quantity) AS avg, min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem")
def sheet_sum_avg(spark, d):
    cells = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("value"))
    end = cells.agg(F.max("row").alias("row"), F.max("col").alias("col")).first()
    return range_aggregate(cells, "A1", cell(end.row or 0, end.col or 0))


@query("SELECT doc_id, md5('<b>' || source || '</b> and <i>' || lang || '</i>') AS html FROM documents")
def wiki_bold(spark, d):
    markup = F.concat(F.lit("'''"), "source", F.lit("''' and ''"), "lang", F.lit("''"))
    return docs(spark, d).select("doc_id", F.md5(to_html(markup).cast("binary")).alias("html"))

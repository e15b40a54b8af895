"""Registered queries of page formats, meta words, text mining and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import EDGES, HOST, PATH, TOKS, docs, edges, index, query, spread, table, with_
from tessera.catalog_crawl import domain_sql
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import meta as M
from tessera.operators import mining as X
from tessera.plans import search as P
from tessera.plans.parser import parse
from tessera.sources import formats as Z

# Formats: a file of each kind is written and read again.

_KINDS = ("docx", "pptx", "xlsx", "epub", "rtf", "zip", "gz", "bz2", "atom", "rss", "svg", "gopher", "txt")
_CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT unnest({list(_KINDS)}) AS kind), t AS (SELECT item_id, {_CLEAN} AS text FROM benchmark)
SELECT item_id, kind, CASE WHEN kind IN ('docx', 'pptx', 'xlsx', 'epub', 'atom', 'rss', 'svg') THEN 'item ' || item_id WHEN kind = 'zip' THEN 'item ' || item_id WHEN kind = 'rtf' THEN '' WHEN kind = 'gopher' THEN text ELSE trim(substring(text, 1, 100)) END AS title,
CASE WHEN kind = 'gopher' THEN text || chr(10) || 'more' ELSE text END AS text, CASE WHEN kind IN ('atom', 'rss') THEN ['http://e.com/1'] WHEN kind = 'gopher' THEN ['gopher://e.com:70/1/m'] ELSE [] END AS links, CASE WHEN kind = 'svg' THEN 12 END AS width FROM t, k""")
def page_formats(spark, d):
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = spread(table(spark, d, "benchmark")).select("item_id", text.alias("text"), F.explode(F.array(*map(F.lit, _KINDS))).alias("kind"))
    title = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    rows = rows.withColumn("page", Z.read_page(Z.write_page(title, "text", "kind"), "kind"))
    return rows.select("item_id", "kind", "page.title", "page.text", "page.links", "page.width")


@query("SELECT part.p_partkey, kind, p_size AS width, p_size * 2 + 1 AS height FROM part, (SELECT unnest(['png', 'gif', 'bmp', 'jpg']) AS kind)")
def image_sizes(spark, d):
    w, h = F.col("p_size"), F.col("p_size") * 2 + 1
    be = lambda c, n: F.lpad(F.hex(c), n, "0")
    le = lambda c, n: F.rpad(F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0")), n, "0")
    raw = {
        "png": F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 8), be(h, 8)),
        "gif": F.concat(F.lit("474946383961"), le(w, 4), le(h, 4)),
        "bmp": F.concat(F.lit("424D" + "00" * 16), le(w, 8), le(h, 8)),
        "jpg": F.concat(F.lit("FFD8FFE000040000FFC0001108"), be(h, 4), be(w, 4), F.lit("03")),
    }
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.unhex(v).alias("raw")) for k, v in raw.items()])
    rows = table(spark, d, "part").select("p_partkey", F.inline(kinds)).withColumn("p", Z.read_page("raw", "kind"))
    return rows.select("p_partkey", "kind", "p.width", "p.height")


# Meta words


def pages(spark, d):
    return spread(table(spark, d, "pages"))


@query(f"""WITH p AS (SELECT page_id, url, {HOST} AS h, {PATH} AS path, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS root FROM pages), q AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps, string_split(h, '.') AS hs FROM p)
SELECT DISTINCT page_id, unnest(list_concat(['site:all', 'path:all', 'path:/', 'info:' || url, 'site:' || root, 'filetype:' || CASE WHEN regexp_extract(path, '[^/][.]([A-Za-z0-9]+)$', 1) = '' THEN 'html' ELSE lower(regexp_extract(path, '[^/][.]([A-Za-z0-9]+)$', 1)) END],
CASE WHEN path IN ('', '/') THEN ['host:all'] ELSE [] END, list_transform(range(1, len(ps) + 1), lambda n: 'site:' || root || '/' || array_to_string(ps[1:n], '/')), list_transform(range(1, len(ps) + 1), lambda n: 'path:/' || array_to_string(ps[1:n], '/')),
list_transform(range(1, len(hs) + 1), lambda n: 'site:' || array_to_string(hs[n:], '.')), list_transform(range(1, len(hs) + 1), lambda n: 'site:.' || array_to_string(hs[n:], '.')))) AS word FROM q""")
def meta_url(spark, d):
    return pages(spark, d).select("page_id", F.explode(M.url_words(F.col("url"))).alias("word")).distinct()


_SERVERS = ("Apache/2.4.1 (Unix)", "nginx", "Server/7 (Win32) x", "")


def response_meta():
    """Meta words of responses that events stand for."""
    e = F.col("event_id")
    server = F.element_at(F.array(*map(F.lit, _SERVERS)), (e % 4 + 1).cast("int"))
    ips = F.array(F.concat(F.lit("10.0.0."), (e % 256).cast("string")))
    moved = F.when(e % 5 == 0, F.array(F.lit("http://e.com/old")))
    return M.response_words(200 + e % 3, e * 7, F.col("value") / 10, (e % 7) / 4, ips, server, F.col("ts"), moved)


@query("""WITH x AS (SELECT *, ['apache', 'nginx', 'server', ''][(event_id % 4)::INTEGER + 1] AS s, ['2.4.1', '', '7', ''][(event_id % 4)::INTEGER + 1] AS v, ['unix', '', 'win32', ''][(event_id % 4)::INTEGER + 1] AS o FROM events)
SELECT event_id, unnest(list_concat(['code:' || (200 + event_id % 3), 'size:' || (event_id * 7 // 5000 * 5000), 'time:' || format('{:.1f}', floor(value / 10 / 0.5) * 0.5), 'dns:' || format('{:.1f}', floor((event_id % 7) / 4.0 / 0.5) * 0.5), 'ip:10.0.0.' || (event_id % 256)],
CASE WHEN s <> '' THEN ['server:' || s] ELSE [] END, CASE WHEN v <> '' THEN ['version:' || v] ELSE [] END, CASE WHEN o <> '' THEN ['os:' || o] ELSE [] END, ['modified:' || strftime(ts, '%Y'), 'modified:' || strftime(ts, '%Y-%m'), 'modified:' || strftime(ts, '%Y-%m-%d')], CASE WHEN event_id % 5 = 0 THEN ['location:http://e.com/old'] ELSE [] END)) AS word FROM x""")
def meta_response(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(response_meta()).alias("word"))


@query("SELECT event_id, 'date:' || unnest([" + ", ".join(f"strftime(ts, '{f}')" for f in ("%Y", "%Y-%m", "%Y-%m-%d", "%Y-%m-%d-%H", "%Y-%m-%d-%H-%M", "%Y-%m-%d-%H-%M-%S")) + "]) AS word FROM events")
def meta_dates(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(M.date_words(F.col("ts"))).alias("word"))


@query(with_(EDGES) + f""", a AS (SELECT page_id, url, CASE WHEN regexp_matches(link, '^[a-z]+:') THEN link ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/' || link END AS link FROM edges),
g AS (SELECT page_id, count(*) AS n, count(*) FILTER ({domain_sql('link')} = {domain_sql('url')}) AS c FROM a GROUP BY 1) SELECT page_id, 'numlinks:' || n AS word FROM g UNION ALL SELECT page_id, 'cld:' || c FROM g UNION ALL SELECT page_id, 'link:' || link FROM a""")
def meta_links(spark, d):
    dst = F.when(F.col("link").rlike("^[a-z]+:"), F.col("link")).otherwise(F.concat(U.host(F.col("url")), F.lit("/"), "link"))
    rows = edges(spark, d).withColumn("link", dst).groupBy("page_id").agg(F.max("url").alias("url"), F.collect_list("link").alias("links"))
    return rows.select("page_id", F.explode(M.link_words(F.col("url"), F.col("links"))).alias("word"))


@query("""WITH x AS (SELECT p_partkey, ['text', 'image', 'video'][(p_partkey % 3)::INTEGER + 1] AS kind, p_size * p_size * 100 AS area, (p_size * 100)::DOUBLE AS s FROM part)
SELECT p_partkey, unnest(list_concat(['media:all', 'media:' || kind], CASE WHEN kind = 'image' THEN ['media:image-' || CASE WHEN area < 50 THEN 'tracking' WHEN area < 100000 THEN 'small' WHEN area < 400000 THEN 'medium' ELSE 'large' END] ELSE [] END,
CASE WHEN kind = 'video' THEN list_transform([60, 300, 600, 900, 1800, 3600, 7200], lambda d: 'duration:' || d || CASE WHEN s > d THEN '-plus' ELSE '-minus' END) ELSE [] END)) AS word FROM x""")
def meta_media(spark, d):
    kind = F.element_at(F.array(F.lit("text"), F.lit("image"), F.lit("video")), (F.col("p_partkey") % 3 + 1).cast("int"))
    size = F.col("p_size") * 10
    words = M.media_words(kind, size, size, F.when(kind == "video", F.col("p_size") * 100.0))
    return table(spark, d, "part").select("p_partkey", F.explode(words).alias("word"))


@query("""SELECT doc_id, unnest(list_concat(['lang:' || lang || '-XX', 'lang:' || lang, 'safe:all', CASE WHEN doc_id % 4 = 0 THEN 'safe:false' ELSE 'safe:true' END, 'guid:' || md5(doc_id::VARCHAR)], CASE WHEN doc_id % 2 = 0 THEN ['robot:a', 'robot:b'] ELSE [] END)) AS word FROM documents""")
def meta_content(spark, d):
    agents = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    words = M.content_words(F.concat("lang", F.lit("-XX")), F.col("doc_id") % 4 == 0, F.md5(F.col("doc_id").cast("string").cast("binary")), agents)
    return table(spark, d, "documents").select("doc_id", F.explode(words).alias("word"))


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 AND event_id % 3 = 1 AND NOT strftime(ts, '%Y-%m-%d') = '2024-01-05'")
def q_meta_words(spark, d):
    """Conditions on stored meta words."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.lit("").alias("text"), response_meta().alias("meta"))
    return P.conjunct_docs(rows, parse("server:apache code:201 -modified:2024-01-05").blocks[0].disjuncts[0]).select(F.col("doc_id").alias("event_id"))


_ANCHOR = r"""a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]+\">[^<]*</a>')) AS x FROM pages),
l AS (SELECT DISTINCT page_id, regexp_extract(x, 'href=\"([^\"]+)\"', 1) AS url, unnest(list_filter(string_split_regex(lower(regexp_extract(x, '>([^<]*)<', 1)), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM a)"""


@query(with_(_ANCHOR) + """, g AS (SELECT term, url, page_id // 100 AS gen, count(*) AS n FROM l GROUP BY 1, 2, 3), gd AS (SELECT term, url, sum(n / greatest(gen + 1, i)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY term, url ORDER BY gen) AS i FROM g) GROUP BY 1, 2),
h AS (SELECT term, page_id // 100 AS gen, count(DISTINCT page_id) AS n FROM l GROUP BY 1, 2), hd AS (SELECT term, sum(n / greatest(gen + 1, i)) AS d FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY gen) AS i FROM h) GROUP BY 1)
SELECT term, url, round(10 * gd.d / hd.d, 6) AS bonus FROM gd JOIN hd USING (term)""")
def anchor_bonus(spark, d):
    urls = F.regexp_extract_all("html", F.lit('<a href="([^"]+)">[^<]*</a>'), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit('<a href="[^"]+">([^<]*)</a>'), F.lit(1))
    rows = pages(spark, d).select(F.col("page_id").alias("src"), F.floor(F.col("page_id") / 100).alias("generation"), F.inline(F.arrays_zip(urls.alias("url"), texts.alias("t"))))
    rows = rows.select("src", "generation", "url", F.explode(T.tokens(F.col("t"))).alias("term"))
    return M.anchor_bonus(rows).withColumn("bonus", F.round("bonus", 6))


# Mining


@query()
def document_diffs(spark, d):
    """U-10/U-11: each document against the next of its source, line by line."""
    from pyspark.sql import Window

    rows = docs(spark, d).select("doc_id", "source", "text").withColumn("next", F.lead("text").over(Window.partitionBy("source").orderBy("doc_id")))
    return rows.where("next is not null").select("doc_id", X.diff("text", "next").alias("diff"))


@query()
def segments(spark, d):
    """Benchmark words run together and split again by the corpus's own words."""
    cost = X.segmenter_words(index(spark, d).dictionary(), 20_000)
    rows = table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(T.tokens(F.col("text")), 1, 20), "").alias("run"))
    return X.segmented(rows, "run", cost).select("item_id", F.array_join("words", " ").alias("words"))


_PAIRS = """it AS (SELECT n_regionkey::BIGINT AS part, c_custkey AS id, l_partkey % 40 AS feature FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
sz AS (SELECT part, id, count(*) AS n FROM it GROUP BY 1, 2), pr AS (SELECT x.part, x.id AS a, y.id AS b, count(*) AS c FROM it x JOIN it y ON x.part = y.part AND x.feature = y.feature AND x.id < y.id GROUP BY 1, 2, 3)"""


def _customers(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("feature"))  # shuffled as small numbers
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = c.join(o, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("n_regionkey").cast("long").alias("part"), F.col("c_custkey").alias("id"), "feature").distinct()


@query(with_(_PAIRS) + "SELECT pr.part, a, b, round(1 - c / greatest(x.n, y.n), 6) AS weight FROM pr JOIN sz x ON x.part = pr.part AND x.id = a JOIN sz y ON y.part = pr.part AND y.id = b")
def pair_weights(spark, d):
    return X.shared_weights(_customers(spark, d)).withColumn("weight", F.round("weight", 6))


@query()
def tree_clusters(spark, d):
    return X.cut_clusters(X.shared_tree(_customers(spark, d)), 0.5)


_GRAMS = TOKS + ", g AS (SELECT ts[i:i + k - 1] AS terms, count(*) AS n FROM (SELECT ts, k, unnest(range(1, greatest(len(ts) - k + 2, 1))) AS i FROM (SELECT ts, unnest([2, 3, 4]) AS k FROM toks)) GROUP BY 1), o AS (SELECT * FROM g WHERE n >= 10), s AS (SELECT terms[1:len(terms) - 1] AS terms, n FROM o UNION ALL SELECT terms[2:len(terms)], n FROM o), b AS (SELECT terms, max(n) AS m FROM s GROUP BY 1)"


@query(with_(_GRAMS) + "SELECT array_to_string(o.terms, ' ') AS phrase, o.n FROM o LEFT JOIN b USING (terms) WHERE m IS NULL OR m < o.n")
def maximal_phrases(spark, d):
    rows = table(spark, d, "documents").select("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows if rows.rdd.getNumPartitions() > 1 else spread(rows)  # texts are read twice: a larger table is not dealt out
    # A counter for about 32 bytes of text; 128 MB a size at most.
    grams = X.frequent_grams(rows.select(T.tokens(F.col("text")).alias("ts")), 4, 10, min(max(int(size).bit_length() - 5, 12), 27))
    return X.maximal_phrases(grams, 10).select(F.array_join("terms", " ").alias("phrase"), "n")


def _features(spark, d):
    features = spark.read.parquet(f"{index(spark, d).path}/postings").select("doc_id", "term")
    return features, table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("label"))


@query(with_(TOKS) + """, k AS (SELECT doc_id, toxic::BIGINT AS label, (doc_id % 5)::INTEGER AS fold FROM labels), r AS (SELECT DISTINCT doc_id, term, label, fold FROM tok JOIN k USING (doc_id)),
z AS (SELECT fold, (SELECT sum(label) FROM k) - sum(label) AS pos, (SELECT sum(1 - label) FROM k) - sum(1 - label) AS neg FROM k GROUP BY 1),
o AS (SELECT term, fold, sum(label) AS x, sum(1 - label) AS y FROM r GROUP BY 1, 2), e AS (SELECT term, sum(x) AS ax, sum(y) AS ay FROM o GROUP BY 1),
b AS (SELECT term, fold, ln((pos + 1) / (neg + 1)) AS b0, ln((ax - x + 1) / (ay - y + 1)) - ln((pos + 1) / (neg + 1)) AS b FROM o JOIN e USING (term) JOIN z USING (fold) WHERE ax - x + ay - y > 0),
s AS (SELECT doc_id, fold, label, round(max(b0) + sum(b), 9) AS v FROM r JOIN b USING (term, fold) GROUP BY 1, 2, 3) SELECT fold, count(*) AS docs, count(*) FILTER ((v > 0) = (label = 1)) AS correct FROM s GROUP BY 1""")
def nb_accuracy(spark, d):
    features, labels = _features(spark, d)
    return X.cross_accuracy(features, labels.withColumn("fold", (F.col("doc_id") % 5).cast("int")))


@query()
def lasso_classes(spark, d):
    """The probability of label 1 of every document with a chosen term."""
    from pyspark.ml.functions import vector_to_array

    model, rows = X.lasso(*_features(spark, d), most=200)
    return model.transform(rows).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query()
def label_next(spark, d):
    """Unlabelled documents on which a sampled committee disagrees most."""
    from tessera.operators import learn as L

    features, labels = _features(spark, d)
    members = X.committee(L.stats(features, labels), 4, 7)
    return X.most_wanted(features.join(labels.select("doc_id"), "doc_id", "left_anti"), members, 20)


@query(with_(TOKS) + "SELECT term, count(DISTINCT doc_id) FILTER (toxic = 1) AS hot, count(DISTINCT doc_id) FILTER (toxic = 0) AS cold FROM tok JOIN labels USING (doc_id) GROUP BY 1")
def vocabulary(spark, d):
    """Documents of each label that have a term."""
    features, labels = _features(spark, d)
    return features.join(labels, "doc_id").groupBy("term").agg(F.count_if(F.col("label") == 1).alias("hot"), F.count_if(F.col("label") == 0).alias("cold"))


# Signatures, rules and replies

_SCRAPERS = [("shop", r"<nav><ul>", r"<h1>([^<]*)</h1>"), ("plain", r"<article>", r"<title>([^<]*)</title>")]


@query("""SELECT page_id, CASE WHEN contains(html, '<nav><ul>') THEN 'shop' WHEN contains(html, '<article>') THEN 'plain' END AS label,
CASE WHEN contains(html, '<nav><ul>') THEN regexp_extract(html, '<h1>([^<]*)</h1>', 1) WHEN contains(html, '<article>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS text FROM pages""")
def page_scrapers(spark, d):
    """P26/E20."""
    from tessera.operators.rules import scraped

    return pages(spark, d).select("page_id", scraped(F.col("html"), _SCRAPERS).alias("s")).select("page_id", "s.label", "s.text")


@query("SELECT n_nationkey, true AS has, false AS lacks FROM nation")
def page_signatures(spark, d):
    """P26 by path."""
    from tessera.operators.rules import has_signature

    page = F.concat(F.lit("<html><head><meta name='x'/></head><body>"), F.lower("n_name"), F.lit("</body></html>"))
    return table(spark, d, "nation").select("n_nationkey", has_signature(page, "/html/head/meta").alias("has"), has_signature(page, "/html/video").alias("lacks"))


@query("""WITH m AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS state, coalesce(text, '') AS text FROM conversations)
SELECT id, CASE WHEN regexp_matches(text, 'the') AND state = 'a' THEN 'one' WHEN regexp_matches(text, 'th|de') THEN 'two' ELSE 'three' END AS response, CASE WHEN regexp_matches(text, 'the') AND state = 'a' THEN 'b' WHEN regexp_matches(text, 'th|de') THEN 'a' ELSE '' END AS state FROM m""")
def bot_replies(spark, d):
    """P29."""
    from tessera.operators.rules import story

    rows = [(1, "the", "a", "b", "one"), (2, "th|de", "", "a", "two"), (3, "", "", "", "three")]
    patterns = spark.createDataFrame(rows, "place int, request string, trigger_state string, result_state string, response string")
    messages = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("state"), "text")
    return story(messages, patterns)


@query("SELECT doc_id, source AS key, lang || ' ' || doc_id AS words FROM documents")
def keyword_links(spark, d):
    """E5."""
    from tessera.operators.rules import apply_rules

    rows = docs(spark, d).select("doc_id", F.concat("source", F.lit(", "), "lang", F.lit(" "), F.col("doc_id").cast("string")).alias("told"))
    return apply_rules(rows, "addKeywordLink(told)").select("doc_id", F.explode("links").alias("key", "words"))

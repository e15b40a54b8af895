"""Registered queries of URL, text and codec functions, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import HOST, PATH, TOKS, docs, edges, index, query, spread, table, with_
from tessera.functions import codecs as C
from tessera.functions import text as T
from tessera.functions import urls as U

_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_BARE = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"


def pages(spark, d):
    return spread(table(spark, d, "pages"))


def _map(pairs) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs) + "}"


_TLD = _map((t, lang) for lang, names in U.TLD_LANGUAGES.items() for t in names.split())


@query(f"SELECT page_id, url_decode(replace(CASE WHEN length({_BARE}) > 40 THEN substring(regexp_replace({_BARE}, '/$', ''), 1, 32) || '...' || right(regexp_replace({_BARE}, '/$', ''), 8) ELSE regexp_replace({_BARE}, '/$', '') END, ' ', '%2520')) AS shown FROM pages")
def url_display(spark, d):
    return pages(spark, d).select("page_id", U.display_url(F.col("url"), 40).alias("shown"))


@query(f"WITH x AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, regexp_replace(url, '^[a-z]+://', '') FROM pages) SELECT page_id, url, {HOST} <> '' AS has_host, contains({HOST}, 'localhost') OR contains({HOST}, '127.0.0.1') AS local FROM x")
def url_tests(spark, d):
    u = F.col("url")
    rows = pages(spark, d).select("page_id", "url")
    rows = rows.unionByName(rows.withColumn("url", F.regexp_replace("url", "^[a-z]+://", "")))
    return rows.select("page_id", "url", U.has_host(u).alias("has_host"), U.is_localhost(u).alias("local"))


@query(f"""WITH h AS (SELECT page_id, string_split({HOST}, '.') AS ps FROM pages), t AS (SELECT page_id, ps, CASE WHEN ps[len(ps)] = 'ca' AND len(ps) > 1 AND ps[len(ps) - 1] = 'qc' THEN 'qc' ELSE ps[len(ps)] END AS tld FROM h)
SELECT page_id, coalesce(({_TLD})[tld], CASE WHEN tld IN {U.GENERIC_DOMAINS} THEN CASE WHEN ps[1] IN {tuple(U.HOST_LANGUAGES)} THEN ps[1] ELSE 'en' END END) AS lang FROM t""")
def url_language(spark, d):
    return pages(spark, d).select("page_id", U.language(F.col("url")).alias("lang"))


@query(f"SELECT page_id, CASE WHEN {HOST} <> '' THEN {_ROOT} END AS host, CASE WHEN {HOST} <> '' AND regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) <> '' THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS path FROM pages")
def url_host_and_path(spark, d):
    return pages(spark, d).select("page_id", U.host_and_path(F.col("url")).alias("h")).select("page_id", "h.host", "h.path")


@query(f"""WITH p AS (SELECT DISTINCT {_ROOT} || '/' AS url FROM pages), h AS (SELECT url, string_split_regex({HOST}, '[.]|-') AS ps FROM p), n AS (SELECT url, ps[1:len(ps) - 1] AS ps FROM h WHERE len(ps) > 1)
SELECT url, array_to_string(CASE WHEN contains(ps[1], 'www') THEN ps[2:] ELSE ps END, ' ') AS words FROM n""")
def url_host_words(spark, d):
    roots = pages(spark, d).select(F.concat(U.host(F.col("url")), F.lit("/")).alias("url")).distinct()
    return roots.select("url", U.host_words(F.col("url")).alias("words"))


@query(f"SELECT page_id, array_to_string(list_filter(string_split_regex(url_decode(regexp_extract({PATH}, '([^/]*?)(?:[.][^./]*)?/?$', 1)), '[_ +.-]'), lambda x: x <> ''), ' ') AS words FROM pages")
def url_path_words(spark, d):
    return pages(spark, d).select("page_id", U.last_path_words(F.col("url")).alias("words"))


@query(f"SELECT page_id, coalesce(({_map(U.MIME_TYPES.items())})[CASE WHEN regexp_extract({PATH}, '[^/][.]([A-Za-z0-9]+)$', 1) = '' THEN 'html' ELSE lower(regexp_extract({PATH}, '[^/][.]([A-Za-z0-9]+)$', 1)) END], 'text/plain') AS mime FROM pages")
def url_mime(spark, d):
    return pages(spark, d).select("page_id", U.mime_type(F.col("url")).alias("mime"))


_IN_SITES = f"(ends_with({HOST}, 'example.com') OR regexp_matches(url, '/fr/[0-9]+') OR (regexp_matches({_ROOT}, '^https://.*[.]org') AND regexp_matches(substring(url, length({_ROOT}) + 1), '^/.*page')))"


@query(f"SELECT page_id, {_IN_SITES} AS member, {_IN_SITES} AND NOT ends_with({HOST}, '.net') AND NOT regexp_matches(url, 'ref=x') AS allowed FROM pages")
def url_site_lists(spark, d):
    sites = ["domain:example.com", "regex:/fr/[0-9]+", "https://*.org/*page"]
    u = F.col("url")
    return pages(spark, d).select("page_id", U.member_of(u, sites).alias("member"), U.may_crawl(u, sites, ["domain:.net", "regex:ref=x"]).alias("allowed"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) IN ('http', 'https', 'gopher') AS crawlable, regexp_replace(" + HOST + r", '^www\.', '') AS domain, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)', 1) = '' THEN 80 ELSE regexp_extract(url, '^[a-z]+://[^/?#]*:([0-9]+)', 1)::INTEGER END AS port, regexp_extract(" + PATH + r", '([^/]*?)(?:[.][A-Za-z0-9]+)?$', 1) AS file, trim(regexp_replace(regexp_replace(url, '^[A-Za-z]+://(www\.)?', ''), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM pages")
def url_names(spark, d):
    u = F.col("url")
    return pages(spark, d).select("page_id", U.crawlable(u).alias("crawlable"), U.base_domain(u).alias("domain"), U.port(u).alias("port"), U.file_name(u).alias("file"), U.words(u).alias("words"))


@query(f"WITH p AS (SELECT page_id, list_filter(string_split({PATH}, '/'), lambda x: x <> '') AS ps FROM (SELECT page_id, url || '/a/a/b' || repeat('/a', (page_id % 4)::INTEGER) AS url FROM (SELECT page_id, {_ROOT} AS url FROM pages))) SELECT page_id, len(list_filter(ps, lambda x: x = 'a')) > 3 AS recursive FROM p")
def url_recursive(spark, d):
    u = F.concat(U.host(F.col("url")), F.lit("/a/a/b"), F.expr("repeat('/a', cast(page_id % 4 as int))"))
    return pages(spark, d).select("page_id", U.recursive(u).alias("recursive"))


# Text


def _expanded_sql(text: str) -> str:
    for pattern, instead in T.CONTRACTIONS:
        i = "(?i)" in pattern
        p = pattern.replace("(?i)", "").replace("'", "''")
        text = f"regexp_replace({text}, '{p}', '{instead.replace('$', chr(92))}', 'g{'i' if i else ''}')"
    return text


@query("SELECT conv_id, turn, md5(" + _expanded_sql("replace(coalesce(text, ''), ' it ', ' it''s they''d ')") + ") AS expanded FROM conversations")
def contractions(spark, d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(" it "), F.lit(" it's they'd "))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.expanded(text).cast("binary")).alias("expanded"))


@query(r"SELECT item_id, md5(regexp_replace(text, '(.{1,40})(?:\s|$)|(.{40})', '\1\2' || chr(10), 'g')) AS wrapped FROM benchmark")
def word_wrap(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(T.wrapped(F.col("text"), 40).cast("binary")).alias("wrapped"))


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[A-Za-z][^>]*=\"[^>]*>')) AS tag FROM pages)
SELECT page_id, tag, '<' || lower(regexp_extract(tag, '^<\s*([A-Za-z][A-Za-z0-9]*)', 1)) || array_to_string(list_transform(list_filter(regexp_extract_all(tag, '([A-Za-z-]+\s*=\s*\"[^\"]*\")', 1), lambda a: lower(regexp_extract(a, '^([A-Za-z-]+)', 1)) IN ('href', 'lang')), lambda a: ' ' || a), '') || '>' AS safe FROM t""")
def safe_tags(spark, d):
    tags = F.regexp_extract_all("html", F.lit('(<[A-Za-z][^>]*="[^>]*>)'), F.lit(1))
    return pages(spark, d).select("page_id", F.explode(tags).alias("tag")).select("page_id", "tag", T.safe_tag(F.col("tag"), ("href", "lang")).alias("safe"))


@query(r"""SELECT page_id, upper(CASE WHEN e = '' THEN 'UTF-8' ELSE e END) AS encoding, CASE upper(l) WHEN 'EUC-JP' THEN 'ja' WHEN 'KOI8-R' THEN 'ru' END AS lang
FROM (SELECT page_id, regexp_extract(html, '(?i)(?:<meta[^>]*charset\s*=\s*[\"'']?|<\?xml[^>]*encoding\s*=\s*[\"''])([A-Za-z0-9_-]+)', 1) AS e, ['utf-8', 'euc-jp', 'koi8-r'][(page_id % 3)::INTEGER + 1] AS l FROM pages)""")
def page_encodings(spark, d):
    other = F.element_at(F.array(F.lit("utf-8"), F.lit("euc-jp"), F.lit("koi8-r")), (F.col("page_id") % 3 + 1).cast("int"))
    return pages(spark, d).select("page_id", T.page_encoding(F.col("html")).alias("encoding"), T.language_of_encoding(other).alias("lang"))


@query("SELECT doc_id, md5(text) AS text FROM documents")
def encoding_sniff(spark, d):
    marked = F.concat(F.unhex(F.lit("EFBBBF")), F.col("text").cast("binary"))
    raw = F.when(F.col("doc_id") % 3 == 0, marked).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.col("text").cast("binary"))
    return docs(spark, d).select("doc_id", F.md5(T.as_text(raw).cast("binary")).alias("text"))


_ENTITIES = ("of the", "and the", "in the", "of the and")


@query(with_(TOKS) + "SELECT doc_id, md5(trim(" + "replace(" * 4 + "' ' || array_to_string(ts, ' ') || ' '" + "".join(f", ' {e} ', ' {e.replace(' ', '-')} ')" for e in sorted(_ENTITIES, key=lambda e: (-e.count(' '), e))) + ")) AS joined FROM toks")
def entity_join(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.joined_entities(F.array_join(T.tokens(F.col("text")), " "), _ENTITIES).cast("binary")).alias("joined"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(concat_ws(' ', regexp_extract(html, '<title>([^<]*)</title>', 1), regexp_extract(html, '<h1>([^<]*)</h1>', 1), array_to_string(regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1), ' ')), '[^\p{L}\p{N}]', ' ', 'g'), '\s+', ' ', 'g')) AS words,
CASE WHEN trim(t) = '' THEN url ELSE trim(t) END AS title FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS t FROM pages)""")
def summary_words(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    links = F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    words = T.summary_text(title, F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), links)
    shown = T.shown_title(F.when(F.col("page_id") % 2 == 0, "").otherwise(title), F.col("url"))
    return pages(spark, d).select("page_id", words.alias("words"), shown.alias("title"))


@query(with_(TOKS) + "SELECT doc_id, string_agg(term, ' ' ORDER BY n DESC, term) AS cloud FROM (SELECT doc_id, term, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS r FROM tok GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1")
def word_cloud(spark, d):
    by_doc = spark.read.parquet(f"{index(spark, d).path}/postings").groupBy("doc_id")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("n"), F.col("term").alias("t")))), 1, 5)
    return by_doc.agg(best.alias("b")).select("doc_id", F.array_join(F.transform("b", lambda s: s["t"]), " ").alias("cloud"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS text FROM pages")
def page_text(spark, d):
    return pages(spark, d).select("page_id", F.md5(T.strip_markup(F.col("html")).cast("binary")).alias("text"))


@query(r"SELECT conv_id, turn, md5(lower(regexp_replace(regexp_replace('The U.K. and A&W ' || coalesce(text, ''), '\b(\p{Lu})\.(\p{Lu})\.(?:(\p{Lu})\.)?', '_\1\2\3', 'g'), '\b(\p{L}+)\s?&\s?(\p{L}+)\b', '\1_and_\2', 'g'))) AS t FROM conversations")
def acronym_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.acronyms(F.concat(F.lit("The U.K. and A&W "), F.coalesce("text", F.lit("")))).cast("binary")).alias("t"))


# Codecs

_X = "xor(('0x' || substring(md5({0}), 1, 16))::UBIGINT, ('0x' || substring(md5({0}), 17, 16))::UBIGINT)"


def _safe64(blob: str) -> str:
    return f"rtrim(replace(replace(to_base64({blob}), '+', '-'), '/', '_'), '=')"


@query("SELECT page_id, " + _safe64("unhex(format('{:016x}', " + _X.format("url") + "))") + " AS hash FROM pages")
def hash_url(spark, d):
    return pages(spark, d).select("page_id", C.crawl_hash(F.col("url")).alias("hash"))


_KEY = "unhex(rpad(substring(md5({0}), 1, 16) || '00' || substring(hex(encode({0})), 1, 22), 40, '0'))"


@query(with_(TOKS) + "SELECT DISTINCT term, " + _safe64(_KEY.format("term")) + " AS key FROM tok")
def word_keys(spark, d):
    return index(spark, d).dictionary().select("term", C.word_key(F.col("term")).alias("key"))


@query("SELECT item_id, " + _safe64(_KEY.format("string_split(text, ' ')[1]")) + " || '.' || " + _safe64("unhex(format('{:016x}', " + _X.format("text") + "))") + " AS key FROM benchmark")
def phrase_keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", C.path_key(F.col("text")).alias("key"))


@query("""WITH b AS (SELECT page_id, list_transform(range(1, octet_length(encode(url)) + 1), lambda i: substring(hex(encode(url)), 2 * i - 1, 2)) AS xs FROM pages)
SELECT page_id, array_to_string(xs, ' ') || ' ' AS hex, array_to_string(list_transform(xs, lambda x: lpad((('0x' || x)::INTEGER)::VARCHAR, 3, '0')), ' ') || ' ' AS int, array_to_string(list_transform(xs, lambda x: right(bin(256 + ('0x' || x)::INTEGER), 8)), ' ') || ' ' AS bin FROM b""")
def byte_strings(spark, d):
    return pages(spark, d).select("page_id", *[C.byte_string(F.col("url"), k).alias(k) for k in ("hex", "int", "bin")])


@query("SELECT page_id, replace(replace(replace(to_base64(encode(url)), '+', '.'), '=', '~'), '/', '_') AS code, url FROM pages")
def web_codes(spark, d):
    rows = pages(spark, d).select("page_id", C.web_encode(F.col("url")).alias("code"))
    return rows.withColumn("url", C.web_decode(F.col("code")))


@query("""WITH x AS (SELECT p_partkey, p_size, ['cm', 'pt', 'em', 'pc', 'ex', 'in', 'mm', 'px', '%', ''][(p_partkey % 10)::INTEGER + 1] AS u FROM part)
SELECT p_partkey, CASE WHEN u = '%' THEN floor(8 * least(p_size, 100))::BIGINT ELSE trunc(p_size * CASE u WHEN 'cm' THEN 28 WHEN 'pt' THEN 28 WHEN 'em' THEN 6 WHEN 'pc' THEN 6 WHEN 'ex' THEN 12 WHEN 'in' THEN 72 WHEN 'mm' THEN 2.8::DOUBLE ELSE 1 END)::BIGINT END AS px,
CASE WHEN p_partkey % 3 = 0 THEN p_size || 'M' WHEN p_partkey % 3 = 1 THEN p_size || 'K' ELSE p_size::VARCHAR END AS metric, (p_size * CASE WHEN p_partkey % 3 = 0 THEN 1000000 WHEN p_partkey % 3 = 1 THEN 1000 ELSE 1 END)::BIGINT AS number FROM x""")
def units(spark, d):
    rows = table(spark, d, "part").withColumn("u", F.element_at(F.array(*map(F.lit, ("cm", "pt", "em", "pc", "ex", "in", "mm", "px", "%", ""))), (F.col("p_partkey") % 10 + 1).cast("int")))
    number = F.col("p_size").cast("long") * F.when(F.col("p_partkey") % 3 == 0, 1_000_000).when(F.col("p_partkey") % 3 == 1, 1000).otherwise(1)
    rows = rows.select("p_partkey", C.pixels(F.concat(F.col("p_size").cast("string"), "u")).alias("px"), C.metric_text(number).alias("metric"))
    return rows.withColumn("number", C.metric_int(F.col("metric")))


_RUNS = with_(TOKS) + "SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok WHERE term = 'the' GROUP BY 1"


def _joined(c):
    return F.array_join(c.cast("array<string>"), ",").alias("positions")


@query(_RUNS)
def varbyte_positions(spark, d):
    """Differences of positions, coded and decoded."""
    rows = index(spark, d).postings(["the"]).select("doc_id", C.varbyte(C.delta(F.col("positions"))).alias("code"))
    return rows.select("doc_id", _joined(C.undelta(C.unvarbyte(F.col("code")))))


@query(_RUNS.replace("SELECT doc_id, string_agg", "SELECT doc_id, (SELECT count(*) FROM documents o WHERE o.doc_id < tok.doc_id) AS doc_index, string_agg"))
def packed_positions(spark, d):
    rows = index(spark, d).postings(["the"]).select("doc_id", C.packed_postings("doc_index", "positions").alias("code"))
    rows = rows.select("doc_id", C.unpacked_postings("code").alias("p"))
    return rows.select("doc_id", F.col("p.doc_index").alias("doc_index"), _joined(F.col("p.positions")))


@query(f"SELECT {HOST} AS host, least(sum(least(length(html), 16777215)), 16777215)::BIGINT AS weight, min(least(page_id, 255)) AS depth FROM pages GROUP BY 1")
def weight_merge(spark, d):
    weight, depth = C.merged_weight(C.queue_weight(F.length("html"), F.col("page_id")))
    return pages(spark, d).groupBy(U.host_name(F.col("url")).alias("host")).agg(weight.alias("weight"), depth.alias("depth"))


@query("""WITH p AS (SELECT doc_id, list_transform(list(p ORDER BY event_type), lambda x: least(greatest(x, 1e-8), 1 - 1e-8)) AS ps, least(greatest(avg(p), 1e-8), 1 - 1e-8) AS m FROM (SELECT user_id AS doc_id, event_type, sum(value / 1000) / count(*) AS p FROM events GROUP BY 1, 2) WHERE p BETWEEN 0 AND 1 GROUP BY 1)
SELECT doc_id AS user_id, round(list_sum(list_transform(ps, lambda p: p * ln(p / m) + (1 - p) * ln((1 - p) / (1 - m)))) / len(ps), 6) AS kl FROM p""")
def divergence(spark, d):
    shares = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.sum(F.col("value") / 1000) / F.count("*")).alias("p")).where("p between 0 and 1")
    lists = shares.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "p"))), lambda s: s["p"]).alias("ps"))
    return lists.select("user_id", F.round(C.divergence_to_mean(F.col("ps")), 6).alias("kl"))


_U = "(('0x' || substring(md5(user_id::VARCHAR), 1, 7))::BIGINT / 268435456.0)::DOUBLE"


@query(f"SELECT user_id, least(greatest(round(n - sign({_U} - 0.5) * ln(greatest(1 - 2 * abs({_U} - 0.5), 1e-12)) / 0.5), 0), 2 * n)::BIGINT AS n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def private_counts(spark, d):
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    u = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long") / 268435456.0
    return n.select("user_id", C.private_count(F.col("n"), u).alias("n"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0) AS q FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(e, q), lambda z: z[1] + z[2])), 6) AS added, round(list_sum(list_transform(list_zip(e, q), lambda z: z[1] - z[2])), 6) AS less, round(sqrt(list_dot_product(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))), list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))))), 6) AS unit FROM v""")
def vec_algebra(spark, d):
    from tessera.functions import vectors as V

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = F.broadcast(e.where("vec_id = 0").select(F.col("e").alias("q")).limit(1))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    a, b = F.col("e"), F.col("q")
    return e.join(q).select("vec_id", total(V.add(a, b)).alias("added"), total(V.add(a, V.scale(b, F.lit(-1.0)))).alias("less"), F.round(V.norm(V.normalize(a)), 6).alias("unit"))

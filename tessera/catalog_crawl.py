"""Registered queries over the state of a crawl, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import EDGES, HOST, edges, query, spread, table, with_
from tessera.functions import urls as U
from tessera.operators import analytics as A
from tessera.operators import crawl as W

_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_E = EDGES + f", e AS (SELECT page_id, url AS src, CASE WHEN regexp_matches(link, '^[a-z]+:') THEN link WHEN starts_with(link, '/') THEN {_ROOT} || link ELSE {_ROOT} || '/' || link END AS dst FROM edges)"


def host_sql(c: str) -> str:
    return HOST.replace("url", c, 1)


def domain_sql(c: str) -> str:
    ps = f"string_split({host_sql(c)}, '.')"
    return f"array_to_string({ps}[greatest(len({ps}) - CASE WHEN len({ps}) >= 3 AND length({ps}[len({ps})]) = 2 AND length({ps}[len({ps}) - 1]) <= 3 THEN 2 ELSE 1 END, 1):len({ps})], '.')"


def links(spark, d):
    e = edges(spark, d)
    root = U.host(F.col("url"))
    dst = F.when(F.col("link").rlike("^[a-z]+:"), F.col("link")).when(F.col("link").startswith("/"), F.concat(root, "link")).otherwise(F.concat(root, F.lit("/"), "link"))
    return e.select("page_id", F.col("url").alias("src"), dst.alias("dst"))


def pages(spark, d):
    return spread(table(spark, d, "pages"))


@query(with_(_E) + "SELECT src, dst, count(*) AS n FROM e WHERE src <> dst GROUP BY 1, 2")
def links_elsewhere(spark, d):
    return W.without_self_links(links(spark, d)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(with_(_E) + f""", f AS (SELECT src, dst, {host_sql('dst')} AS host, {domain_sql('dst')} = {domain_sql('src')} AS same FROM e),
h AS (SELECT src, host, count(*) FILTER (same) AS n, count(*) FILTER (same AND host <> {host_sql('src')} AND length(string_split(host, '.')[1]) > 3) AS m FROM f GROUP BY 1, 2),
g AS (SELECT src, sum(n) AS common, count(*) FILTER (m > 0) AS hosts, max(m) AS most FROM h GROUP BY 1)
SELECT src, CASE WHEN (hosts > 2 OR most > 4) AND {domain_sql('src')} NOT IN {W.NO_FARMS} THEN -1 ELSE common END::BIGINT AS common FROM g""")
def link_farms(spark, d):
    return W.common_domains(links(spark, d), 4)


@query(with_(_E) + f""", f AS (SELECT src, dst, {domain_sql('dst')} = {domain_sql('src')} AS same FROM e), w AS (SELECT url AS src, max(length(html)) AS w FROM pages GROUP BY 1),
c AS (SELECT src, count(*) AS n, count(*) FILTER (same) AS c FROM f GROUP BY 1), k AS (SELECT src, floor(w / (2 * n)) AS near, floor((w - floor(w / (2 * n)) * c) / greatest(n - c, 1)) AS far FROM c JOIN w USING (src))
SELECT dst AS url, least(sum(CASE WHEN same THEN near ELSE far END), 16777215)::BIGINT AS weight FROM f JOIN k USING (src) GROUP BY 1""")
def link_weights(spark, d):
    weights = pages(spark, d).groupBy(F.col("url").alias("src")).agg(F.max(F.length("html")).alias("w"))
    return W.spread_weight(links(spark, d), weights)


@query(with_(_E) + """, q AS (SELECT url, length(html)::BIGINT AS weight, (page_id % 5)::INTEGER AS depth FROM pages UNION ALL SELECT dst, 10, 9 FROM e)
SELECT url, least(sum(weight), 16777215)::BIGINT AS weight, min(depth) AS depth FROM q WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY 1""")
def crawl_queue(spark, d):
    p = pages(spark, d)
    queue = p.select("url", F.length("html").cast("long").alias("weight"), (F.col("page_id") % 5).cast("int").alias("depth"))
    found = links(spark, d).select(F.col("dst").alias("url"), F.lit(10).cast("long").alias("weight"), F.lit(9).alias("depth"))
    return W.merge_queue(queue, found, p.where("page_id % 3 = 0"))


@query(with_(_E) + "SELECT DISTINCT dst AS url FROM e WHERE dst NOT IN (SELECT url FROM pages)")
def unseen_urls(spark, d):
    return W.unseen(links(spark, d).select(F.col("dst").alias("url")), pages(spark, d))


_RULES = [("disallow", "/de/"), ("disallow", "/*ref=x$"), ("disallow", "/fr/*5"), ("allow", "/de/1*")]


@query(f"SELECT page_id, url, p LIKE '/de/1%' OR NOT (p LIKE '/de/%' OR p LIKE '/fr/%5%') OR {HOST} NOT LIKE '%.com' AS allowed FROM (SELECT page_id, url, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS p FROM pages)")
def robots_join(spark, d):
    p = pages(spark, d).select("page_id", "url")
    hosts = p.select(U.host_name(F.col("url")).alias("host")).where(F.endswith("host", F.lit(".com"))).distinct()
    rules = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(U.path_rule_regex(r)).alias("pattern")) for k, r in _RULES])
    return W.robots_filter(p, hosts.select("host", F.inline(rules)))


_BLOCKED = f"SELECT DISTINCT {HOST} FROM pages WHERE page_id % 10 = 0"


@query(f"SELECT page_id FROM pages WHERE {HOST} NOT IN ({_BLOCKED})")
def blocked_hosts(spark, d):
    p = pages(spark, d)
    return W.host_filter(p, p.where("page_id % 10 = 0").select(U.host_name(F.col("url")).alias("host"))).select("page_id")


@query(f"SELECT page_id FROM pages WHERE {HOST} IN ({domain_sql('url')}, 'www.' || {domain_sql('url')}) OR {domain_sql('url')} NOT IN (SELECT {domain_sql('url')} FROM pages WHERE page_id % 10 = 0)")
def culled_domains(spark, d):
    p = pages(spark, d)
    return W.domain_cull(p, p.where("page_id % 10 = 0").select(U.company_domain(F.col("url")).alias("domain"))).select("page_id")


@query(f"""WITH q AS (SELECT {HOST} AS host, length(html) AS weight, url FROM pages WHERE {HOST} NOT IN (SELECT {HOST} FROM pages WHERE page_id % 20 = 0))
SELECT host, arg_max(url, (weight, url)) AS url, max(weight) AS weight FROM q GROUP BY 1 ORDER BY weight DESC, url LIMIT 20""")
def ready_hosts(spark, d):
    p = pages(spark, d)
    queue = p.select("url", F.length("html").alias("weight"))
    return W.ready(queue, p.where("page_id % 20 = 0").select(U.host_name(F.col("url")).alias("host")), 20)


@query("SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 = 0 AND 1700000000 + page_id >= 1700000100)")
def stale_urls(spark, d):
    p = pages(spark, d)
    cached = p.where("page_id % 4 = 0").select("url", (F.lit(1_700_000_000) + F.col("page_id")).alias("expires"))
    return W.stale(p, cached, 1_700_000_100).select("page_id")


@query(f"""WITH p AS (SELECT url, CASE WHEN page_id % 2 = 0 THEN {_ROOT} || '/c' ELSE url || '?' END AS canonical FROM pages)
SELECT url, canonical FROM p WHERE levenshtein(url, canonical) > 3""")
def canonical_edges(spark, d):
    to = F.when(F.col("page_id") % 2 == 0, F.concat(U.host(F.col("url")), F.lit("/c"))).otherwise(F.concat("url", F.lit("?")))
    html = F.concat(F.lit('<head><link data-a="1" rel="canonical" href="'), to, F.lit('"></head>'), "html")
    return W.canonical_edges(pages(spark, d).withColumn("html", html))


@query()
def pruned_links(spark, d):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]+)">'), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit('<a href="[^"]+">([^<]*)</a>'), F.lit(1))
    rows = pages(spark, d).select("page_id", F.inline(F.arrays_zip(found.alias("dst"), texts.alias("text"))))
    return W.prune_links(rows.withColumnRenamed("page_id", "page"), 5).select("page", "dst", "rank", F.round("told", 6).alias("told"))


@query("SELECT event_type, sum(event_id % 100)::BIGINT AS urls, max(value) AS memory, arg_max(user_id, (ts, user_id)) AS recent, bool_and(value > 1) AS stalled FROM events GROUP BY 1")
def crawl_statuses(spark, d):
    e = table(spark, d, "events").withColumns({"urls": F.col("event_id") % 100, "memory": F.col("value"), "recent": F.col("user_id")})
    return W.merge_statuses(e, "event_type", "ts", ["urls"], ["memory"], ["recent"]).join(W.stalled(e, "event_type", F.col("value") > 1), "event_type")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1000000 ELSE n_chars END AS place FROM documents")
def summary_offsets(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("place"))
    moves = docs.where("doc_id % 7 = 0").select("doc_id", (F.col("place") + 1_000_000).alias("new"))
    return W.remap(docs, moves, "doc_id", "place")


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def list_union(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return W.crawl_lists(a, table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))


# Sources


@query("SELECT event_id, json_extract_string(props, '$.' || k) AS value, k AS key FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_tags(spark, d):
    """A JSON object as (key, value) rows."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("SELECT page_id, regexp_extract(m, '([a-z]+)=', 1) AS name, regexp_extract(m, '=([^&#]*)', 1) AS value FROM (SELECT page_id, unnest(regexp_extract_all(url, '[a-z]+=[^&#]*')) AS m FROM pages)")
def scraped_values(spark, d):
    """(name, value) pairs by a pattern."""
    names = F.regexp_extract_all("url", F.lit("([a-z]+)=[^&#]*"), F.lit(1))
    values = F.regexp_extract_all("url", F.lit("[a-z]+=([^&#]*)"), F.lit(1))
    return pages(spark, d).select("page_id", F.inline(F.arrays_zip(names.alias("name"), values.alias("value"))))


@query("SELECT o_orderkey, o_custkey::BIGINT AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders")
def csv_rows(spark, d):
    """Rows written as CSV lines and parsed again."""
    line = F.to_csv(F.struct("o_custkey", "o_orderstatus", "o_totalprice"))
    rows = table(spark, d, "orders").select("o_orderkey", F.from_csv(line, F.lit("cust bigint, status string, price double")).alias("r"))
    return rows.select("o_orderkey", "r.*")


@query("SELECT c_custkey AS id, 'segment' AS name, lower(c_mktsegment) AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer")
def ini_values(spark, d):
    """name=value lines below a [section], comments and blank lines left out."""
    text = F.concat(F.lit("; a comment\n[c]\n segment = "), F.lower("c_mktsegment"), F.lit("\n\nnation="), F.col("c_nationkey").cast("string"))
    line = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.split(text, "\n")).alias("line"))
    return line.where(F.col("line").rlike(r"^\s*[^;\[#\s][^=]*=")).select("id", F.trim(F.split_part("line", F.lit("="), F.lit(1))).alias("name"), F.trim(F.regexp_replace("line", "^[^=]*=", "")).alias("value"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def log_tail(spark, d):
    """S38."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query("SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(lower(line), 'token') OR contains(lower(line), 'license') GROUP BY 1, 2")
def log_lines(spark, d):
    """Lines that hold one of some words, in any case."""
    lines = spread(table(spark, d, "documents")).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.contains(F.lower("line"), F.lit("token")) | F.contains(F.lower("line"), F.lit("license"))).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


@query("SELECT url, max(page_id) AS page_id, max(length(html)) AS size FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id = 7) GROUP BY 1")
def page_lookup(spark, d):
    """The stored page of a url."""
    p = table(spark, d, "pages")
    return p.join(p.where("page_id = 7").select("url").distinct(), "url", "left_semi").groupBy("url").agg(F.max("page_id").alias("page_id"), F.max(F.length("html")).alias("size"))


@query("SELECT o_orderkey, 'INSERT INTO ORDERS VALUES (' || o_orderkey || ', ''' || o_orderstatus || ''', ' || o_custkey || ');' AS line FROM orders")
def sink_sql(spark, d):
    """Rows as INSERT statements."""
    return table(spark, d, "orders").select("o_orderkey", F.format_string("INSERT INTO ORDERS VALUES (%d, '%s', %d);", "o_orderkey", F.replace("o_orderstatus", F.lit("'"), F.lit("''")), "o_custkey").alias("line"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def table_copy(spark, d):
    """A table written elsewhere and read from there."""
    import uuid

    from tessera.operators.store import shared_folder

    path = f"{shared_folder(spark)}/copy-{uuid.uuid4().hex}"
    table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT event_id FROM events WHERE ((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) BETWEEN 14 * 3600 AND 16 * 3600 AND floor(epoch(ts))::BIGINT >= 0")
def time_interval(spark, d):
    """Rows within a span of the day, from 14:00 for two hours."""
    e = table(spark, d, "events").withColumn("t", A.epoch(F.col("ts")))
    return e.where((F.col("t") % A.DAY).between(14 * 3600, 16 * 3600)).select("event_id")

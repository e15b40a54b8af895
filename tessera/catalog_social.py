"""Registered queries of relational patterns: customers are users, nations are groups, orders are posts, suppliers advertise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import TOKS, docs, events, index, query, table, with_
from tessera.operators import analytics as A
from tessera.operators import learn as L
from tessera.operators import recommend as R
from tessera.operators import social as S

_GROUPS = "g AS (SELECT n_nationkey AS group_id, n_name AS group_name, n_nationkey % 2 = 0 AS open FROM nation), m AS (SELECT c_nationkey AS group_id, c_custkey AS user_id, c_acctbal > 0 AS active FROM customer)"


def _groups(spark, d):
    groups = table(spark, d, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("group_name"), (F.col("n_nationkey") % 2 == 0).alias("open"))
    members = table(spark, d, "customer").select(F.col("c_nationkey").alias("group_id"), F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("active"))
    return groups, members


def _posts(spark, d):
    """Orders as posts to the group that their key names."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("post_id"), (F.col("o_orderkey") % 25).cast("int").alias("group_id"), F.col("o_custkey").alias("user_id"), A.epoch(F.col("o_orderdate")).alias("t"))


@query(with_(_GROUPS) + """SELECT o_orderkey AS post_id, group_name, c_name AS user_name FROM orders JOIN g ON group_id = o_orderkey % 25 JOIN customer ON c_custkey = o_custkey
WHERE open OR EXISTS (SELECT 1 FROM m WHERE m.group_id = g.group_id AND m.user_id = 7 AND active)""")
def visible_posts(spark, d):
    groups, members = _groups(spark, d)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return S.visible_posts(_posts(spark, d), groups, members, users, 7).select("post_id", "group_name", "user_name")


@query("SELECT DISTINCT p_partkey AS activity_id, p_name AS name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def user_activities(spark, d):
    orders = table(spark, d, "orders")
    first = orders.agg(F.min("o_custkey")).first()[0]
    roles = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("role_id"))
    acts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("role_id"), F.col("l_partkey").alias("activity_id"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("activity_id"), F.col("p_name").alias("name"))
    return S.activities(roles, acts, names, first)


@query("SELECT c_name AS source, s_name AS target FROM customer JOIN supplier ON s_suppkey = c_custkey % 10 + 1 WHERE c_mktsegment = 'BUILDING'")
def page_relations(spark, d):
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_name").alias("source"), (F.col("c_custkey") % 10 + 1).alias("to_id"), F.col("c_mktsegment").alias("kind"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page_id"), F.col("s_name").alias("name"))
    return S.linked_pages(rows, names, "BUILDING")


_BIDS = "b AS (SELECT l_suppkey AS ad_id, p_brand AS keyword, l_shipdate::DATE AS day, l_extendedprice AS amount FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))"


def _bids(spark, d):
    ads = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ad_id"), (F.col("s_acctbal") > 0).alias("active"))
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bids = rows.select(F.col("l_suppkey").alias("ad_id"), F.col("p_brand").alias("keyword"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("amount"), (F.col("l_returnflag") != "R").alias("accepted"))
    return ads, bids


@query(with_(_BIDS) + "SELECT keyword, day, round(greatest(sum(amount), 1), 2) AS total FROM b GROUP BY 1, 2")
def accepted_bids(spark, d):
    return S.bid_totals(*_bids(spark, d)).withColumn("total", F.round("total", 2))


@query(with_(_BIDS) + """, t AS (SELECT keyword, ad_id, round(sum(amount), 2) AS total FROM b GROUP BY 1, 2),
c AS (SELECT *, sum(total) OVER (PARTITION BY keyword ORDER BY total DESC, ad_id ROWS UNBOUNDED PRECEDING) AS upto, sum(total) OVER (PARTITION BY keyword) AS whole FROM t)
SELECT keyword, ad_id, total FROM c WHERE upto >= 0.37 * whole QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY total DESC, ad_id) = 1""")
def ad_pick(spark, d):
    ads, bids = _bids(spark, d)
    rows = bids.where("accepted").join(ads.where("active").select("ad_id"), "ad_id").groupBy("keyword", "ad_id").agg(F.round(F.sum("amount"), 2).alias("total"))
    return S.weighted_pick(rows, ["keyword"], "total", "ad_id", F.lit(0.37))


@query()
def random_trends(spark, d):
    words = index(spark, d).dictionary().select("term", "num_occ")
    return S.weighted_sample(words, "num_occ", "term", 10, 42)


_E = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)"


@query(with_(_E) + f", n AS (SELECT max(t) AS now FROM e), r AS (SELECT event_type AS term, t // 3600 * 3600 AS bucket, count(*) AS occ FROM e GROUP BY 1, 2) SELECT term, bucket, occ, ((bucket - ((now - 86400) // 3600 * 3600 + 3600)) // 3600)::INTEGER AS place FROM r, n WHERE bucket >= (now - 86400) // 3600 * 3600 + 3600 AND bucket <= now")
def term_series(spark, d):
    e = events(spark, d)
    rolled = e.groupBy(F.col("event_type").alias("term"), A.bucket(F.col("t"), A.HOUR).alias("bucket")).agg(F.count("*").alias("occ"))
    return S.series(rolled, A.DAY, A.HOUR, e.agg(F.max("t")).first()[0])


@query(with_(_E) + ", r AS (SELECT user_id, t // 3600 * 3600 AS bucket, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, min(bucket) AS first_bucket, sum(n)::BIGINT AS views, count(*) AS buckets FROM r GROUP BY 1")
def item_statistics(spark, d):
    return S.period_statistics(A.rollup(events(spark, d), ["user_id"], A.HOUR), "user_id")


@query(with_(_E) + "SELECT t // 86400 * 86400 AS bucket, count(*) AS num_views FROM e WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1")
def item_histogram(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("event_type")).first()[0]
    return S.histogram(A.rollup(e, ["event_type"], A.DAY), "event_type", first, 0, 1 << 40)


@query("SELECT count(DISTINCT o_custkey) AS total, max(o_orderdate) AS last_change FROM orders WHERE o_orderstatus = 'F'")
def paging_total(spark, d):
    """Rows for paging, and the last change."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.agg(F.count_distinct("o_custkey").alias("total"), F.max("o_orderdate").cast("timestamp_ntz").alias("last_change"))


_SIM = "s AS (SELECT user_id, (event_id % 25)::INTEGER AS group_id, sum(value) AS v FROM events GROUP BY 1, 2), mem AS (SELECT DISTINCT user_id, (event_id % 7)::INTEGER AS group_id FROM events WHERE event_type = (SELECT min(event_type) FROM events))"


@query(with_(_SIM) + ", r AS (SELECT user_id, group_id, v AS rating FROM s ANTI JOIN mem USING (user_id, group_id)) SELECT user_id, group_id, round(rating, 6) AS rating, row_number() OVER (PARTITION BY user_id ORDER BY round(rating, 6) DESC, group_id)::INTEGER AS rank FROM r QUALIFY rank <= 3")
def group_ratings(spark, d):
    e = table(spark, d, "events")
    similar = e.select("user_id", (F.col("event_id") % 25).cast("int").alias("group_id"), F.col("value").alias("similarity"))
    first = e.agg(F.min("event_type")).first()[0]
    members = e.where(F.col("event_type") == first).select("user_id", (F.col("event_id") % 7).cast("int").alias("group_id"))
    return S.group_ratings(similar, members).withColumn("rating", F.round("rating", 6))


@query("""WITH top AS (SELECT l_partkey AS item_id, sum(l_quantity) AS score FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT c_custkey AS user_id, item_id FROM customer, top WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def rec_for_new(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    rated = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    popular = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("score"))
    return S.for_new(users, rated, popular)


@query("SELECT o_orderkey AS post_id FROM orders WHERE o_orderkey % 25 % 3 <> 0 AND floor(epoch(o_orderdate))::BIGINT + 86400 * 100 * (o_orderkey % 25 % 3) < (SELECT max(floor(epoch(o_orderdate))::BIGINT) FROM orders)")
def expired_posts(spark, d):
    posts = _posts(spark, d)
    groups = _groups(spark, d)[0].withColumn("lifetime", F.col("group_id") % 3 * A.DAY * 100)
    return S.expired(posts, groups, F.lit(posts.agg(F.max("t")).first()[0])).select("post_id")


@query("SELECT md5(text) AS hash, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id FROM documents GROUP BY 1")
def dedup_description(spark, d):
    rows = docs(spark, d).select("doc_id", "n_chars", F.md5(F.col("text").cast("binary")).alias("hash"))
    return S.best_of(rows, ["hash"], [F.desc("n_chars"), F.col("doc_id")]).select("hash", "doc_id")


@query("""WITH r AS (SELECT url, min(page_id) AS rank FROM pages GROUP BY 1), p AS (SELECT url, min(page_id) AS place FROM pages WHERE page_id IN (5, 9) GROUP BY 1)
SELECT url, row_number() OVER (ORDER BY CASE WHEN p.url IS NULL THEN 1 ELSE 0 END, coalesce(place, rank), url)::INTEGER AS rank FROM r LEFT JOIN p USING (url)""")
def pinned_results(spark, d):
    p = table(spark, d, "pages")
    results = p.groupBy("url").agg(F.min("page_id").alias("rank"))
    pins = p.where("page_id in (5, 9)").groupBy("url").agg(F.min("page_id").alias("place")).withColumn("query", F.lit("q"))
    return S.pinned(results, pins, "q")


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'edited' ELSE source END AS source, lang FROM documents")
def edited_results(spark, d):
    rows = docs(spark, d).select("doc_id", "source", "lang")
    edits = rows.where("doc_id % 9 = 0").select("doc_id", F.lit("edited").alias("source"), F.lit(None).cast("string").alias("lang"))
    return S.overlay(rows, edits, "doc_id", ["source", "lang"])


@query("""WITH h AS (SELECT user_id, event_type, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(h) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM h) SELECT user_id, event_type, min(event_id) AS first, count(*) AS size FROM r GROUP BY user_id, run, event_type""")
def media_groups(spark, d):
    return S.media_groups(table(spark, d, "events").select("user_id", "event_type", "event_id"), "event_type", "event_id", ["user_id"])


@query("WITH t AS (SELECT user_id AS question, event_type AS answer, sum(value) AS score FROM events GROUP BY 1, 2) SELECT question, arg_max(answer, (score, answer)) AS answer, round(max(score), 6) AS score FROM t GROUP BY 1")
def best_answers(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("answer"), F.col("value").alias("score"))
    return S.best_answers(rows).withColumn("score", F.round("score", 6))


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(h) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, min(ts) AS start, list(event_id ORDER BY ts DESC, event_id DESC)[1:3] AS items FROM s GROUP BY user_id, k""")
def media_sessions(spark, d):
    out = S.sessions(table(spark, d, "events"), ["user_id"], "ts", "event_id", "3 hours", 3)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(with_(TOKS) + "SELECT term, count(*) AS num_occ FROM tok WHERE starts_with(term, 'th') GROUP BY 1 ORDER BY num_occ DESC, term LIMIT 10")
def suggest(spark, d):
    return S.suggestions(index(spark, d).dictionary(), "th", 10).select("term", "num_occ")


@query(with_(TOKS) + ", b AS (SELECT DISTINCT a.doc_id, a.term || ' ' || c.term AS gram FROM tok a JOIN tok c ON a.doc_id = c.doc_id AND c.pos = a.pos + 1), k(gram) AS (VALUES ('of the'), ('and the'), ('la des')) SELECT doc_id, count(*) AS known FROM b JOIN k USING (gram) GROUP BY 1")
def known_ngrams(spark, d):
    """How many known word pairs a document has."""
    from tessera.functions import text as T

    terms = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("terms"))
    grams = terms.select("doc_id", F.explode(F.array_distinct(T.word_ngrams(F.col("terms"), 2))).alias("gram"))
    known = spark.createDataFrame([("of the",), ("and the",), ("la des",)], "gram string")
    return grams.join(F.broadcast(known), "gram").groupBy("doc_id").agg(F.count("*").alias("known"))  # three rows


@query("SELECT c_nationkey AS nation, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_acctbal DESC, c_custkey) AS members FROM customer GROUP BY 1")
def grouped_lists(spark, d):
    """A4: rows of a group as one ordered list."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), F.col("c_custkey").alias("k")))), lambda s: s["k"].cast("string"))
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_join(rows, ",").alias("members"))


@query(with_(_E) + ", n AS (SELECT max(t) AS now FROM e), r AS (SELECT user_id % 3 AS category, event_type AS term, round(sum((1 + user_id % 2) / greatest(ceil((now - t) / 3600), 1)), 6) AS score FROM e, n WHERE t >= now - 86400 GROUP BY 1, 2) SELECT category, term, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, term)::INTEGER AS rank FROM r QUALIFY rank <= 50")
def trend_weighted(spark, d):
    """Weighted trends by category, the first fifty of each."""
    e = events(spark, d)
    rows = e.withColumns({"weight": 1 + F.col("user_id") % 2, "occ": F.lit(1), "category": F.col("user_id") % 3, "term": F.col("event_type")})
    scored = A.decayed(rows, ["category", "term"], e.agg(F.max("t")).first()[0]).withColumn("score", F.round("score", 6))
    return A.top_per(scored, ["category"], [F.desc("score"), F.col("term")], 50)


@query("SELECT user_id, count(*) AS views, count(*) FILTER (rn > 1) AS repeats FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def impressions_forever(spark, d):
    """Running counters beside the log: all views, and those of a kind seen before."""
    rn = A.top_per(table(spark, d, "events"), ["user_id", "event_type"], [F.col("event_id")], 1 << 60)
    return rn.groupBy("user_id").agg(F.count("*").alias("views"), F.count_if(F.col("rank") > 1).alias("repeats"))


_CHI = with_(TOKS) + ", ft AS (SELECT DISTINCT doc_id, term FROM tok), s AS (SELECT term, sum(toxic) AS tl, sum(1 - toxic) AS tn, (SELECT sum(toxic) FROM labels) AS p, (SELECT sum(1 - toxic) FROM labels) AS n FROM ft JOIN labels USING (doc_id) GROUP BY 1)"


@query(_CHI + " SELECT term, round(pow(tl * (n - tn) - tn * (p - tl), 2) / ((tl + tn) * (p - tl + n - tn)), 6) AS chi2 FROM s WHERE p - tl + n - tn > 0 ORDER BY chi2 DESC, term LIMIT 30")
def top_features(spark, d):
    """The features that tell most."""
    features = spark.read.parquet(f"{index(spark, d).path}/postings").select("doc_id", "term")
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("label"))
    return L.chi2(L.stats(features, labels)).where("chi2 is not null").withColumn("chi2", F.round("chi2", 6)).orderBy(F.desc("chi2"), "term").limit(30).select("term", "chi2")


@query("SELECT n_regionkey AS region, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey * 7 % 11 DESC, n_name)::INTEGER AS rank FROM nation")
def highlights(spark, d):
    """Highlights of each part of a page by priority."""
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 7 % 11).alias("priority"))
    return A.top_per(rows, ["region"], [F.desc("priority"), F.col("name")], 1 << 30).select("region", "name", "rank")


@query("SELECT o_orderkey, to_json({'key': o_orderkey, 'status': o_orderstatus}) AS json, '<item><title>' || o_orderstatus || '</title><guid>' || o_orderkey || '</guid></item>' AS rss FROM orders")
def response_formats(spark, d):
    """Results as JSON and as feed items."""
    o = table(spark, d, "orders")
    json = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    escaped = F.replace(F.replace("o_orderstatus", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return o.select("o_orderkey", json.alias("json"), F.concat(F.lit("<item><title>"), escaped, F.lit("</title><guid>"), F.col("o_orderkey").cast("string"), F.lit("</guid></item>")).alias("rss"))

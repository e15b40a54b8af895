"""Queries that cover whole tables."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from tessera import catalog
from tessera.functions.sheet import cell, place
from tessera.operators import mining as X
from tessera.operators import recommend as R
from tessera.registry import QUERIES

#: sf0.001 has fewer than 20 users.
SF = "/root/testdata/sf0.01"


def test_recommendations_reach_every_user(spark):
    users = {r.user_id for r in catalog.table(spark, SF, "events").select("user_id").distinct().collect()}
    assert max(users) >= 20
    for name in ("rec_user_tf", "rec_cosine", "rec_topk"):
        got = catalog.QUERIES[name](spark, SF).select("user_id").distinct().collect()
        assert {r.user_id for r in got} == users


def test_titles_with_entities(spark, tmp_path):
    pages = ["<html lang=\"en\"><title>A &amp; B</title>", "<title> x &lt;y&gt;\n&#233;</title>", "<title>R&D</title>", "<title>plain</title>", "no title"]
    rows = [(i, "u", p) for i, p in enumerate(pages)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["html_summary"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [(0, "A & B", "en"), (1, "x <y> é", ""), (2, "R&D", ""), (3, "plain", ""), (4, "", "")]
    assert catalog.QUERIES["html_summary"](spark, SF).count() == catalog.table(spark, SF, "pages").count()


def test_sheet_spans_the_grid(spark):
    assert [cell(*place(x)) for x in ("A1", "Z9", "AA10", "ZZ1", "AAA3")] == ["A1", "Z9", "AA10", "ZZ1", "AAA3"]
    values = [r.l_quantity for r in catalog.table(spark, SF, "lineitem").select("l_quantity").collect()]
    got = catalog.QUERIES["sheet_sum_avg"](spark, SF).first()
    assert round(got["sum"], 4) == round(sum(values), 4) and (got["min"], got["max"]) == (min(values), max(values))


def test_diff_returns_lines_of_odd_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb"), (2, "b\nc"), (3, "d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "c\nz")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.line: r.n for r in catalog.QUERIES["diff_lines"](spark, str(tmp_path)).collect()}
    assert got == {"a": 1, "b": 2, "d": 1}


def test_titles_cut_in_an_entity(spark, tmp_path):
    """As the SQL: a reference without its semicolon is no reference."""
    cut = ["A &amp; B &amp", "x &lt", "x &#39", "&ampx; &amp;lt;", "a&quot b"]
    rows = [(i, "u", f"<html><title>{t}</title><p>&amp x</p>") for i, t in enumerate(cut)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [r.title for r in catalog.QUERIES["html_summary"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == ["A & B &amp", "x &lt", "x &#39", "&ampx; &lt;", "a&quot b"]


def test_relations_of_repeated_and_negative_customers(spark, tmp_path):
    """As the SQL: a customer's row has its own name, and customers' keys never meet suppliers'."""
    customers = [(1, "c1", "BUILDING"), (1, "c1", "BUILDING"), (1, "other", "BUILDING"), (2, "c2", "MACHINERY"), (-3, "below", "BUILDING"), (-5, "lower", "BUILDING"), (4, "c4", "BUILDING")]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, f"s{i}") for i in range(11)], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = sorted(tuple(r) for r in QUERIES["page_relations"](spark, str(tmp_path)).collect())
    assert got == [("c1", "s2"), ("c1", "s2"), ("c4", "s5"), ("other", "s2")]


def _viewing(spark):
    rng = random.Random(3)
    tf = {(i, t): rng.randrange(1, 4) for i in range(40) for t in rng.sample("abcdefghijklmnopqrst", 6)} | {(i, "all"): 1 for i in range(39)}
    views = [(rng.randrange(12) or None, rng.randrange(42)) for _ in range(200)] + [(0, 3)]
    return tf, views, spark.createDataFrame([(*k, n) for k, n in tf.items()], "item_id long, term string, freq long"), spark.createDataFrame(views, "user_id long, item_id long")


def _users(tf, views):
    found = defaultdict(Counter)
    for u, i in views:
        found[u].update({t: n for (j, t), n in tf.items() if j == i})
    return found


def test_user_terms_by_groups(spark):
    """Terms are summed where a group's users meet packed items, not by a shuffle of every view's terms."""
    tf, views, items, seen = _viewing(spark)
    want = {(u, t, n) for u, c in _users(tf, views).items() for t, n in c.items()}
    for block in (250_000, 10):
        rows = R.user_tf(items, seen, block)
        assert {(r.user_id, r.term, r.freq) for r in rows.collect()} == want and rows.count() == len(want)
    assert "Join" in rows._jdf.queryExecution().executedPlan().toString() and rows.where("abs(log_freq - 1 - log10(freq)) > 1e-12").count() == 0
    assert R.user_tf(items, seen.where("user_id = 99")).count() == 0


def _cosines(tf, views):
    df = Counter(t for _, t in tf)
    idf = {t: math.log10(40 / (n + 1)) for t, n in df.items()}
    for u, c in _users(tf, views).items():
        own = {t: (1 + math.log10(n)) * idf[t] for t, n in c.items() if idf[t]}
        for i in range(40):
            x = [(own[t], (1 + math.log10(n)) * idf[t]) for (j, t), n in tf.items() if j == i and t in own]
            if x:
                yield u, i, sum(a * b for a, b in x) / math.sqrt(sum(a * a for a, _ in x)) / math.sqrt(sum(b * b for _, b in x))


def test_cosines_by_groups_and_blocks(spark):
    tf, views, items, seen = _viewing(spark)
    want = {(u, i): s for u, i, s in _cosines(tf, views)}
    for sizes in ((250_000, 65_536), (20, 7)):
        got = {(r.user_id, r.item_id): r.similarity for r in R.similar(items, seen, None, *sizes).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - s) < 1e-9 for k, s in want.items())


def test_best_unseen_by_groups_and_blocks(spark):
    tf, views, items, seen = _viewing(spark)
    best = defaultdict(list)
    for u, i, s in _cosines(tf, views):
        if u is None or (u, i) not in views:
            best[u].append((-round(s, 6), i))
    want = {(u, i, k + 1) for u, x in best.items() for k, (_, i) in enumerate(sorted(x)[:3])}
    for sizes in ((250_000, 65_536), (20, 7)):
        got = R.similar(items, seen, 3, *sizes).selectExpr("user_id", "item_id", "round(similarity, 6) similarity")
        assert {(r.user_id, r.item_id, r["rank"]) for r in R.top_items(got, seen).collect()} == want


def _held(coded):
    rows = coded.collect()
    return R._Items([(np.array(r.ids), r.pack, r.words) for r in sorted(rows, key=lambda r: (r.part, r.ids[0]))])


def test_cosines_laid_out_in_turns(spark):
    """Items are held as whole numbers, some bytes an entry, and laid out some at a time for some users at a time."""
    items = spark.range(300_000).selectExpr("id % 2000 item_id", "concat('t', ((id % 2000) * 7 + 13 * (id div 2000)) % 997) term", "1 + (id div 2000) % 3 freq")
    seen = spark.range(3000).selectExpr("id % 30 user_id", "(id * 17) % 2000 item_id")
    held = _held(R._coded(items))
    assert held.size.sum() == 300_000 > R._LAID and held.code.nbytes + held.freq.nbytes == 5 * 300_000
    assert len(R._Targets(held, np.arange(2000), 2000).blocks) > 1
    m = np.zeros((2000, 997))
    k = np.arange(150)
    for i in range(2000):
        m[i, (i * 7 + 13 * k) % 997] = 1 + k % 3
    n = np.zeros((30, 2000))
    for j in range(3000):
        n[j % 30, j * 17 % 2000] += 1
    idf, u = np.log10(2000 / ((m > 0).sum(0) + 1)), n @ m
    told = lambda x: np.where(x > 0, (1 + np.log10(np.maximum(x, 1))) * idf, 0)
    a, b = told(u), told(m)
    want = a @ b.T / np.sqrt(a * a @ (b != 0).T) / np.sqrt((a != 0) @ (b * b).T)
    got = R.similar(items, seen).toPandas()
    assert len(got) == 60_000 and abs(got["similarity"] - want[got["user_id"], got["item_id"]]).max() < 1e-9


def test_user_terms_by_shelves(spark):
    """What users meet is packed: no row of a meeting has an item's terms as text, and shelves have terms of their own."""
    tf, views, items, seen = _viewing(spark)
    coded = R._coded(items)
    met = R._met(coded, R._grouped(R._counted(seen), 2), 2, 3, True)
    assert {"term", "freq", "item_id"}.isdisjoint(met.columns) and met.rdd.getNumPartitions() == 6
    shelves = [set(_held(coded.where(f"part % 3 = {k}")).terms.to_pylist()) for k in range(3)]
    assert sum(map(len, shelves)) == len(set.union(*shelves)) == len({t for _, t in tf})
    held = _held(coded)
    told = {(i, held.terms[c].as_py()): f for i, at, n in zip(held.ids.tolist(), held.start, held.size) for c, f in zip(held.code[at : at + n].tolist(), held.freq[at : at + n].tolist())}
    assert told == tf


def test_equal_cosines_of_copies(spark):
    """Of many copies of an item, only those that may be among a user's best are written."""
    items = spark.range(50).selectExpr("id item_id", "explode(array('a', 'b')) term", "1L freq").union(spark.createDataFrame([(90, "a", 2)], "item_id long, term string, freq long"))
    got = R.similar(items, spark.createDataFrame([(1, 0), (2, 90), (None, 90)], "user_id long, item_id long"), 3, 250_000, 7)
    assert got.count() <= 3 * 3 * 8
    best = {(r.user_id, r["rank"]): r.item_id for r in R.top_items(R.similar(items, spark.createDataFrame([(1, 0)], "user_id long, item_id long"), 3), spark.createDataFrame([(1, 0)], "user_id long, item_id long")).collect()}
    assert [best[1, k] for k in (1, 2, 3)] == [1, 2, 3]


def test_blocks_of_pairs_are_packed(spark):
    """A block of ids goes to a pair of blocks as one value, not id by id."""
    items = spark.range(4000).selectExpr("1L part", "id % 1000 id", "id div 200 feature")
    rows = X._pair_blocks(items, 100)
    assert rows.count() == 10 * 10 and "features" not in rows.columns
    got = X.shared_weights(items, 100)
    features = {i: {(i + 1000 * k) // 200 for k in range(4)} for i in range(1000)}
    want = sum(bool(features[a] & features[b]) for a in range(1000) for b in range(a + 1, 1000))
    assert got.count() == want == got.select("a", "b").distinct().where("a < b").count()

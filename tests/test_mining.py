"""Formats, differences, segmentation, clusters, learning and crawl tables against plain Python."""

import itertools
import random
import re
import shutil
import struct
import subprocess
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera import registry
from tessera.functions import codecs as C
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import crawl as W
from tessera.operators import learn as L
from tessera.operators import mining as X
from tessera.operators import social as S
from tessera.sources import formats as Z

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lcs_length(a, b):
    best = {}
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        best[i, j] = 0 if not i or not j else best[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(best[i - 1, j], best[i, j - 1])
    return best[len(a), len(b)]


def test_differences(tmp_path):
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 9))] for _ in range(2))
        pairs = X.common_lines(a, b)
        assert len(pairs) == lcs_length(a, b) and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        told = X.line_diff("\n".join(a), "\n".join(b))
        (tmp_path / "a").write_text("\n".join(a) + "\n")
        (tmp_path / "old").write_text(told + "\n" if told else "")
        out = subprocess.run(["patch", "-s", "-o", "-", str(tmp_path / "a"), str(tmp_path / "old")], capture_output=True, text=True) if told and shutil.which("patch") else None
        if out is not None and out.returncode == 0:
            assert out.stdout == "\n".join(b) + "\n"
        assert (told == "") == (a == b)
    assert X.line_diff("a\nb\nc", "a\nx\nc\nd") == "2c2\n< b\n---\n> x\n3a4\n> d" and X.line_diff("a\nb", "a") == "2d1\n< b"


def test_segmentation():
    cost = {"the": 1.0, "them": 3.0, "me": 2.0, "menu": 2.5, "a": 1.0, "t": 4.0}
    best = lambda t: min((sum(cost.get(w, 20.0) for w in p) for k in range(len(t)) for c in itertools.combinations(range(1, len(t)), k) for p in [[t[i:j] for i, j in zip((0, *c), (*c, len(t)))]] if all(w in cost or len(w) == 1 for w in p)), default=0.0)
    for t in ("themenu", "theme", "amenut", "xthe", "aaa"):
        split = X.cheapest_split(t, cost, 20.0, 4)
        assert "".join(split) == t and sum(cost.get(w, 20.0) for w in split) == pytest.approx(best(t))
    assert X.reverse_match("themenu", set(cost), 4) == ["the", "menu"] and X.reverse_match("themx", set(cost), 4) == ["them", "x"] and X.cheapest_split("", cost, 1.0, 4) == []


def test_trees_and_clusters(spark):
    rng = random.Random(4)
    rows = [(p, a, b, round(rng.random(), 3)) for p in (1, 2) for a, b in itertools.combinations(range(10), 2) if rng.random() < 0.7]
    edges = spark.createDataFrame(rows, "part long, a long, b long, weight double")
    tree = [tuple(r) for r in X.spanning_tree(edges).collect()]
    for p in (1, 2):
        reach, total = {0}, 0.0  # Prim's algorithm
        mine = [r for r in rows if r[0] == p]
        while len(reach) < 10:
            a, b, w = min(((a, b, w) for _, a, b, w in mine if (a in reach) != (b in reach)), key=lambda e: e[2])
            reach |= {a, b}
            total += w
        assert sum(r[3] for r in tree if r[0] == p) == pytest.approx(total) and sum(r[0] == p for r in tree) == 9
    got = {(r.part, r.id): r.cluster for r in X.cut_clusters(X.spanning_tree(edges), 0.2).collect()}
    for p in (1, 2):
        low = {i: i for i in range(10)}
        for _ in range(10):
            for _, a, b, w in [r for r in rows if r[0] == p and r[3] <= 0.2]:
                low[a] = low[b] = min(low[a], low[b])
        assert {i: got[p, i] for i in range(10)} == low


def test_pairs_by_blocks(spark):
    """All pairs of all blocks, none of them through a shuffle; the forest is that of all pairs."""
    rng = random.Random(6)
    sets = {(p, i): set(rng.sample(range(12), rng.randrange(1, 5))) for p in (1, 2) for i in rng.sample(range(-50, 500), 70)} | {(3, 1): {5}, (3, 2): {6}}
    items = spark.createDataFrame([(p, i, f) for (p, i), s in sets.items() for f in s], "part long, id long, feature long")
    want = {(p, a, b): 1 - len(x & y) / max(len(x), len(y)) for (p, a), x in sets.items() for (q, b), y in sets.items() if p == q and a < b and x & y}
    edges = spark.createDataFrame([(*k, w) for k, w in want.items()], "part long, a long, b long, weight double")
    tree = sorted(map(tuple, X.spanning_tree(edges).collect()))
    for size in (8192, 16):
        got = X.shared_weights(items, size)
        assert sorted(map(tuple, got.collect())) == sorted((*k, w) for k, w in want.items())
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, X.shared_tree(items, size).collect())) == tree
    assert X.shared_weights(items.where("part = 9")).count() == 0


def test_phrases_and_learning(spark):
    grams = spark.createDataFrame([(["a", "b"], 5), (["a", "b", "c"], 5), (["b", "c"], 7), (["x"], 1)], "terms array<string>, n long")
    assert {tuple(r.terms): r.n for r in X.maximal_phrases(grams, 2).collect()} == {("a", "b", "c"): 5, ("b", "c"): 7}
    rng = random.Random(1)
    rows = [(i, t) for i in range(120) for t in {rng.choice("uvwxyz") for _ in range(4)} | ({"hot"} if i % 3 == 0 else {"cold"})]
    features = spark.createDataFrame(rows, "doc_id long, term string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100)], "doc_id long, label long")
    assert all(r.correct == r.docs for r in X.cross_accuracy(features, L.folds(labels)).collect())
    model, vectors = X.lasso(features, labels, most=8)
    got = {r.doc_id: r.prediction for r in model.transform(vectors).collect()}
    assert all(got[i] == float(i % 3 == 0) for i in range(120))
    members = X.committee(L.stats(features, labels), 3, 5)
    assert members.count() == 3 * 8 and [r.score for r in X.most_wanted(features.where("doc_id >= 100"), members, 5).collect()] == sorted((r.score for r in X.most_wanted(features.where("doc_id >= 100"), members, 5).collect()), reverse=True)
    assert X.lasso_penalty(4.0, 8, 2) == pytest.approx(2**0.5 / 2)


def test_frequent_runs_by_any_number_of_counters(spark):
    rng = random.Random(8)
    rows = [([rng.choice("aabbcdefgh") for _ in range(rng.randrange(40))],) for _ in range(60)] + [(None,), ([],), (["a"],)]
    want = Counter(tuple(t[i : i + k]) for (t,) in rows if t for k in (2, 3, 4) for i in range(len(t) - k + 1))
    texts = spark.createDataFrame(rows, "ts array<string>").repartition(3)
    for least, bits in ((5, 9), (5, 16), (300, 9)):
        got = X.frequent_grams(texts, 4, least, bits)
        assert {tuple(r.terms): r.n for r in got.collect()} == {g: n for g, n in want.items() if n >= least}
    # Its source is read and shuffled once.
    grams = spark.createDataFrame([(list(g), n) for g, n in want.items()], "terms array<string>, n long")
    assert X.maximal_phrases(grams, 5)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_formats():
    for kind in ("docx", "pptx", "xlsx", "epub", "rtf", "zip", "gz", "bz2", "atom", "rss", "svg"):
        p = Z.parsed(Z.written("T & <x>", "one & two <é> {漢}\\ 🙂", kind), kind)
        shown = "one & two   {漢}\\ 🙂" if kind in ("atom", "rss") else "one & two <é> {漢}\\ 🙂"  # feeds hold markup
        assert p.text.strip() == shown and (p.title == "T & <x>" or kind in ("rtf", "gz", "bz2")), kind
    assert Z.parsed(b"a,b\n1,\"x,y\"\n", "csv").text == "a b\n1 x,y" and Z.parsed(b"a\tb\n1\t2\n", "tsv").title == "a b"
    assert Z.parsed(b"<urlset><url><loc>http://a/</loc></url></urlset>", "sitemap").links == ["http://a/"]
    assert Z.parsed(b"class FooBar { int maxValue2; }", "java").text == "class Foo Bar int max Value" and Z.parsed(b"def run_all(): pass", "py").title == "run_all"
    stream = zlib.compress(b"BT (Hello \\(x\\)) Tj ET")
    pdf = b"%PDF /Title (My title) /URI (http://u/) stream\n" + stream + b"\nendstream"
    assert (Z.parsed(pdf, "pdf").text, Z.parsed(pdf, "pdf").title, Z.parsed(pdf, "pdf").links) == ("Hello (x)", "My title", ["http://u/"])
    assert Z.parsed(b"\0\1" + "old words here".encode("utf-16-le") + b"\0", "doc").text == "old words here"
    assert Z.parsed(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 9, 4), "png").width == 9
    assert Z.parsed(b"not a zip", "docx").text == "" and Z.parsed(None, "docx").text == "" and Z.parsed(b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>", "xml").text == ""


def test_snippets_against_python(spark):
    """All documents: windows around whole words."""
    got = {r.doc_id: r.snippet for r in registry.QUERIES["snippet"](spark, SF).collect()}
    for r in registry.catalog.table(spark, SF, "documents").collect():
        found = [m[0].strip(" ") for m in regex.finditer(r"(?is).{0,20}(?<![\p{L}\p{N}_])(?:the|der)(?![\p{L}\p{N}_]).{0,40}", r.text)]
        assert got[r.doc_id] == (" ... ".join(found[:3]) if found else r.text[:60])


def test_codecs(spark):
    assert C.unpack_words(C.pack_words([151466751, 11746, 11746])) == [151466751, 11746, 11746]
    rng = random.Random(3)
    for _ in range(200):
        v = [rng.randint(1, 1 << rng.randint(1, 27)) for _ in range(rng.randint(1, 60))]
        assert C.unpack_words(C.pack_words(v)) == v
    for doc, at in ((10, list(range(1, 129))), (33689, [254, 12000, 24000]), (100000, [6000, 12000, 24000]), (0, [1, 4, 7, 174])):
        assert C.unpack_posting(C.pack_posting(doc, at)) == (doc, at)
    assert one(spark, C.varbyte(F.array(F.lit(5), F.lit(300), F.lit(0)))) == "052C8200" and one(spark, C.unvarbyte(F.lit("052C8200"))) == [5, 300, 0]
    assert one(spark, C.unvarbyte(C.varbyte(F.array(F.lit((1 << 40) + 5))))) == [(1 << 40) + 5]
    assert one(spark, C.undelta(C.delta(F.array(F.lit(3), F.lit(9), F.lit(10))))) == [3, 9, 10]
    assert one(spark, C.pixels(F.lit("50%"))) == 400 and one(spark, C.pixels(F.lit("2in"))) == 144 and one(spark, C.metric_text(F.lit(4000))) == "4K"
    assert 0 <= one(spark, C.private_count(F.lit(5), F.lit(0.99999))) <= 10


def test_urls_and_texts(spark):
    u = lambda f, x, *a: one(spark, f(F.lit(x), *a))
    assert u(U.display_url, "https://a.b/c%20d/", 60) == "a.b/c%20d" and u(U.display_url, "http://" + "x" * 50, 10) == "x" * 8 + "..." + "xx"
    assert u(U.language, "http://it.wikipedia.org/x") == "it" and u(U.language, "http://a.qc.ca/") == "fr" and u(U.language, "http://a.zz/") is None and u(U.language, "http://a.com/") == "en"
    assert u(U.host_words, "http://www.big-dog.org/") == "big dog" and u(U.host_words, "http://a.b/c") == "" and u(U.last_path_words, "http://a/b/c_d-e.html") == "c d e"
    sites = ["domain:foo.com", "regex:/z\\d$", "http://e.org/a*$"]
    assert [u(U.member_of, x, sites) for x in ("http://x.foo.com/", "http://q/z1", "http://e.org/abc", "http://e.org/b")] == [True, True, True, False]
    assert u(U.may_crawl, "http://x.foo.com/a.pdf", sites, [], ["html"]) is False and u(U.is_localhost, "http://localhost:80/") and not u(U.has_host, "a/b")
    assert u(T.expanded, "I'm gonna say it's o'k, they'll go") == "I am going to say it is o'k,  they will go"
    assert u(T.wrapped, "aa bbb cccccccc", 4) == "aa\nbbb\ncccc\ncccc\n" and u(T.safe_tag, '<A HREF="x" onclick="y">', ("href",)) == '<a HREF="x">'
    assert one(spark, T.as_text(F.lit(b"\xe9t\xe9"))) == "été" and u(T.joined_entities, "of the and the of", ("of the", "the and the")) == "of the-and-the of"


def test_crawl_tables(spark):
    edges = spark.createDataFrame([("http://a.com/", f"http://sub{i % 5}.a.com/{i}") for i in range(40)] + [("http://a.com/", "http://b.org/")] + [("http://c.net/", "http://c.net/x")], "src string, dst string")
    got = {r.src: r.common for r in W.common_domains(edges, 6).collect()}
    assert got == {"http://a.com/": -1, "http://c.net/": 1}
    four = spark.createDataFrame([("http://a.com/", x) for x in ("http://a.com/1", "http://b.org/", "http://c.org/", "http://d.org/")], "src string, dst string")
    got = {r.url: r.weight for r in W.spread_weight(four, spark.createDataFrame([("http://a.com/", 100)], "src string, w long")).collect()}
    assert got == {"http://a.com/1": 12, "http://b.org/": 29, "http://c.org/": 29, "http://d.org/": 29}
    links = spark.createDataFrame([(1, "u", "one two three"), (1, "v", "a"), (1, "w", "one two"), (1, "x", None)], "page long, dst string, text string")
    kept = {r.dst: r.told for r in W.prune_links(links, 2).collect()}
    want = {"u": 3.0, "w": 2.0}  # short texts do not compress
    assert kept == pytest.approx(want)
    rules = spark.createDataFrame([("h.com", "disallow", U.path_rule_regex("/trap")), ("h.com", "allow", U.path_rule_regex("/trapeze"))], "host string, kind string, pattern string")
    urls = spark.createDataFrame([("http://h.com/trap/1",), ("http://h.com/trapeze",), ("http://h.com/",), ("http://i.com/trap",)], "url string")
    assert {r.url: r.allowed for r in W.robots_filter(urls, rules).collect()} == {"http://h.com/trap/1": False, "http://h.com/trapeze": True, "http://h.com/": True, "http://i.com/trap": True}


def test_weighted_sampling(spark):
    rows = spark.createDataFrame([(f"t{i}", 1 + 99 * (i == 0)) for i in range(50)], "term string, w long")
    first = [{r.term for r in S.weighted_sample(rows, "w", "term", 5, s).collect()} for s in range(12)]
    assert sum("t0" in f for f in first) >= 10 and all(len(f) == 5 for f in first) and first[0] == {r.term for r in S.weighted_sample(rows, "w", "term", 5, 0).collect()}
    runs = spark.createDataFrame([Row(k="a", p=i, kind=k) for i, k in enumerate("xxyx")])
    assert sorted((r["first"], r["size"], r["kind"]) for r in S.media_groups(runs, "kind", "p", ["k"]).collect()) == [(0, 2, "x"), (2, 1, "y"), (3, 1, "x")]


def test_summaries_against_plain_loops():
    """Scores of the three methods from their formulas, sentence by sentence."""
    import math

    from tessera.operators import summarize as Y

    rng = random.Random(6)
    parts = [" ".join(rng.choice("sun moon star sky sea land tree rain wind snow".split()) for _ in range(rng.randint(2, 8))) + "." for _ in range(30)]
    words = [[w for w in re.findall(r"[a-z]+", p)] for p in parts]
    n = {t: sum(t in w for w in words) for w in words for t in w}
    rows = [{t: (1 + math.log(w.count(t))) * math.log(len(parts) / n[t]) for t in set(w)} for w in words]
    length = lambda r: math.sqrt(sum(v * v for v in r.values()))
    dot = lambda a, b: sum(v * b.get(t, 0.0) for t, v in a.items())
    mean = {t: sum(r.get(t, 0.0) for r in rows) / len(rows) for t in n}
    assert Y.centroid(parts).tolist() == pytest.approx([dot(r, mean) / (length(r) * length(mean)) if length(r) else 0.0 for r in rows])
    unit = [{t: v / length(r) for t, v in r.items()} if length(r) else r for r in rows]
    c = {t: sum(r.get(t, 0.0) / (1 + i**0.8) for i, r in enumerate(unit)) for t in n}
    c = {t: v / length(c) for t, v in c.items()}
    want, left = [0.0] * len(parts), set(range(len(parts)))
    while left:
        i = max(left, key=lambda k: (dot(unit[k], c), -k))
        if dot(unit[i], c) <= 0:
            break
        want[i] = dot(unit[i], c)
        left.discard(i)
        c = {t: v - v * unit[i].get(t, 0.0) for t, v in c.items()}
    assert Y.weighted(parts).tolist() == pytest.approx(want)

    def far(a, b):
        pa, pb = ({t for t, v in x.items() if v > 0} for x in (a, b))
        return sum((a.get(t, 0.0) - b.get(t, 0.0)) ** 2 for t in {*a, *b}) / len(pa ^ pb) if pa ^ pb else 0.0

    r = [1 / len(parts)] * len(parts)
    for _ in range(10):
        r = [sum(far(a, b) * s for b, s in zip(unit, r)) for a in unit]
        r = [v / sum(r) for v in r]
    assert Y.graph(parts).tolist() == pytest.approx([v / (1 + i**0.4) for i, v in enumerate(r)])
    text = " ".join(parts)
    for m in Y.METHODS:
        order = sorted(range(len(parts)), key=lambda i: (-round(float(Y.METHODS[m](parts)[i]), 9), i))
        taken, used = [], 0
        for i in order:
            if used + len(parts[i]) <= 120 or not taken:
                taken.append(i)
                used += len(parts[i])
        assert Y.summary(text, m, 120) == " ".join(parts[i] for i in sorted(taken))

"""Hand-worked cases of the query language, scoring, URL rules, sources and streams."""

import gzip

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.functions import codecs as C
from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.functions import vectors as V
from tessera.functions.stem import porter
from tessera.operators import learn as L
from tessera.operators import store
from tessera.operators import scoring as S
from tessera.operators.summarize import METHODS, summary
from tessera.plans import search as P
from tessera.plans.parser import Block, guess, mix, parse
from tessera.sources.archives import WarcSource, read_delimited
from tessera.sources.pages import parse_html, robots_rules


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def conjunct(text):
    return parse(text, guesses=False).blocks[0].disjuncts[0]


def test_parse():
    c = conjunct('cats "of * the" -dogs lang:en -site:a.b i:7 w:0.5')
    assert c.terms == ("cats",) and c.phrases == (("of", None, "the"),) and c.without == ("dogs",)
    assert c.fields == (("lang", "en"),) and c.not_fields == (("site", "a.b"),) and c.index == "7" and c.weight == 0.5
    q = parse("#3# a | b | a #2# c", guesses=False)
    assert [(b.most, len(b.disjuncts)) for b in q.blocks] == [(3, 2), (2, 1)]
    assert conjunct("x if:x!yes+no!other").terms == ("x", "yes", "no")
    assert conjunct("z if:x!yes!other").terms == ("z", "other")
    assert guess("www.example.com") == "site:example.com" and guess("plain words") == "plain words"
    assert parse("").blocks == (Block((conjunct(""),)),)
    assert mix("q", [(5, [("1", 1.0, ""), ("2", 0.5, "k")])]) == "#5# q i:1 w:1 | q k i:2 w:0.5".replace("q i", "q i")


COVERS = [([[1, 10], [3, 12]], 19 / 6), ([[1, 100], [3, 102]], 4 / 3 + 1 / 98 + 1 / 3), ([[1, 2], [3]], 2.0), ([[5], [90]], 1 / 86)]


@pytest.mark.parametrize("lists,score", COVERS)
def test_cover_score(spark, lists, score):
    df = spark.createDataFrame([Row(l=[Row(term=str(i), positions=p) for i, p in enumerate(lists)])])
    assert df.select(S.cover_score(F.col("l"))).first()[0] == pytest.approx(score)


def test_fusion_and_grouping(spark):
    df = spark.createDataFrame([(1, 9.0, 9.0), (2, 8.0, 8.0), (3, 8.0, 9.0)], "doc_id long, a double, b double")
    got = {r.doc_id: r.score for r in S.fuse(df, ("a", "b")).collect()}
    assert got == {r.doc_id: r.score for r in S.fuse(df, ("a", "b"), rows=3).collect()}
    assert got[1] == pytest.approx(600 / 59) and got[2] == pytest.approx(600 / 60) and got[3] == pytest.approx(300 / 60 + 300 / 59)
    items = spark.createDataFrame([(i, "u", "h", "c", 4.0, 1.0, 1.0) for i in range(3)], "item_id long, url_hash string, host_hash string, hash string, rank double, relevance double, proximity double")
    assert S.group_by_url(items).first()["rank"] == 7.0
    assert one(spark, S.bm(F.lit(3.0), F.lit(5.0), F.lit(5.0), F.lit(1), F.lit(10), 1.0)) == pytest.approx(1.661244, abs=1e-6)


def test_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat", "en", "a"), (2, "cat the sat", "en", "b"), (3, "the dog", "en", "a"), (4, None, "fr", "a"), (5, "", "en", "a")], "doc_id long, text string, lang string, source string")
    ids = lambda q: sorted(r.doc_id for r in P.conjunct_docs(docs, conjunct(q)).collect())
    assert ids("the cat") == [1, 2] and ids('"the cat"') == [1] and ids("the -dog") == [1, 2] and ids('"the * sat"') == [1]
    assert ids("-the lang:en") == [5] and ids("cat source:b") == [2] and ids("nothing") == []
    index = store.build(docs, str(tmp_path / "index"))
    stored = lambda q: sorted(r.doc_id for r in P.matches(index, conjunct(q)).collect())
    for q in ("the cat", '"the cat"', "the -dog", '"the * sat"', "-the lang:en", "cat source:b", "nothing", "-the", "-dog -cat", "lang:fr"):
        assert stored(q) == ids(q), q
    assert ids("-the") == [4, 5]  # a document without text has no word
    assert [r["rank"] for r in P.search(index, "the", most=2).orderBy("rank").collect()] == [1, 2]
    plan = P.explain(index, "the")
    assert "PartitionFilters" in plan and "In(term" in plan.replace("EqualTo(term", "In(term")
    more = store.append(index, spark.createDataFrame([(9, "the cat", "en", "z")], docs.schema), str(tmp_path / "more"))
    assert sorted(r.doc_id for r in P.matches(more, conjunct("the cat")).collect()) == [1, 2, 9] and more.docs == 6 and more.num_docs(["the", "none"]) == {"the": 4, "none": 0}


LINKS = [("../bob", "http://www.example.com/a", None), ("bob", "http://www.example.com/a/b", "http://www.example.com/a/bob"), ("../bob", "http://www.example.com/a/", "http://www.example.com/bob"), ("/x#y", "http://e.com/q", "http://e.com/x"), ("//f.com/z", "https://e.com/", "https://f.com/z"), ("http://g.com/", "http://e.com/", "http://g.com/")]


@pytest.mark.parametrize("link,base,want", LINKS)
def test_resolve(spark, link, base, want):
    assert one(spark, U.resolve(F.lit(link), F.lit(base))) == want


def test_urls(spark):
    u = F.lit("https://aaa.bbb.cc.edu:81/a/b.pdf?q=1#f")
    assert one(spark, U.company_domain(u)) == "cc.edu" and one(spark, U.port(u)) == 81 and one(spark, U.extension(u)) == "pdf"
    assert one(spark, U.company_domain(F.lit("https://x.somewhere.co.uk/"))) == "somewhere.co.uk"
    assert one(spark, U.file_name(u)) == "b" and one(spark, U.query(u)) == "q=1" and one(spark, U.fragment(u)) == "f"
    assert one(spark, U.host_name(F.lit(None).cast("string"))) is None
    assert one(spark, U.recursive(F.lit("http://h/a/b/a/b/a/b/a")))
    assert one(spark, U.robots_allowed(F.lit("/trapdoor"), ["/trapdoor"], ["/trap"])) and not one(spark, U.robots_allowed(F.lit("/trap"), ["/trapdoor"], ["/trap"]))
    assert one(spark, U.robots_allowed(F.lit("/x"), [], []))


def test_text_and_codecs(spark):
    assert one(spark, T.char_ngrams(F.lit("orange"), 3)) == ["ora", "ran", "ang", "nge"] and one(spark, T.char_ngrams(F.lit("orange"), 6)) == ["orange"]
    assert one(spark, T.tokens(F.lit(" Ä-b  c1 "))) == ["ä", "b", "c1"]
    assert one(spark, T.acronyms(F.lit("U.K. and A&W"))) == "_uk and a_and_w"
    assert one(spark, C.undelta(C.delta(F.array(*map(F.lit, (3, 9, 10)))))) == [3, 9, 10]
    assert one(spark, C.metric_int(F.lit("4K"))) == 4000
    assert one(spark, C.web_unbase64(C.web_base64(F.lit("ü?>~")))) == "ü?>~"
    w, depth = C.queue_unweight(C.queue_weight(F.lit(10), F.lit(9)))
    assert (one(spark, w), one(spark, depth)) == (10, 9)
    assert one(spark, V.distortion(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("b"), F.lit(2.0)))) == 2.5


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("sky", "sky"), ("happy", "happi"), ("adjustable", "adjust"), ("abashed", "abash"), ("is", "is")])
def test_porter(word, stem):
    assert porter(word) == stem


def test_learning(spark):
    s = spark.createDataFrame([("t", 8, 2, 10, 10)], "term string, tl long, tnl long, pos long, neg long").withColumns({"ntl": F.col("pos") - F.col("tl"), "ntnl": F.col("neg") - F.col("tnl")})
    assert L.chi2(s).first().chi2 == pytest.approx((8 * 8 - 2 * 2) ** 2 / (10 * 10))
    assert L.decile_classes(spark.createDataFrame([(1, 0.72), (2, 0.3)], "doc_id long, p double"), "x").first().words == ["class:x", "class-score:x:70plus", "class-score:x:60plus", "class-score:x:50plus"]


def test_pages_and_summaries():
    p = parse_html('<html lang="en"><title>T &amp; U</title><meta name="robots" content="noindex, follow"><script>x<y</script><p>Hi <a href="/a">go <img alt="pic"></a><a rel="nofollow" href="/b">no</a>')
    assert p["title"] == "T & U" and p["text"] == "Hi go no" and p["links"] == [{"href": "/a", "anchor": "go pic"}] and p["robots"] == ["NOINDEX", "FOLLOW"]
    assert robots_rules("User-agent: *\nDisallow: /\nUser-agent: mybot\nAllow: /a\nCrawl-delay: 3", "MyBot/1") == (["/a"], [], 3)
    for m in METHODS:
        assert summary("", m) == "" and summary("One word.", m) == "One word."
        assert set(summary("Cats eat fish. Cats eat birds. Rain falls.", m, 30).split()) <= set("Cats eat fish. birds. Rain falls.".split())


def test_sources(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://e.com/\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc.gz").write_bytes(gzip.compress(record * 2))
    spark.dataSource.register(WarcSource)
    rows = spark.read.format("warc").load(str(tmp_path / "w")).collect()
    assert [(r.url, r.code, r.type, bytes(r.body)) for r in rows] == [("http://e.com/", 200, "text/html", b"<p>x</p>")] * 2
    (tmp_path / "t.txt").write_text("a##b\nc##")
    assert [r.record for r in read_delimited(spark, str(tmp_path / "t.txt"), "##").collect()] == ["a", "b\nc"]


def test_sheet():
    from tessera.functions.sheet import Sheet, place

    s = Sheet([["1", "2", "=A1+B1*3"], ["=8-3-2", "=sum(A1:B1, 4)", "=pow(2,3)%5"], ["x", "=C4", "=-(A1)"]])
    assert place("B3") == (2, 1) and place("AA1") == (0, 26)
    assert (s.value(0, 2), s.value(1, 0), s.value(1, 1), s.value(1, 2), s.value(2, 0), s.value(2, 2)) == (7, 3, 7, 3, "x", -1)
    with pytest.raises(ValueError):
        Sheet([["=B1", "=A1"]]).value(0, 0)
    with pytest.raises(ValueError):
        Sheet([["=1+"]]).value(0, 0)


def test_rules_and_markup(spark):
    from tessera.functions import wiki
    from tessera.operators.rules import apply_rules, emails, phones, word_filter

    df = spark.createDataFrame([("Ab Ab c", None), (None, "v")], "text string, x string")
    got = apply_rules(df, "y = text /[A-Z]b/\ntext = /b/d/\nz = 'a'\nz .= x\npushStack(st, z)\npopStack(st, top)\nunset(x)").collect()
    assert got[0].y == ["Ab", "Ab"] and got[0].text == "Ad Ad c" and got[0].z == "a" and got[1].z == "av" and got[1].top == "av" and got[1].st == [] and got[1].x is None
    acts = [sorted(r.actions) for r in word_filter(df, [("ab#2", "A"), ("-c", "B"), ("ab#0.5", "C")]).collect()]
    assert acts == [["A", "C"], ["B"]]
    assert one(spark, emails(F.lit("x a.b@c.org, a.b@c.org"))) == ["a.b@c.org"] and one(spark, phones(F.lit("call (408) 555-1234 now 12"))) == ["4085551234"]
    m = F.lit("== T ==\n'''b''' ''i'' [[P|q]] <x>\n* one\n* two\n")
    assert one(spark, wiki.to_html(m)) == '<h2>T</h2>\n<b>b</b> <i>i</i> <a href="P">q</a> &lt;x&gt;\n<ul><li>one</li>\n<li>two</li>\n</ul>'
    assert one(spark, wiki.links(m)) == ["P"] and one(spark, wiki.headings(m)) == [Row(level=2, title="T")]


def test_engine(spark):
    from tessera.engine import Engine

    docs = spark.createDataFrame([(1, "cat cat dog", "en", "a"), (2, "cat dog bird", "en", "a"), (3, "fish", "en", "b")], "doc_id long, text string, lang string, source string")
    e = Engine(docs)
    assert e.top_terms(1, 2) == ["cat", "dog"] and [r.doc_id for r in e.related(1).collect()] == [2]
    from tessera.engine import ResultCache, activity

    assert activity("related: 4") == ("related", ("4",)) and activity("trending:news:day") == ("trending", ("news", "day")) and activity("a cache:b") == ("search", ("a cache:b",))
    assert [r.doc_id for r in e.ask("related:1").collect()] == [2] and e.ask("cache:3").first().text == "fish" and e.version() == 1 and e.version("x") is None
    first = sorted(r.doc_id for r in e.ask("cat").collect())
    assert first == [1, 2] == sorted(r.doc_id for r in e.ask("cat").collect()) and len(e.results.known) == 1
    kept, made = ResultCache(spark, 1), []
    for key in "aab":
        assert kept.get(key, lambda: made.append(key) or spark.range(2)).count() == 2
    assert made == ["a", "b"] and list(kept.known) == ["b"]
    assert e.cached(3, ["fish"]).first().text == "<b>fish</b>" and e.search("cat").count() == 2

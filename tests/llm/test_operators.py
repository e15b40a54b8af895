"""Each operator over small tables with nulls, ties, repeats and clashing columns, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, hnsw, langid, minhash, mixing, sentencepiece_io, shared, suffix_dedup, tokenbin, topk_search, toxicity

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def passages():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    base = [word() for _ in range(120)]
    out = [None, "", "  ", "one", "one two three", "one two three", "z" * 450]
    for i in range(150):  # a family larger than a block of 64
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(20):
        out.append(" ".join(word() for _ in range(60)) + " " + " ".join(base[:40]) + " " + " ".join(word() for _ in range(30)))
    return out


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", f"s{i % 3}" if i % 5 else None, 0, 1, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rid long, n long, key string")


def empty(df):
    return df.where("false")


def test_minhash(spark):
    texts = passages()
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), k=3, percent=85).collect()}
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    low = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and low[i] != low[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    low[i] = low[j] = min(low[i], low[j])
                    changed = True
    assert [got[i].component_id for i in range(len(texts))] == low
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert minhash.near_duplicates(empty(frame(spark, texts))).collect() == []


def test_minhash_odd_ids(spark):
    """Null and repeated doc_ids are documents of their own; words that weak hashes confuse stay apart."""
    from test_kernels import THUE_MORSE

    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = [(4, a), (4, b), (None, a), (9, b), (None, "alone here now"), (1, THUE_MORSE[0]), (2, THUE_MORSE[1]), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rid", F.lit("clash"))
    got = minhash.near_duplicates(df, k=3, percent=85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(4, 4, True), (None, 4, False), (4, 4, True), (9, 4, False), (None, None, True), (1, 1, True), (2, 2, True), (3, 3, True)], key=repr)


@pytest.mark.parametrize("most", [4096, 1])
def test_suffix_dedup(spark, most):
    texts = passages()
    ids = [i if i not in (20, 21) else 5000 for i in range(len(texts))]  # two rows of one doc_id
    got = suffix_dedup.remove_repeats(frame(spark, texts, ids), most=most).collect()
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for d, b in zip(ids, raw):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((d, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), hashlib.sha256(left).hexdigest()))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    if most > 1:
        assert suffix_dedup.remove_repeats(empty(frame(spark, texts))).collect() == []


def test_components_by_stars(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (4, 4), *[(50, i) for i in range(60, 90)]], "a long, b long")
    for at_once in (0, 10**6):
        got = {r.id: r.component for r in shared.components(links, at_once).collect()}
        assert {got[i] for i in (1, 2, 3, 7, 8, 9)} == {1} and got[21] == 20 and {got[i] for i in range(60, 90)} == {50} and 4 not in got


def test_mixing(spark):
    rng = random.Random(1)
    texts = [None, ""] + [" ".join("w" for _ in range(rng.randint(1, 90))) for _ in range(600)]
    df = frame(spark, texts)
    rows = mixing.mix(df).collect()
    assert sorted(r.taken for r in rows) == sorted(r.taken for r in mixing.mix(df.repartition(3)).collect())
    size = {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in df.collect()}
    words: dict = {}
    for i, s in source.items():
        words[s] = words.get(s, 0) + size[i]
    order = sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while True:  # the excess of full sources is shared again
        left = sum(size.values()) - sum(target[s] for s in order if s not in open_)
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * words[s]}
        target |= {s: 3.0 * words[s] for s in over} | {s: share[s] for s in open_ - over}
        open_ -= over
        if not over:
            break
    taken = dict.fromkeys(order, 0)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == words[s] and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 90
    assert mixing.mix(empty(df)).collect() == []


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 6)).round(3)
    rows = [(i, x[i].tolist(), "c") for i in range(150)] + [(200, None, ""), (300, [], ""), (400, [1.0, None], ""), (500, [float("nan")] * 6, ""), (600, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ids string")
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, rows=16, group=2).orderBy("query_id", "rank").collect()
    q = np.floor(1024 * x).astype(int)
    for a in (0, 100):
        s = q @ q[a]
        order = [j for j in np.lexsort((np.arange(150), -s)) if j != a][:10]
        assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == a] == [(k + 1, j, s[j]) for k, j in enumerate(order)]
    assert {r.query_id for r in got} == {0, 100}
    assert topk_search.top_k(empty(df), F.col("vec_id") % 100 == 0).collect() == []
    # Rows of one vec_id are queries of their own, and no candidates of each other.
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (7, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [0.0, 3.0]), (None, [5.0, 5.0])], "vec_id long, embedding array<double>")
    rows = topk_search.top_k(twice, F.col("vec_id") == 0, k=2).collect()
    by_row = [[(r.rank, r.vec_id, r.score >> 20) for r in sorted(rows, key=lambda r: r.rank) if r.query_row == n] for n in {r.query_row for r in rows}]
    assert sorted(by_row) == [[(1, 7, 2), (2, 8, 2)], [(1, 9, 3), (2, 7, 0)]]


def test_hnsw(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x[:40] = x[0] + 0.02 * rng.normal(size=(40, 8))
    x[50] = x[51] = 2 * x[52]
    rows = [(i, x[i].tolist(), 1) for i in range(200)] + [(300, None, 1), (301, [0.0] * 8, 1), (302, [None] * 8, 1), (303, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: r for r in hnsw.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    assert [got[i].n_links for i in range(200)] == (link.sum(1) - 1).tolist()
    assert all(got[i].component_id == np.flatnonzero(link[i])[0] for i in range(60)) and len(got) == 204
    assert all(got[i].n_links == 0 and got[i].kept for i in (300, 301, 302, 303))
    assert hnsw.near_duplicates(empty(df)).collect() == []
    # Rows of one vec_id or none are vectors of their own; sizes that overflow a square are no matter.
    odd = spark.createDataFrame([(5, [1e200, 1e200], 0), (5, [1.0, 1.0], 0), (6, [1e-300, 1e-300], 0), (None, [2.0, 2.0], 0), (None, [1.0, -1.0], 0), (8, [], 0), (9, [1.0, float("inf")], 0)], "vec_id long, embedding array<double>, component_id int")
    rows = hnsw.near_duplicates(odd).collect()
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=repr)
    assert got == sorted([(5, 3, 5), (5, 3, 5), (6, 3, 5), (None, 3, 5), (None, 0, None), (8, 0, 8), (9, 0, 9)], key=repr)
    assert sum(r.kept for r in rows) == 4


def test_languages_and_toxicity(spark):
    rng = random.Random(3)
    words = {"en": "the thing that this with and of".split(), "de": "der die das und schön für ist".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=30)) + (" idiot" if i % 4 == 0 else ""), k, 1) for i, k in enumerate(["en", "de"] * 60)] + [(900, None, None, 1), (901, "12 34", None, 1), (902, "", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(docs, langid.train(docs.where(langid.fold(F.col("doc_id"), 5) != 0))).collect()}
    assert all(got[i].lang_pred == k and not got[i].rejected and 0 <= got[i].score <= 1 for i, _, k, _ in rows[:120])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert {r.lang_pred for r in langid.identify(docs, langid.train(empty(docs))).collect()} == {"und"}
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(120)) and got[900].predicted == 0 and got[902].score == got[900].score
    assert {r.predicted for r in toxicity.score(docs, toxicity.train(docs, empty(labels))).collect()} == {0}


def test_tokens_and_pieces(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    texts = passages()[:30]
    df = frame(spark, texts)
    path = vocabularies.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    start = 0
    for r, x in zip(tokenbin.token_files(df, path).orderBy("doc_id").collect(), texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        start += len(ids)
    assert tokenbin.token_files(empty(df), path).collect() == []
    odd = spark.createDataFrame([(7, "b"), (None, "c"), (7, "a"), (None, None), (-3, "<|endoftext|>")], "doc_id long, text string").withColumn("ids", F.lit(0))
    once = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.token_files(odd, path).orderBy("start").collect()]
    assert [x[0] for x in once] == [None, None, -3, 7, 7] and once[-1][1] + once[-1][2] == 9
    assert once == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenbin.token_files(odd.repartition(3, "text"), path).orderBy("start").collect()]
    path = vocabularies.path("piece_bpe_32k.model")
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_io.encode_documents(df, path).collect():
        assert r.ids == p.encode(texts[r.doc_id] or "") and r.round_trip and r.n_differing == 0
    assert sentencepiece_io.encode_documents(empty(df), path).collect() == []


def test_chats(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, "user", None), (2, 2, "user", "c"), (None, 1, "robot", "x"), (3, 1, None, "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert got[1].cost == 0 and got[1].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert got[2].n_merged == 1 and "user\n\nc<|im_end|>" in got[2].rendered and got[None].n_relabelled == 1 and got[3].cost == 2
    assert chat.format_chats(empty(turns)).collect() == []


def test_pipeline(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = shared.keep(stage(spark, before, "/root/testdata/sf0.001"), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        if name == "near_dedup":
            kept = minhash.near_duplicates(before).where("kept").count()
            assert after.count() == kept < before.count()
        if name == "mix_sources":
            assert after.groupBy("doc_id").count().where("count > 3").count() == 0
        before = after
    assert before.where("not round_trip").count() == 0 and before.count() > 0

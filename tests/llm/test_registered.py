"""The registered queries themselves: contracts, SQL, brute force and held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare

from tessera.llm import queries, toxicity
from tessera.llm.textnum import span_hash, text_buffer

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
COLUMNS = {
    "op1_exact_topk_search": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")],
    "op2_suffix_array_dedup": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op3_mixing": [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")],
    "op4_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op5_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op8_minhash_near_dedup": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op9_token_binary_output": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op10_embedding_near_dedup": [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
}


def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    got = queries.QUERIES[name](spark, SMALL).dtypes
    assert got[: len(COLUMNS[name])] == COLUMNS[name]


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_id(spark):
    docs = documents(spark, MIDDLE)
    got = {r.doc_id: r for r in queries.op4_language_id(spark, MIDDLE).collect()}
    assert set(got) == set(docs) and all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    long = [i for i, r in got.items() if r.held_out and sum(c.isalpha() for c in docs[i].text or "") >= 20]
    right = np.mean([got[i].lang_pred == docs[i].lang for i in long])
    assert len(long) > 100 and right >= 0.98
    assert np.mean([got[i].rejected for i in got]) <= 0.005


def test_toxicity(spark):
    docs = documents(spark, MIDDLE)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, MIDDLE).collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (fold(i, 3) == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [(got[i].score, t) for i, t in labels.items() if i in got and got[i].held_out]
    hot, cold = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([a > b for a in hot for b in cold]) > 0.9  # the area under the curve
    assert np.mean([s >= 0.7 for s in cold]) < 0.02


def test_toxicity_scores_against_plain_sums(spark):
    """A score is the logistic of bias and weights of the distinct features of a text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    one = lambda w, k=0: int(toxicity.mix(h + np.uint64(k))[0]) if (h := span_hash(*word(w))) is not None and k else int(span_hash(*word(w))[0])

    def word(w):
        data, off = text_buffer(pa.array([w], pa.binary()))
        return data, off[:-1], off[1:]

    for r in toxicity.score(docs, model).collect()[:60]:
        text = (docs_by := r.doc_id) is not None and texts(docs)[docs_by] or ""
        raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())
        words = set(re.findall(rb"[a-z\x80-\xff]+", raw))
        found = {one(w) for w in words} | {one(w[:k], k) for w in words for k in (4, 5, 6) if len(w) >= k}
        logit = model.bias + sum(weight.get(f, 0.0) for f in found)
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-9)


_TEXTS: dict = {}


def texts(docs):
    if not _TEXTS:
        _TEXTS.update({r.doc_id: r.text for r in docs.collect()})
    return _TEXTS


def test_fit_against_plain_descent():
    """The accelerated steps reach the optimum that slow plain proximal steps reach."""
    rng = np.random.default_rng(5)
    keys = np.arange(1, 9, dtype=np.uint64)
    own = [np.sort(rng.choice(keys, rng.integers(1, 6), replace=False)) for _ in range(80)]
    y = np.array([float(1 in o or (2 in o and rng.random() < 0.7)) for o in own])
    twins = [(i, np.setdiff1d(own[i], [np.uint64(3)])) for i in range(0, 80, 3) if 3 in own[i]]
    model = toxicity.fit(own, y, np.ones(80), twins, l1=1e-3, swap=0.5)
    x = np.array([[float(k in o) for k in keys] for o in own])
    d = np.array([[float(k in t) for k in keys] for _, t in twins]) - x[[i for i, _ in twins]]
    loss = lambda w, b: np.mean(np.logaddexp(0, x @ w + b) - y * (x @ w + b)) + 0.5 * np.mean((d @ w) ** 2) + 1e-3 * np.abs(w).sum()
    w, b = np.zeros(8), 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = x.T @ (p - y) / 80 + 2 * 0.5 * d.T @ (d @ w) / len(twins)
        w, b = w - 0.2 * g, b - 0.2 * float(np.mean(p - y))
        w = np.sign(w) * np.maximum(np.abs(w) - 0.2 * 1e-3, 0)
    ours = np.zeros(8)
    ours[np.searchsorted(keys, model.keys)] = model.weights
    assert loss(ours, model.bias) <= loss(w, b) + 1e-4


def test_tokens_of_the_whole_table(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabularies.path("byte_bpe_50k.json"))
    docs, start = documents(spark, SMALL), 0
    got = {r.doc_id: r for r in queries.op9_token_binary_output(spark, SMALL).collect()}
    assert set(got) == set(docs)
    for i in sorted(docs):
        ids = np.array([*t.encode(docs[i].text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_pieces_of_the_whole_table(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
    docs = documents(spark, SMALL)
    for r in queries.op6_sentencepiece_coding(spark, SMALL).collect():
        ids = np.array(library.encode(docs[r.doc_id].text or ""), "<u4")
        assert (r.n_ids, r.ids_crc32, r.round_trip, r.n_differing) == (len(ids), zlib.crc32(ids.tobytes()), True, 0)


def test_conversations_of_the_whole_table(spark):
    from test_kernels import cheapest

    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    by_conv: dict = {}
    for r in rows:
        by_conv.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r for r in queries.op7_chat_formatting(spark, SMALL).collect()}
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort(key=lambda r: (r.turn, r.role or "", r.text or ""))
        roles = tuple(r.role if r.role in ("system", "user", "assistant") else None for r in turns)
        assert got[c].cost == cheapest(roles) and got[c].n_turns == len(turns)
        at = 0
        for r in turns:  # every text stands in the result, in its order
            at = got[c].rendered.index(r.text or "", at)


def test_mix_of_the_whole_table(spark):
    docs = documents(spark, SMALL)
    rows = queries.op3_mixing(spark, SMALL).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", d.text or "")) for i, d in docs.items()}
    assert {r.doc_id: r.size for r in rows} == size
    taken, largest = {}, {}
    for r in rows:
        s = docs[r.doc_id].source
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    target = {docs[r.doc_id].source: r.target for r in rows}
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in target)

"""Numpy kernels against plain Python."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import chat, hnsw, langid, minhash, suffix_dedup, tokenbin, topk_search, toxicity
from tessera.llm.chunks import ChunkEncoder, cut_byte_level
from tessera.llm.sentencepiece_io import Codec, Model, UNIGRAM, build, parse
from tessera.llm.shared import reach
from tessera.llm.suffix_array import repeated_starts, suffix_array
from tessera.llm.textnum import gram_hash, same_spans, shingle_hashes, slices, span_hash, text_buffer, word_counts

_TM = [0]
for _ in range(10):
    _TM += [1 - b for b in _TM]
#: Two words of 1,024 letters that polynomial hashes modulo a power of two do not tell apart.
THUE_MORSE = ["".join("ab"[b] for b in _TM[:1024]), "".join("ba"[b] for b in _TM[:1024])]
ODD = [None, "", " ", "\t\n", "a", "A b", "é è\x0bç", "x" * 500, "a b " * 300, "\x85 　z", "one two three"]


def texts(seed, n=60):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "foo", "bar", "Foo", "é", "漢", "1", ".", ",", "'s", "don", " ", "▁", "🙂", "<s>", "a", "\r"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_words_and_shingles():
    x = texts(1)
    data, off = text_buffer(pa.array(x))
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in x]
    assert word_counts(data, off).tolist() == [len(w) for w in split]
    h, second, rows = shingle_hashes(data, off, 3)
    assert len(set(zip(rows.tolist(), second.tolist()))) == len(h)
    low = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in x]
    sets = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in low]
    assert np.bincount(rows, minlength=len(x)).tolist() == [len(s) for s in sets]
    ours = [set(h[rows == i].tolist()) for i in range(len(x))]
    for i, j in itertools.combinations(range(len(x)), 2):
        assert len(ours[i] & ours[j]) == len(sets[i] & sets[j])
    assert [b for _, b in slices(off, 100)][-1] == len(x)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)))
    s = minhash.sketch(np.concatenate((a, b, a[:1])), np.repeat([0, 1, 2], [400, 400, 1]), 4, 192)
    assert (s[:3] != minhash._EMPTY).all() and (s[3] == minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.12
    i, j = minhash.linked_pairs([a, b, a[:0]], 80)
    assert (i.tolist(), j.tolist()) == ([0], [1]) and not len(minhash.linked_pairs([a, b], 82)[0])


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(1, 4, int(rng.integers(1, 50)))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    text = np.frombuffer(b"abcdefghijXabcdefghijYYYYYYYYYYYY", np.uint8)
    found = repeated_starts(text, np.array([len(text)]), 10, np.arange(len(text)), np.zeros(len(text), bool))
    assert np.flatnonzero(found).tolist() == [0, 11, 21, 22, 23]


def test_runs_hold_every_window():
    rng = random.Random(5)
    for t in ("".join(rng.choice("abcd") for _ in range(900)), "z" * 700, "xy" * 300, "a" * 200, "a" * 199):
        data, off = text_buffer(pa.array([t]))
        first, _ = suffix_dedup.anchors(data, off, 200)
        at, n, _, _ = suffix_dedup.pieces(data, off, first, 200) if len(first) else (first,) * 4
        assert sorted(i for a, m in zip(at, n) for i in range(a, a + m)) == list(range(max(0, len(t) - 199)))


def test_stream_vbyte():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)
        control, data = tokenbin.pack(v)
        assert tokenbin.unpack(control, data, n).tolist() == v.tolist()


@pytest.fixture(scope="module")
def vocabularies():
    return pytest.importorskip("public_tokenizers")


def test_byte_level_chunks(vocabularies):
    from tokenizers import Tokenizer

    path = vocabularies.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    x = [*texts(2, 1500), "end <|endoftext|> start", "<|endoftext|><|endoftext|>", *THUE_MORSE]
    ids, at = tokenbin.byte_level_encoder(path)(*text_buffer(pa.array(x)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in t.encode_batch([y or "" for y in x], add_special_tokens=False)]
    # The memory of chunks may be emptied at any time.
    small = ChunkEncoder(cut_byte_level, lambda ts: [t.encode(y, add_special_tokens=False).ids for y in ts], 10)
    for i, j in zip(range(0, 100, 10), range(10, 110, 10)):
        d, o = text_buffer(pa.array(x[i:j]))
        got, p = small(d, o)
        assert got.tolist() == ids[at[i] : at[j]].tolist()


def test_sentencepiece(vocabularies):
    import sentencepiece

    path = vocabularies.path("piece_bpe_32k.model")
    x = [t or "" for t in [*texts(3, 800), *THUE_MORSE]]
    c = Codec(path)
    ids, at = c.encode(*text_buffer(pa.array(x)))
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(x)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want and not (c.encoder.flags & 0xFFFFFFFF).any()
    assert ((c.encoder.flags >> 32 == 0) == np.array(["▁" not in t for t in x])).all()  # that sign decodes to a space
    whole = build(parse(open(path, "rb").read()))
    assert [e.ids for e in whole.encode_batch(x, add_special_tokens=False)] == want
    assert c.decode(ids, at) == [t.replace("▁", " ") for t in x]
    # Parity is told by document: a library that gives other ids is noticed where its chunks stand.
    other = Codec(path)
    library = other.reference.encode
    other.reference = type("Other", (), {"encode": staticmethod(lambda texts, num_threads=1: [i[:-1] if "foo" in t else i for t, i in zip(texts, library(texts))])})
    again, _ = other.encode(*text_buffer(pa.array(["bar bar", "", "foo bar foo"])))
    flags = other.encoder.flags & 0xFFFFFFFF
    assert flags.tolist()[:2] == [0, 0] and flags[2] > 0 and again.tolist() == [i for t in ("bar bar", "", "foo bar foo") for i in whole.encode(t).ids]


def test_unigram_pipeline():
    m = Model([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -2.5, 1), ("▁", -3.0, 1)], UNIGRAM, False, b"", True, False, 0)
    assert build(m).encode("ab ab").ids == [3, 3] and build(m).encode("a").ids == [1]


def test_unigram_model_file(tmp_path):
    """A unigram model with byte fallback, written as a protobuf, encodes as the sentencepiece library does."""
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, raw):
        return varint(number << 3 | 2) + varint(len(raw)) + raw

    rng = random.Random(4)
    words = {"".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(150)}
    normal = {*words, *("▁" + w for w in words), *"abcdef", "▁"}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((w, -rng.random() * 9 - 1, 1) for w in sorted(normal))]
    raw = b"".join(message(1, message(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + b"\x18" + varint(k)) for p, s, k in pieces)
    raw += message(2, b"\x18\x01" + varint(35 << 3) + b"\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    path = str(tmp_path / "unigram.model")
    open(path, "wb").write(raw)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    x = ["", "abc fed", "  a  b", "é漢🙂 abc", *(" ".join(rng.choice(sorted(words)) + rng.choice(["", "f", "é"]) for _ in range(30)) for _ in range(200))]
    c = Codec(path)
    ids, at = c.encode(*text_buffer(pa.array(x)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == library.encode(x) and not c.encoder.flags.any() and c.decode(ids, at) == x


def test_language_models():
    en, de = "the thing that they think ", "der die das und schön "
    d, o = text_buffer(pa.array([en * 20, de * 20]))
    models = []
    for k in range(2):
        code, row = langid.grams(d, o, 4)
        symbols = np.unique(langid.grams(d, o, 1)[0])
        models.append(langid.KneserNey(*np.unique(code[row == k], return_counts=True), 4, len(symbols) + 1))
    for m in models:  # what may follow a context sums to one, with one share for letters not met
        context = np.uint64(ord("t") << 32 | ord("h") << 16 | ord("e")) << np.uint64(16)
        assert np.exp(m.log_prob(context | np.append(symbols, np.uint64(ord("q"))))).sum() == pytest.approx(1)
    lm = langid.LanguageModel(["en", "de"], models, 4, bound=np.full((2, 40), 99.0))
    best, score, _, _, size = lm.predict(*text_buffer(pa.array(["they think that", "und die der", "12 !", None])))
    assert best[:2].tolist() == [0, 1] and (score[:2] > 0.5).all() and size[2:].tolist() == [0, 0]


def test_symbols_keep_scripts_apart():
    """Letters of different scripts are different symbols, also beyond U+FFFF; signs are none."""
    letters = "aäяλ漢अ𐌰𝒳"
    codes, rows = langid.grams(*text_buffer(pa.array(list(letters))), 2)
    assert len({tuple(codes[rows == i].tolist()) for i in range(len(letters))}) == len(letters)
    assert len(langid.grams(*text_buffer(pa.array(["🙂 12 !", None, ""])), 4)[0]) == 0
    a, b = (langid.grams(*text_buffer(pa.array([t])), 4)[0].tolist() for t in ("Ab, 🙂 c", "ab c"))
    assert a == b


def test_hashes():
    data, off = text_buffer(pa.array([*THUE_MORSE, THUE_MORSE[0]]))
    a, b, c = span_hash(data, off[:-1], off[1:]).tolist()
    assert a == c != b and same_spans(data, off[:-1], off[[0, 0, 0]], np.diff(off)).tolist() == [True, False, True]
    rng = random.Random(8)
    x = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 700))) for _ in range(400)] + ["a", "a\0", "", "\0"]
    data, off = text_buffer(pa.array(x))
    for seed in (0, 1):
        h = span_hash(data, off[:-1], off[1:], seed)
        assert len(set(h.tolist())) == len(set(x)) and len(set(zip(x, h.tolist()))) == len(set(x))
    g = gram_hash(data)
    raw = data.tobytes()
    assert len(g) == len(raw) - 63 and len(set(g.tolist())) == len({raw[i : i + 64] for i in range(len(g))})


def test_toxicity_swaps():
    assert toxicity.swapped("The women and MEN", toxicity.IDENTITY_TERMS) == "The men and women" and toxicity.swapped("womenfolk", toxicity.IDENTITY_TERMS) is None
    rng = random.Random(0)
    fill = [f"w{chr(97 + i)}" for i in range(26)]
    f = lambda t: np.unique(toxicity.features(*text_buffer(pa.array([t])))[0])
    x = [" ".join(rng.choices(fill, k=6)) + (" idiot muslim" if i % 3 == 0 else " muslim" if i % 7 == 0 else "") for i in range(240)]
    y = np.array([float(i % 3 == 0) for i in range(240)])
    twins = [(i, f(t)) for i, s in enumerate(x) if (t := toxicity.swapped(s, toxicity.IDENTITY_TERMS))]
    logit = lambda m, t: float(np.log(s / (1 - s))) if (s := m.score(*text_buffer(pa.array([t])))[0]) else 0.0
    fair, plain = (toxicity.fit([f(t) for t in x], y, np.ones(240), tw) for tw in (twins, []))
    assert abs(logit(fair, "muslim") - logit(fair, "")) < 0.3 * abs(logit(plain, "muslim") - logit(plain, "")) + 1e-6
    assert fair.score(*text_buffer(pa.array(["idiot", "wa"])))[0] > 0.7


def cheapest(roles):
    """All repairs, by breadth: the least cost."""
    best, front = {(0, None): 0}, [(0, 0, None)]
    while front:
        front.sort(key=lambda z: z[0])
        cost, i, state = front.pop(0)
        if i == len(roles):
            return cost
        moves = [(0 if r == roles[i] else 2, i + 1, r) for r in chat.NEXT[state]] + [(3, i, r) for r in chat.NEXT[state]]
        if state is not None:
            moves.append((1 + (0 if state == roles[i] else 2), i + 1, state))
        for c, j, s in moves:
            if best.get((j, s), 1e9) > cost + c:
                best[(j, s)] = cost + c
                front.append((cost + c, j, s))


def test_long_conversations_are_linear():
    rng = random.Random(1)
    for n in (300, 6000):
        roles = tuple(rng.choice((*chat.ROLES, None)) for _ in range(n))
        cost, steps = chat.repair(roles)
        assert [i for _, _, i in steps if i >= 0] == list(range(n))
        price = {"merge": chat.MERGE, "insert": chat.INSERT}
        assert cost == sum(price.get(a, 0) + (chat.RELABEL if i >= 0 and r != roles[i] else 0) for a, r, i in steps)
    assert chat.repair(())[0] == 0


def test_role_repair():
    for n in range(1, 6):
        for roles in itertools.product((*chat.ROLES, None), repeat=n):
            cost, steps = chat.repair(roles)
            assert cost == cheapest(roles), roles
            state = None
            for action, role, _ in steps:
                assert (action == "merge" and role == state) or role in chat.NEXT[state]
                state = role
            assert [i for a, _, i in steps if i >= 0] == list(range(n))


def test_reach_and_graph():
    ids, low = reach(np.array([5, 9, 3, 20]), np.array([9, 7, 4, 21]))
    assert dict(zip(ids.tolist(), low.tolist())) == {3: 3, 4: 3, 5: 5, 7: 5, 9: 5, 20: 20, 21: 20}
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x[:300] = x[0] + 0.05 * rng.normal(size=(300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    for width in (hnsw.audited_width(g, 0.95, 0.98), 16):  # a beam of 16 is full of links for 300 of the queries
        found = set()
        for a, b in g.within(x, 0.95, width):
            found |= set(zip(a.tolist(), b.tolist()))
        true = set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.95))))
        assert len(found & true) >= 0.99 * len(true)


def test_block_search():
    rng = np.random.default_rng(4)
    q, x = rng.integers(-50, 50, (7, 5)), rng.integers(-50, 50, (200, 5))
    x[10] = x[11]
    ids = np.arange(200)
    blocks = [(ids[i : i + 16], x[i : i + 16], x[i : i + 16].max(0), x[i : i + 16].min(0)) for i in range(0, 200, 16)]
    r, v, s = topk_search.search(ids[:7], q, blocks, 10, np.full(7, -np.inf))
    for i in range(7):
        all_s = x @ q[i]
        order = [j for j in np.lexsort((ids, -all_s)) if j != i][:10]
        assert v[r == i].tolist() == order and s[r == i].tolist() == all_s[order].tolist()


def test_large_components_are_exact():
    x = topk_search.quantised(np.array([[1e300, 1.0], [-1e300, 0.5], [3.5, 2.0]]), 1024.0)
    s = topk_search.scores(x, x)
    assert s[0, 0] == (int(1e300) * 1024) ** 2 + 1024**2 and s[2, 2] == 3584**2 + 2048**2
    blocks = [(np.arange(3), x, x.max(0), x.min(0))]
    r, v, s = topk_search.search(np.array([9, 9, 9]), x, blocks, 2, np.full(3, -np.inf))
    assert v.tolist() == [0, 2, 1, 2, 0, 2] and s.tolist()[0] == 2**63 - 1 and s.tolist()[4:] == [2**63 - 1, 3584**2 + 2048**2]

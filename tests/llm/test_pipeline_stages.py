"""Each stage of the pipeline against brute force, and on tables with odd rows."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, key string"


def odd_rows():
    """Null and repeated doc_ids, null and empty texts, repeated rows, a long text, junk, columns of clashing names."""
    rng = random.Random(9)
    en, de = "the thing that this with and of was there".split(), "der die das und schön für ist nicht auch".split()
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    rows = []
    for i in range(240):
        words, lang = (en, "en") if i % 2 else (de, "de")
        rows.append((i, text(words, 40), lang, f"s{i % 3}"))
    base, passage = text(en, 90), text(de, 60)
    changed = base.split()
    changed[40] = "other"
    rows += [(900, base, "en", "s0"), (901, " ".join(changed), "en", None), (902, base, "en", "s1")]
    rows += [(910 + k, text(en, 20) + " " + passage + " " + text(de, 20), "en", "s2") for k in range(3)]
    rows += [(7, text(en, 30), "en", "s1"), (7, text(de, 30), "de", "s1"), (None, text(en, 35), "en", None), (None, text(de, 35), "de", "s0"), (None, base, "en", "s0")]
    rows += [(950, None, "en", "s0"), (951, "", "de", "s1"), (952, "12 34 !?", None, "s1"), (953, "".join(rng.choice("qxzjkvw ") for _ in range(400)), None, "s1")]
    rows += [(960, text(en, 20_000), None, "s2")]
    rows += rows[:2]
    return [(i, t, lang, s, len(t or ""), "x", "y") for i, t, lang, s in rows]


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "", r.lang or "", r.source or "")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(sets):
    low = list(range(len(sets)))
    top = lambda i: i if low[i] == i else top(low[i])
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and both:
                a, b = sorted((top(i), top(j)))
                low[b] = a
    return [top(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage on the odd rows."""
    from tessera.llm.shared import keep

    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out, names = {}, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "cut_repeats", "mix_sources", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        after = keep(stage(spark, docs, ""), name)
        out[name] = sorted(docs.collect(), key=key), after.collect(), after.columns
        docs = after
    return out


def test_columns(stages):
    for name in ("language_id", "near_dedup", "cut_repeats", "mix_sources"):
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_drops_what_is_no_language(stages):
    before, after, _ = stages["language_id"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {950, 951, 952, 953}
    assert len(after) == len(before) - 4  # rows of one doc_id, or of none, neither multiply nor vanish


def test_near_duplicates_stage(stages):
    before, after, _ = stages["near_dedup"]
    root = groups([shingles(r.text) for r in before])
    kept = sorted(after, key=key)
    assert len(kept) == len(set(root))
    place = {}
    for r, g in zip(before, root):
        place.setdefault((r.doc_id, r.text, r.source), g)
    assert sorted(place[r.doc_id, r.text, r.source] for r in kept) == sorted(set(root))  # one of each group


def test_repeats_stage(stages):
    before, after, _ = stages["cut_repeats"]
    raw = [(r.text or "").encode() for r in before]
    seen: dict = {}
    for b in raw:
        for i in range(len(b) - 199):
            seen[b[i : i + 200]] = seen.get(b[i : i + 200], 0) + 1
    want = []
    for r, b in zip(before, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if not any(gone) or text.strip(" "):
            want.append((r.doc_id, text, len(text) if any(gone) else r.n_chars))
    assert any(len(t) < len(r.text) for r in before for i, t, _ in want if i == r.doc_id and r.doc_id and r.doc_id >= 910)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in after), key=order) == sorted(want, key=order)


def test_mix_stage(stages):
    before, after, _ = stages["mix_sources"]
    size = lambda r: len(WORD.findall(r.text or ""))
    sources = sorted({r.source for r in before}, key=lambda s: (s is None, s or ""))
    words = {s: sum(size(r) for r in before if r.source == s) for s in sources}
    taken = {s: sum(size(r) for r in after if r.source == s) for s in sources}
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    target, free = {}, set(sources)
    while True:
        left = sum(words.values()) - sum(target.get(s, 0) for s in sources if s not in free)
        share = {s: left * weight[s] / sum(weight[o] for o in free) for s in free}
        over = {s for s in free if share[s] > 3 * words[s]}
        target |= {s: 3.0 * words[s] for s in over} | {s: share[s] for s in free - over}
        free -= over
        if not over:
            break
    for s in sources:
        assert abs(taken[s] - target[s]) <= max(size(r) for r in before if r.source == s)
    counts: dict = {}
    for r in after:
        counts[key(r)] = counts.get(key(r), 0) + 1
    for k in counts:
        assert counts[k] <= 3 * sum(key(r) == k for r in before)


def test_encode_stage(stages):
    import public_tokenizers
    import sentencepiece

    before, after, _ = stages["encode"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in after), key=order) == sorted(((r.doc_id, library.encode(r.text)) for r in before), key=order)
    assert all(r.round_trip for r in after)


def test_empty_table(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.collect() == [], name

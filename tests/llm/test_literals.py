"""Cases that once came out short: literals of added tokens."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import tokenbin
from tessera.llm.textnum import text_buffer


def marked():
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endoftext", "|>", "<|", " ", "  ", "\n", "\n\n", "end", " start", "it's", "'s", "12", "é", "\t", "<|im_start|>", "...", " "]
    return ["end <|endoftext|> start", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endof", "text|>y", None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000))]


def test_added_tokens_in_texts(tmp_path):
    vocabularies = pytest.importorskip("public_tokenizers")
    from tokenizers import AddedToken, Tokenizer

    x = marked()
    path = vocabularies.path("byte_bpe_50k.json")
    other = []
    for i, token in enumerate((AddedToken("<|im_start|>", lstrip=True, rstrip=True, normalized=False), AddedToken("start", normalized=False))):
        t = Tokenizer.from_file(path)
        t.add_special_tokens([token])
        t.save(str(tmp_path / f"{i}.json"))
        other.append(str(tmp_path / f"{i}.json"))
    for p in (path, *other):
        ids, at = tokenbin.byte_level_encoder(p)(*text_buffer(pa.array(x)))
        want = [e.ids for e in Tokenizer.from_file(p).encode_batch([y or "" for y in x], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    ids, _ = tokenbin.byte_level_encoder(path)(*text_buffer(pa.array(x[:1])))
    assert ids.tolist() == [437, 220, 50256, 923]


def test_added_tokens_in_files(spark):
    vocabularies = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    x = marked()[:60]
    path = vocabularies.path("byte_bpe_50k.json")
    t, start = Tokenizer.from_file(path), 0
    for r, y in zip(tokenbin.token_files(spark.createDataFrame(list(enumerate(x)), "doc_id long, text string"), path).orderBy("doc_id").collect(), x, strict=True):
        ids = [*t.encode(y or "", add_special_tokens=False).ids, 0]
        assert r.start == start and r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)

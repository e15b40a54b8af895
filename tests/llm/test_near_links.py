"""No link just at the threshold is lost by the bands."""

import random

import pytest

import corpus_pipeline
from tessera.llm import minhash


def pairs_at_80(spark, n):
    """Documents 2i and 2i + 1 share 80 of 100 runs of five words."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        w = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(104)]
        rows += [(2 * i, " ".join(w[:94]), "en", "s", 0), (2 * i + 1, " ".join(w[10:]), "en", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def test_pipeline_stage_at_80(spark):
    docs = pairs_at_80(spark, 1000)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(range(0, 2000, 2))


@pytest.mark.parametrize("percent", [1, 30, 50, 80, 85, 99, 100])
def test_miss_rate(percent):
    assert minhash.miss_rate(percent, *minhash.banding(percent)) <= 2e-7

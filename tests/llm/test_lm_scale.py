"""op3: what a pair costs does not grow with the number of buckets; rare words by a join give the same scores."""

import gc
import random
import tracemalloc

import pytest

pytest.importorskip("pyarrow")

import pyarrow as pa  # noqa: E402

from quadrat.llm import lm  # noqa: E402

DOC = "doc_id long, text string"


def texts(n, words, seed=5, spread=400):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % spread}" for _ in range(words))) for i in range(n)]


def test_cost_of_a_pair(spark, monkeypatch):
    df = spark.createDataFrame(texts(300, 300), DOC).coalesce(1)
    cost = {}
    kept = lm.stored
    for buckets in (16, 2048):
        def stored(t, name, buckets=buckets):
            out = kept(t, name)
            if name == "lm-ratios":
                binary = [f"coalesce(length({c}), 0)" for c, kind in out.dtypes if kind == "binary"]
                cost[buckets] = out.selectExpr(f"sum({' + '.join(binary)})").first()[0]
            return out

        monkeypatch.setattr(lm, "stored", stored)
        monkeypatch.setattr(lm, "BUCKETS", buckets)
        assert lm.scored(df).count() == 300
    # ids of texts in every row made it three times as much
    assert cost[2048] < 2 * cost[16]


def test_words_not_held(spark, monkeypatch):
    rows = texts(120, 40) + [(500, None), (501, ""), (502, "only here"), (502, "only here"), (None, "w1 w1 w2"), (503, "w1")]
    rows += [(600 + i, f"rare{i % 7} rare{i % 5} w1 other{i}") for i in range(60)]
    df = spark.createDataFrame(rows, DOC)

    def got(size):
        return sorted(
            ((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 7), round(r.score, 5)) for r in lm.scored(df, vocabulary=size).collect())
        )

    whole = got(10**6)
    assert len(whole) == len(rows)
    for size, pack, sums in ((0, 400_000, 4_000_000), (20, 50, 3), (150, 700, 10)):
        monkeypatch.setattr(lm, "PACK", pack)
        monkeypatch.setattr(lm, "SUMS", sums)
        assert got(size) == whole


def test_driver_keeps_no_words(spark, monkeypatch):
    words, kept, held = 100_000, lm.stored, {}
    df = spark.createDataFrame([(k, " ".join(f"w{k}-{i}" for i in range(words // 100))) for k in range(100)], DOC)

    def stored(t, name):
        gc.collect()
        held[name] = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        return kept(t, name)

    monkeypatch.setattr(lm, "stored", stored)
    tracemalloc.start()
    try:
        assert lm.scored(df).count() == 100
    finally:
        tracemalloc.stop()
    # 63 bytes a word were held while pairs were counted
    assert held["lm-ratios"] - held["lm-words"] < 8 * words

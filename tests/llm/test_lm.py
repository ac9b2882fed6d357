import collections
import math
import random
import re

import numpy as np
import pytest

from rhopool.llm import lm

SCHEMA = "doc_id bigint, text string, row int, score double, n_known string"


def _tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


@pytest.mark.parametrize("head", [3, 1 << 17])
def test_base_is_exact_and_the_model_is_a_good_one(spark, head):
    r = random.Random(8)
    follow = {k: [r.randint(0, 199) for _ in range(4)] for k in range(200)}
    texts = []
    for _ in range(150):
        w, out = r.randint(0, 199), []
        for _ in range(r.randint(0, 80)):
            w = r.choice(follow[w])
            out.append(f"Wört{w}")
        texts.append(" ".join(out))
    rows = [(i, t, 1, 0.5, "x") for i, t in enumerate([*texts, None, "", "never seen words", texts[0]])] + [(None, texts[1], None, None, None), (0, texts[0], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lm.score(df, lm.fit(df.where("doc_id < 120"), head=head)).collect()
    train = collections.Counter(t for i, text, *_ in rows if i is not None and i < 120 for t in _tokens(text))
    total, distinct = sum(train.values()), len(train)
    want = sorted((i is None, i or 0, len(ts := _tokens(t)), sum(x in train for x in ts), total, round(sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in ts), 8))
                  for i, t, *_ in rows)
    assert sorted((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 8)) for g in got) == want
    fresh = [g for g in got if g.doc_id is not None and 120 <= g.doc_id < 150 and g.n_tokens > 10]
    assert sum(g.score for g in fresh) > sum(g.base_score for g in fresh) * 0.8


def test_counts_come_back_within_their_level(spark):
    df = spark.createDataFrame([(k, " ".join([f"x{k}"] * (k + 1)), None, None, None) for k in range(60)], SCHEMA)
    shared, words = lm.fit(df, broadcast_bits=1 << 29)
    exact = {r.key: r.n for r in words.collect()}
    keys = np.array(list(exact), np.int64).view(np.uint64)
    estimate = shared.value.count(keys)
    true = np.array(list(exact.values()))
    assert (np.abs(lm.level(np.maximum(estimate, 1)) - lm.level(true)) <= 1).mean() > 0.95
    assert (shared.value.count(lm.mix(keys + np.uint64(12345))) > 0).mean() < 0.05


def test_a_small_filter_raises_the_least_count_and_stays_in_its_bound(spark):
    df = spark.createDataFrame([(k, " ".join(f"a{k}b{j}" for j in range(400)), None, None, None) for k in range(100)], SCHEMA)
    shared, _ = lm.fit(df, max_bits=1 << 16, broadcast_bits=1 << 29)
    assert shared.value.bits.nbytes == 1 << 13 and shared.value.least > 1


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lm.score(df, lm.fit(df)).count() == 0
    (r,) = lm.score(spark.createDataFrame([(1, "a b", None, None, None)], SCHEMA), lm.fit(df)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_a_filter_beyond_the_broadcast_keeps_every_ngram_and_scores_alike(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, " ".join(f"a{r.randint(0, 5000)}" for _ in range(r.randint(0, 300))), None, None, None) for k in range(400)]
    rows += [(None, None, None, None, None), (7, rows[8][1], None, None, None), (900, "", None, None, None), (901, "x" * 100_000, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train = df.where("doc_id < 300")
    whole, cut = lm.fit(train, head=50, broadcast_bits=1 << 29), lm.fit(train, head=50, broadcast_bits=1 << 16)
    monkeypatch.setattr(lm, "SHARD_BITS", 1 << 18)
    small = lm.fit(train, head=50, broadcast_bits=1 << 16)
    assert whole.parts is None and cut.shared.value.bits.nbytes == 0 and small.ranges == 4
    assert whole.shared.value.least == cut.shared.value.least == 1
    found = [sorted((g.doc_id is None, g.doc_id or 0, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 8), round(g.score, 8)) for g in lm.score(df, f).collect())
             for f in (whole, cut, small)]
    assert len(found[0]) == 404 and found[0] == found[1] == found[2]
    assert lm.score(df.limit(0), small).count() == 0

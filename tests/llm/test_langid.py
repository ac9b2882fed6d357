import math
import random

import numpy as np

from rhopool.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, lang_pred int, lang_score string"
SOUNDS = {"aa": ("ka", "ti", "mo", "su"), "bb": ("ström", "gut", "lich", "ung"), "cc": ("qui", "ère", "eau", "la")}


def _text(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy_and_stated_cases(spark):
    r = random.Random(1)
    rows = [(i, _text(r, lang, r.choice([4, 30, 400])), lang, 1, "x") for i, lang in enumerate(r.choice(list(SOUNDS)) for _ in range(500))]
    more = [(1000, None, "aa", 1, ""), (1001, "", "bb", 1, ""), (1002, "12 34 ... !", "cc", 1, ""), (None, _text(r, "bb", 5000), None, 1, ""), (0, rows[0][1], rows[0][2], 1, "")]
    df = spark.createDataFrame(rows + more, SCHEMA)
    got = langid.predict(df, langid.fit(df.where("doc_id < 300"))).collect()
    assert len(got) == len(rows) + len(more) and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "lang_score"}
    fresh = [g for g in got if g.doc_id is not None and 300 <= g.doc_id < 1000]
    assert sum(g.lang == g.lang_pred for g in fresh) >= 0.97 * len(fresh)
    by = {g.doc_id: g for g in got}
    assert all(by[k].lang_pred == "und" and by[k].lang_score == 1 for k in (1000, 1001, 1002)) and by[None].lang_pred == "bb"
    assert all(0 <= g.lang_score <= 1 for g in got)


def test_network_equals_plain_loops():
    r = random.Random(2)
    langs = list(SOUNDS)
    texts = [_text(r, r.choice(langs), n) for n in (1, 5, 60, 300)] + ["", "x", "É" * 200]
    rng = np.random.default_rng(0)
    width = langid.FILTERS * sum(langid.WIDTHS)
    net = langid.Network(langs, rng.normal(0, 1, (256, width)).astype(np.float32), rng.normal(0, 1, (langid.FILTERS * 3, 3)).astype(np.float32), np.zeros(3, np.float32))
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, begin = langid.windows(data, offsets)
    got = net.logits(langid.cut(data, begin, offsets[doc + 1]))
    at = 0
    for k, b in enumerate(raw):
        start = 0
        while b and (start == 0 or start + langid.WIDTHS[-1] - 1 < len(b)):
            window = [langid.SEEN[c] for c in b[start:start + langid.WINDOW]]
            window += [0] * (langid.WINDOW - len(window))
            slot, hidden = 0, []
            for w in langid.WIDTHS:
                for f in range(langid.FILTERS):
                    hidden.append(math.tanh(max(sum(float(net.table[window[p + j], (slot + j) * langid.FILTERS + f]) for j in range(w)) for p in range(langid.WINDOW - w + 1))))
                slot += w
            want = np.array(hidden) @ net.dense.astype(float)
            assert doc[at] == k and np.allclose(got[at], want, atol=1e-3)
            at += 1
            start += langid.STRIDE
            if start + langid.WINDOW - langid.STRIDE >= len(b):
                break
    assert at == len(doc)


def test_gradient_lowers_the_loss():
    r = random.Random(3)
    langs = list(SOUNDS)
    y = np.array([r.randrange(3) for _ in range(200)])
    raw = [_text(r, langs[k], 30).encode() for k in y]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, begin = langid.windows(data, offsets)
    x = langid.cut(data, begin, offsets[doc + 1])
    net = langid.train(x, y[doc], langs)
    assert (net.logits(x).argmax(axis=1) == y[doc]).mean() > 0.99
    again = langid.train(x, y[doc], langs)
    assert np.array_equal(net.table, again.table)


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", None, 1, ""), (2, None, "aa", 1, "")], SCHEMA)
    got = {g.doc_id: (g.lang_pred, g.lang_score) for g in langid.predict(df, langid.fit(df)).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 1.0)}
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "abc def", "aa", 1, "")], SCHEMA)
    assert langid.predict(none, langid.fit(one)).count() == 0
    assert langid.predict(one, langid.fit(one)).first().lang_pred == "aa"

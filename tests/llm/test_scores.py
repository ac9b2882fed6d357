import random

import numpy as np
import pytest

from rhopool.llm import quality, quality_rules, toxicity
from rhopool.llm.toxicity import Automaton

SCHEMA = "doc_id bigint, text string, label string, toxicity int, kept int, quality_score string"
LABELS = "doc_id bigint, toxic int, quality int, text string"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_accepts_terms_within_one_edit_and_open_stems():
    r = random.Random(6)
    terms = [("stupid", False), ("stupor", False), ("cad", False), ("blor", True), ("worthless", False), ("dümmling", False), ("été𝄞x", False)]
    m = Automaton.build(terms)
    words = [t for t, _ in terms] + ["blorx", "blo", "STUPID", "st", "", "dummling", "dümling", "ete𝄞x", "été𝄞"]
    for t, _ in terms * 200:
        w = list(t)
        for _ in range(r.randint(0, 3)):
            k = r.randint(0, max(len(w) - 1, 0))
            kind = r.randint(0, 2)
            if kind == 0 and w:
                del w[k]
            elif kind == 1:
                w.insert(k, r.choice("stuxdü"))
            elif w:
                w[k] = r.choice("stuxdü")
        words.append("".join(w))
    data, stop = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w.encode()) for w in words])
    points, number = toxicity.code_points(data)
    assert "".join(map(chr, points)) == "".join(words).replace("STUPID", "stupid")
    state = m.run(points, number[np.append(0, stop[:-1])], number[stop])
    for w, term, edits in zip(words, m.term[state], m.edits[state]):
        low = w.lower()
        fits = [(_distance(low, t), k) for k, (t, o) in enumerate(terms) if not o and _distance(low, t) <= (len(t) >= 5)]
        fits += [(0, k) for k, (t, o) in enumerate(terms) if o and low.startswith(t) and len(low) > len(t)]
        if w:
            assert (term >= 0) == bool(fits), w
            if fits:
                assert (edits, term) == min(fits), w


def _corpus(n=600):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = [f"{r.choice('abcdefgh')}{r.randint(0, 99)}" for _ in range(r.randint(60, 90))]
        toxic, poor = i % 7 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words[r.randint(0, 59)] = r.choice(["grobnik", "skulk" + r.choice("xyzuvw") * 2, "vermile"])
        if poor:
            words = [w.upper() + "!!" for w in words[:20]] * 4
        rows.append((i, " ".join(words), "x", 1, 1, "y"))
        labels.append((i, int(toxic), int(not poor), "z"))
    return rows, labels


EDGE = [(9001, None, None, None, None, None), (9002, "", None, None, None, None), (None, "a b c", None, None, None, None), (9003, "x" * 400_000, None, None, None, None), (0, "same id", None, None, None, None)]


def test_toxic_texts_are_found_by_learned_terms_with_errors_and_quotes(spark):
    rows, labels = _corpus()
    docs, known = spark.createDataFrame([*rows, *EDGE], SCHEMA), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, known.where("doc_id % 3 <> 1"))
    held = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    truth = {i: t for i, t, *_ in labels if i % 3 == 1}
    assert np.mean([(held[i] >= 0.7) == t for i, t in truth.items()]) > 0.98
    assert all(0 <= s <= 1 for s in held.values()) and held[9001] == held[9002] < 0.3
    texts = {1: "a b you grobnik c d", 2: "a b grobmik c d", 3: 'he wrote "grobnik" c d', 4: "a b grub c d"}
    s = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), model).collect()}
    assert s[1] > s[3] > s[4] and s[1] > s[2] > s[4]


def test_toxicity_without_labels_uses_the_seeds(spark):
    docs = spark.createDataFrame([(1, "you stupid moron, worthless scum", *[None] * 4), (2, "a fine day", *[None] * 4)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], LABELS))
    s = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert s[1] > 0.7 > 0.3 > s[2]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_classifier_on_held_out_rows(spark):
    rows, labels = _corpus()
    docs, known = spark.createDataFrame([*rows, *EDGE], SCHEMA), spark.createDataFrame(labels, LABELS)
    model = quality.fit(docs, known.where("doc_id % 5 <> 2"))
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == q for i, _, q, _ in labels if i % 5 == 2 or i % 5 == 0]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[9001] == got[9002]
    none = quality.fit(docs, known.limit(0))
    assert {round(r.quality_score, 6) for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0


def _counts(text):
    words = text.encode().split()
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    again = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if line.encode().strip():
            dup += line in lines
            lines.append(line)
    return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(again)]


def test_rules_count_as_defined_and_trees_are_monotonic(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a ", "b ", "é\n", "# ", "\n", " \n", "c|", "\x1c"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert quality_rules.statistics(t.encode())[0] == _counts(t)
    rows, labels = _corpus()
    docs = spark.createDataFrame([*rows, *EDGE], SCHEMA)
    trees = quality_rules.fit(docs, spark.createDataFrame(labels, LABELS))
    got = {x.doc_id: x for x in quality_rules.apply_rules(docs.where("doc_id is not null and text <> 'same id'"), trees).collect()}
    assert all(got[i].kept == bool(q) for i, _, q, _ in labels)
    assert all(got[i].base_failed == (got[i].n_words < 50 or 100 * got[i].n_repeat_words > 50 * got[i].n_words) for i in got)
    x = np.random.default_rng(0).random((200, len(quality_rules.FEATURES))) * 5
    for f, way in enumerate(quality_rules.FEATURES.values()):
        if way:
            higher = x.copy()
            higher[:, f] += np.random.default_rng(f).random(200) * 3
            assert (way * (trees.margin(higher) - trees.margin(x)) >= -1e-9).all()
    no_trees = quality_rules.apply_rules(docs, None).where("doc_id = 9001 or doc_id is null").collect()
    assert all(not r.kept and r.rule_score is None for r in no_trees)
    assert quality_rules.apply_rules(docs.limit(0), trees).count() == 0


def test_boosting_keeps_the_direction_on_noisy_rows():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 2))
    y = (rng.random(2000) < np.where(x[:, 0] < 0.5, 0.3, 0.6) + 0.3 * np.sin(12 * x[:, 0])).astype(int)
    trees = quality_rules.boost(x, y, (1, 0))
    line = np.stack([np.linspace(0, 1, 500), np.full(500, 0.4)], axis=1)
    assert (np.diff(trees.margin(line)) >= -1e-9).all() and trees.margin(line)[-1] > trees.margin(line)[0]


@pytest.mark.parametrize("sign", [1, -1])
def test_network_is_calibrated(sign):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-sign * 2 * x[:, 0]))
    net = quality.train_network(x, (rng.random(4000) < p).astype(int))
    assert np.abs(net.probability(x) - p).mean() < 0.08


def test_learned_words_are_found_with_an_error_in_their_first_letters(spark):
    rows = [(i, f"a{i % 7} b{i % 5} " + ("you clown here" if i % 3 == 0 else "fine day here"), *[None] * 4) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 == 0), 1, None) for i in range(300)], LABELS)
    model = toxicity.fit(docs, labels)
    words = ["clown", "clowns", "c1own", "clwn", "cloown", "lown", "plant", "cl"]
    data, stop = np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([len(w) for w in words])
    points, number = toxicity.code_points(data)
    state = model.automaton.run(points, number[np.append(0, stop[:-1])], number[stop])
    assert (model.automaton.term[state] >= 0).tolist() == [True] * 6 + [False] * 2


def test_rare_and_long_terms_are_learned_in_samples_of_any_size(spark):
    r = random.Random(17)
    word = lambda n: "".join(r.choice("bcdfghklmnprstvz") + r.choice("aeiou") for _ in range(n))
    bad = sorted({word(4) for _ in range(120)})
    long = "q" + word(40)
    rows, labels = [], []
    for i in range(2400):
        words = [f"{r.choice('abcdefgh')}{r.randint(0, 99)}" for _ in range(30)]
        if i % 2:
            words[5] = bad[i // 2 % len(bad)]
            words[9] = long if i % 100 == 1 else "x1"
        rows.append((i, " ".join(words), i % 2))
        labels.append((i, i % 2, 0, ""))
    sample = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    terms, left_out = toxicity.learn_terms(sample, 1200, 1200)
    known = {t for t, o, _ in terms if not o}
    assert left_out == 0 and set(bad) <= known and long in known
    some, left_out = toxicity.learn_terms(sample, 1200, 1200, letters=100)
    assert sum(len(t) for t, *_ in some) <= 100 and left_out == len(terms) - len(some)


def test_a_quotation_needs_both_marks_in_its_line():
    texts = ['the 5" pipe you idiot', 'he said "you idiot" and 5" more idiot', 'a "b\nidiot" c', "x \u201cidiot\u201d idiot", "\u201copen idiot", "\u00abidiot\u00bb idiot", 'idiot"', '"idiot"']
    want = [[False], [True, False], [False], [True, False], [False], [True, False], [False], [True]]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, at = zip(*[(k, offsets[k] + j) for k, b in enumerate(raw) for j in range(len(b)) if b[j:j + 5] == b"idiot"])
    got = toxicity._quoted(data, offsets, np.array(doc), np.array(at))
    assert got.tolist() == [x for w in want for x in w]

import random

from rhopool.llm.components import components
from rhopool.llm.dedup import near_duplicates

SCHEMA = "doc_id bigint, text string, band int, id string, label double"


def _shingles(text, size):
    w = [x.decode("utf-8").lower() for x in (text or "").encode().split()]
    return frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)] if w else [])


def _brute(rows, size, percent):
    sets = [(r[0], _shingles(r[1], size)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}


def test_groups_match_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for family in range(12):
        text = [r.choice(vocabulary) for _ in range(60)]
        for _ in range(12):
            text = [r.choice(vocabulary) if r.random() < 0.03 else w for w in text]  # drifting copies: chains of links
            rows.append((len(rows) * 7 + 3, " ".join(text), 1, "x", 0.5))
    rows += [(1000, "", 1, "x", 0.5), (1001, None, 1, "x", 0.5), (1002, "one", 1, "x", 0.5), (1003, "ONE", None, None, None), (1004, " one\n", 1, "x", 0.5), (3, rows[0][1], 1, "x", 0.5),
             (1005, "é É", 1, "x", 0.5), (1006, "a b", 1, "x", 0.5), (1007, "b a", 1, "x", 0.5), (1008, "word " * 30_000, 1, "x", 0.5)]
    df = spark.createDataFrame([*rows, (None, rows[0][1], 1, "x", 0.5)], SCHEMA)
    for size in (2, 5):
        got = near_duplicates(df, shingle=size, percent=80).collect()
        assert len(got) == len(rows) + 1
        want = _brute(rows, size, 80)
        assert {g.doc_id: g.component_id for g in got if g.doc_id is not None} == want
        assert all(g.kept == (g.doc_id == g.component_id) for g in got if g.doc_id is not None)
        assert [(g.component_id, g.kept) for g in got if g.doc_id is None] == [(None, True)]
        assert {g.doc_id: g.n_shingles for g in got if g.doc_id is not None} == {i: len(_shingles(t, size)) for i, t, *_ in rows}


def test_different_texts_under_one_id_are_each_compared(spark):
    r = random.Random(8)
    text = lambda: [f"w{r.randint(0, 9999)}" for _ in range(60)]
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (1, b), (3, b), (5, [*b, "more"]), (7, [*a, "tail"]), (20, c), (9, c), (9, d), (11, [*d, "end"]), (11, [*d, "end"]), (12, text())]
    got = {g.doc_id: g.component_id for g in near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id int, text string")).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 7: 1, 9: 9, 20: 9, 11: 9, 12: 12}


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_hubs_loops_and_nulls(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(200, 260)] + [(260, 259), (5, 5), (None, 3), (7, None), (100, 101)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 141)}, 1: 1, **{k: 1 for k in range(200, 261)}, 5: 5}

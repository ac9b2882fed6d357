import random

import numpy as np

from rhopool.llm import decontam

DOCS = "doc_id bigint, text string, item_id string, seed int, tiles int"
ITEMS = "item_id bigint, text string, doc_id string"


def _naive(doc, item, tile):
    """Greedy tiling by trying every pair of places, as the definition says."""
    marked_d, marked_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and a + n not in marked_d and b + n not in marked_i:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < tile:
            return total
        marked_d.update(range(a, a + n))
        marked_i.update(range(b, b + n))
        total += n


def test_tiles_match_the_definition():
    r = random.Random(2)
    for _ in range(200):
        doc, item = [[r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(2)]
        seeds = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if doc[i:i + 3] == item[j:j + 3]]
        got = decontam.tiles(*np.array(seeds).reshape(-1, 2).T, 3) if seeds else []
        assert sum(n for *_, n in got) == _naive(doc, item, 3)


def test_reordered_passages_are_caught_and_clean_texts_are_not(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(5000)]
    item = [r.choice(words) for _ in range(40)]
    other = [r.choice(words) for _ in range(30)]
    fill = lambda n: [r.choice(words) for _ in range(n)]
    texts = {1: [*fill(50), *item, *fill(50)], 2: [*fill(9), *item[20:], *fill(20), *item[:20]], 3: fill(200), 4: [*fill(30), *item[:12], *fill(30)],
             5: [w.upper() + "," for w in other], 6: [*item[30:], *item[20:30], *item[10:20], *item[:10]] * 3}
    rows = [(k, " ".join(t), "x", 1, 2) for k, t in texts.items()] + [(7, None, None, None, None), (8, "", None, None, None), (None, " ".join(item), "x", 1, 1),
                                                                      (1, " ".join(texts[1]), "x", 1, 1), (9, " ".join([*fill(200_000), *item]), "x", 1, 1)]
    bench = [(10, " ".join(item), "d"), (11, " ".join(other), None), (12, "w1 w2", None), (13, None, None), (None, " ".join(item), None), (10, " ".join(item), "d")]
    docs, items = spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, ITEMS)
    got = {(x.doc_id, x.item_id): x for x in decontam.contaminated(docs, items).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 11), (6, 10), (9, 10)}
    assert got[2, 10].tiles == 2 and got[6, 10].tiles == 4 and all(x.matched == x.item_tokens for x in got.values())
    assert any(x.doc_id == 4 and x.matched == 12 for x in decontam.overlaps(docs, items).collect())
    assert decontam.contaminated(docs.limit(0), items).count() == decontam.contaminated(docs, items.limit(0)).count() == 0

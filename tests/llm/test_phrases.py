import collections
import random
import re

import numpy as np
import pytest

from rhopool.llm import phrases

SCHEMA = "text string, lang string, n bigint, score int, phrase string, id int"


def _brute(rows, least, top):
    out = []
    by = collections.defaultdict(list)
    for text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        by[lang or "und"] += [re.findall(r"[^\x20\t]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", low)]
    for lang, pieces in by.items():
        f = collections.Counter(tuple(p[i:i + m]) for p in pieces for m in range(1, 6) for i in range(len(p) - m + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        often = {p: c for p, c in f.items() if c >= least}
        found = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            inside = any(q != p and c >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in often.items() if len(q) > len(p))
            if not inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _rows(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "Été", "ß", "run", "x" * 40, "a", "b c"]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(words if r.random() < 0.8 else [f"w{r.randrange(500)}"]) + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", " ;"]) for _ in range(r.randrange(60)))
        rows.append((text, r.choice(["en", "en", "de", None]), 1, 1, "x", 1))
    return rows + [(None, "en", 1, 1, "", 1), ("", None, 1, 1, "", 1), ("New York City " * 30, "fr", 1, 1, "", 1)] + rows[:5]


@pytest.mark.parametrize("least, top, budget, size", [(8, 2000, 1 << 20, 120), (8, 25, 100, 120), (3, 2000, 20, 60)])
def test_equals_plain_counting_at_any_budget(spark, least, top, budget, size, monkeypatch):
    monkeypatch.setattr(phrases, "CELLS", (4, 8))
    monkeypatch.setattr(phrases, "RANGE", 500)
    rows = _rows(size + least, size)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = phrases.collocations(df, least, top, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(g) for g in got.collect()) == _brute(rows, least, top)


def test_heavy_prefixes_are_lengthened_and_groups_keep_the_budget(spark):
    rows = [("the cat the dog the bird the cat runs", "en", 1, 1, "", 1)] * 200
    df = spark.createDataFrame(rows, SCHEMA)
    words, _, found = phrases.phrase_counts(df, 100, 150)
    texts = df.select("text", "lang")
    division = phrases.divide(texts, words, words.count(), 1800, 100, 150)
    assert len(division.heavy) >= 2 and division.groups.max() > 0
    assert {r["n"] for r in found.collect()} == {200, 400}


def test_packed_suffixes_come_back():
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 9, (500, phrases.DEPTH)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows[::3, 3:] = 0
    rows, n = phrases.merged(rows)
    back, counts = phrases.unpack(*phrases.pack(rows, n))
    assert (back == rows).all() and (counts == n).all() and n.sum() == 500


def test_products_beyond_64_bits_are_exact(spark):
    # 1000 * a * n passes 2**63 only for counts no test can hold; the expression is checked on its own.
    a, n, l, r = 9_000_000_000_000, 90_000_000_000_000, 9_000_000_000_001, 9_000_000_000_007
    row = spark.sql(f"select (cast(1000 as decimal(4, 0)) * cast({a} as decimal(19, 0)) * cast({n} as decimal(19, 0))) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0))) as s").first()
    assert row.s == 1000 * a * n // (l * r)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([("a b c", "en", 1, 1, "", 1), (None, None, 1, 1, "", 1)], SCHEMA)).count() == 0

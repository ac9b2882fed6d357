import random
import re

from rhopool.llm import pii

SCHEMA = "doc_id bigint, text string, base string, spans int, lang string"
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def _brute(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 12 <= len(digits) <= 19 and pii.luhn(digits)
                    or kind == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    r = random.Random(0)
    for k in range(60_000):
        t = "".join(r.choice("aZ_.@-+ 0123456789()é%" if k % 2 else "0123 -.+@a") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == _brute(t), t
    assert pii.base_spans("0" * 6000 + ".0.0.1") == [(0, 1, 6006)]


def test_contexts_discover_unseen_forms_and_leave_others(spark):
    seeds = [(i, f"Filler words here. please phone me on +1 555 010 {1000 + i} after noon, room {i}", "x", 1, "en") for i in range(12)]
    rows = [*seeds, (50, "Odd ones: please phone me on 555-0199-77 after noon", None, None, None), (51, "The answer was 555-0199-78 in the book", None, None, None),
            (52, None, None, None, None), (53, "", None, None, None), (None, "ü 4111 1111 1111 1111 a@b.example", None, None, None), (0, seeds[0][1], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in pii.extract(df).collect():
        got.setdefault(r.doc_id, []).append(([tuple(s) for s in r.base], [tuple(s) for s in r.spans]))
    assert got[0] == got[0][:1] * 2 and got[0][0][0] == [("phone", 38, 38 + len("+1 555 010 1000"))]
    at = rows[12][1].index("555")
    assert got[50] == [([], [("phone", at, at + 11)])] and got[51] == [([], [])] and got[52] == got[53] == [([], [])]
    assert got[None] == [([("card", 2, 21), ("email", 22, 33)],) * 2]
    masked = {r.doc_id: r.text for r in pii.mask(pii.extract(df)).collect()}
    assert masked[None] == "ü [card] [email]" and masked[50].endswith("on [phone] after noon") and masked[52] is None


def test_empty_table_and_long_text(spark):
    assert pii.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "a" * 300_000 + "1" * 300_000 + " me@x.example " + "b.c" * 100_000
    (r,) = pii.extract(spark.createDataFrame([(1, long, None, None, None)], SCHEMA)).collect()
    assert [tuple(s) for s in r.base] == [("email", 600_001, 600_013)]


def test_repeated_documents_discover_what_single_ones_do(spark):
    texts = [f"Filler words here. please phone me on +1 555 010 {1000 + i} after noon, room {i}" for i in range(12)]
    texts += ["Odd ones: please phone me on 555-0199-77 after noon", "The answer was 555-0199-78 in the book", "two in a word: me@x.example,you@y.example"]
    for times in (1, 2, 40):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts * times)], SCHEMA)
        found = {r.doc_id: [s.kind for s in r.spans] for r in pii.extract(df).collect()}
        assert len(found) == 15 * times
        assert all(kinds == (["phone"] if i % 15 <= 12 else [] if i % 15 == 13 else ["email", "email"]) for i, kinds in found.items()), times


def test_a_value_is_tagged_where_a_good_pattern_stands_only(spark):
    texts = [f"please dial our desk at +1 415 010 {1000 + i} thanks" for i in range(40)] + ["please dial our desk at 2024 thanks"] + [f"in the spring of 2024 we met {i}" for i in range(300)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.extract(df).collect()}
    assert found[40] == [("phone", texts[40].index("2024"))] and all(found[i] == [("phone", 24)] for i in range(40))
    assert all(found[i] == [] for i in range(41, 341))

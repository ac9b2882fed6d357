import hashlib
import random

import pytest

from rhopool.llm import warc

SCHEMA = "page_id bigint, url string, html string, source string, place bigint"
HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {}\r\n\r\n"


def _pages():
    r = random.Random(5)
    inner = HEAD.format(5) + "hello\r\n\r\n"
    texts = ["", None, "a", "\r\n\r\n", "WARC/1.0\r\n", "x" * 50 + "WARC/1.0\r\n" * 40, inner, inner * 3, "pre" + inner + "post", inner + "\r\n\r\n",
             HEAD.format(10**9) + "y" * 3000, HEAD.format(0), "é" * 700 + "WARC/1.0\r\nContent-Length: x\r\n\r\n", "z" * 30000]
    same = "same payload " * 100
    texts += [same, same, same, "w" * 999, "w" * 999, "w" * 1000, "w" * 1000]
    texts += ["".join(r.choice(["<p>", "ü", "\n", "\r\n", "WARC/1.0\r\n", " text "]) for _ in range(r.randint(0, 400))) for _ in range(60)]
    return [(i, f"http://h/{i}\n x", t, "s", 7) for i, t in enumerate(texts)]


def _expected(rows):
    out = {}
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        twins = [p for p, _, h, *_ in rows if (h or "").encode() == raw] if len(raw) >= 1000 else [page_id]
        first = max(twins)
        out[page_id] = (len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == page_id else "revisit", None if first == page_id else first)
    return out


@pytest.mark.parametrize("split", ["128m", "3000b", "700b"])
def test_round_trip_with_magic_in_payloads_and_any_split(spark, split):
    rows = _pages()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(3)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == _expected(rows)
    assert len(got) == len(rows) and all(r.declared_digest == r.payload_digest for r in got)
    assert {r.uri for r in got} >= {"http://h/0x"}


def test_empty_table_null_and_repeated_ids(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "q" * 1200
    rows = [(None, None, long, None, None), (None, "u", None, None, None), (4, "u", long, None, None), (4, "u", long, None, None), (3, "u", long, None, None)]
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 3, "revisit", 4), (False, 4, "response", 0), (False, 4, "response", 0), (True, 0, "response", 0), (True, 0, "response", 0)]


def test_foreign_files_and_broken_chains(spark, tmp_path):
    one = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((one + one + "WARC/1.0\r\nContent-Length: 50\r\n\r\nshort").encode())
    (tmp_path / "b.warc").write_bytes(b"junk " + one.encode())
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.payload_digest for r in got if r.payload_bytes == 3] == [hashlib.sha1(b"abc").hexdigest()] * 2
    assert {r.page_id for r in got} == {None}
    assert not [r for r in got if r.file.endswith("b.warc")]


def test_ids_of_nineteen_digits_and_full_filters(spark, monkeypatch):
    from rhopool.llm import filters
    monkeypatch.setattr(filters, "BITS", (6, 6))   # nearly all rows are left open
    top = 2 ** 63 - 1
    rows = [(k, "u", f"{t}" * 1200, None, None) for k, t in ((top, "a"), (-2 ** 63, "a"), (top - 1, "b"), (-10 ** 17, "a"), (5, "b"))] + [(k, "u", f"page {k} " * 200, None, None) for k in range(10, 90)]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {top: ("response", None), -2 ** 63: ("revisit", top), top - 1: ("response", None), -10 ** 17: ("revisit", top), 5: ("revisit", top - 1), **{k: ("response", None) for k in range(10, 90)}}
    assert warc._id(f"<urn:page:{2 ** 63}>") is None

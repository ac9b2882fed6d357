import random

import public_tokenizers
import pytest
import tiktoken

from rhopool.llm import bpe

CLASH = "doc_id bigint, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def rank_file():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(rank_file):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(rank_file), special_tokens={})


def _texts():
    r = random.Random(3)
    letters = [*"abstmdrvelLS '''  \n\t\r0129.,!-é中ß\u0085\x1c²½😀٣", "'s", "'re", "'ll", "'ve", " 's", "<|endoftext|>"]
    return ["", "'", "'r", "'l", "it's we'll 'tis", "a" * 5000 + " " * 3000 + "=" * 4000, "x" * 300, *("".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000))]


def test_ids_offsets_and_bytes_agree_with_the_library(spark, rank_file, reference):
    texts = _texts()
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, None, None, None), (0, texts[4], None, None)]
    got = bpe.transcode(spark.createDataFrame(rows, CLASH), rank_file, offsets=True, decode=True).collect()
    assert len(got) == len(rows)
    table = {v: k for k, v in bpe.parse_ranks(rank_file).items()}
    for r in got:
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        at = 0
        for i, place in zip(r.ids, r.token_offsets):
            assert place == at
            at += len(table[i])
    again = bpe.decode_ids(bpe.transcode(spark.createDataFrame(rows[:50], CLASH), rank_file), rank_file).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again)


def test_scan_is_the_sequential_composition():
    import numpy as np

    f = np.random.default_rng(0).integers(0, 256, 1000).astype(np.uint8)
    states, want = list(range(4)), []
    for g in f.tolist():
        states = [(g >> (2 * s)) & 3 for s in states]
        want.append(sum(s << (2 * k) for k, s in enumerate(states)))
    assert bpe.compose_scan(f).tolist() == want


def test_empty_table(spark, rank_file):
    assert bpe.transcode(spark.createDataFrame([], CLASH), rank_file, decode=True).count() == 0


def test_bytes_that_are_no_utf8_are_replaced(spark, rank_file, reference):
    raw = [b"fine \xc3\xa9", b"bad \xff\xfe end", b"\xc3", b"\xa9 starts inside", b"", b"also fine"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "doc_id int, b binary").coalesce(1).selectExpr("doc_id", "cast(b as string) text")
    got = {r.doc_id: r for r in bpe.transcode(df, rank_file, offsets=True, decode=True).select("doc_id", "ids", "decoded").collect()}
    for i, b in enumerate(raw):
        text = b.decode("utf-8", "replace")
        assert got[i].ids == reference.encode_ordinary(text) and bytes(got[i].decoded) == text.encode()

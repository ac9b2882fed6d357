import random

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline as P
from rhopool.llm.bpe import parse_ranks
from rhopool.llm.queries import rank_bytes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity string, spans string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    words = [f"w{k}" for k in range(3000)]
    fill = lambda n: [r.choice(words) for _ in range(n)]
    item = fill(30)
    base = fill(120)
    near = [w if k % 60 else "changed" for k, w in enumerate(base)]
    texts = {1: base, 2: near, 3: base, 4: fill(80), 5: [*fill(20), *item[15:], *fill(5), *item[:15]], 6: [*fill(30), "you", "stupid", "worthless", "moron", *fill(10)],
             7: [*fill(10), "me@mail.example.com", "+1", "555", "010", "1234", *fill(5)], 10: fill(20_000), 11: ["one"], 12: ["one"]}
    rows = [(k, " ".join(t), "en", "s0", 5, "x", "y") for k, t in texts.items()]
    rows += [(8, "", None, None, None, None, None), (9, None, None, None, None, None, None), (4, rows[3][1], "en", "s0", 5, "x", "y"), (None, " ".join(base), None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_every_decision_takes_effect(spark, folder):
    path, rows = folder
    got = entry.queries()["pipeline"](spark, path).collect()
    text = {r[0]: r[1] for r in rows}
    text[7] = text[7].replace("me@mail.example.com", "[email]").replace("+1 555 010 1234", "[phone]")
    kept = [1, 4, 7, 8, 9, 10, 11]  # 6 is toxic, 2, 3, 12 and the row without id are copies, 4 came twice, 5 holds the item in two parts
    assert sorted((g.doc_id for g in got), key=str) == sorted(kept, key=str)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(rank_bytes()), special_tokens={})
    assert all(g.ids == library.encode_ordinary(text[g.doc_id] or "") and g.n_tokens == len(g.ids) for g in got)


def test_stages_keep_columns_and_survive_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "tokens"]
    for name, stage in P.STAGES:
        out = stage(spark, docs.limit(0), folder[0])
        assert out.count() == 0
        assert name == "tokens" or out.columns == docs.columns


def test_repeated_and_missing_ids_are_judged_by_their_texts(spark, folder):
    r = random.Random(3)
    item = spark.read.parquet(f"{folder[0]}/benchmark.parquet").where("item_id = 1").first().text
    fill = lambda n: " ".join(r.choice([f"v{k}" for k in range(3000)]) for _ in range(n))
    a, b, c = fill(100), fill(100), fill(100)
    rows = [(1, a), (1, b), (3, b), (5, b + " more"), (None, a), (None, c), (None, c), (7, item), (7, c + " end"), (None, item), (8, None), (None, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)
    got = P.drop_near_duplicates(spark, docs, folder[0])
    assert sorted(((g.doc_id, g.text) for g in got.collect()), key=str) == sorted([(1, a), (1, b), (7, item), (7, c + " end"), (8, None), (None, "")], key=str)
    clean = P.drop_contaminated(spark, docs, folder[0]).collect()
    assert sorted(((g.doc_id, g.text) for g in clean), key=str) == sorted([x for x in rows if x[1] != item], key=str)

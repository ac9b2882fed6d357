import random
import re

import numpy as np
import pyarrow as pa

from rhopool.llm.words import per_text, span_hashes, text_blocks, word_table


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["id", "text"])


def test_words_match_the_pattern_and_equal_words_share_a_hash():
    r = random.Random(1)
    texts = ["", None, " ", "é\x1c\x85 a\x0bb", "x" * 5000] + ["".join(r.choice("aBé \n\t\x1c,") for _ in range(r.randint(0, 30))) for _ in range(400)]
    seen = {}
    for limit in (7, 1 << 20):
        got = []
        for rows, data, offsets in text_blocks([_batch(texts)], limit=limit):
            starts, ends, doc = word_table(data, offsets)
            h, at = span_hashes(data, starts, ends, lower=True), per_text(doc, len(offsets) - 1)
            for k in range(rows.num_rows):
                words = [data[a:b].tobytes().decode() for a, b in zip(starts[at[k]:at[k + 1]], ends[at[k]:at[k + 1]])]
                got.append(words)
                for w, x in zip(words, h[at[k]:at[k + 1]].tolist()):
                    low = re.sub("[A-Z]", lambda m: m[0].lower(), w)
                    assert seen.setdefault(low, x) == x
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_sliced_batches_keep_their_own_texts():
    batch = _batch(["one two", "three", None, "four five six"]).slice(1, 3)
    (rows, data, offsets), = text_blocks([batch])
    assert data.tobytes() == b"threefour five six" and offsets.tolist() == [0, 5, 5, 18] and rows.num_rows == 3
    assert np.array_equal(word_table(np.zeros(0, np.uint8), np.array([0, 0]))[0], np.zeros(0))

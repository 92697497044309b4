import os
import random

import pytest
from pyspark.sql import functions as F

from tagframe.llm import token_counts as t

pytestmark = pytest.mark.skipif(not os.path.exists(t.RANKS), reason="no public tokenizers here")

PARTS = ["a", "B", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "'re", "1", "23", ".", "--", "é", "漢", " the", " and", "x" * 20, "\x1c", "\x85", "\r\n"]


@pytest.fixture(scope="module")
def counter():
    return t.counter(t.rank_bytes())


def test_edits_against_whole_encodings(counter):
    rnd = random.Random(3)
    whole = lambda x: len(counter.encoding.encode_ordinary(x))
    for _ in range(400):
        d = t.Document("".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 400))), counter)
        assert d.count == whole(d.text)
        for _ in range(5):
            before, at, n = d.text, rnd.randint(0, len(d.text) + 3), rnd.choice([0, 1, 2, 5, 60])
            new = "".join(rnd.choice(PARTS) for _ in range(rnd.choice([0, 1, 3, 200])))
            d.edit(at, n, new)
            at = min(at, len(before))
            assert d.text == before[:at] + new + before[at + n :]
            assert d.count == whole(d.text) and d.chars[1] == len(d.text)


def test_an_edit_encodes_a_small_part(counter):
    d = t.Document("some words here and there " * 4000, counter)
    d.encoded = 0
    d.edit(50_000, 3, "xyz")
    assert d.encoded < 60


def test_frames(docs, no_docs, spark, counter):
    rows = t.token_counts(docs.withColumn("edits", t.revision()), t.rank_bytes()).collect()
    assert len(rows) == docs.count() and all(r.n_edits == 3 for r in rows)
    edits = spark.createDataFrame([(1, 2, 0, 5, "x"), (1, 1, 10, 0, "longer "), (4, 1, 0, 0, "new"), (7, 1, None, None, None)], "doc_id bigint, seq int, start int, removed int, inserted string")
    out = {r.doc_id: r for r in t.token_counts(t.with_edits(docs, edits), t.rank_bytes()).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    after = text[1][:10] + "longer " + text[1][10:]
    assert out[1].n_tokens == len(counter.encoding.encode_ordinary("x" + after[5:]))
    assert out[4].n_tokens == 1 and out[5].n_tokens == 0 and out[2].n_edits == 0 and out[7].n_tokens == out[7].n_tokens_before
    assert t.token_counts(no_docs.withColumn("edits", F.array().cast("array<struct<start:int,removed:int,inserted:string>>")), t.rank_bytes()).count() == 0

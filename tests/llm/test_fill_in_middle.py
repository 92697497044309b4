import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tagframe.llm import fill_in_middle as m

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = ["a", "B ", " ", "  ", "\n", "\t", "word", "é", "漢 ", "🎉", "\x1c", "\x85", " ", "\x00", "x" * 300, "the same passage of some words again and again, " * 6]


def cut(text, doc_id, seed=42):
    """The contract, by one pattern over a whole text."""
    t = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    p, i, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{i}", "spm": f"<S>{s}<P>{p}<M>{i}"}[form]
    return len(t), form, None if form == "plain" else len(p), None if form == "plain" else len(i), out


def test_summaries_add_up_to_every_token_end():
    rnd, chunks = random.Random(1), m.Chunks(200_000)
    shared = "".join(rnd.choice("abcdefgh é\n") for _ in range(9_000))
    for k in range(150):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 120))) + shared * (k % 9 == 0)
        data = text.encode()
        array = np.frombuffer(data, np.uint8)
        bounds = m.chunk_bounds(array, m.chunk_marks(array).tolist(), 0, len(data))
        for a, b in zip(bounds, bounds[1:]):
            data[a:b].decode()  # no character is cut
            assert 0 < b - a <= m.MOST + 1
        t, tokens = m.Text(data, bounds, chunks), TOKEN.findall(text)
        assert t.tokens == len(tokens)
        ends = np.cumsum([0, *map(len, tokens)])
        assert [t.characters(k) for k in range(len(tokens) + 1)] == ends.tolist()
    assert chunks.hits and chunks.held < 200_000


def test_chunks_follow_the_content():
    rnd = random.Random(2)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(20_000)).encode()
    cuts = []
    for head in (b"", b"something else before it " * 40):
        data = np.frombuffer(head + shared, np.uint8)
        bounds = m.chunk_bounds(data, m.chunk_marks(data).tolist(), 0, len(data))
        cuts.append({bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])})
    assert len(cuts[0] & cuts[1]) > 0.8 * len(cuts[0])


def test_rows_against_brute_force(spark, docs, no_docs):
    rnd = random.Random(3)
    rows = [(k if rnd.random() < 0.9 else None, "".join(rnd.choice([*PARTS, "<P>"] if rnd.random() < 0.02 else PARTS) for _ in range(rnd.randint(0, 60))), "x", 1) for k in range(300)]
    rows += [(1000, None, "x", 1), (1001, "", "x", 1), (1002, " \n", "x", 1), (1003, "w " * 200_000, "x", 1), (1004, "漢" * 100_000, "x", 1), (1004, "漢" * 100_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string, _cuts int")
    got = m.fill_in_middle(df).withColumn("back", m.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and all("_cuts" in r.asDict() for r in got)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == cut(r.text or "", r.doc_id), (r.doc_id, r.text[:80])
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert m.fill_in_middle(docs).count() == docs.count() and m.fill_in_middle(no_docs).count() == 0


def test_forms_follow_their_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    n = {r.form: r["count"] for r in m.fill_in_middle(df, seed=7, plain=20, spm=50).groupBy("form").count().collect()}
    assert abs(n["plain"] - 800) < 120 and abs(n["spm"] - n["psm"]) < 250

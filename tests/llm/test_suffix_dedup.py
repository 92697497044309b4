import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagframe.llm import suffix_dedup as s

L = s.LENGTH


def brute(rows):
    """Plain meaning: rows (doc_id, text) to (n_bytes, n_removed, n_spans, kept) in their order."""
    least = {}
    texts = [(s.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for k in range(len(t) - L + 1):
            w = t[k : k + L]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - L + 1):
            if least[t[k : k + L]] < i:
                gone[k : k + L] = b"\1" * L
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["é", "漢字", "\x00", "\n"]
    prose = lambda m: " ".join(rnd.choice(words) for _ in range(m))
    passages = [prose(rnd.randint(8, 60)) for _ in range(12)] + ["ab" * 60, "z" * 170, "word " * 40]
    line = "a very common line that many of the documents share, word by word."
    rows = []
    for i in range(n):
        parts = [prose(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 3))]
        parts += [p[rnd.randint(0, 9) : len(p) - rnd.randint(0, 9)] for p in rnd.sample(passages, rnd.randint(0, 2))]
        parts += [line] * (rnd.random() < 0.4)
        rnd.shuffle(parts)
        rows.append((i, rnd.choice(["", " ", "\n"]).join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (2, rows[3][1]), (2, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (None, None), (n + 5, None), (n + 6, ""), (n + 7, "x" * 49), (n + 8, "x" * 50), (n + 9, "x" * 50), (n + 10, "x" * 3000), (-5, "x" * 60), (n + 11, "漢" * 5000), (n + 12, "yy" + "漢" * 5000)]
    return rows


def same(spark, rows, **options):
    df = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row int, _doc string").repartition(5)
    got = {r.row: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.repeats_removed(df, **options).collect()}
    want = brute(rows)
    for k, w in enumerate(want):
        assert got[k] == w, (k, rows[k], got[k], w)
    assert len(got) == len(rows)
    return got


def test_against_brute_force(spark, monkeypatch):
    same(spark, corpus(1, 150))
    monkeypatch.setattr(s, "CONTEXTS", 1)  # heads with different neighbours go by themselves
    monkeypatch.setattr(s, "ENTRIES", 40)
    same(spark, corpus(2, 150), batches=3)
    monkeypatch.setattr(s, "BUCKET", 500)
    same(spark, corpus(3, 120), batches=7)


def test_levels_merge_geometrically_and_in_any_order(spark):
    rows = corpus(4, 90)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = s.Levels(spark, 8)
    ranks = []
    for k in (2, 0, 3, 1):
        index.add(df.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == k))
        ranks.append(sorted(index.levels))
    assert ranks == [[0], [1], [0, 1], [2]]
    covered = index.found(s._GONE).unionByName(s.settled(df, index.found(s._ASKED)))
    spans = {}
    for r in covered.collect():
        spans.setdefault((r.doc, r.t), []).append((r.start, r.start + r.windows + L - 1))
    for r, (_, removed, _, _) in zip(s.keyed(df).collect(), brute([(None if r.doc == s.LAST else r.doc, r.text) for r in s.keyed(df).collect()])):
        gone = set()
        for a, b in spans.get((r.doc, r.t), []):
            gone.update(range(a, b))
        assert len(gone) == removed
    index.close()


def test_every_window_is_in_one_stretch_with_its_head():
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(0, 400))) for _ in range(30)] + [b"q" * 500]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    e = s.stretches(data, offsets)
    head_of = {}
    for row, start, windows, h in zip(e["row"], e["start"], e["windows"], e["h"]):
        assert 0 < windows <= s.SPREAD
        for k in range(windows):
            w = texts[row][start + k : start + k + L]
            assert len(w) == L and head_of.setdefault(w, h) == h
    assert sum(e["windows"]) == sum(max(0, len(t) - L + 1) for t in texts)
    back = s.unpack([s.pack({**e, "doc": -e["row"] - 1, "t": e["row"], "h": e["h"] >> np.uint64(16), "c": e["c"] >> np.uint64(16)})])
    assert (back["doc"] == -e["row"] - 1).all() and (back["start"] == e["start"]).all() and (back["windows"] == e["windows"]).all()


def scanned(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    e = s.stretches(data, np.cumsum([0, *map(len, texts)]))
    e, _, contexts = s.scan({k: v.astype(np.int64 if k in ("row", "start") else np.uint64) for k, v in {**e, "doc": e["row"]}.items()})
    return e, contexts


def test_different_stretches_with_a_common_window_are_asked_for():
    rnd = random.Random(6)
    prose = lambda n, letters: bytes(rnd.choice(letters) for _ in range(n))
    shared = [prose(rnd.randint(50, 90), b"abcdefgh") for _ in range(20)] + [b"ab" * 40, b"q" * 70, b"word " * 15]
    texts = [prose(rnd.randint(0, 60), b"abcdefgh") + rnd.choice(shared) + prose(rnd.randint(0, 60), b"ab") for _ in range(200)]
    e, contexts = scanned(texts)
    asked = s.meeting(e, contexts)
    seen = {}
    for k, (row, start, windows) in enumerate(zip(e["row"], e["start"], e["windows"].astype(int))):
        for w in range(start, start + windows):
            seen.setdefault(texts[row][w : w + L], {})[e["c"][k]] = k
    met = {k for found in seen.values() if len(found) > 1 for k in found.values()}
    assert len(met) > 100 and asked[list(met)].all()


def test_stretches_that_share_little_more_than_a_head_are_not_asked_for(spark):
    rnd = random.Random(7)
    prose = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [prose(24) for _ in range(30)]
    rows = [(i, prose(60) + phrases[i % 30] + prose(60)) for i in range(300)]
    _, contexts = scanned([t.encode() for _, t in rows])
    assert (contexts > 5).sum() > 50
    index = s.Levels(spark, 8)
    index.add(spark.createDataFrame(rows, "doc_id bigint, text string"), last=True)
    assert index.found(s._ASKED).count() == 0


def test_arrays_go_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(s, "LEAST", 2)
    df = spark.createDataFrame(corpus(8, 60), "doc_id bigint, text string")
    index, most = s.Levels(spark, 8), []
    met = index.rows

    def counted(path, kind):
        out = met(path, kind)
        if kind == s._ENTRY:
            most.append((out.count(), out.select("part").distinct().count()))
        return out

    monkeypatch.setattr(index, "rows", counted)
    index.add(df.where("doc_id % 2 = 0"))
    index.add(df.where("doc_id % 2 = 1"), last=True)
    assert [parts for _, parts in most] == [4, 3, 2, 1] + [4, 4, 3, 3, 2, 2, 1, 1]  # those that were scanned are gone


@pytest.mark.parametrize("keys", [[b"a"], [b"ab", b"abc", b"abd", b"x", b"x"], [b"", b"a"] * 3])
def test_reach_is_the_longest_common_prefix_with_a_neighbour(keys):
    import pyarrow as pa

    keys = sorted(keys)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(keys))), pa.array(keys, pa.binary())], ["k", "key"])
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for size in (1, 2, 10):
        got = [x for out in s._reach(batch.slice(a, size) for a in range(0, len(keys), size)) for x in out["reach"].to_pylist()]
        inner = [max(common(keys[k - 1], keys[k]), common(keys[k], keys[k + 1])) for k in range(1, len(keys) - 1)]
        assert got[1:-1] == inner and len(got) == len(keys) and got[0] > 1000 and got[-1] > 1000


def test_covered_stretches_are_joined_to_spans(spark):
    rnd = random.Random(9)
    rows = [(d, 1, rnd.randrange(900), rnd.randint(1, s.SPREAD)) for d in range(5) for _ in range(4 * d + 1)] + [(7, 1, k, 1) for k in range(300)]
    out = {r.doc: [tuple(x) for x in r.spans] for r in s.spans_of(spark.createDataFrame(rows, "doc bigint, t int, start bigint, windows int")).collect()}
    for d in {r[0] for r in rows}:
        gone = {k for doc, _, a, n in rows if doc == d for k in range(a, a + n + L - 1)}
        assert [k for a, b in out[d] for k in range(a, b)] == sorted(gone)
        assert all(b < a for (_, b), (a, _) in zip(out[d], out[d][1:]))
    assert out[7] == [(0, 349)]


def test_few_or_no_rows(spark, docs, no_docs):
    assert s.repeats_removed(no_docs).count() == 0
    out = s.repeats_removed(docs.withColumn("kept", F.lit(1)).withColumn("t", F.lit(2)))
    assert out.count() == docs.count() and out.where("n_removed > n_bytes").count() == 0

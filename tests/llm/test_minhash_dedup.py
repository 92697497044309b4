import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagframe.llm import minhash_dedup as m
from tagframe.llm.components import components

from .conftest import WORDS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, percent):
    """{doc_id: (sizes, least reachable)}."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    return sorted((i, len(s), min(groups[find(k)])) for k, (i, s) in enumerate(sets))


def check(df, width, percent):
    got = m.near_duplicates(df, width, percent).collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_odd_texts(docs, no_docs, width, percent):
    check(docs, width, percent)
    assert m.near_duplicates(no_docs).count() == 0


def test_groups_of_near_copies(spark, monkeypatch):
    """Copies that drift from a few bases, so that many pairs lie about the threshold and stars alone would not do."""
    monkeypatch.setattr(m, "BLOCK", 16)
    rnd, rows = random.Random(4), []
    for _ in range(4):
        base = [rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(rnd.choice([8, 40, 120]))]
        for _ in range(40):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 14))):
                copy[rnd.randrange(len(copy))] = "z" + str(rnd.randint(0, 999))
            rows.append((rnd.randint(0, 10**6), " ".join(copy)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)


def test_sets_are_those_of_the_words():
    texts = ["A b C a b c", "", None, "x", "é É é É", "a\x00b a\x00b", "one two three four"]
    assert [len(s) for s in m.shingle_sets(pa.array(texts), 3)] == [len(shingles(t, 3)) for t in texts]


def test_densification_fills_every_bin_from_the_set():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)) for n in (1, 2, 50, 1000)]
    for s, values in zip(sets, m.densified(sets), strict=True):
        assert set(values.tolist()) <= set(s.tolist())
    same = m.densified([sets[2], sets[2]])
    assert (same[0] == same[1]).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (100, 100), (None, 3)] + [(500 + i, 400) for i in range(20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys([400, *range(500, 520)], 400)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_stars_not_pairs(spark):
    """A group of many near copies gives about as many edges as members, and equal texts none."""
    text = F.concat(F.lit(" ".join(WORDS * 10) + " "), F.col("id").cast("string"))
    df = spark.range(300).select(F.col("id").alias("doc_id"), text.alias("text")).unionByName(spark.range(300, 600).select(F.col("id").alias("doc_id"), F.lit("same text again and again").alias("text")))
    got = m.near_duplicates(df, 3, 85)
    assert {r.component_id for r in got.collect()} == {0, 300}


def test_rows_not_ids(spark):
    """Rows that share a doc_id with other texts, and rows without one, are each judged by their own text."""
    a, b = " ".join(WORDS * 3), " ".join(WORDS[::-1] * 3)
    rows = [(5, a), (5, b), (3, b + " tail"), (None, a + " end"), (None, a + " end"), (None, "one two three four"), (None, "one two three four"), (9, a), (None, None), (5, b)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(m.near_duplicates(df, 3, 85).collect(), key=str)
    want = [(5, 5), (5, 3), (3, 3), (None, 5), (None, 5), (None, None), (None, None), (9, 5), (None, None), (5, 3)]
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = m.one_of_each(df.withColumn("row", F.lit(1)).withColumn("node", F.lit("x")), 3, 85)
    assert left.columns == ["doc_id", "text", "row", "node"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(5, a), (3, b + " tail"), (None, "one two three four"), (None, None)], key=str)


def test_hubs_are_broadcast(spark, monkeypatch):
    from tagframe.llm import common

    monkeypatch.setattr(common, "HUB", 5)
    left = spark.range(200).select(F.when(F.col("id") < 100, F.lit(None)).when(F.col("id") < 180, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = left.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m")).where("k <> 190")
    for how in ("inner", "left"):
        want = left.join(right.drop("n"), "k", how).select("k", "v", "m")
        got = common.hub_join(left, right, "k", "n", how).select("k", "v", "m")
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    links = [(0, i) for i in range(1, 60)] + [(100 + i, 100 + i + 1) for i in range(10)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), **dict.fromkeys(range(100, 111), 100)}


def test_blocks_of_long_sets(spark, monkeypatch):
    monkeypatch.setattr(m, "SHINGLES", 300)
    rnd, rows = random.Random(6), []
    base = [rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(120)]
    for k in range(40):
        copy = list(base)
        for _ in range(rnd.randint(0, 8)):
            copy[rnd.randrange(len(copy))] = "z" + str(rnd.randint(0, 999))
        rows.append((k, " ".join(copy)))
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85)

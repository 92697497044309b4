import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagframe.llm import hard_negatives as h


def brute(rows, scale=256, positives=5, negatives=10, low=30, high=90):
    """Plain meaning: rows (id, label, vector)."""
    whole = {}
    for i, label, v in sorted((r for r in rows if None not in r[:3] and not any(x is None or not math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], [math.floor(scale * x) for x in r[2]])):
        whole.setdefault(i, (label, [math.floor(scale * x) for x in v]))
    out = []
    for a, (label, q) in whole.items():
        if a % 100:
            continue
        score = {i: sum(x * y for x, y in zip(q, v)) for i, (_, v) in whole.items() if i != a}
        by = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in by if whole[i][0] == label][:positives]:
            held = [i for i in by if whole[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(held, 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [1, 300, 2**20, 2**40])
def test_packed_scores_are_exact(top):
    rnd = random.Random(top)
    rows = [[rnd.randint(-top, top) for _ in range(9)] for _ in range(50)]
    columns = [np.array(c, np.int64 if top < 2**30 else object) for c in zip(*rows)]
    packed = h.Packed(columns, 50, top)
    for anchor in rows[:10]:
        found = packed.scores(anchor)
        assert [int(x) for x in found] == [max(-h.LIMIT, min(h.LIMIT, sum(x * y for x, y in zip(anchor, r)))) for r in rows]


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        base = (i * 7) % 4
        rows.append((i, rnd.randint(0, 3) if i % 11 else None, [rnd.gauss(1 if k % 4 == base else 0.2, 0.5) for k in range(12)], 1.0, "x"))
    rows += [(i, 1, [0.5] * 12, 1.0, "x") for i in range(900, 960)]  # ties
    rows += [(100, 2, [1.0] * 12, 0.0, "y"), (100, 2, [1.0] * 12, 0.0, "y"), (1000, 1, None, 0.0, "y"), (1100, 1, [1.0, None], 0.0, "y"), (1200, 1, [float("nan")] * 12, 0.0, "y"), (None, 1, [1.0] * 12, 0.0, "y"), (1300, 1, [], 0.0, "y"), (1400, 2, [1.0, 2.0], 0.0, "y"), (1500, 3, [float("inf")] * 12, 0.0, "y")]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>, score double, rank string")
    plain = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    want = brute(plain)
    assert len(want) > 200
    for cells in ((4096, 4096), (100, 3)):  # one cell, or many
        monkeypatch.setattr(h, "CANDIDATES", cells[0])
        monkeypatch.setattr(h, "ANCHORS", cells[1])
        got = h.hard_negatives(df, F.col("vec_id") % 100 == 0)
        assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_few_or_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id bigint, label int, embedding array<double>")
    assert h.hard_negatives(empty, F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(100, 1, [1.0])], empty.schema)
    assert h.hard_negatives(one, F.col("vec_id") % 100 == 0).count() == 0
    three = spark.createDataFrame([(100, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5])], empty.schema)
    assert [tuple(r) for r in h.hard_negatives(three, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1, 2, 131072, 65536)]

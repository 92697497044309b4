import random
import time

import pytest
from pyspark.sql import functions as F

from tagframe.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1}, {"a": 3, "b": 5, "c": 1}, {"a": 7, "b": 2, "c": 2, "d": 1}, {str(i): i + 1 for i in range(20)}])
def test_less_than_one_block_off_and_within_windows(weights):
    total, count = sum(weights.values()), dict.fromkeys(weights, 0)
    for slot, (s, j) in enumerate(mixing.period(weights)):
        count[s] += 1
        assert count[s] == j
        assert (j - 1) * total // weights[s] <= slot < -(-j * total // weights[s])
        assert all(abs(count[x] - (slot + 1) * weights[x] / total) < 1 for x in weights)
    assert count == weights


def test_every_block_has_one_slot():
    rnd = random.Random(1)
    for _ in range(20):
        weights = {s: rnd.randint(1, 9) for s in "abcd"}
        blocks = {s: rnd.randint(0, 50) for s in "abcd"}
        seen = {}
        for p in mixing.phases(blocks, weights):
            for s, (slots, before, n, weight) in p["sources"].items():
                for b in range(before, before + n):
                    j = b - before
                    seen[p["start"] + j // weight * p["size"] + slots[j % weight]] = (s, b)
        assert sorted(seen) == list(range(sum(blocks.values())))
        assert sorted(seen.values()) == sorted((s, b) for s in blocks for b in range(blocks[s]))


def test_rows_are_all_kept_and_shares_hold(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(3000)] + [(None, None), (7, "zzz"), (7, "zzz")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string").withColumn("slot", F.lit("clash"))
    out = mixing.mixed_order(df, {"a": 1, "b": 1}, block_docs=4).toPandas()
    assert len(out) == len(rows)
    assert set(out.groupby("slot")["stream"].nunique()) == {1}
    assert sorted(out["slot"].unique()) == list(range(out["slot"].nunique()))
    first = out[out["phase"] == 0].drop_duplicates("slot").sort_values("slot")
    n = len(first)
    for s in ("a", "b"):
        got = (first["stream"] == s).cumsum().to_numpy()
        assert all(abs(got[k] - (k + 1) / 3) < 1 for k in range(n))  # the third stream holds sources without a weight
    assert ((first["release"] <= first["slot"]) & (first["slot"] < first["due"])).all()


def test_sources_beyond_those_laid_out_keep_shares_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 3)
    sizes = {"a": 400, "b": 400, "c": 300, **{f"d{k}": 40 + 10 * k for k in range(11)}, None: 500}
    rows = [(k * 1000 + i, x) for k, (x, n) in enumerate(sizes.items()) for i in range(n)]
    out = mixing.mixed_order(spark.createDataFrame(rows, "doc_id bigint, source string"), block_docs=4).toPandas()
    out["source"] = out["source"].astype(object).where(out["source"].notna(), None)
    assert sorted(out["doc_id"]) == [i for i, _ in rows]
    one = out.drop_duplicates("slot").sort_values("slot")
    assert out.groupby("slot")["source"].nunique(dropna=False).eq(1).all()
    assert list(one["slot"]) == list(range(sum(-(-n // 4) for n in sizes.values())))
    weight = {x: round(20 * (n / 500) ** 0.5) for x, n in sizes.items()}
    total, order = sum(weight.values()), one["source"].tolist()
    until = min(max(k for k, y in enumerate(order) if y == x) for x in sizes)  # all sources have blocks up to here
    assert until > 100
    count = dict.fromkeys(sizes, 0)
    for k, x in enumerate(order[:until]):
        count[x] += 1
        assert all(abs(count[y] - (k + 1) * weight[y] / total) < 3 for y in sizes)


def test_odd_tables(docs, no_docs):
    assert mixing.mixed_order(docs).count() == docs.count()
    assert mixing.mixed_order(no_docs).count() == 0
    assert set(mixing.mixed_order(docs).columns) >= set(docs.columns)


@pytest.mark.parametrize("weight", [0, -1, 0.5])
def test_weights_must_be_whole_and_positive(docs, weight):
    with pytest.raises(ValueError, match="whole numbers"):
        mixing.mixed_order(docs, {"s": weight, "t": 1})


def scheduled(sources, hashes, weight=None, size=8):
    """doc_ids with slot and place, by choosing the block for each slot in turn; sources: by doc_id."""
    by = {x: sorted((i for i in sources if sources[i] == x), key=lambda i: (hashes[i], i)) for x in set(sources.values())}
    most = max(map(len, by.values()))
    weight = weight or {x: max(1, round(20 * (len(d) / most) ** 0.5)) for x, d in by.items()}
    blocks = {x: [d[k : k + size] for k in range(0, len(d), size)] for x, d in by.items()}
    out, slot = [], 0
    while blocks:
        total, t, done = sum(weight[x] for x in blocks), 0, dict.fromkeys(blocks, 0)
        while all(blocks.values()):
            ready = [x for x in blocks if done[x] * total // weight[x] <= t]
            x = min(ready, key=lambda x: (-(-(done[x] + 1) * total // weight[x]), x))
            out += [(i, slot, k) for k, i in enumerate(blocks[x].pop(0))]
            slot, t, done[x] = slot + 1, t + 1, done[x] + 1
        blocks = {x: b for x, b in blocks.items() if b}
    return out


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 2, "c": 1}])
def test_rows_against_a_simulated_schedule(spark, weights):
    df = spark.range(1700).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 < 4, "a").when(F.col("id") % 7 < 6, "b").otherwise("c").alias("source"))
    rows = mixing.mixed_order(df, weights).orderBy("slot", "place").collect()
    hashes = {r.doc_id: r.h for r in df.selectExpr("doc_id", "xxhash64(CAST(doc_id AS STRING)) AS h").collect()}
    assert [(r.doc_id, r.slot, r.place) for r in rows] == scheduled({r.doc_id: r.source for r in rows}, hashes, weights)


def test_rows_without_id_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 50)
    df = spark.range(1000).select(F.when(F.col("id") < 30, F.col("id")).alias("doc_id"), F.lit("a").alias("source"))
    out = mixing.mixed_order(df)
    assert out.columns[:2] == ["doc_id", "source"] and "_row" not in out.columns
    assert sorted((r.slot, r.place) for r in out.collect()) == [(k // 8, k % 8) for k in range(1000)]


def test_great_weights_are_not_laid_out_beyond_the_blocks(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    weights = {"a": 1_500_000, "b": 1_500_001}
    began = time.time()
    assert len(mixing.phases({"a": 250, "b": 250}, weights)) <= 2 and time.time() - began < 1
    order = [r.source for r in mixing.mixed_order(df, weights).where("place = 0").orderBy("slot").collect()]
    assert len(order) == 500 and all(abs(order[: k + 1].count("a") - (k + 1) / 2) < 1 for k in range(len(order)))
    share = {"a": 6_000_000, "b": 2_000_000, "c": 4_000_000}
    assert [p["size"] for p in mixing.phases({"a": 10**9, "b": 10**9, "c": 10**9}, share)] == [6, 3, 1]


def test_columns_that_clash_stay(spark, monkeypatch):
    names = ["size", "weight", "count", "before", "start", "path", "slots", "shards", "offset", "_h", "_n", "_shard", "_row", "n", "column 3", "others", "shares"]
    rows = [(i, None if i % 5 == 0 else f"s{i % 4}", *range(len(names))) for i in range(60)] + [(None, "s1", *range(len(names)))]
    df = spark.createDataFrame(rows, ["doc_id", "source", *names])
    for most in (256, 2):
        monkeypatch.setattr(mixing, "SOURCES", most)
        out = mixing.mixed_order(df)
        assert out.columns == ["doc_id", "source", *names, *mixing.NEW]
        got = out.collect()
        assert len(got) == len(rows) and all([r[c] for c in names] == list(range(len(names))) for r in got)


def test_a_thousand_sources_of_few_blocks(spark):
    df = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1000).alias("source"))
    out = mixing.mixed_order(df).select("slot", "place").distinct().count()
    assert out == 24_000

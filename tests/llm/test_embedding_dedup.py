import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagframe.llm import embedding_dedup as e

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string"


def brute(rows):
    ids, units = [], []
    for i, v, *_ in rows:
        ids.append(i)
        ok = v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)
        units.append(np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None)
    links = [[b for b in range(len(ids)) if b != a and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.9] for a in range(len(ids))]
    part = list(range(len(ids)))
    for _ in range(len(ids)):
        new = [min([part[a], *(part[b] for b in links[a])], key=lambda k: (ids[k], k)) for a in range(len(ids))]
        if new == part:
            break
        part = new
    return sorted((ids[a], len(links[a]), min(ids[part[a]], ids[a])) for a in range(len(ids)))


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA)
    got = e.linked_vectors(df)
    out = got.collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute(rows)
    assert all(r.recall == 1.0 and r.kept == (r.vec_id == r.component_id) for r in out)


def test_groups_chains_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 32)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for size, spread in ((60, 0.02), (40, 0.35), (40, 0.42), (1, 0), (1, 0), (2, 0.1)):
        base = rng.standard_normal(16)
        for _ in range(size):
            rows.append((k, (base + spread * rng.standard_normal(16)).tolist()))
            k += 1
    for _ in range(100):
        rows.append((k, rng.standard_normal(16).tolist()))
        k += 1
    rows += [(k, rows[0][1]), (k + 1, rows[0][1]), (k + 1, rows[0][1])]
    rows += [(k + 2, None), (k + 3, []), (k + 4, [0.0] * 16), (k + 5, [1.0, None]), (k + 6, [float("nan")] * 16), (k + 7, [float("inf")] + [0.0] * 15), (k + 8, [1.0, 0.0]), (k + 9, [2.0, 0.0])]
    check(spark, rows)


def test_empty(spark):
    assert e.linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, [1.0, 0.0])])


@pytest.mark.parametrize("n", [400])
def test_recall_of_the_lists(spark, n):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((n // 4, 24))
    x = np.concatenate([base + 0.1 * rng.standard_normal(base.shape) for _ in range(4)])
    df = spark.createDataFrame([(i, v.tolist(), 0, "x") for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r.n_links for r in e.linked_vectors(df).select("vec_id", F.col("n_links")).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    true = (u @ u.T >= 0.9).sum(1) - 1
    assert sum(min(got[i], t) for i, t in enumerate(true)) >= 0.99 * true.sum()


def test_lists_that_grew_are_audited(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.ones(16) + 0.2 * rng.standard_normal((150, 16))  # all may matter, so lists grow beyond 128 entries
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(bytes([k]), v.tobytes(), e.code_of(v), 0.1) for k, v in enumerate(x)], "node binary, unit binary, code binary, radius double")
    audits, audit = [], e.recall
    monkeypatch.setattr(e, "recall", lambda *a: audits.append(audit(*a)) or audits[-1])
    near = {r.u: len(r.near) for r in e.neighbour_lists(nodes, 1.2).collect()}
    assert audits and audits[-1][0] == 1.0
    assert set(near.values()) == {149}


def test_all_are_compared_where_rounds_do_not_end_in_an_audit_that_holds(spark, monkeypatch):
    monkeypatch.setattr(e, "MOST_ROUNDS", 2)
    monkeypatch.setattr(e, "WHOLE", 16)
    # lists that always miss their best entries
    lost = e.descended
    monkeypatch.setattr(e, "descended", lambda *a: lost(*a).select("u", F.slice("near", 4, 100).alias("near")))
    rng = np.random.default_rng(6)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base + 0.35 * rng.standard_normal(base.shape) for _ in range(4)])
    check(spark, [(k, v.tolist()) for k, v in enumerate(x)] + [(100, [1.0, 0.0]), (101, [1.0, 0.1])])


def test_codes_never_take_an_angle_too_large():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 48)) * rng.exponential(1, (60, 48))
    x = np.concatenate([x, x + 0.05 * rng.standard_normal(x.shape)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = e.least_angles(*e.decoded(pa.array([e.code_of(v) for v in x])))
    true = np.arccos(np.clip(x @ x.T, -1, 1))
    off = ~np.eye(len(x), dtype=bool)
    assert (got[off] <= true[off] + 1e-9).all() and np.median((true - got)[off]) < 0.05


def test_lost_links_are_noticed(spark, monkeypatch):
    """Lists that lose what they should hold, and an audit of leaders that does not look: the audit of links sees it."""
    monkeypatch.setattr(e, "recall", lambda *a: (1.0, 1))
    lost = e.descended
    monkeypatch.setattr(e, "descended", lambda *a: lost(*a).select("u", F.slice("near", 5, 100).alias("near")))
    rng = np.random.default_rng(11)
    base = rng.standard_normal((20, 16))
    x = np.concatenate([base + 0.3 * rng.standard_normal(base.shape) for _ in range(4)])
    check(spark, [(k, v.tolist()) for k, v in enumerate(x)])

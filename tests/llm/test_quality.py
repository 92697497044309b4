import random
import zlib

import numpy as np
import pytest

from tagframe.llm import quality

from .conftest import WORDS


def text(good, rnd):
    words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ed"]) for _ in range(rnd.randint(30, 80))]
    if good:
        return " ".join(words).capitalize() + "."
    return rnd.choice([" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 60), " ".join(w + "$$$" for w in words)])


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(5)
    rows = [(i, text(i % 4 != 0, rnd), int(i % 4 != 0)) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, quality int")


def test_held_out_accuracy_and_columns(labelled):
    out = quality.quality_scores(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")).join(labelled.select("doc_id", "quality"), "doc_id").toPandas()
    assert len(out) == 600
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.97
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.7)).all()


def test_held_out_labels_do_not_matter(labelled, spark):
    docs, labels = labelled.select("doc_id", "text").limit(200), labelled.select("doc_id", "quality")
    other = spark.createDataFrame([(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.quality) for r in labels.collect()], "doc_id bigint, quality int")
    a, b = ({r.doc_id: r.score for r in quality.quality_scores(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_odd_tables(docs, no_docs, labelled):
    labels = labelled.select("doc_id", "quality")
    out = quality.quality_scores(docs, labels)
    assert out.count() == docs.count() and out.where("score IS NULL").count() == 0
    assert quality.quality_scores(no_docs, labels).count() == 0
    none = quality.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def test_dual_coordinate_descent_separates():
    features = [np.array([1, 5]) if k % 2 else np.array([2, 5]) for k in range(100)]
    labels = np.array([k % 2 for k in range(100)], float)
    weight, bias, offset = quality.fit(features, labels)
    score = [1 / (1 + np.exp(-(weight[f].sum() / np.sqrt(2) + bias + offset))) for f in features]
    assert all((s > 0.7) == bool(y) for s, y in zip(score, labels, strict=True))

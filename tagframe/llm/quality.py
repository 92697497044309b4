"""Quality classifier: naive Bayes support vectors.

Features are indicators: byte trigrams, n-grams (one to three) of word shapes, and marks of how large a share of the
words has a trait (capitals, odd endings, a repeat of an earlier word and so on), all hashed into FEATURES cells. Each
indicator is scaled by the log ratio of its smoothed, normalised counts in the two classes; a linear hinge-loss model on
the scaled indicators is fitted by dual coordinate descent; a logistic curve fitted to the margins of a part of the rows
that the model has not seen makes scores of them.

The model is fitted on a bounded sample of labelled rows (`sample`), which one task gathers; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_held_out, mixed, slices, table, utf8, word_hashes

FEATURES = 1 << 17
#: Labelled rows that the model is fitted on at most. Scoring has no such bound.
SAMPLE = 5_000
#: Weight of a margin violation, passes of coordinate descent, share of the sample that fits the logistic curve.
COST, PASSES, CURVE = 1.0, 12, 5
THRESHOLD = 0.7

_UPPER, _LETTER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?)\"'")] = True
_MARKS = np.array([0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])


def _traits(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shape code, traits) of each word."""
    words, rows, start, end = word_hashes(data, offsets)
    if not len(words):
        return rows, np.zeros(0, np.uint64), np.zeros((0, 7), bool)
    first, last, second = data[start], data[end - 1], data[np.minimum(start + 1, end - 1)]
    size = np.digitize(end - start, [2, 3, 5, 9, 17, 40])
    before = np.zeros(len(words), np.int64)
    for k in (1, 2):
        before[k:] |= ((words[k:] == words[:-k]) & (rows[k:] == rows[:-k])) * k
    order = np.lexsort((words, rows))
    seen = np.zeros(len(words), bool)
    seen[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    capitals = _UPPER[first] & _UPPER[second] & (end - start > 1)
    ending = np.where(_LETTER[last] | _DIGIT[last], 0, np.where(_STOP[last], 1, 2))
    bare = ~_LETTER[first] & ~_DIGIT[first] & (end - start <= 2)
    code = ((((_UPPER[first] * 2 + capitals) * 3 + ending) * 8 + size) * 4 + before) * 4 + _DIGIT[first] * 2 + bare
    traits = np.stack([capitals, ending == 2, before > 0, seen & (size >= 3), bare, _DIGIT[first], size >= 5], 1)
    return rows, code.astype(np.uint64), traits


def indicators(text: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted cells of its features."""
    for at in range(0, len(text), 256):
        part = text.slice(at, 256)
        data, offsets = utf8(part)
        grid = np.zeros((len(part), FEATURES), bool)
        flat, low = grid.reshape(-1), np.uint64(64 - FEATURES.bit_length() + 1)

        def put(rows: np.ndarray, keys: np.ndarray, flat=flat, low=low) -> None:
            flat[rows * FEATURES + (mixed(keys) >> low).astype(np.int64)] = True

        if len(data) > 2:
            d = data.astype(np.uint64)
            owner = np.repeat(np.arange(len(part)), np.diff(offsets))
            put(owner[:-2], d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16) | np.uint64(1 << 40))
        rows, code, traits = _traits(data, offsets)
        key = np.zeros(len(code), np.uint64)
        for n in range(3):
            key = key[: max(0, len(code) - n)] * np.uint64(4099) + code[n:] + np.uint64(1)
            put(rows[: len(key)], key | np.uint64((n + 2) << 40))
        words = np.maximum(1, np.bincount(rows, minlength=len(part)))
        for t in range(traits.shape[1]):
            share = np.bincount(rows[traits[:, t]], minlength=len(part)) / words
            for k, mark in enumerate(_MARKS):
                grid[share >= mark, int(mixed(np.array([(9 << 40) | t << 8 | k], np.uint64))[0] >> low)] = True
        for row in grid:
            yield np.flatnonzero(row)


def fit(features: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weight of each cell, slope and offset of the logistic curve) from indicators and labels 0 or 1."""
    n = len(features)
    if not n or labels.min() == labels.max():  # nothing to tell apart: every text gets its one label's score
        return np.zeros(FEATURES, np.float32), 0.0, 8.0 if n and labels.max() else -8.0 if n else 0.0
    rng = np.random.default_rng(5)
    part = rng.permutation(n)
    curve = part[: n // CURVE] if n >= 50 else part
    train = part[n // CURVE :] if n >= 50 else part
    if labels[train].min() == labels[train].max():
        train = curve = part
    counts = [np.ones(FEATURES), np.ones(FEATURES)]
    for i in train:
        counts[int(labels[i])][features[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = 2.0 * labels - 1
    share = np.array([np.mean(labels[train] == c) for c in (0, 1)])
    cost = COST * 0.5 / share[labels.astype(int)]
    scale = [ratio[f] / max(1.0, np.sqrt(len(f))) for f in features]
    norm = np.array([s @ s + 1.0 for s in scale])
    weight, bias, alpha = np.zeros(FEATURES), 0.0, np.zeros(n)
    for _ in range(PASSES):
        for i in rng.permutation(train):
            f, s = features[i], scale[i]
            gradient = sign[i] * (weight[f] @ s + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weight[f] += step * s
                bias += step
                alpha[i] = new
    margin = np.array([weight[features[i]] @ scale[i] + bias for i in curve])
    # logistic curve by Newton steps on slightly smoothed targets
    pos, neg = (labels[curve] == 1).sum(), (labels[curve] == 0).sum()
    target = np.where(labels[curve] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w, g = p * (1 - p) + 1e-9, p - target
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        a, b = a - da, b - db
    return (weight * ratio * a).astype(np.float32), bias * a, b


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, labels = [], []
    for batch in batches:
        features += [f.astype(np.int32) for f in indicators(batch["text"])]
        labels += batch["label"].to_pylist()
    weight, slope, offset = fit(features, np.array(labels, np.float64))
    yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()], pa.binary()), pa.array([float(slope)]), pa.array([float(offset)])], ["weight", "bias", "offset"])


def train(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> tuple[bytes, float, float]:
    """A model from docs(doc_id, text) and known(doc_id, label 0/1), fitted on at most `sample` rows.

    The labels with the least hashes of doc_id are the sample, so it is the same on every run.
    """
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = known.where("label IN (0, 1)").orderBy(*order).limit(sample)
    part = docs.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(sample)
    fitted = part.select("text", "label").coalesce(1).mapInArrow(_fit, "weight binary, bias double, offset double").first()
    return tuple(fitted) if fitted else (np.zeros(FEATURES, np.float32).tobytes(), 0.0, 0.0)


def scored(docs: DataFrame, model: tuple[bytes, float, float]) -> DataFrame:
    """docs with a column score added (0 to 1; a clashing column is replaced). Null counts as an empty text."""
    weights = docs.sparkSession.sparkContext.broadcast(bytes(model[0]))
    bias, offset = model[1], model[2]
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.frombuffer(weights.value, np.float32)
        for batch in slices(batches, "text"):
            margin = np.array([weight[f].sum(dtype=np.float64) / max(1.0, np.sqrt(len(f))) for f in indicators(batch["text"])])
            score = 1 / (1 + np.exp(-np.clip(margin + bias + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("score")).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality) -> docs' columns, held_out, score, predicted.

    Labels of held-out rows, of rows without text and other than 0 and 1 are not learned from; without any label every
    score is 0.5. Rows repeat as docs repeats them; columns of docs that clash with the new ones are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    known = labels.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = train(docs.select("doc_id", "text"), known)
    return scored(docs, model).withColumns({"held_out": is_held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")

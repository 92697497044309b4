"""Hard negatives by Kronecker-packed products.

Vectors become integers (a fixed scale, rounded down), so scores are exact. Rows are dealt into cells of at most about
CANDIDATES rows and ANCHORS anchors. In a cell the k-th components of all candidates, made non-negative by a bias, lie
side by side in the fields of one wide integer, which is multiplied once by each anchor's k-th component; the sum over k
holds all the anchor's scores, as fields are wide enough to never carry over. An anchor's best positives of all cells
come first; with their scores known, a second pass takes the best negatives within each positive's band.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Rows of a cell: candidates and anchors. They bound a task's memory; the results are the same with any.
CANDIDATES, ANCHORS = 4096, 4096
SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Scores beyond this stay there, so that a hundred times them is still a long.
LIMIT = 9 * 10**16


def _matrix(vectors: pa.ListArray, width: int) -> list[np.ndarray]:
    """One array for each component, of exact integers; vectors that are shorter have zeros there."""
    values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(vectors), width))
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)
    out[np.repeat(np.arange(len(vectors)), sizes), at] = values[offsets[0] : offsets[-1]]
    if np.abs(out).max(initial=0) < 2.0**62:
        return list(out.T.astype(np.int64))
    return [np.array([int(x) for x in column], object) for column in out.T]


class Packed:
    """The candidates of a cell in wide integers, one for each component."""

    def __init__(self, columns: list[np.ndarray], n: int, anchor_most: int):
        self.n, self.columns = n, columns
        self.bias = max((int(-c.min()) for c in columns), default=0)
        self.bias = max(self.bias, 0)
        top = max((int(c.max()) for c in columns), default=0) + self.bias
        most = max(1, len(columns) * top * 2 * anchor_most)
        self.width = (most.bit_length() + 7) // 8
        self.width = 8 if 4 < self.width <= 8 else 4 if self.width <= 4 else self.width
        self.anchor_bias = anchor_most
        self.wide = []
        self.sums = [0] * n if any(c.dtype == object for c in columns) else np.zeros(n, np.int64)
        for c in columns:
            fields = c + self.bias
            if self.width <= 8:
                packed = fields.astype(f"<u{self.width}").tobytes()
            else:
                packed = b"".join(int(x).to_bytes(self.width, "little") for x in fields)
            self.wide.append(int.from_bytes(packed, "little"))
            self.sums = self.sums + c

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner products of all candidates with an anchor."""
        total = 0
        for x, wide in zip(anchor, self.wide, strict=True):
            total += (x + self.anchor_bias) * wide
        data = total.to_bytes(self.n * self.width, "little")
        # fields hold the sum of (x + anchor_bias) * (y + bias)
        extra = self.bias * (sum(anchor) + len(anchor) * self.anchor_bias)
        if self.width <= 8 and not isinstance(self.sums, list) and self.sums.dtype != object:
            found = np.frombuffer(data, f"<u{self.width}").astype(np.int64) - extra - self.anchor_bias * self.sums
            return np.clip(found, -LIMIT, LIMIT)
        found = [int.from_bytes(data[k * self.width : (k + 1) * self.width], "little") - extra - self.anchor_bias * int(self.sums[k]) for k in range(self.n)]
        return np.array([max(-LIMIT, min(LIMIT, x)) for x in found], np.int64)


def _cell(best: Callable[[dict, int, np.ndarray, np.ndarray, np.ndarray], list]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a cell gives out: the rows that `best` takes of an anchor's scores."""

    def run(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        names = ["anchor_id", "of", "vec_id", "score"]
        rows: list[tuple] = []
        if candidates.num_rows and anchors.num_rows:
            candidates = candidates.sort_by("vec_id").combine_chunks()
            anchors = anchors.combine_chunks()
            ids, labels = candidates["vec_id"].to_numpy(), candidates["label"].to_numpy()
            c, a = (t["q"].combine_chunks() if isinstance(t["q"], pa.ChunkedArray) else t["q"] for t in (candidates, anchors))
            width = max(max((len(v) for v in x), default=0) for x in (c, a))
            of_anchors = _matrix(a, width)
            most = max((int(abs(x).max()) for x in of_anchors), default=0)
            packed = Packed(_matrix(c, width), len(ids), most)
            for k, row in enumerate(anchors.drop_columns(["q"]).to_pylist()):
                scores = packed.scores([int(x[k]) for x in of_anchors])
                rows += best(row, row["anchor_id"], scores, ids, labels)
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.table([pa.array(x, pa.int64()) for x in columns], names)

    return run


def _first(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The n candidates of `among` with the highest scores, ties in their order (that of ids)."""
    if len(among) > n:
        least = np.partition(scores[among], len(among) - n)[len(among) - n]
        among = among[scores[among] >= least]
    return among[np.argsort(-scores[among], kind="stable")][:n]


def _positives(n: int) -> Callable:
    def best(row: dict, anchor: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list:
        found = _first(scores, np.flatnonzero((labels == row["label"]) & (ids != anchor)), n)
        return [(anchor, 0, int(ids[k]), int(scores[k])) for k in found]

    return best


def _negatives(n: int, low: int, high: int) -> Callable:
    def best(row: dict, anchor: int, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list:
        other = np.flatnonzero(labels != row["label"])
        of = 100 * scores[other]
        out = []
        for p in row["positives"]:
            s = p["score"]
            found = _first(scores, other[(of >= low * s) & (of <= high * s)], n)
            out += [(anchor, p["vec_id"], int(ids[k]), int(scores[k])) for k in found]
        return out

    return best


def _met(candidates: DataFrame, anchors: DataFrame, parts: int, blocks: int, best: Callable) -> DataFrame:
    """(anchor_id, of, vec_id, score): what `best` takes in each cell of candidates (part) and anchors (block)."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("block", every(blocks)).groupBy("part", "block")
    right = anchors.withColumn("part", every(parts)).groupBy("part", "block")
    return left.cogroup(right).applyInArrow(_cell(best), "anchor_id bigint, of bigint, vec_id bigint, score bigint")


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part: q has each component times scale, rounded down, as a double.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that share an id one
    stays: the least label, then the least vector.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    q = F.transform(x, lambda v: _floor(v * scale))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.label", "row.q")


def _floor(x: Column) -> Column:
    """Rounded down, as a double; beyond 2**53 a double is whole."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def hard_negatives(vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors(vec_id, label, embedding, ...) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which is_anchor (of vec_id and label) holds. An anchor's positives are its `positives` best
    other rows of its label. For each of them the `negatives` best rows of other labels with scores from low to high
    hundredths of the positive's are given out, from rank 1; there may be none. Ties go to the smaller id. See integers()
    for the rows that take no part; shorter vectors have zeros where they end. Scores are kept within LIMIT. Other
    columns play no role. Every anchor meets every row once in each of two passes, in cells of bounded size: a cell takes
    the best of its own, so per anchor a few rows for each cell are shuffled.
    """
    rows = saved(integers(vectors, scale), "integers")
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    parts, blocks = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(n_anchors / ANCHORS))
    deal = lambda k, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(k)).cast("int")
    candidates = rows.withColumn("part", deal(parts, 1))
    anchors = rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("label"), F.col("q").alias("q"), deal(blocks, 2).alias("block"))
    first = _met(candidates, anchors, parts, blocks, _positives(positives))
    best = Window.partitionBy("anchor_id", "of").orderBy(F.desc("score"), "vec_id")
    first = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    lists = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives"))
    lists = saved(lists, "positives")
    found = _met(candidates, anchors.join(lists, "anchor_id"), parts, blocks, _negatives(negatives, low, high))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    scores = lists.select("anchor_id", F.explode("positives").alias("p")).select("anchor_id", F.col("p.vec_id").alias("of"), F.col("p.score").alias("positive_score"))
    out = found.join(scores, ["anchor_id", "of"])
    return out.select("anchor_id", F.col("of").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th label is off by one, as in a set with wrong labels; every 100th row is an anchor."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM q a, q b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

"""Maximum matching of rows of two sides whose fractions differ by no more than a tolerance.

Fractions are cut into cells, and one grouping by the other columns and the cells settles most of them: those where no row
is near a border, so that none has a partner elsewhere, and each side has one value, or all are near each other and as many
on both sides. The rows of the other cells are a smaller matching of their own.

These fall into groups that no match can leave: rows of one key, sorted by one fraction, are cut wherever two neighbours are
further apart than the tolerance, and so on with the next fraction. The cuts come from one range sort for each fraction;
what a task cannot know, whether its first row goes on with the last group of the task before, is settled by one
row for each task. A group of one fraction is matched by a sweep, one of several by augmenting paths.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path

#: Tolerances a side of a cell; no round number, as round values would gather at the borders.
CELL = 618.0339887498949
#: In cells of higher numbers, a double says too little about how far a value is from the border.
FAR = 2.0**43


def _cut(tolerance: float):
    """Numbers the runs of a sorted task: rows (g, x, ...) gain task, run, and whether the run is the task's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, x = batch["g"].to_pylist(), batch["x"].to_numpy(zero_copy_only=False)
            near = np.zeros(len(g), bool)
            near[1:] = np.array([a == b for a, b in zip(g, g[1:], strict=False)], bool) & (np.diff(x) <= tolerance)
            near[0] = before is not None and before[0] == g[0] and x[0] - before[1] <= tolerance
            fresh = ~near
            if before is None:
                fresh[0] = False
            numbers = number + np.cumsum(fresh)
            number, before = int(numbers[-1]), (g[-1], x[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), task, np.int32)), pa.array(numbers.astype(np.int64))], [*batch.schema.names, "task", "run"])

    return run


def grouped(rows: DataFrame, tolerance: float) -> DataFrame:
    """rows(g string, x double, ...) with g narrowed to the runs of x in it whose neighbours are within the tolerance.

    The runs of a task are numbered, and rows are written once, as the numbering must not change between its uses. A
    run that goes on over the limits of tasks takes the number of its beginning; that needs the first and last row of
    each task, which are gathered: a row for each task, whatever the rows.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "runs")
    schema = T.StructType([*rows.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("run", T.LongType())])
    rows.repartitionByRange("g", "x").sortWithinPartitions("g", "x").mapInArrow(_cut(tolerance), schema).write.parquet(path)
    cut = spark.read.schema(schema).parquet(path)
    edge = F.struct("g", "x", "run")
    ends = cut.groupBy("task").agg(F.min(edge).alias("first"), F.max(edge).alias("last")).orderBy("task").collect()
    heads, before = [], None  # (task, the group that its first run belongs to)
    for r in ends:
        own = f"{r.task}-0"
        goes_on = before is not None and before[0] == r.first.g and r.first.x - before[1] <= tolerance
        head = before[2] if goes_on else own
        heads.append((r.task, head))
        before = (r.last.g, r.last.x, head if r.last.run == 0 else f"{r.task}-{r.last.run}")
    names = F.broadcast(spark.createDataFrame(heads, "task int, head string"))
    own = F.concat_ws("-", "task", "run")
    out = cut.join(names, "task").withColumn("g", F.when(F.col("run") == 0, F.col("head")).otherwise(own))
    return out.drop("task", "run", "head")


class _Row:
    """One different row: its place in the fractions, and how many of it each side has left."""

    __slots__ = ("x", "counts", "row")

    def __init__(self, x: list[float], left: int, right: int, row: dict):
        self.x, self.counts, self.row = x, [left, right], row


def _met(a: _Row, b: _Row, side: int) -> None:
    """Matches what a has on a side with what b has on the other."""
    n = min(a.counts[side], b.counts[1 - side])
    a.counts[side] -= n
    b.counts[1 - side] -= n


def _swept(rows: Iterator[_Row], tolerance: float) -> Iterator[_Row]:
    """Matches sorted rows of one fraction; each takes the earliest of the other side that is near enough. Holds no more than the rows within the tolerance."""
    waiting: tuple[deque, deque] = (deque(), deque())
    held: deque = deque()
    for row in rows:
        while held and row.x[0] - held[0].x[0] > tolerance:
            yield held.popleft()
        for side in (0, 1):
            other = waiting[1 - side]
            while other and (row.x[0] - other[0].x[0] > tolerance or not other[0].counts[1 - side]):
                other.popleft()
            while other and row.counts[side]:
                _met(row, other[0], side)
                if not other[0].counts[1 - side]:
                    other.popleft()
        _met(row, row, 0)
        for side in (0, 1):
            if row.counts[side]:
                waiting[side].append(row)
        held.append(row)
    yield from held


def _augmented(rows: list[_Row], tolerance: float) -> list[_Row]:
    """Matches rows of several fractions, as many as can be: along paths that alternate between the sides, until there is none."""
    if all(r.counts[0] == r.counts[1] for r in rows):
        for r in rows:
            r.counts = [0, 0]
        return rows
    x = np.array([r.x for r in rows])
    left, right = ([r.counts[side] for r in rows] for side in (0, 1))
    order = np.argsort(x[:, 0], kind="stable")
    first = x[order, 0]
    low, high = np.searchsorted(first, x[:, 0] - 2 * tolerance), np.searchsorted(first, x[:, 0] + 2 * tolerance, "right")
    has = np.array(right) > 0
    near = {}
    for a in np.flatnonzero(np.array(left) > 0).tolist():
        found = order[low[a] : high[a]]
        near[a] = found[has[found] & (np.abs(x[found] - x[a]) <= tolerance).all(axis=1)].tolist()
    flow: dict[int, dict[int, int]] = {}  # right row: left row: how many of them are matched
    for a in sorted(near, key=lambda k: len(near[k])):
        while left[a]:
            reached: dict[int, int] = {}  # right row: the left row it was reached from
            freed: dict[int, int] = {a: -1}  # left row: the right row whose match it could give up
            queue, end = deque([a]), None
            while queue and end is None:
                u = queue.popleft()
                for b in near[u]:
                    if b in reached:
                        continue
                    reached[b] = u
                    if right[b]:
                        end = b
                        break
                    for w in flow.get(b, ()):
                        if w not in freed:
                            freed[w] = b
                            queue.append(w)
            if end is None:
                break
            path, b = [], end
            while b >= 0:
                u = reached[b]
                path.append((u, b, freed[u]))
                b = freed[u]
            n = min([left[a], right[end], *(flow[given][u] for u, _, given in path if given >= 0)])
            for u, b, given in path:
                into = flow.setdefault(b, {})
                into[u] = into.get(u, 0) + n
                if given >= 0:
                    flow[given][u] -= n
                    if not flow[given][u]:
                        del flow[given][u]
            left[a] -= n
            right[end] -= n
    for r, n, m in zip(rows, left, right, strict=True):
        r.counts = [n, m]
    return rows


def _left_over(fractions: int, tolerance: float):
    """The rows of sorted groups that stay without a partner, with how many of them there are on each side."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Row]]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("g", *(f"x{k}" for k in range(fractions)), "l", "r", "row")]
            for g, *rest in zip(*columns, strict=True):
                yield g, _Row(rest[:fractions], *rest[fractions:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, first = None, []
        for batch in batches:
            schema = batch.schema
            first.append(batch)
            break
        if schema is None:
            return
        kinds, out = schema.field("row").type, []
        for _, group in itertools.groupby(rows_of(itertools.chain(first, batches)), key=lambda r: r[0]):
            found = (r for _, r in group)
            for r in _swept(found, tolerance) if fractions == 1 else _augmented(list(found), tolerance):
                if any(r.counts):
                    out.append(r)
                if len(out) >= 10_000:
                    yield _out(out, kinds)
                    out = []
        yield _out(out, kinds)

    return run


def _out(rows: list[_Row], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.counts[0] for r in rows], pa.int64()), pa.array([r.counts[1] for r in rows], pa.int64()), pa.array([r.row for r in rows], kind)], ["l", "r", "row"])


def left_over(rows: DataFrame, fractions: int, tolerance: float) -> DataFrame:
    """rows(g, x0, x1, ..., l, r, row) -> (l, r, row): what a maximum matching within each g leaves of both sides.

    With one fraction no task holds more than the rows within the tolerance of one; with several it holds a group, whose
    rows hang together by steps within the tolerance in every fraction in turn.
    """
    for k in range(fractions):
        rows = grouped(rows.withColumn("x", F.col(f"x{k}")), tolerance).drop("x")
    kinds = rows.select("l", "r", "row").schema
    return rows.repartition("g").sortWithinPartitions("g", "x0").mapInArrow(_left_over(fractions, tolerance), kinds)


def _special(v: Column) -> Column:
    """What a fraction is if it is not finite."""
    return F.when(v.isNull(), "null").when(F.isnan(v) | (F.abs(v) == float("inf")), v.cast("string"))


def _placed(df: DataFrame, plain: list[str], fractions: list[str], tolerance: float, left: int) -> DataFrame:
    """(row, k0, ..., f0, ..., s0, ..., c0, ..., near, l, r) of one side: other columns, fractions, what is not finite, cells.

    Lists, maps and structs are compared as JSON. near: another row within the tolerance may be in another cell.
    """
    width = CELL * tolerance if tolerance > 0 else 1.0
    margin = 2 * max(tolerance, 0.0) / width
    nested = lambda c: isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
    keys = [(F.to_json(F.struct(c)) if nested(c) else F.col(c)).alias(f"k{i}") for i, c in enumerate(plain)]
    x = [F.col(c).cast("double") for c in fractions]
    out = df.select(F.struct(*df.columns).alias("row"), *keys, *[F.col(c).alias(f"f{i}") for i, c in enumerate(fractions)], *[_special(v).alias(f"s{i}") for i, v in enumerate(x)])
    near = F.lit(False)
    for i in range(len(fractions)):
        at = F.when(F.col(f"s{i}").isNull(), F.col(f"f{i}").cast("double") / width).otherwise(0.5)
        off = at - F.floor(at)
        near = near | (F.col(f"s{i}").isNull() & ((F.abs(at) > FAR) | (off < margin) | (off > 1 - margin)))
        out = out.withColumn(f"c{i}", F.floor(at))
    return out.select("*", near.alias("near"), F.lit(left).cast("bigint").alias("l"), F.lit(1 - left).cast("bigint").alias("r"))


def _cells(each: DataFrame, by: list[str], fractions: int, whole: bool, tolerance: float) -> DataFrame:
    """(by, near, l, r, left0, ..., right0, ..., close, whole) of cells that are not settled without a rest.

    l and r count the rows of both sides. close: all rows are within the tolerance of each other. whole: the rows of a side
    are one row, whose fractions are left0, ... or right0, ...
    """
    sides, named = (("left", "l"), ("right", "r")), range(fractions)
    values = [f(F.when(F.col(n) > 0, F.col(f"f{i}"))).alias(f"{side}{to}{i}") for i in named for side, n in sides for f, to in ((F.min, ""), (F.max, "_to"))]
    cells = each.groupBy(*by).agg(F.max("near").alias("near"), F.sum("l").alias("l"), F.sum("r").alias("r"), *values)
    spread = [F.greatest(f"left_to{i}", f"right_to{i}").cast("double") - F.least(f"left{i}", f"right{i}").cast("double") for i in named]
    close = reduce(and_, [F.col(f"s{i}").isNotNull() | (v <= max(tolerance, 0.0)) for i, v in enumerate(spread)])
    one = reduce(and_, [F.col(f"{side}{i}").eqNullSafe(F.col(f"{side}_to{i}")) for i in named for side, _ in sides], F.lit(whole))
    out = cells.select("*", close.alias("close"), one.alias("whole")).drop(*[f"{side}_to{i}" for i in named for side, _ in sides])
    return out.where(F.col("near") | (F.col("l") != F.col("r")) | ~F.col("close"))


def unmatched(a: DataFrame, b: DataFrame, fractions: list[str], tolerance: float) -> DataFrame:
    """(columns, side): what a maximum matching of two tables of the same columns leaves of both.

    Cells with a rest are written once. They keep their rows with them if each side has one, and no column is nested; only
    rows of the others are read again.
    """
    spark, columns = a.sparkSession, b.columns
    plain = [c for c in columns if c not in fractions]
    each = _placed(a, plain, fractions, tolerance, 1).unionByName(_placed(b, plain, fractions, tolerance, 0))
    by = [*[f"k{i}" for i in range(len(plain))], *[f"{c}{i}" for c in "sc" for i in range(len(fractions))]]
    kept = all(each.schema[f"k{i}"].dataType == each.schema["row"].dataType[c].dataType for i, c in enumerate(plain))
    found, path = _cells(each, by, len(fractions), kept, tolerance), shared_path(spark, "cells")
    found.write.parquet(path)
    cells = spark.read.schema(found.schema).parquet(path)
    kinds = {(r.near, r.whole) for r in cells.select("near", "whole").distinct().collect()}

    def sided(df: DataFrame, left: Column, right: Column) -> DataFrame:
        """(row, side, n) of cells that keep their rows with them."""
        row = lambda side: F.struct(*[F.col(f"{side}{fractions.index(c)}" if c in fractions else f"k{plain.index(c)}").alias(c) for c in columns]).alias("row")
        of = lambda side, n: F.struct(row(side), F.lit(side).alias("side"), n.alias("n"))
        return df.select(F.explode(F.array(of("left", left), of("right", right))).alias("e")).select("e.*").where("n > 0")

    met = F.when(F.col("close"), F.least("l", "r")).otherwise(0)
    none = each.where(F.lit(False)).select("row", F.lit("left").alias("side"), F.col("l").alias("n"))
    out = sided(cells.where(F.col("whole") & ~F.col("near")), F.col("l") - met, F.col("r") - met) if kept else none
    rest = []
    if (True, True) in kinds:
        n = lambda side: F.when(F.col("side") == side, F.col("n")).otherwise(0)
        rest.append(sided(cells.where(F.col("whole") & F.col("near")), F.col("l"), F.col("r")).select("row", n("left").alias("l"), n("right").alias("r")))
    if not all(one for _, one in kinds):
        several = cells.where(~F.col("whole")).select(*[F.col(c).alias(f"in_{c}") for c in by])
        rest.append(each.join(several, reduce(and_, [F.col(c).eqNullSafe(F.col(f"in_{c}")) for c in by]), "left_semi").select("row", "l", "r"))
    if rest:
        found = reduce(DataFrame.unionByName, rest).groupBy("row").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        x = [F.col(f"row.{c}").cast("double") for c in fractions]
        special = [_special(v) for v in x]
        text = [F.col(f"row.{c}").cast("string") if isinstance(b.schema[c].dataType, T.TimestampNTZType) else F.col(f"row.{c}") for c in plain]
        key = F.md5(F.to_json(F.struct(*[v.alias(f"k{i}") for i, v in enumerate(text)], *[v.alias(f"s{i}") for i, v in enumerate(special)])))
        rows = found.select(key.alias("g"), *[F.when(s.isNull(), v).otherwise(0.0).alias(f"x{i}") for i, (s, v) in enumerate(zip(special, x, strict=True))], "l", "r", "row")
        each_side = F.array(*[F.struct(F.lit(side).alias("side"), F.col(n).alias("n")) for side, n in (("left", "l"), ("right", "r"))])
        out = out.unionByName(left_over(rows, len(fractions), tolerance).select("row", F.explode(each_side).alias("s")).select("row", "s.*").where("n > 0"))
    return out.select("row.*", "side", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")

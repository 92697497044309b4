"""Suffix-array dedup: removes byte strings of LENGTH that also start in a document with a smaller id.

Every window of LENGTH bytes has a head: its HEAD bytes with the least hash, so equal windows have equal heads at equal
places. Neighbouring windows with one head are a stretch. A suffix array here is sparse: it has the suffixes that begin
at heads, ordered by the hash of the head, each with a hash of its stretch, its document and its place. New documents
come in batches. A batch gets such an array, which is scanned together with those of the levels before it: of equal
stretches the one with the least document stays in the index, and the others are known to be covered. Where one head has
different stretches, a long match may still reach into them. A window holds its head and the SIDE bytes to one side of it,
so only stretches that have these on one side in common with another one are asked for. Levels of equal size merge, so an
entry is merged as often as the number of batches has binary digits. Arrays are scanned part by part, so that only a part
of them is shuffled at a time.

What was asked for is looked up in the texts and settled exactly: these suffixes are sorted by their bytes, the longest
common prefixes with the neighbours say which windows can match at all (the same to the left), and windows that are left
are compared byte by byte, by the least document of each.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, UNDO, discard, free_name, mixed, powers, shared_dir, slices, table, utf8

LENGTH, HEAD = 50, 16
#: Positions of a head in a window; also the most windows of a stretch.
SPREAD = LENGTH - HEAD + 1
#: Bytes on one side of a head at least, in every window.
SIDE = (LENGTH - HEAD) // 2
#: Bytes of text whose entries make up a bucket of an array: they bound what one task holds.
BUCKET = 4 << 20
#: Entries that a task gathers before it sorts them, and the different stretches of one head among these beyond which
#: they are asked for at once instead of going into a bucket. They change speed alone.
ENTRIES, CONTEXTS = 1 << 17, 32
BATCHES = 4
#: Parts that the buckets are dealt to, one after the other, and the least buckets of one.
PARTS, LEAST = 8, 16
NEW = ("n_bytes", "n_removed", "n_spans", "kept")
#: Stands for a null doc_id: it comes last.
LAST = (1 << 63) - 1

_ENTRY, _GONE, _ASKED = 0, 1, 2
_OUT = "kind int, bucket int, entries binary, doc bigint, t int, start bigint, windows int"
#: Fields of an entry and their bytes. In `windows`, bit 7 says that the head has very many stretches elsewhere, and bit 6
#: that the entry has been asked for. `l` and `r` are hashes of the head with the SIDE bytes before and behind it (0: the
#: stretch has fewer there; both 0: the head comes again in the stretch, so its windows have it at several places).
_FIELDS = (("h", 6), ("c", 6), ("l", 3), ("r", 3), ("doc", 8), ("t", 3), ("start", 4), ("windows", 1))
_SIZE = sum(w for _, w in _FIELDS)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


@lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    return powers(np.uint64(base), size)


def _running(data: np.ndarray) -> np.ndarray:
    """The running sum that hashes of ranges are cut out of."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(int(BASE), _size(len(data)))[: len(data)], out=run[1:])
    return run


def _size(n: int) -> int:
    return 1 << max(16, n.bit_length())  # few different ones, so that their powers are made once


def _range_hashes(run: np.ndarray, begin: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """A hash of each of some ranges of bytes, from their running sum."""
    undo = _powers(int(UNDO), _size(len(run) - 1))[begin]
    return mixed((run[begin + sizes] - run[begin]) * undo + np.asarray(sizes).astype(np.uint64))


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the HEAD bytes from each place on (of what there is, near the end)."""
    h, m = _BYTE[data], 1
    while m < HEAD:
        factor = np.uint64(pow(int(BASE), m, 1 << 64))
        ahead = h[m:].copy()
        h *= factor
        h[:-m] += ahead
        m *= 2
    return mixed(h)


def least_of(h: np.ndarray) -> np.ndarray:
    """The least hash of the SPREAD places from each place on."""
    out, m = h.copy(), 1
    while 2 * m <= SPREAD:
        np.minimum(out[:-m], out[m:], out=out[:-m])
        m *= 2
    rest = SPREAD - m
    if rest:
        np.minimum(out[:-rest], out[rest:], out=out[:-rest])
    return out


def _first_least(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far the first of the least of the SPREAD places from each of some places on is; in runs, as SPREAD hashes of each are laid out."""
    view, out = np.lib.stride_tricks.sliding_window_view(np.append(h, np.zeros(SPREAD, np.uint64)), SPREAD), np.empty(len(at), np.int64)
    for start in range(0, len(at), 1 << 14):
        out[start : start + (1 << 14)] = view[at[start : start + (1 << 14)]].argmin(axis=1)
    return out


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """h, c, l, r, row, start (from the row's first byte) and windows of all stretches of texts laid out by utf8()."""
    n = len(data)
    hashes = head_hashes(data)
    least = least_of(hashes)
    fresh = np.ones(n, bool)
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    begin = np.flatnonzero(fresh)
    row = np.searchsorted(offsets, begin, "right") - 1
    windows = np.minimum(np.append(begin[1:], n), offsets[row + 1] - LENGTH + 1) - begin
    begin, row, windows = begin[windows > 0], row[windows > 0], windows[windows > 0]
    pieces = -(-windows // SPREAD)  # stretches of repeated heads are cut
    at = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPREAD
    begin, row, windows = np.repeat(begin, pieces) + at, np.repeat(row, pieces), np.minimum(np.repeat(windows, pieces) - at, SPREAD)
    run, sizes = _running(data), windows + LENGTH - 1
    at = _first_least(hashes, begin)
    once = at == _first_least(hashes, begin + windows - 1) + windows - 1
    before, behind = once & (at >= SIDE), once & (at + HEAD + SIDE <= sizes)
    l, r = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    for out, which, places in ((l, before, begin + at - SIDE), (r, behind, begin + at)):
        out[which] = np.maximum(_range_hashes(run, places[which], HEAD + SIDE) >> np.uint64(40), np.uint64(1))
    return {"h": least[begin], "c": _range_hashes(run, begin, sizes), "l": l, "r": r, "row": row, "start": begin - offsets[row], "windows": windows}


def pack(e: dict[str, np.ndarray]) -> bytes:
    """Entries as bytes, place by place, so that places which are mostly zero take no room once compressed; of h, the steps from one to the next."""
    e = {**e, "h": np.diff(e["h"], prepend=np.uint64(0))}
    return b"".join(np.ascontiguousarray(e[name].astype(np.int64 if name == "doc" else np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for name, width in _FIELDS)


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    sizes = [len(b) // _SIZE for b in blobs]
    out = {name: np.zeros((sum(sizes), 8), np.uint8) for name, _ in _FIELDS}
    done = 0
    for blob, n in zip(blobs, sizes, strict=True):
        at = 0
        for name, width in _FIELDS:
            out[name][done : done + n, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
            at += n * width
        h = out["h"][done : done + n].view(np.uint64)
        np.bitwise_and(np.cumsum(h, axis=0), np.uint64((1 << 48) - 1), out=h)
        done += n
    return {name: a.view(np.int64 if name == "doc" else np.uint64).ravel() for name, a in out.items()}


def _taken(e: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in e.items()}


def scan(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Entries in the order of the array; which of them stay; how many different stretches their head has."""
    e = _taken(e, np.lexsort((e["doc"], e["c"], e["h"])))
    n = len(e["h"])
    head = np.concatenate(([True], e["h"][1:] != e["h"][:-1]))[:n]
    content = head | np.concatenate(([True], e["c"][1:] != e["c"][:-1]))[:n]
    least = e["doc"][np.flatnonzero(content)][np.cumsum(content) - 1] if n else e["doc"]
    at = np.flatnonzero(head)
    contexts = np.add.reduceat(content.astype(np.int64), at)[np.cumsum(head) - 1] if n else np.zeros(0, np.int64)
    return e, e["doc"] == least, contexts


def meeting(e: dict[str, np.ndarray], contexts: np.ndarray) -> np.ndarray:
    """Which of scanned entries may have a window in common with a different stretch of their head, here or elsewhere."""
    out = np.zeros(len(contexts), bool)
    if not len(out):
        return out
    head = np.concatenate(([True], e["h"][1:] != e["h"][:-1]))
    of, marked = np.cumsum(head) - 1, e["windows"] >= 128
    any_in_head = lambda which: np.logical_or.reduceat(which, np.flatnonzero(head))[of]
    # where the head comes again, or where others are not here, the sides do not tell
    out |= any_in_head(marked) | (contexts > 1) & any_in_head((e["l"] == 0) & (e["r"] == 0))
    which = np.flatnonzero((contexts > 1) & ~out)
    for side in ("l", "r"):
        at = which[e[side][which] != 0]
        at = at[np.lexsort((e["c"][at], e[side][at], of[at]))]
        new = np.concatenate(([True], (of[at][1:] != of[at][:-1]) | (e[side][at][1:] != e[side][at][:-1])))[: len(at)]
        first, ends = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at))
        differ = e["c"][at[first]] != e["c"][at[ends - 1]] if len(at) else new
        out[at[np.repeat(differ, ends - first)] if len(at) else at] = True
    return out


def _batch(kind: int, **columns: object) -> pa.RecordBatch:
    """One batch of the rows that scans give out; columns that a kind has not are null."""
    types = (("bucket", pa.int32()), ("entries", pa.binary()), ("doc", pa.int64()), ("t", pa.int32()), ("start", pa.int64()), ("windows", pa.int32()))
    n = len(next(iter(columns.values())))
    values = [pa.array(columns[k] if isinstance(columns[k], list) else columns[k].astype(t.to_pandas_dtype()), t) if k in columns else pa.nulls(n, t) for k, t in types]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *values], ["kind", *(k for k, _ in types)])


def _placed(kind: int, e: dict[str, np.ndarray], which: np.ndarray) -> pa.RecordBatch:
    found = _taken(e, which)
    return _batch(kind, doc=found["doc"], t=found["t"], start=found["start"], windows=found["windows"] & np.uint64(63))


def _arrays(buckets: int):
    """The array of each slice of a batch, in buckets; what the slice's own rows settle is not sent on."""

    def settled(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        e = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        e, keep, contexts = scan(e)
        yield _placed(_GONE, e, ~keep)
        many = keep & (contexts > CONTEXTS)
        marks = np.zeros(len(many), bool)
        if many.any():  # one entry of each such head goes into its bucket, and says so there
            where = np.flatnonzero(many)
            marks[where[np.concatenate(([True], e["h"][where[1:]] != e["h"][where[:-1]]))]] = True
        yield _placed(_ASKED, e, many & ~marks)
        e["windows"] = np.where(marks, e["windows"] | np.uint64(128), e["windows"])
        e = _taken(e, keep & (~many | marks))
        e["bucket"] = e["bucket"].astype(np.int64)  # these follow the order of h
        at = np.flatnonzero(np.concatenate(([True], e["bucket"][1:] != e["bucket"][:-1]))[: len(e["bucket"])])
        ends = np.append(at[1:], len(e["bucket"]))
        if len(at):
            yield _batch(_ENTRY, bucket=e["bucket"][at], entries=[pack({k: e[k][a:b] for k, _ in _FIELDS}) for a, b in zip(at, ends, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in slices([batch], "text", 1 << 20):
                data, offsets = utf8(piece["text"])
                e = stretches(data, offsets)
                row = e.pop("row")
                e["doc"], e["t"] = piece["doc"].to_numpy()[row], piece["t"].to_numpy()[row].astype(np.uint64)
                even = mixed(e["h"])  # the least of many are small
                e["bucket"], e["h"], e["c"] = (even >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), even >> np.uint64(16), e["c"] >> np.uint64(16)
                e["windows"], e["start"] = e["windows"].astype(np.uint64), e["start"].astype(np.uint64)
                if len(row):
                    parts.append(e)
                held += len(row)
                if held >= ENTRIES:
                    yield from settled(parts)
                    parts, held = [], 0
        if parts:
            yield from settled(parts)

    return run


def _met(tables: pa.Table) -> pa.Table:
    """The arrays of one bucket, scanned together: the merged array, what is covered, and what is to be looked up."""
    merges = tables["merges"].to_numpy(zero_copy_only=False)
    blobs = tables["entries"].to_pylist()
    e = unpack(blobs)
    e["merges"] = np.repeat(merges, [len(b) // _SIZE for b in blobs])
    e, keep, contexts = scan(e)
    asks = keep & meeting(e, contexts) & (e["windows"] & np.uint64(64) == 0)
    out = [_placed(_GONE, e, ~keep), _placed(_ASKED, e, asks)]
    e["windows"] = np.where(asks, e["windows"] | np.uint64(64), e["windows"])
    stays = keep & e["merges"]
    if stays.any():
        out.append(_batch(_ENTRY, bucket=[tables["bucket"][0].as_py()], entries=[pack(_taken(e, stays))]))
    return pa.Table.from_batches(out)


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job go when it is done, as its result is in a table then; Arrow batches are small, as rows hold texts or arrays."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {name: spark.conf.get(name, None) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stored(df: DataFrame, path: str, *parts: str) -> str:
    """Adds rows to a table in the shared folder and gives its path; its row groups are small, as writers hold them."""
    with _tidy(df.sparkSession):
        df.write.mode("append").option("parquet.block.size", 16 << 20).partitionBy(*parts).parquet(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc (doc_id, null last) and t, which tells rows of one doc_id with different texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(text).bitwiseAND(0xFFFFFF).cast("int").alias("t"), text.alias("text"))


class Levels:
    """The index family: tables of arrays, one for each binary digit that the number of batches has."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.parts = spark, buckets, max(1, min(PARTS, buckets // LEAST))
        self.levels: dict[int, str] = {}  # rank to path
        self.paths: list[str] = []

    def rows(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(f"{_OUT}, part int").parquet(path).where(F.col("kind") == kind).drop("kind")

    def stored(self, rows: DataFrame, path: str) -> str:
        return _stored(rows.withColumn("part", F.coalesce(F.col("bucket") % self.parts, F.lit(0))), path, "kind", "part")

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Scans a batch of documents(doc_id, text, ...) against all levels, and merges it with those of ranks 0, 1, ... that exist.

        Batches may come in any order: of equal stretches always the one with the least document stays. last: no other
        batch will come, so nothing is merged.
        """
        batch = self.stored(keyed(docs).mapInArrow(_arrays(self.buckets), _OUT), _path(self.spark, "arrays"))
        rank = 0
        while rank in self.levels:
            rank += 1
        merged = _path(self.spark, "level")
        for part in range(self.parts):
            of = lambda path, merges: self.rows(path, _ENTRY).where(F.col("part") == part).select("bucket", "entries", F.lit(merges).alias("merges"))  # noqa: B023, E731
            arrays = of(batch, not last)
            for r, path in self.levels.items():
                arrays = arrays.unionByName(of(path, r < rank and not last))
            self.stored(arrays.groupBy("bucket").applyInArrow(_met, _OUT), merged)
            for old in [batch, *(path for r, path in self.levels.items() if r < rank or last)]:
                _remove(self.spark, f"{old}/kind={_ENTRY}/part={part}")
        for r in range(rank):
            self.levels.pop(r)
        self.levels[rank] = merged
        self.paths += [batch, merged]

    def found(self, kind: int) -> DataFrame:
        out = self.rows(self.paths[0], kind)
        for path in self.paths[1:]:
            out = out.unionByName(self.rows(path, kind))
        return out.select("doc", "t", "start", "windows")

    def close(self) -> None:
        """Removes the arrays; what they have found stays."""
        for path in self.levels.values():
            _remove(self.spark, f"{path}/kind={_ENTRY}")
        self.levels = {}

    def forget(self) -> None:
        """Removes what the arrays have found."""
        for path in self.paths:
            _remove(self.spark, path)
        self.paths = []


#: left has the bytes before the head from the last to the first; whole has all bytes of the windows.
_SUFFIX = "doc bigint, t int, starts array<bigint>, windows int, at int, left binary, whole binary"


def _ranges(begin: np.ndarray, sizes: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """begin, begin + step, ... for each, one after the other, and where each begins and the last ends."""
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(begin, sizes) + step * (np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes)), offsets


def _binary(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, step: int = 1) -> pa.Array:
    at, offsets = _ranges(begin, sizes, step)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts with the stretches asked for: each place of a head, the windows whose first head it is, and the bytes around.

    Places of one document with the same windows and bytes are one row.
    """
    for batch in batches:
        for piece in slices([batch], "text", 1 << 20):
            data, offsets = utf8(piece["text"])
            lists = piece["asked"]
            asked = lists.flatten()
            of = np.repeat(np.arange(piece.num_rows), pc.list_value_length(lists).to_numpy())
            start, windows = asked.field("start").to_numpy(), asked.field("windows").to_numpy().astype(np.int64)
            at, bounds = _ranges(offsets[:-1][of] + start, windows + LENGTH - 1)
            near = data[at]  # the bytes of all stretches, one after the other
            each, ends = _ranges(bounds[:-1], windows)  # where each window begins there
            first = each + _first_least(head_hashes(near), each)
            fresh = np.ones(len(each), bool)
            np.not_equal(first[1:], first[:-1], out=fresh[1:])
            fresh[ends[:-1]] = True
            cut = np.flatnonzero(fresh)
            n = np.diff(np.append(cut, len(each)))
            begin, head, stretch = each[cut], first[cut], np.searchsorted(ends, cut, "right") - 1
            content = _range_hashes(_running(near), begin, n + LENGTH - 1) + (head - begin).astype(np.uint64)
            places = start[stretch] + begin - bounds[:-1][stretch]
            order = np.lexsort((places, content, of[stretch]))
            new = np.ones(len(order), bool)
            new[1:] = (content[order][1:] != content[order][:-1]) | (of[stretch][order][1:] != of[stretch][order][:-1])
            kept = order[new]
            row, left = of[stretch][kept], head[kept] - begin[kept]
            starts = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(order)), pa.int32()), pa.array(places[order]))
            columns = [piece["doc"].take(pa.array(row)), piece["t"].take(pa.array(row)), starts, pa.array(n[kept].astype(np.int32)), pa.array(left.astype(np.int32))]
            columns += [_binary(near, head[kept] - 1, left, -1), _binary(near, begin[kept], n[kept] + LENGTH - 1)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SUFFIX.split(", ")])


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _common_to_next(keys: pa.Array) -> np.ndarray:
    """The length of the longest common prefix of each key, but for the last, with the next one."""
    offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data, sizes = np.frombuffer(keys.buffers()[2] or b"", np.uint8), np.diff(offsets)
    width = max(1, int(sizes.max()))
    places = offsets[:-1, None] + np.arange(width)
    bytes_ = np.append(data, np.zeros(1, np.uint8))[np.minimum(places, len(data))]
    differ = bytes_[1:] != bytes_[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted keys the longest common prefix with a neighbour; the first and the last row of a task, whose other neighbour is elsewhere, have their whole length."""
    waiting, before = None, 1 << 30
    for batch in batches:
        if not batch.num_rows:
            continue
        to_next = _common_to_next(batch["key"])
        if waiting is not None:
            link = _common(waiting["key"][0].as_py(), batch["key"][0].as_py())
            yield _with_reach(waiting, np.array([max(before, link)]))
            before = link
        if batch.num_rows > 1:
            yield _with_reach(batch.slice(0, batch.num_rows - 1), np.maximum(np.append(before, to_next[:-1]), to_next))
            before = int(to_next[-1])
        waiting = batch.slice(batch.num_rows - 1)
    if waiting is not None:
        yield _with_reach(waiting, np.array([1 << 30]))


def _with_reach(batch: pa.RecordBatch, reach: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "key"), pa.array(np.minimum(reach, 1 << 30).astype(np.int32))], [*(c for c in batch.schema.names if c != "key"), "reach"])


def _pruned(suffixes: DataFrame) -> DataFrame:
    """Suffixes with only those windows whose bytes to the right of the head, and to its left, occur elsewhere too."""

    def reached(df: DataFrame, key) -> DataFrame:
        rows = df.withColumn("key", key)
        return rows.repartitionByRange("key", "doc").sortWithinPartitions("key", "doc").mapInArrow(_reach, f"{_SUFFIX}, reach int")

    # the first window has `at` bytes before the head; later ones have fewer, and more behind it
    right = reached(suffixes, F.substring("whole", F.col("at") + 1, F.lit(2 * LENGTH)))
    right = right.withColumn("windows", F.least(F.col("windows"), F.col("reach") + F.col("at") - LENGTH + 1)).where("windows > 0").drop("reach")
    left = reached(right, F.concat(F.substring("whole", F.col("at") + 1, F.lit(HEAD)), F.col("left")))
    skipped = F.greatest(F.lit(0), F.col("at") - (F.col("reach") - HEAD))
    return left.withColumn("skip", skipped).where("skip < windows")


def settled(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc, t, start, windows) of single windows in what was asked for that a smaller document has too."""
    lists = asked.distinct().groupBy("doc", "t").agg(F.collect_list(F.struct("start", "windows")).alias("asked"))
    suffixes = keyed(docs).join(lists, ["doc", "t"]).select("doc", "t", "text", "asked").mapInArrow(_suffixes, _SUFFIX)
    spark = docs.sparkSession
    sorted_twice = _stored(suffixes, _path(spark, "suffixes"))  # and each sort looks at a sample first
    suffixes = spark.read.schema(suffixes.schema).parquet(sorted_twice)
    rows = _pruned(suffixes)
    each = rows.withColumn("k", F.explode(F.sequence(F.col("skip"), F.col("windows") - 1)))
    each = each.select("doc", "t", "starts", "k", F.substring("whole", F.col("k") + 1, F.lit(LENGTH)).alias("window"))
    windows = _stored(each, _path(spark, "windows"))
    _remove(spark, sorted_twice)
    each = spark.read.schema(each.schema).parquet(windows)
    least = each.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("window", "first")
    found = each.join(least, "window").where("doc > first").select("doc", "t", F.explode(F.transform("starts", lambda x: x + F.col("k"))).alias("start"), F.lit(1).alias("windows"))
    path = _stored(found, _path(spark, "settled"))
    out = spark.read.schema(found.schema).parquet(path)
    out.saved_path = path
    _remove(spark, windows)
    return out


_SPANS = "doc bigint, t int, spans array<struct<start: bigint, end: bigint>>"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc, t, covered), where covered has start << 6 | windows of stretches in any order, the maximal spans of bytes."""
    for batch in batches:
        lists = batch["covered"]
        of, packed = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy()
        start = packed >> 6
        end = start + (packed & 63) + LENGTH - 1
        row = int(end.max(initial=0)) + 1  # rows are laid out one after the other
        order = np.argsort(start + of * row, kind="stable")
        start, reach = (start + of * row)[order], np.maximum.accumulate((end + of * row)[order])
        cut = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))[: len(start)])
        start, end = start[cut], reach[np.append(cut[1:], len(start))[: len(cut)] - 1]
        offsets = np.searchsorted(start, np.arange(batch.num_rows + 1) * row)
        spans = pa.StructArray.from_arrays([pa.array(start % row), pa.array(end % row)], ["start", "end"])
        yield pa.RecordBatch.from_arrays([batch["doc"], batch["t"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc", "t", "spans"])


def spans_of(covered: DataFrame) -> DataFrame:
    """(doc, t, spans) of covered(doc, t, start, windows), as a table, so that texts are not shuffled beside all that is covered."""
    packed = F.shiftleft(F.col("start"), 6).bitwiseOR(F.col("windows").cast("bigint"))
    spans = covered.groupBy("doc", "t").agg(F.collect_list(packed).alias("covered")).mapInArrow(_joined, _SPANS)
    return covered.sparkSession.read.schema(_SPANS).parquet(_stored(spans, _path(covered.sparkSession, "spans")))


_CUT = "n_removed bigint, n_spans bigint, kept binary"


def _cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        removed, runs, kept = [], [], []
        for k in range(len(texts)):
            if not texts[k].is_valid:
                removed.append(0)
                runs.append(0)
                kept.append(None)
                continue
            data = texts[k].as_py().encode()
            found = spans[k].values
            marks = np.zeros(len(data) + 1, np.int64)
            np.add.at(marks, found.field("start").to_numpy(), 1)
            np.add.at(marks, found.field("end").to_numpy(), -1)
            gone = np.cumsum(marks)[:-1] > 0
            removed.append(int(gone.sum()))
            runs.append(int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        yield pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])


def repeats_removed(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """docs(doc_id, text, ...) with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left) added.

    A byte goes where a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id; strings
    are judged on the texts as they came, and never cross documents. Null texts are empty. Rows without doc_id come after
    all others, and rows of equal doc_id never remove from one another. Columns of docs named like the new ones are
    replaced.

    Every entry of an array is 20 bytes or so; the text is shuffled twice, by document: to look up what was asked for,
    and to cut. Equal stretches of a slice of documents are settled before anything is sent, so a passage that a third
    of all rows share arrives once for each slice.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    index = Levels(spark, max(8, math.ceil(size / BUCKET)))
    bounds = sorted(set(docs.select(F.col("doc_id").cast("bigint")).stat.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01))) if batches > 1 and size else []
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = docs.select("doc_id", "text")  # the bare column is compared, so that parts of files are skipped
        if high is None and low is not None:
            part = part.where((F.col("doc_id") > int(low)) | F.col("doc_id").isNull())
        elif high is not None:
            part = part.where(F.col("doc_id") <= int(high)) if low is None else part.where((F.col("doc_id") > int(low)) & (F.col("doc_id") <= int(high)))
        index.add(part, last=high is None)
    index.close()
    matches = settled(docs.select("doc_id", "text"), index.found(_ASKED))
    spans = spans_of(index.found(_GONE).unionByName(matches))
    discard(matches)
    index.forget()
    doc, t, found, out = (free_name(docs, c) for c in ("doc", "t", "spans", "out"))
    rows = docs.drop(*[c for c in NEW if c in docs.columns])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.withColumns({doc: doc_id, t: F.xxhash64(text).bitwiseAND(0xFFFFFF).cast("int")})
    rows = rows.join(spans.select(F.col("doc").alias(doc), F.col("t").alias(t), F.col("spans").alias(found)), [doc, t], "left")

    def cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _cut(parts)

    rows = rows.withColumn(out, F.arrow_udf(cut, _CUT)(F.when(F.col(found).isNotNull(), F.col("text")), F.col(found)))
    rows = rows.withColumns({"n_bytes": F.octet_length(text).cast("bigint"), "n_removed": F.col(f"{out}.n_removed"), "n_spans": F.col(f"{out}.n_spans"), "kept": F.when(F.col(found).isNotNull(), F.col(f"{out}.kept")).otherwise(F.encode(text, "UTF-8"))})
    return rows.drop(doc, t, found, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats_removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

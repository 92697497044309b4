"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One of our own only where all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def free_name(df: DataFrame, name: str) -> str:
    """A name for a column of a step's own, which no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def discard(df: DataFrame) -> None:
    """Removes the table of a frame that came from saved() and is not read again; other frames have none."""
    if "saved_path" not in vars(df):
        return
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a key from which hub_join takes it for a hub, and the share of all rows; so there are at most 1,000 hubs.
HUB, HUBS = 1_000, 1_000


def hub_join(left: DataFrame, right: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row per key and in column n how many rows of left have it; n is dropped.

    Keys with more than HUB rows and a thousandth of all rows are at most HUBS, so their rows of right are broadcast and
    their rows of left stay where they are; only the others are shuffled by key. how: inner or left.
    """
    most = max(HUB, (right.agg(F.sum(n)).first()[0] or 0) // HUBS)
    hubs, rest = right.where(F.col(n) > most).drop(n), right.where(F.col(n) <= most).drop(n)
    other = left.join(F.broadcast(hubs.select(key)), key, "left_anti").join(rest, key, how)
    return left.join(F.broadcast(hubs), key).select(other.columns).unionByName(other)


def is_held_out(doc_id: Column) -> Column:
    """True for the rows that no model of this subpackage learns labels from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Splits Arrow batches into runs of rows with about `most` bytes of text, so that vectors stay small."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings (null: empty) in one uint8 array, and the len + 1 offsets of the strings."""
    array = pc.fill_null(array, "").cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (whole[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (whole[:0], np.zeros(1, np.int64))


BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be undone modulo 2**64
UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of every word [^\\x20\\x09-\\x0D]+, A-Z lower-cased, of strings laid out by utf8().

    The hash is a polynomial in the bytes modulo 2**64, cut out of one running sum, so no word is visited alone.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    solid = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(solid & (first[:n] | ~np.concatenate(([False], solid[:-1]))))
    ends = np.flatnonzero(solid & (np.concatenate((first[1:n], [True])) | ~np.concatenate((solid[1:], [False])))) + 1
    low = LOWER[data].astype(np.uint64) + np.uint64(1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(low) * powers(BASE, n), out=run[1:])
    h = (run[ends] - run[starts]) * powers(UNDO, n)[starts]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return mixed(h + (ends - starts).astype(np.uint64)), rows, starts, ends


def combed(steps: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(base, table): the step from state s with symbol c is in table[base[s] + c], as s << 32 | next, if there is one.

    The rows of the states lie in one another's gaps, so the table has about as many places as there are steps. States
    without steps have the base 0, where nothing names them.
    """
    width = max((c for row in steps for c in row), default=0) + 1
    used = bytearray(2 * width + sum(map(len, steps)) * 2)
    base, free, entries = np.zeros(len(steps), np.int64), {}, []
    for s in sorted(range(len(steps)), key=lambda s: -len(steps[s])):
        row = sorted(steps[s])
        if not row:
            continue
        at = free.get(len(row), width)  # rows of one length are tried at ever later places
        while True:
            begin = at - row[0]
            if begin + row[-1] >= len(used):
                used.extend(bytes(len(used)))
            if not used[at] and not any(used[begin + c] for c in row):
                break
            at += 1
        base[s], free[len(row)] = begin, at
        for c in row:
            used[begin + c] = 1
            entries.append((begin + c, s << 32 | steps[s][c]))
    out = np.full(max((k for k, _ in entries), default=0) + width + 1, -1, np.int64)
    for k, x in entries:
        out[k] = x
    return base, out

"""Live operations as Structured Streaming jobs: point writes to series, watches, priority arrays."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..jobs.series import last_per_level
from .state import bucket


def his_write(points: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Points of a stream without repeats of (id, ts); those later than the delay are dropped with the watermark."""
    return points.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id", "ts"])


def _changes(refresh: bool) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(bytes(state.get[0])) if state.exists else {}  # (watch, id): (ts, val, end of the lease in ms)
        now, came, out = state.getCurrentWatermarkMs(), set(), []
        rows = [] if state.hasTimedOut else list(frames)
        if rows:
            new = pd.concat(rows, ignore_index=True)
            new = new[new["ts"].notna()].sort_values("ts", ascending=False, kind="stable").drop_duplicates(["watch", "id"])
            us = new["ts"].astype("datetime64[us]").astype("int64")
            for k, at, last, lease in zip(zip(new["watch"], new["id"], strict=True), us.tolist(), new["val"].tolist(), new["lease_s"].tolist(), strict=True):
                old = held.get(k)
                ts, val = (at, last) if old is None or at > old[0] else old[:2]
                held[k] = (ts, val, int(ts / 1000 + lease * 1000))
                came.add(k)
                if refresh or old is None or val != old[1]:
                    out.append((*k, ts, val))
        for k in [k for k, v in held.items() if v[2] < now and k not in came]:
            del held[k]
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(now + 1, min(v[2] for v in held.values())))
        elif state.exists:
            state.remove()
        if out:
            watch, id, ts, val = zip(*out, strict=True)
            yield pd.DataFrame({"watch": watch, "id": id, "ts": pd.to_datetime(pd.Series(ts, dtype="int64"), unit="us"), "val": val})

    return run


def watch(points: DataFrame, subscriptions: DataFrame, refresh: bool = False, delay: str = "1 hour") -> DataFrame:
    """For each watch and subscribed id the newest value, given out where it differs from what was given out before.

    subscriptions(watch, id, lease_s) is static; a watch's state goes when its lease passes in the points' time without
    points. refresh gives out every newest value. State holds one value for each (watch, id), in buckets that are dealt over
    all tasks, as one call for each of them costs far more than the comparison.
    """
    met = points.select("id", "ts", "val").withWatermark("ts", delay).join(subscriptions, "id")
    return met.withColumn("bucket", bucket("watch", "id")).groupBy("bucket").applyInPandasWithState(_changes(refresh), "watch string, id string, ts timestamp, val double", "held binary", "update", GroupStateTimeout.EventTimeTimeout)


def point_write_batch(table: Callable[[], DataFrame], store: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last write for each (id, level): reads the table, merges a batch, stores it."""

    def run(batch: DataFrame, _: int) -> None:
        both = table().unionByName(batch.select(*table().columns))
        rest = [c for c in both.columns if c not in ("id", "level")]
        store(both.groupBy("id", "level").agg(F.max_by(F.struct(*rest), "at").alias("w")).select("id", "level", "w.*"))

    return run


def point_read(writes: DataFrame, now: str) -> DataFrame:
    """Priority arrays at a time: id, level, levelDis, val, who, in_force."""
    return last_per_level(writes, now)

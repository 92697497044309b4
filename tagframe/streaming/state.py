"""Watches and point writes as keyed state with timers, in the time of the events.

What a key does with its rows is a plain class that takes steps in the order of time (Watched, Levels). Keys are dealt to
buckets: the state of a bucket holds the fields of all its keys as one value, with one timer for the lease or duration that
ends first among them, as a call for each key, and for each of its ends, costs far more than the steps do. State of these
jobs needs the RocksDB provider, which with_state() sets for the session.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


#: Into how many buckets keys are dealt. A batch reads and writes the whole state of the buckets that it touches.
BUCKETS = 512


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _ms(us: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-us // 1000)


def _null(v: object) -> object:
    return None if v is None or v != v else v


class _Bucket(StatefulProcessor):
    """The keys of a bucket: what each holds, by its id. rows and ended are the steps of a kind of key."""

    order: tuple[str, ...] = ()  # of the rows of a batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "held binary, timer bigint")

    def rows(self, held: dict, rows: pd.DataFrame) -> pd.DataFrame | None:
        """Takes sorted rows; gives out what they make."""
        raise NotImplementedError

    def ended(self, held: dict, at: int) -> pd.DataFrame | None:
        """Ends what ends up to a time in microseconds."""
        raise NotImplementedError

    def due(self, held: dict) -> int | None:
        """When (in milliseconds) something of a key ends next."""
        raise NotImplementedError

    def _load(self) -> tuple[dict, int | None]:
        if not self.state.exists():
            return {}, None
        held, timer = self.state.get()
        return pickle.loads(bytes(held)), _null(timer)

    def _store(self, held: dict, timer: int | None) -> None:
        due = self.due(held)
        if due is not None and (timer is None or due < timer):  # an earlier timer than needed does no harm
            self.handle.registerTimer(due)
            timer = due
        self.state.update((pickle.dumps(held), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        whole = pd.concat(list(rows))
        out = self.rows(held, whole[whole["at_us"].notna()].sort_values(list(self.order), kind="stable"))
        self._store(held, timer)
        if out is not None:
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._load()
        out = self.ended(held, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000)
        self._store(held, None)
        if out is not None:
            yield out

    def close(self) -> None:
        pass


class Levels:
    """The priority array of one point: for each level its last write (val, who, at, until), times in microseconds."""

    def __init__(self, held: dict[int, tuple] | None = None):
        self.held = dict(held or {})

    def in_force(self) -> tuple:
        """(level, val, who) of the lowest level that holds; nulls if there is none."""
        there = [k for k, w in self.held.items() if w[0] is not None]
        return (min(there), *self.held[min(there)][:2]) if there else (None, None, None)

    def until(self, at: int, included: bool) -> Iterator[tuple]:
        """Ends the writes whose duration is over before a time (or at it); gives (at, level, val, who) where the value in force changes."""
        while True:
            ends = sorted(w[3] for w in self.held.values() if w[0] is not None and w[3] is not None and (w[3] <= at if included else w[3] < at))
            if not ends:
                return
            before = self.in_force()
            for k, w in list(self.held.items()):
                if w[0] is not None and w[3] == ends[0]:
                    self.held[k] = (None, None, w[2], None)
            if self.in_force() != before:
                yield ends[0], *self.in_force()

    def write(self, at: int, rows: list[tuple]) -> Iterator[tuple]:
        """Writes (level, val, who, duration_s) of one time; a null val gives its level back. Older ones than a level's last do not count."""
        yield from self.until(at, included=False)
        before = self.in_force()
        for level, val, who, duration in rows:
            if level not in self.held or self.held[level][2] <= at:
                self.held[level] = (val, who, at, None if duration is None or val is None else at + round(duration * 1_000_000))
        if self.in_force() != before:
            yield at, *self.in_force()


_IN_FORCE = "id string, at timestamp, level int, val double, who string"


class _PriorityArrays(_Bucket):
    order = ("id", "at_us", "seq")

    def _out(self, found: list[tuple]) -> pd.DataFrame | None:
        if not found:
            return None
        id, at, level, val, who = zip(*found, strict=True)
        return pd.DataFrame({"id": pd.Series(id, dtype=object), "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"), "level": pd.array(level, "Int32"), "val": pd.array(val, "Float64"), "who": pd.Series(who, dtype=object)})

    def rows(self, held: dict, rows: pd.DataFrame) -> pd.DataFrame | None:
        found = []
        each = zip(*[rows[c].tolist() for c in ("id", "at_us", "level", "val", "who", "duration_s")], strict=True)
        for id, writes in itertools.groupby(each, key=lambda r: r[0]):
            levels = Levels(held.get(id))
            for at, group in itertools.groupby(writes, key=lambda r: r[1]):
                found += [(id, *f) for f in levels.write(int(at), [(int(r[2]), _null(r[3]), _null(r[4]), _null(r[5])) for r in group])]
            held[id] = levels.held
        return self._out(found)

    def ended(self, held: dict, at: int) -> pd.DataFrame | None:
        found = []
        for id, levels in held.items():
            now = Levels(levels)
            found += [(id, *f) for f in now.until(at, included=True)]
            held[id] = now.held
        return self._out(found)

    def due(self, held: dict) -> int | None:
        ends = [w[3] for levels in held.values() for w in levels.values() if w[3] is not None]
        return _ms(min(ends)) if ends else None


def priority_arrays(writes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """A stream of point writes (id, level, val, who, at, duration_s) -> (id, at, level, val, who): every change of the value in force.

    State holds the last write of each of the 17 levels, whatever has been written before. A write with a duration ends by
    a timer, and then the next level that holds is given out, without any new write. Writes of one time count together.
    """
    with_state(writes.sparkSession)
    rows = writes.withColumns({"at_us": F.unix_micros("at"), "seq": F.xxhash64("level", "val", "who")}).withWatermark("at", delay)
    return rows.withColumn("bucket", bucket("id")).groupBy("bucket").transformWithStateInPandas(_PriorityArrays(), _IN_FORCE, "append", "eventTime")


class Watched:
    """Who watches one id: its newest value (ts, val), and for each watch (until, lease, given, val), times in microseconds."""

    def __init__(self, value: tuple | None = None, watches: dict[str, tuple] | None = None):
        self.value, self.watches = value, dict(watches or {})

    def _give(self, watch: str, reason: str) -> Iterator[tuple]:
        until, lease, _, _ = self.watches[watch]
        if self.value:
            self.watches[watch] = (until, lease, True, self.value[1])
            yield watch, *self.value, reason

    def until(self, at: int) -> None:
        """Ends the leases that are over before a time."""
        self.watches = {w: v for w, v in self.watches.items() if v[0] >= at}

    def step(self, at: int, kind: str, watch: str | None, val: float | None, lease_s: float | None) -> Iterator[tuple]:
        """One event; gives (watch, ts, val, reason). point: a value; sub: its watch gets the value there is; refresh: the same
        again; poll: only keeps the lease; unsub: ends the watch of this id. All but the last give a lease anew."""
        self.until(at)
        if kind == "point":
            if self.value is None or at >= self.value[0]:
                self.value = (at, val)
                for w in sorted(self.watches):
                    if not self.watches[w][2] or self.watches[w][3] != val:
                        yield from self._give(w, "change")
        elif kind == "unsub":
            self.watches.pop(watch, None)
        elif kind == "sub" or watch in self.watches:
            old = self.watches.get(watch, (0, 0, False, None))
            lease = int(lease_s * 1_000_000) if lease_s is not None else old[1]
            self.watches[watch] = (at + lease, lease, *old[2:])
            if kind in ("sub", "refresh"):
                yield from self._give(watch, kind)


_GIVEN = "watch string, id string, ts timestamp, val double, reason string"


class _Watches(_Bucket):
    order = ("id", "at_us", "seq", "watch")

    def rows(self, held: dict, rows: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        each = zip(*[rows[c].tolist() for c in ("id", "at_us", "kind", "watch", "val", "lease_s")], strict=True)
        for id, steps in itertools.groupby(each, key=lambda r: r[0]):
            now = Watched(*held.get(id, ()))
            for _, at, kind, watch, val, lease_s in steps:
                out += [(id, *g) for g in now.step(int(at), kind, _null(watch), _null(val), _null(lease_s))]
            held[id] = (now.value, now.watches)
        if not out:
            return None
        id, watch, ts, val, reason = zip(*out, strict=True)
        return pd.DataFrame({"watch": watch, "id": pd.Series(id, dtype=object), "ts": pd.to_datetime(pd.Series(ts, dtype="int64"), unit="us"), "val": pd.array(val, "Float64"), "reason": reason})

    def ended(self, held: dict, at: int) -> None:
        for id, fields in held.items():
            now = Watched(*fields)
            now.until(at)
            held[id] = (now.value, now.watches)

    def due(self, held: dict) -> int | None:
        ends = [v[0] for _, watches in held.values() for v in watches.values()]
        return _ms(min(ends)) + 1 if ends else None


#: The order of events of one time.
_ORDER = ("point", "unsub", "sub", "poll", "refresh")


def watches(points: DataFrame, events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Streams of points(id, ts, val) and of watch events(id, at, kind, watch, lease_s) -> (watch, id, ts, val, reason).

    kind: sub, poll, refresh or unsub; see Watched. A subscribed id gives a row to each of its watches where its value
    changes, and to one that subscribes or asks to be refreshed. A watch that nobody keeps ends with its lease. State is
    kept by id: its newest value, and its watches.
    """
    with_state(points.sparkSession)
    none = lambda t: F.lit(None).cast(t)
    p = points.select("id", F.col("ts").alias("at"), F.lit("point").alias("kind"), none("string").alias("watch"), F.col("val").cast("double").alias("val"), none("double").alias("lease_s"))
    e = events.select("id", "at", "kind", "watch", none("double").alias("val"), F.col("lease_s").cast("double").alias("lease_s"))
    seq = F.array_position(F.array(*[F.lit(k) for k in _ORDER]), F.col("kind")).cast("int")
    rows = p.unionByName(e).withColumns({"at_us": F.unix_micros("at"), "seq": seq}).withWatermark("at", delay)
    return rows.withColumn("bucket", bucket("id")).groupBy("bucket").transformWithStateInPandas(_Watches(), _GIVEN, "append", "eventTime")

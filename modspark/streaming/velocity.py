"""Exact trailing counts per user on a stream.

For every post, the posts of the same user in ``[t - hours, t]`` (peers at
``t`` included): what ``windows.trailing_count`` gives in batch.  A post's
count is final once the watermark has passed it, so counts leave when their
hour ends in event time, each once.

A user's time line is cut into slices as wide as the range, and state is keyed
by (group, slice), a group being the users of one hash value: a post belongs to
its own slice and, moved forward by the range, to the next one, where it tells
which posts it has already left.  Within a slice a user's count at ``t`` is

    own posts at or before t  +  moved posts at or after t.

State is a ring of hour buckets (a map state: hour -> packed posts) and, per
user, the own posts of the hours given out plus the moved posts still ahead.  A
timer a started hour emits that hour's counts of all users of the group, drops
both its buckets and brings the numbers up to date, so each post is read twice
whatever the range; a timer at the slice's end drops the rest.  Calls to the
state grow with groups and hours, not with users.  No state of a user outlives
two slices after the last post, and a user with a third of all posts is one key
a slice, not one key for ever.

Defined cases: posts behind the watermark are late and count nowhere (neither
themselves nor for others); posts without a time are given back at once with
no count; posts without a user are one group; repeated posts count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000  # microseconds
GROUPS = 64  # of users; the tasks that may work on one slice
_POSTS = pa.schema([("key", pa.string()), ("t", pa.int64()), ("id", pa.string())])
_MOVED = pa.schema([("key", pa.string()), ("t", pa.int64())])
_SUMS = pa.schema([("key", pa.string()), ("n", pa.int64())])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(held: tuple | None, schema: pa.Schema) -> pa.Table:
    return pa.ipc.open_stream(bytes(held[-1])).read_all() if held else schema.empty_table()


class TrailingCount(StatefulProcessor):
    """State of one (group, slice)."""

    def __init__(self, hours: int):
        self.span = hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # hour -> posts until they are given out
        self.own = handle.getMapState("own", "hour long", "posts binary")
        # hour -> posts of the slice before, moved forward by the range
        self.moved = handle.getMapState("moved", "hour long", "posts binary")
        # the last hour given out; per user the own posts up to it and the moved ones after it
        self.sums = handle.getValueState("sums", "hour long, sums binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame[frame["t"] - self.span * frame["moved"] > low]  # late posts count nowhere
            if not len(frame):
                continue
            moved, hours = frame["moved"].to_numpy(), frame["t"].to_numpy() // HOUR
            order = np.lexsort((hours, moved))
            moved, hours = moved[order], hours[order]
            posts = pa.Table.from_pandas(frame[_POSTS.names], _POSTS, preserve_index=False).take(order)
            cuts = np.flatnonzero(np.r_[True, (np.diff(hours) != 0) | (np.diff(moved) != 0)]).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], len(posts)]):
                hour, part = int(hours[lo]), posts.slice(lo, hi - lo)
                state, schema = (self.moved, _MOVED) if moved[lo] else (self.own, _POSTS)
                before = _table(state.getValue((hour,)), schema)
                state.updateValue((hour,), (_packed(pa.concat_tables([before, part.select(schema.names)])),))
                if not moved[lo]:
                    self.handle.registerTimer((hour + 1) * HOUR // 1000)
            ahead = posts.slice(int(np.searchsorted(moved, 1)))
            if len(ahead):
                hour, sums = self._sums(key)
                self._keep(hour, [(sums["key"], sums["n"].to_numpy()), (ahead["key"], np.ones(len(ahead), np.int64))])
            self.handle.registerTimer((key[1] + 1) * self.span // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        hour = end // HOUR - 1
        held = self.own.getValue((hour,))
        if held:
            yield self._counts(key, hour, _table(held, _POSTS))
        if end % self.span == 0:  # the slice is over
            self.own.clear()
            self.moved.clear()
            self.sums.clear()
        elif held:
            self.own.removeKey((hour,))

    def _sums(self, key) -> tuple[int, pa.Table]:
        held = self.sums.get()
        return (int(held[0]) if held else key[1] * self.span // HOUR - 1), _table(held, _SUMS)

    def _keep(self, hour: int, parts: list[tuple[pa.ChunkedArray, np.ndarray]]) -> None:
        """Add up the users' numbers."""
        codes, users = _codes([k for k, _ in parts])
        n = np.zeros(len(users), np.int64)
        for c, (_, by) in zip(codes, parts):
            np.add.at(n, c, by)
        some = np.flatnonzero(n)
        self.sums.update((hour, _packed(pa.Table.from_arrays([users.take(pa.array(some)), pa.array(n[some])], schema=_SUMS))))

    def _counts(self, key, hour: int, own: pa.Table) -> pd.DataFrame:
        last, sums = self._sums(key)
        passed = []
        for h in range(last + 1, hour + 1):
            if held := self.moved.getValue((h,)):
                passed.append(_table(held, _MOVED))
                self.moved.removeKey((h,))
                now = passed[-1] if h == hour else _MOVED.empty_table()
            else:
                now = _MOVED.empty_table()
        gone = pa.concat_tables([_MOVED.empty_table(), *passed])
        codes, users = _codes([own["key"], now["key"], sums["key"], gone["key"]])
        base = np.zeros(len(users), np.int64)
        base[codes[2]] = sums["n"].to_numpy()
        np.subtract.at(base, codes[3], 1)
        # (user, time within the hour) as one number
        mine = codes[0] << 32 | own["t"].to_numpy() - hour * HOUR
        here, there = np.sort(mine), np.sort(codes[1] << 32 | now["t"].to_numpy() - hour * HOUR)
        count = base[codes[0]] + np.searchsorted(here, mine, "right") - np.searchsorted(here, codes[0] << 32)
        count += np.searchsorted(there, codes[0] + 1 << 32) - np.searchsorted(there, mine)
        self._keep(hour, [(pa.chunked_array([users]), base), (own["key"], np.ones(len(own), np.int64))])
        return own.select(["id", "key", "t"]).append_column("n", pa.array(count, pa.int64())).to_pandas()

    def close(self) -> None:
        pass


def _codes(keys: list[pa.ChunkedArray]) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers for the users (a missing user is one) of some columns."""
    every = pa.chunked_array([c for k in keys for c in k.chunks], pa.string()).combine_chunks()
    every = every.dictionary_encode(null_encoding="encode")
    ends = np.cumsum([len(k) for k in keys])
    return np.split(every.indices.to_numpy().astype(np.int64), ends[:-1]), every.dictionary


def trailing_count(
    posts: DataFrame, key: str = "user_id", id_col: str = "content_id", ts_col: str = "ts", hours: int = 24,
    watermark: str = "1 hour", out: str = "posts_last_24h", groups: int = GROUPS,
) -> DataFrame:
    """Stream of (id, key, ts, ``out``); start it within
    ``state.state_settings`` (map states and timers need RocksDB)."""
    ts = F.col(ts_col).cast("timestamp")
    rows = posts.select(F.col(id_col).cast("string").alias("id"), F.col(key).cast("string").alias("key"), ts.alias("ts"))
    timed = rows.filter("ts IS NOT NULL").withWatermark("ts", watermark)
    t, span = F.unix_micros("ts"), hours * HOUR
    each = F.array(
        F.struct(F.lit(0).alias("moved"), t.alias("t"), F.floor(t / span).alias("slice")),
        F.struct(F.lit(1).alias("moved"), (t + span).alias("t"), F.floor((t + span) / span).alias("slice")),
    )
    sliced = timed.select("id", "key", "ts", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"), F.inline(each))
    counts = sliced.groupBy("group", "slice").transformWithStateInPandas(
        TrailingCount(hours), "id string, key string, t long, n long", "Append", "EventTime"
    )
    counts = counts.select("id", "key", F.timestamp_micros("t").alias("ts"), "n")
    untimed = rows.filter("ts IS NULL").withColumn("n", F.lit(None).cast("long"))
    return counts.unionByName(untimed).withColumnsRenamed({"id": id_col, "key": key, "ts": ts_col, "n": out})

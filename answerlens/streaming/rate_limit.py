"""The exact trailing-24-hour count of each anonymous audit, as a stream with timers."""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quotas import FREE_AUDITS_PER_DAY

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package

BLOCK = 3_600_000_000  # microseconds; an hour
DAY = 24  # blocks
COUNTED = "created_ip string, audit_id long, used_24h long"
_SEND = 50_000  # rows sent at once
_NO_ROWS = (np.empty(0, "int64"), np.empty(0, "int64"))


class TrailingCounts(StatefulProcessor):
    """Rows of one address by hour, and for each day how many its hours have.

    A count needs the sizes of the whole blocks between and the rows of its two edge blocks, so a call holds at
    most a size for each block of the span, its new rows and the rows of the blocks it touches. Each block is read and
    written once a call, its size and timer once a day: access to the state costs more than the rows. A late row moves
    the counts of the rows up to a span after it; they are sent again. A timer frees each day a span after its end.
    """

    def __init__(self, seconds: int):
        self.span = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "block long", "t array<long>, id array<long>")
        self.sizes = handle.getMapState("sizes", "day long", "block array<long>, n array<long>")

    def _block(self, m: int, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Times and ids of a block in order."""
        if m not in sizes:
            return _NO_ROWS
        t, i = self.rows.getValue((m,))
        return np.array(t, "int64"), np.array(i, "int64")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(part["t"].to_numpy("int64"), part["audit_id"].to_numpy("int64")) for part in rows]
        t, i = (np.concatenate(v) for v in zip(*parts, strict=True)) if parts else _NO_ROWS
        t, i, _ = _in_order(t, i, np.ones(len(t), bool))
        days = {int(k[0]): dict(zip(v[0], v[1], strict=True)) for k, v in self.sizes.iterator()}
        sizes = {m: n for day in days.values() for m, n in day.items()}
        touched: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # with a mark at new rows
        blocks, first = np.unique(t // BLOCK, return_index=True)
        for m, a, b in zip(blocks.tolist(), first.tolist(), [*first[1:].tolist(), len(t)], strict=True):
            held_t, held_i = self._block(m, sizes)
            is_new = np.concatenate([np.zeros(len(held_t), bool), np.ones(b - a, bool)])
            at, ids, is_new = _in_order(np.concatenate([held_t, t[a:b]]), np.concatenate([held_i, i[a:b]]), is_new)
            if not is_new.any():
                continue
            touched[m], sizes[m] = (at, ids, is_new), len(at)
            self.rows.updateValue((m,), (at.tolist(), ids.tolist()))
        if not touched:
            return
        for d in sorted({m // DAY for m in touched}):
            if d not in days:
                self.handle.registerTimer(((d + 1) * DAY * BLOCK + self.span) // 1000)
            own = {**days.get(d, {}), **{m: sizes[m] for m in touched if m // DAY == d}}
            self.sizes.updateValue((d,), (list(own), list(own.values())))
        order = sorted(sizes)
        before = dict(zip(order, np.cumsum([0, *(sizes[m] for m in order)])[:-1].tolist(), strict=True))
        times = np.concatenate([at[is_new] for at, _, is_new in touched.values()])  # blocks are in order
        end = (int(times[-1]) + self.span) // BLOCK
        edges: dict[int, np.ndarray] = {}
        out, size, seen = [], 0, 0
        for m in order[bisect_left(order, int(times[0]) // BLOCK) : bisect_right(order, end)]:
            at, ids, is_new = touched[m] if m in touched else (*self._block(m, sizes), np.zeros(sizes[m], bool))
            news = seen + np.cumsum(is_new)
            seen += int(is_new.sum())
            start = at - self.span
            sent = news > np.searchsorted(times, start, "right")  # a new row lies in its window
            if not sent.any():
                continue
            at, ids, start, place = at[sent], ids[sent], start[sent], before[m] + 1 + np.flatnonzero(sent)
            gone = np.empty(len(start), "int64")  # rows up to where the window begins
            edge = start // BLOCK
            for e in np.unique(edge).tolist():
                for old in [k for k in edges if k < e]:
                    del edges[old]
                if e not in edges:
                    edges[e] = touched[e][0] if e in touched else self._block(e, sizes)[0]
                here = edge == e
                base = before[order[bisect_left(order, e)]]  # the edge is no later than block m
                gone[here] = base + np.searchsorted(edges[e], start[here], "right")
            out.append(pd.DataFrame({"created_ip": key[0], "audit_id": ids, "used_24h": place - gone}))
            size += len(ids)
            if size >= _SEND:
                yield pd.concat(out)
                out, size = [], 0
        if out:
            yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        d = (expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.span) // (DAY * BLOCK) - 1
        if self.sizes.containsKey((d,)):
            for m in self.sizes.getValue((d,))[0]:
                self.rows.removeKey((m,))
            self.sizes.removeKey((d,))
        yield pd.DataFrame({"created_ip": pd.Series([], dtype="object"), "audit_id": pd.Series([], dtype="int64"), "used_24h": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def _in_order(t: np.ndarray, i: np.ndarray, is_new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by time and id; a row that is held stays the held one."""
    by = np.lexsort((is_new, i, t))
    t, i, is_new = t[by], i[by], is_new[by]
    own = np.concatenate([np.ones(min(len(t), 1), bool), (t[1:] != t[:-1]) | (i[1:] != i[:-1])])
    return t[own], i[own], is_new[own]


def rate_limit(audits: DataFrame, late: str = "1 hour", seconds: int = 86400, limit: int = FREE_AUDITS_PER_DAY) -> DataFrame:
    """Each anonymous audit with the count of its address in the trailing 24 hours, as ``free_rate_limit`` counts.

    An update stream by ``audit_id``: a row arrives when its audit does, and again when a late one moves its count.
    Rows later than ``late`` are dropped; a repeated row counts once. State of an address ends ``seconds`` and ``late`` after its last audit.
    """
    use_rocksdb(audits.sparkSession)
    anonymous = audits.filter("workspace_id IS NULL AND created_ip IS NOT NULL").select("audit_id", "created_ip", "started_at", F.unix_micros("started_at").alias("t"))
    counted = anonymous.withWatermark("started_at", late).groupBy("created_ip").transformWithStateInPandas(
        statefulProcessor=TrailingCounts(seconds), outputStructType=COUNTED, outputMode="Update", timeMode="EventTime"
    )
    return counted.withColumns({"remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("used_24h")), "over_limit": F.col("used_24h") > limit})


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

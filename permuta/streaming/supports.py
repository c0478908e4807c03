"""Patterns of a stream with their supports, kept up to date from trigger to trigger (an extension of batch mining).

With a fixed forgetting rate k a support only fades while no window is added: after d more values it is
``exp(-k d)`` times what it was.  So a series' state is a row for each pattern (its support at a position, count, first and last
position), the last values, and the rows that still wait for their turn; it doesn't grow with the series.

Rows may come late: a row waits until one of its series has come whose time is ``delay`` seconds later, then waiting rows are
handled in order of time and ``seq``.  A row that comes after rows of its time or later ones were handled is left
out and counted as late.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from permuta.functions.thresholds import check_threshold
from permuta.operators.levels import walk

OUT = "series_id string, n long, late long, m int, pattern array<int>, support double, cnt long, first_pos long, last_pos long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closure_of(rows: dict[tuple[int, ...], tuple], n: int, minsup: float, k: float) -> list[tuple]:
    """Patterns whose support at ``n``, and that of all their prefixes, reaches the threshold.

    A suffix occurs wherever the whole does, so prefixes are what is left to ask for.
    """
    kept, out = set(), []
    for p in sorted(rows, key=len):
        support, cnt, first, last, at = rows[p]
        support *= math.exp(-k * (n - at))
        if support >= minsup:
            order = sorted(p[:-1])
            if len(p) == 2 or tuple(order.index(x) + 1 for x in p[:-1]) in kept:
                kept.add(p)
                out.append((len(p), list(p), support, cnt, first, last))
    return out


def new_windows(values: np.ndarray, known: int, end: int, k: float, top: int) -> dict[tuple[int, ...], tuple]:
    """Support at ``end``, count, first and last position of each pattern among the windows that end after the first ``known`` values.

    ``end`` is the position of the last value.
    """
    at = np.arange(end - len(values) + 1, end + 1)
    out = {}
    for m, a, b, window in walk(values, at, np.zeros(len(values), np.int64), top):
        s = np.flatnonzero(window)
        s = s[s + m - 1 >= known]
        if not len(s):
            continue
        s = s[np.lexsort((s, b[s], a[s]))]
        cut = np.flatnonzero(np.concatenate([[True], (a[s][1:] != a[s][:-1]) | (b[s][1:] != b[s][:-1])]))
        last = at[s + m - 1]
        weights = np.add.reduceat(np.exp(-k * (end - last)), cut)
        counts, firsts, lasts = np.diff(np.append(cut, len(s))), np.minimum.reduceat(last, cut), np.maximum.reduceat(last, cut)
        for i, x in enumerate(s[cut].tolist()):
            ranks = np.argsort(np.argsort(values[x : x + m])) + 1
            out[tuple(ranks.tolist())] = float(weights[i]), int(counts[i]), int(firsts[i]), int(lasts[i]), end
    return out


class PatternState(StatefulProcessor):
    """A series' patterns, values and waiting rows; rows in, the whole closure out at every trigger that handles some."""

    def __init__(self, minsup: float, k: float, max_len: int, delay: float):
        self.minsup, self.k, self.max_len, self.delay = minsup, k, max_len, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "n long, late long, newest double, handled double, tail array<double>")
        self.waiting = handle.getListState("waiting", "ts double, seq long, v double")
        self.patterns = handle.getMapState("patterns", "pattern string", "support double, cnt long, first_pos long, last_pos long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, late, newest, handled, tail = self.place.get() if self.place.exists() else (0, 0, -math.inf, -math.inf, [])
        came = pd.concat(rows)[["ts", "seq", "v"]]
        newest = max(newest, float(came["ts"].max()))
        on_time = came["ts"] > handled
        late += int((~on_time).sum())
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=["ts", "seq", "v"])
        held = pd.concat([held, came[on_time]]) if len(held) else came[on_time]
        held = held.sort_values(["ts", "seq"], kind="stable")
        due = held["ts"] <= newest - self.delay
        ready, held = held[due], held[~due]
        self.waiting.clear()
        if len(held):
            self.waiting.put([(float(t), int(s), None if v is None or math.isnan(v) else float(v)) for t, s, v in held.itertuples(index=False, name=None)])
        if len(ready):
            handled = float(ready["ts"].max())
            n += len(ready)
            values = np.concatenate([np.array([math.nan if v is None else v for v in tail], float), ready["v"].to_numpy(float) + 0.0])
            for p, (support, cnt, first, last, at) in new_windows(values, len(tail), n, self.k, self.max_len).items():
                name = ",".join(map(str, p))
                if self.patterns.containsKey((name,)):
                    old = self.patterns.getValue((name,))
                    support, cnt, first = support + old[0] * math.exp(-self.k * (n - old[4])), cnt + old[1], old[2]
                self.patterns.updateValue((name,), (support, cnt, first, last, at))
            tail = [None if math.isnan(v) else float(v) for v in values[-(self.max_len - 1) :]]
        self.place.update((n, late, newest, handled, tail))
        if len(ready):
            every = {tuple(map(int, p[0].split(","))): tuple(r) for p, r in self.patterns.iterator()}
            found = closure_of(every, n, self.minsup, self.k)
            yield pd.DataFrame([(key[0], n, late, *r) for r in found], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_supports(rows: DataFrame, minsup: float, k: float, max_len: int, delay: float = 0.0) -> DataFrame:
    """The closure of each series at each trigger that handles rows of it: series_id, n, late, m, pattern, support, cnt, first_pos, last_pos.

    ``rows`` is a stream (series_id, ts in seconds, seq, v); positions count a series' handled rows, and ``n`` is how many there are.  Equal to
    ``mine(.., minsup, k, max_len=max_len)`` over these rows.  Null and NaN values take a position and end windows.  The stream
    needs the RocksDB state store (``use_rocksdb``).
    """
    check_threshold(minsup)
    if not k >= 0 or max_len < 2:
        raise ValueError("k must be 0 or more and max_len 2 or more")
    plain = rows.selectExpr("series_id", "cast(ts as double) as ts", "cast(seq as long) as seq", "cast(v as double) as v")
    return plain.groupBy("series_id").transformWithStateInPandas(PatternState(minsup, k, max_len, delay), OUT, "Append", "None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

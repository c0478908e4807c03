"""Occurrences of patterns in a stream of series values (an extension; batch mining doesn't need it).

State is the last m - 1 values of a series, whatever its length.  With a fixed forgetting rate k the
support after n values is the sum of exp(-k (n - pos)) over the occurrences written so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from permuta.functions import rank_encode

OUT = "series_id string, pos long, values array<double>"
STATE = "pos long, tail array<double>"


def stream_windows(values: DataFrame, m: int) -> DataFrame:
    """(series_id, pos, pattern) of the tie-free windows of m values of a stream (series_id, seq, v).

    ``seq`` orders a series; rows of one micro-batch are sorted by it, and a row must not come after a
    later one of its series has been handled.  Null and NaN values end windows.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pos, tail = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values("seq")["v"].to_numpy(float) + 0.0
        known = np.concatenate([np.array(tail, float), rows])
        windows = np.lib.stride_tricks.sliding_window_view(known, m) if len(known) >= m else np.zeros((0, m))
        ordered = np.sort(windows, axis=1)
        whole = ~np.isnan(ordered[:, -1]) & (ordered[:, 1:] != ordered[:, :-1]).all(1)
        ends = pos - len(tail) + m + np.flatnonzero(whole)
        state.update((pos + len(rows), known[len(known) - min(m - 1, len(known)) :].tolist()))
        yield pd.DataFrame({"series_id": [key[0]] * len(ends), "pos": ends, "values": windows[whole].tolist()})

    found = values.groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("series_id", "pos", rank_encode(F.col("values")).alias("pattern"))


def support_at(occurrences: DataFrame, lengths: DataFrame, k: float) -> DataFrame:
    """(series_id, pattern, support, cnt) from written occurrences and (series_id, n)."""
    rows = occurrences.join(lengths, "series_id")
    return rows.groupBy("series_id", "pattern").agg(F.sum(F.exp(-F.lit(k) * (F.col("n") - F.col("pos")))).alias("support"), F.count("*").alias("cnt"))

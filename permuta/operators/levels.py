"""The closure of all lengths by doubling: the lengths from m to 2m - 1 are mined in two passes over the series.

A window's suffixes end where it ends, so their supports are no smaller: a pattern is in the closure exactly if it and all its
prefixes reach the threshold.  For a window start that is one walk over its lengths.  With
``less(s, j)``, how many of the values from s to s + j - 1 are below the one at s + j, a pattern of m ranks is told
by ``less(s, 1) .. less(s, m - 1)``, and ``less(s, j) = less(s + 1, j - 1) + (v[s] < v[s + j])``: all starts of a
chunk go from a length to the next in a few vector operations, whatever the length.  The sum of
``less(s, j) * j!`` names patterns of up to 20 ranks exactly; longer ones have a second 64-bit hash.

The first pass sums weights by pattern in each chunk, Spark adds the chunks up; the second walks again, now
knowing which patterns are frequent, and keeps the starts whose walk goes on.  So a pattern of n ranks takes a
number of jobs that grows with log n.  Where supports fall fast from length to length, a block takes only the
lengths that may still reach the threshold: in a block each start gives a row for every length.

Series that fit into one chunk are mined by one walk in one task, without the two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.storage import cut

#: Starts of a chunk at least, and rows that a task works on at once.
STARTS, ROWS = 1 << 13, 1 << 16
#: The first block mines the lengths below it, each later one up to twice as many.
FIRST = 8
#: Frequent patterns of a block that are broadcast, some 100 bytes each; values of the windows that are ranked together.
FEW_PATTERNS, WINDOW_VALUES = 100_000, 1 << 20

PATTERN = "series_id string, m int, pattern array<int>, support double, cnt long, first_pos long, last_pos long, n long, k double, held int"


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (xor-shift, multiply)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def walk(v: np.ndarray, at: np.ndarray, group: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For m = 2 .. ``top``: m, the two names of the window of m values at each start, and whether it is a window.

    It is one if its rows are of one group, at consecutive positions, and its values pairwise distinct and no NaN.
    """
    n = len(v)
    less, tied, dead = np.zeros(n, np.int64), np.zeros(n, bool), np.isnan(v)
    a = b = np.zeros(n, np.uint64)
    factorial = 1
    for j in range(1, min(top, n)):
        first, last = v[: n - j], v[j:]
        less = less[1:] + (first < last)
        tied = tied[1:] | (first == last)
        dead = dead[: n - j] | tied | np.isnan(last) | (group[: n - j] != group[j:]) | (at[j:] - at[: n - j] != j)
        factorial = factorial * j % 2**64
        code = less.astype(np.uint64)
        a = a[: n - j] + code * np.uint64(factorial)
        b = b[: n - j] + _mix(code + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64))
        yield j + 1, a, b, ~dead


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows that hold whole (series, chunk) groups, and the number of each row's group."""
    held, size = [], 0

    def grouped(t: pa.Table):
        sid = t["series_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        chunk = t["chunk"].to_numpy()
        new = np.concatenate([[True], (sid[1:] != sid[:-1]) | (chunk[1:] != chunk[:-1])])
        return np.cumsum(new) - 1

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            group = grouped(t)
            whole = int(np.searchsorted(group, group[-1]))
            if whole:
                yield t.slice(0, whole), group[:whole]
                held = t.slice(whole).to_batches()
            else:
                held = t.to_batches()
            size = sum(x.num_rows for x in held)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, grouped(t)


def _by_pattern(i: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts ``i`` sorted by group and pattern, those of a pattern in ascending order, and where each pattern begins."""
    i = i[np.lexsort((b[i], a[i], group[i]))]
    g, x, y = group[i], a[i], b[i]
    return i, np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))


def _rows(series: pa.ChunkedArray, v: np.ndarray, m: int, starts: np.ndarray, support, cnt, first_pos, last_pos, n, k, held) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 for patterns of ``m`` ranks, each told by the start of a window."""
    step = max(1, WINDOW_VALUES // m)
    for at in range(0, len(starts), step):
        own = slice(at, at + step)
        s = starts[own]
        ranks = np.argsort(np.argsort(v[s[:, None] + np.arange(m)], axis=1), axis=1).astype(np.int32) + np.int32(1)
        pattern = pa.ListArray.from_arrays(pa.array(np.arange(0, m * len(s) + 1, m, dtype=np.int32)), pa.array(ranks.ravel()))
        facts = [pa.array(x[own].astype(kind)) for x, kind in ((support, float), (cnt, np.int64), (first_pos, np.int64), (last_pos, np.int64), (n, np.int64), (k, float), (held, np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(s), np.int32)), pa.nulls(len(s), pa.int64()), series.take(pa.array(s)).combine_chunks(), pa.array(np.full(len(s), m, np.int32)), pattern, *facts], _CLOSED_NAMES)


def _whole_series(sigmas: list[float], max_len: int | None):
    """The closure of series that a task holds whole: rows of kind 0, of each length those that reach the least threshold."""

    def run(batches):
        for t, group in _whole_groups(batches, ROWS):
            v, at, w, n, k = (t[c].to_numpy() for c in ("v", "pos", "w", "n", "k"))
            held = np.full(len(v), len(sigmas))
            for m, a, b, window in walk(v, at, group, len(v) if max_len is None else max_len):
                held = np.where(window, held[: len(window)], 0)
                i = np.flatnonzero(held)
                if not len(i):
                    break
                i, start = _by_pattern(i, group, a, b)
                end, cnt = i + (m - 1), np.diff(np.append(start, len(i)))
                support = np.add.reduceat(w[end], start)
                # All windows of a pattern have the same prefixes, so their walks have reached the same.
                reached = np.minimum(np.searchsorted(sigmas, support, "right"), held[i[start]])
                held[i] = np.repeat(reached, cnt)
                on = reached > 0
                first = i[start][on]
                yield from _rows(t["series_id"], v, m, first, support[on], cnt[on], at[end[start]][on], np.maximum.reduceat(at[end], start)[on], n[first], k[first], reached[on])

    return run


_SUMS = "series_id string, chunk long, m int, a long, b long, support double, cnt long, first_pos long, last_pos long"


def _sums(low: int, top: int, chunk: int):
    """First pass: support, count, first and last position of each pattern in each chunk."""

    def run(batches):
        for t, group in _whole_groups(batches, ROWS):
            v, at, w, alive = (t[c].to_numpy() for c in ("v", "pos", "w", "alive"))
            own = (alive > 0) & ((at - 1) // chunk == t["chunk"].to_numpy())
            for m, a, b, window in walk(v, at, group, top):
                i = np.flatnonzero(window & own[: len(window)]) if m >= low else []
                if not len(i):
                    continue
                i, start = _by_pattern(i, group, a, b)
                end = i + (m - 1)
                one = pa.array(i[start])
                yield pa.RecordBatch.from_arrays(
                    [
                        t["series_id"].take(one).combine_chunks(), t["chunk"].take(one).combine_chunks(), pa.array(np.full(len(start), m, np.int32)), pa.array(a[i[start]].view(np.int64)), pa.array(b[i[start]].view(np.int64)),
                        pa.array(np.add.reduceat(w[end], start)), pa.array(np.diff(np.append(start, len(i)))), pa.array(np.minimum.reduceat(at[end], start)), pa.array(np.maximum.reduceat(at[end], start)),
                    ],
                    [c.split()[0] for c in _SUMS.split(", ")],
                )

    return run


_CLOSED = f"kind int, pos long, {PATTERN}"


def _closed(low: int, top: int, chunk: int):
    """Second pass: patterns of the closure (kind 0), each from the chunk of its first window, and starts that go on (kind 1).

    ``held`` counts the thresholds, in ascending order, that a pattern or a start's walk has reached all along.
    """

    def run(batches):
        for t, every in _whole_groups(batches, ROWS):
            kind = t["kind"].to_numpy()
            known, t = t.filter(pa.array(kind == 0)), t.filter(pa.array(kind == 1))
            known_group, group = every[kind == 0], every[kind == 1]
            km, ka, kb, kh = (known[c].to_numpy() for c in ("m", "a", "b", "held"))
            v, at = t["v"].to_numpy(), t["pos"].to_numpy()
            # Positions in the chunk, from 0; those from the chunk's length on are the next one's.
            own, first = at - 1 - t["chunk"].to_numpy() * chunk, known["chunk"].to_numpy() * chunk
            alive = np.where(own < chunk, t["alive"].to_numpy(), 0)
            key = lambda g, a, b: _mix(a ^ _mix(b ^ _mix(g.astype(np.uint64))))
            facts = {c: known[c].to_numpy() for c in ("support", "cnt", "first_pos", "last_pos")}
            n, k = t["n"].to_numpy(), t["k"].to_numpy()
            last = None
            for m, a, b, window in walk(v, at, group, top):
                if m < low:
                    continue
                alive = np.where(window, alive[: len(window)], 0)
                mine = np.flatnonzero(km == m)
                keys = key(known_group[mine], ka[mine].view(np.uint64), kb[mine].view(np.uint64))
                order = np.argsort(keys)
                keys, mine = keys[order], mine[order]
                i = np.flatnonzero(alive)
                there = np.searchsorted(keys, q := key(group[i], a[i], b[i]))
                there = np.minimum(there, max(len(keys) - 1, 0))
                reached = np.where(keys[there] == q, kh[mine[there]], 0) if len(keys) else np.zeros(len(i), kh.dtype)
                alive[i] = np.minimum(alive[i], reached)
                last = m, alive
                # A pattern's row is written where its first window starts.
                if len(mine):
                    place = _find(group, own, known_group[mine], facts["first_pos"][mine] - m - first[mine], chunk + top)
                    on = (place >= 0) & (place < len(alive))
                    on[on] = alive[place[on]] > 0
                    x, s = mine[on], place[on]
                    yield from _rows(t["series_id"], v, m, s, *(facts[c][x] for c in facts), n[s], k[s], alive[s])
                if not alive.any():
                    break
            if last is not None and last[0] == top:
                s = np.flatnonzero(last[1])
                none = [pa.nulls(len(s), x) for x in _CLOSED_TYPES[3:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(s), np.int32)), pa.array(at[s]), t["series_id"].take(pa.array(s)).combine_chunks(), *none, pa.array(last[1][s].astype(np.int32))], _CLOSED_NAMES)

    return run


_CLOSED_NAMES = ["kind", "pos", "series_id", "m", "pattern", "support", "cnt", "first_pos", "last_pos", "n", "k", "held"]
_CLOSED_TYPES = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]


def _find(group: np.ndarray, at: np.ndarray, g: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """Row of each (group, position), -1 where there is none; rows are sorted by both, their positions from 0 to below ``size``."""
    if not len(at):
        return np.full(len(g), -1)
    known, asked = group * (size + 1) + at, g * (size + 1) + np.clip(pos, -1, size)
    i = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where((group[i] == g) & (at[i] == pos), i, -1)


def _next_top(best: dict[int, float], top: int, sigma: float) -> int:
    """Last length of the next block: twice as many lengths, or one more than those that still reach ``sigma`` if the
    largest support falls on as it did at last."""
    fall = best[top - 1] / best[top] if top - 1 in best else 1.0
    more = math.log(best[top] / sigma) / math.log(fall) if fall > 1 else math.inf
    return top + min(top + 1, 1 + int(min(more, top)))


def closed_levels(base: DataFrame, sigmas: list[float], max_len: int | None = None, starts: int = STARTS, first: int = FIRST) -> list[DataFrame]:
    """Tables of the closure's patterns, with ``held``: of how many of the ascending thresholds.

    ``base``: series_id, pos, v, n, k, w; its long series are read twice for each block of lengths.
    """
    if max_len is not None and max_len < 2:
        return []
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = base.where(F.col("v").isNotNull())
    whole = base.where(F.col("n") <= starts).select("series_id", F.lit(0).cast("long").alias("chunk"), "pos", "v", "w", "n", "k")
    # Work isn't told by the bytes of a row, so the number of tasks is stated.
    whole = whole.repartition(parts, "series_id").sortWithinPartitions("series_id", "pos")
    found = [cut(whole.mapInArrow(_whole_series(sigmas, max_len), _CLOSED)).drop("kind", "pos")]
    base = base.where(F.col("n") > starts)
    if base.isEmpty():
        return found
    alive, best, low, top = None, {}, 2, first - 1
    while True:
        top = top if max_len is None else min(top, max_len)
        chunk = max(starts, top)
        own = F.floor((F.col("pos") - 1) / chunk)
        # The first values of a chunk end windows that start in the one before.
        copies = F.when(((F.col("pos") - 1) % chunk < top - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
        rows = base.withColumn("chunk", F.explode(copies))
        if alive is None:
            rows = rows.withColumn("alive", F.lit(len(sigmas)))
        else:
            marks = alive.select("series_id", "pos", F.col("held").alias("alive"))
            busy = marks.select("series_id", own.alias("chunk")).distinct()
            rows = rows.join(busy.withColumnsRenamed({"series_id": "_s", "chunk": "_c"}), F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")), "left_semi")
            rows = rows.join(marks.withColumnsRenamed({"series_id": "_s", "pos": "_p"}), F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("pos") == F.col("_p")), "left").withColumn("alive", F.coalesce("alive", F.lit(0)))
        rows = rows.select("series_id", "chunk", "pos", "v", "w", "n", "k", "alive")
        dealt = rows.repartition(parts, "series_id", "chunk").sortWithinPartitions("series_id", "chunk", "pos")
        sums = cut(dealt.mapInArrow(_sums(low, top, chunk), _SUMS))
        keys = ["series_id", "m", "a", "b"]
        whole = sums.groupBy(*keys).agg(F.sum("support").alias("support"), F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"))
        held = sum((F.when(F.col("support") >= s, 1).otherwise(0) for s in sigmas), F.lit(0)).cast("int")
        whole = cut(whole.withColumn("held", held).where("held > 0"))
        if whole.count() <= FEW_PATTERNS:
            whole = F.broadcast(whole)
        same = F.col("series_id").eqNullSafe(F.col("_s"))
        for c in keys[1:]:
            same = same & (F.col(c) == F.col(f"_{c}"))
        there = sums.select(F.col("series_id").alias("_s"), "chunk", *[F.col(c).alias(f"_{c}") for c in keys[1:]]).join(whole, same).drop("_s", "_m", "_a", "_b")
        both = there.withColumn("kind", F.lit(0)).unionByName(rows.drop("w").withColumn("kind", F.lit(1)), allowMissingColumns=True)
        both = both.repartition(parts, "series_id", "chunk").sortWithinPartitions("series_id", "chunk", "pos")
        fill = {"v": 0.0, "pos": 0, "n": 0, "k": 0.0, "alive": 0, "m": 0, "a": 0, "b": 0, "held": 0, "support": 0.0, "cnt": 0, "first_pos": 0, "last_pos": 0}
        both = both.select("series_id", "chunk", "kind", *[F.coalesce(c, F.lit(x)).alias(c) for c, x in fill.items()])
        closed = cut(both.mapInArrow(_closed(low, top, chunk), _CLOSED))
        found.append(closed.where("kind = 0").drop("kind", "pos"))
        alive = closed.where("kind = 1")
        if top == max_len or alive.isEmpty():
            return found
        best |= dict(found[-1].groupBy("m").agg(F.max("support")).collect())
        low, top = top + 1, _next_top(best, top, sigmas[0])

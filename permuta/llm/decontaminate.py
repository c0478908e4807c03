"""Benchmark decontamination: Wu-Manber multi-pattern search for windows of benchmark words.

A benchmark item becomes windows of consecutive words; each is a byte string of its words with a
space before, between and after them.  Texts are brought to the same form.  A shift table over
blocks of bytes gives how far a position can be skipped; where the shift is 0, a bucket keyed by
the block holds the patterns that may end there, a comparison of the first bytes thins them, and a
direct comparison confirms the occurrence.  Positions of many lanes of text advance in lockstep, so
each step is one numpy operation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.llm import _text

#: Bytes 0-9, a-z and all above 127 stay, A-Z are folded, the rest become spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Pattern bytes held by the tasks of one pass; a larger benchmark takes more passes.
PASS_BYTES = 32_000_000
_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LANE = 1024


def normal_form(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def windows(words: list[bytes], n: int) -> list[bytes]:
    """Windows of ``n`` words as patterns; a shorter item is one window, an empty one none."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))]


class WuManber:
    """Patterns of similar length: search covers the first ``m`` bytes, ``m`` being the shortest."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, max(1, m // 2))
        self.mask = np.uint64((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] + bytes(8) for p in patterns), np.uint8).reshape(len(patterns), m + 8)
        self.shift = np.full(1 << _BITS, m - b + 1, np.int64)
        for j in range(m - b + 1):
            key = self._slot(np.ascontiguousarray(heads[:, j : j + 8]).view("<u8")[:, 0])
            np.minimum.at(self.shift, key, m - b - j)
        last = self._slot(np.ascontiguousarray(heads[:, m - b : m - b + 8]).view("<u8")[:, 0])
        self.order = np.argsort(last, kind="stable")
        self.keys = last[self.order]
        self.first = np.ascontiguousarray(heads[:, :8]).view("<u8")[:, 0]
        self.first_mask = np.uint64((1 << (8 * min(8, m))) - 1)
        self.first = self.first & self.first_mask

    def _slot(self, block: np.ndarray) -> np.ndarray:
        return (((block & self.mask) * _MULT) >> np.uint64(64 - _BITS)).astype(np.int64)

    def search(self, buf: bytes) -> Iterator[tuple[int, int]]:
        """Start byte and pattern number of every occurrence in ``buf``."""
        n = len(buf) - self.m + 1
        if n <= 0:
            return
        padded = np.frombuffer(buf + bytes(8), np.uint8)
        eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
        back = self.m - self.block
        lane = np.arange(0, n, _LANE)
        end = np.minimum(lane + _LANE, n)
        found = []
        while len(lane):
            step = self.shift[self._slot(eight[lane + back])]
            hit = step == 0
            if hit.any():
                found.append(lane[hit])
            lane = lane + np.maximum(step, 1)
            on = lane < end
            if not on.all():
                lane, end = lane[on], end[on]
        if not found:
            return
        at = np.concatenate(found)
        slot = self._slot(eight[at + back])
        lo, hi = np.searchsorted(self.keys, slot, "left"), np.searchsorted(self.keys, slot, "right")
        count = hi - lo
        pos = np.repeat(at, count)
        which = self.order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        same = (eight[pos] & self.first_mask) == self.first[which]
        for p, w in zip(pos[same].tolist(), which[same].tolist(), strict=True):
            if buf.startswith(self.patterns[w], p):
                yield p, w


def matchers(patterns: list[bytes]) -> list[tuple[WuManber, list[int]]]:
    """One search for each class of lengths, so that a few short items don't shorten all skips."""
    classes = defaultdict(list)
    for i, p in enumerate(patterns):
        classes[min(5, len(p).bit_length() - 1)].append(i)
    return [(WuManber([patterns[i] for i in own]), own) for own in classes.values()]


def _passes(benchmark: DataFrame, text: str, item: str, n: int) -> Iterator[tuple[list[bytes], list[list[str]]]]:
    """Distinct windows with the items they stand in, in groups of at most ``PASS_BYTES``."""

    def cut(batches):
        for batch in batches:
            ids, out = batch.column("item").to_pylist(), ([], [])
            for i, t in zip(ids, batch.column("text").to_pylist(), strict=True):
                for w in dict.fromkeys(windows(normal_form((t or "").encode()), n)):
                    out[0].append(w)
                    out[1].append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["w", "item"])

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, "w binary, item string")
    rows = rows.groupBy("w").agg(F.sort_array(F.collect_set("item")).alias("items"))
    held, size = ([], []), 0
    for row in rows.toLocalIterator():
        held[0].append(bytes(row["w"]))
        held[1].append(row["items"])
        size += len(row["w"]) + sum(map(len, row["items"]))
        if size >= PASS_BYTES:
            yield held
            held, size = ([], []), 0
    yield held


def find_windows(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id", n: int = 10) -> DataFrame:
    """``docs`` with n_words long, hits array<int> and items array<string> added.

    ``hits`` are the word positions inside any occurrence of a benchmark window, ``items`` the ids
    (as strings, sorted) of items with an occurring window.  Null or empty text has no words and no
    hits; a null item id marks words but is not listed; repeated rows and items count once each in
    ``items``.  An empty benchmark hits nothing.  Columns of ``docs`` named n_words, hits or items are
    replaced.
    """
    schema = docs.drop("n_words", "hits", "items").schema
    out = docs.drop("n_words", "hits", "items")
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for patterns, owners in _passes(benchmark, item_text, item, n):
        search = _searcher(out.sparkSession.sparkContext.broadcast((patterns, owners)), text, len(schema))
        out = out.mapInArrow(search, out.schema)
    return out


def _searcher(broadcast, text: str, n_columns: int):
    def search(batches):
        patterns, owners = broadcast.value
        # A worker has one object for a broadcast, so later tasks find the tables of the first.
        if not hasattr(broadcast, "tables"):
            broadcast.tables = matchers(patterns) if patterns else []
        found = broadcast.tables
        for batch in batches:
            data, off = _text.flat(batch.column(text))
            n_words, hits, items = [], [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for a, b, part, at in _text.chunks(data, off, 4 << 20):
                raw = part.tobytes().translate(WORD_BYTES)
                split = [raw[at[i] : at[i + 1]].split() for i in range(b - a)]
                forms = [b" " + b" ".join(w) + b" " for w in split]
                n_words += map(len, split)
                starts = np.cumsum([0] + [len(f) + 1 for f in forms])
                buf = b"\n".join(forms)
                by_doc = defaultdict(list)
                for matcher, own in found:
                    for pos, which in matcher.search(buf):
                        by_doc[int(np.searchsorted(starts, pos, "right")) - 1].append((pos, own[which]))
                for i in range(b - a):
                    old_hits, old_items = next(before)
                    if i in by_doc:
                        spaces = np.flatnonzero(np.frombuffer(forms[i], np.uint8) == 32)
                        hit, names = np.zeros(len(split[i]), bool), set(old_items)
                        hit[old_hits] = True
                        for pos, which in by_doc[i]:
                            w = int(np.searchsorted(spaces, pos - starts[i]))
                            hit[w : w + patterns[which].count(b" ") - 1] = True
                            names.update(owners[which])
                        old_hits, old_items = np.flatnonzero(hit).tolist(), sorted(names)
                    hits.append(old_hits)
                    items.append(old_items)
            added = [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_columns], *added], names=batch.schema.names)

    return search


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``find_windows``: n_words, n_hit, n_items, items_sha256, contaminated."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10, min_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of which no more than ``min_share`` of the words are hit, columns unchanged."""
    names = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    found = find_windows(plain, benchmark, f"_{names.index(text)}", n=n)
    return found.where(F.size("hits") <= F.lit(min_share) * F.col("n_words")).drop("n_words", "hits", "items").toDF(*names)

"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are minimizers of word k-mers: of every ``w`` consecutive k-mers the one of least hash.  Equal
seeds meet in a join; each occurrence is matched with the first text of all that holds the seed, so n
copies of a passage give n matches and not n * n.  A task matches the occurrences it reads with its own first
one and sends only that to the others, so a seed of very many texts gives a few rows to its join; the
task's other occurrences then take over the match of its first.
The matches of two texts are chained in order with gap costs, the best predecessor being found through a
Fenwick tree; a chain's gaps and ends are aligned word by word, which carries passages over small edits.
The first text of a seed needn't be the one that holds the passage: where neighbouring seeds of a text have different
first texts, the two together are a seed as well (``LINKED``), and that pair's first text is a partner too; so a
fuzzy copy is found although each of its lines stands in an earlier text.  And where a text's seeds all stand in
other texts and no equal run explains them, its windows of a whole passage's length meet in the same
way, so every exact repeat of that length is found, whatever its parts match.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.llm import _text
from permuta.llm._store import Scratch

#: Words of a seed, k-mers of a minimizer window: exact runs of K + W - 1 words always share a seed.
K, W = 6, 8
#: Most words between neighbouring matches of a chain, cost of a word of gap and of a word of shift.
GAP, GAP_COST, SHIFT_COST = 60, 0.05, 0.4
#: So many anchors whose ends lie within ``GAP`` words are looked through one by one; a tree holds more.
FEW = 16
#: Words around chains that their first alignment sees; where it comes to their end, another sees the whole texts.
AROUND = 32
#: Most texts whose keys go to all tasks, 8 bytes each, to pick the texts a join needs.
PICKED = 500_000
#: Seeds that a task holds before it passes them on.
RUN = 2_000_000
#: Seeds behind a seed that are joined with it, and joined seeds that two texts must share to be aligned for them.
LINKED, LEAST_LINKED = 4, 3
#: Bytes of a batch of stretches that are aligned in lockstep: many pairs share the cost of a step.
LOCKSTEP = 16 << 20
#: Aligning stops after a loss of so many points (match 1, mismatch or gap -1), in a band of so many words.
DROP, BAND = 8, 12


def minimizers(h: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of a text's seeds; the leftmost of equal k-mers in a window."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = _text.shingle_hashes(h, k)
    if len(s) <= w:
        at = np.array([int(s.argmin())])
    else:
        least, at, wide = s, np.arange(len(s)), 1  # of the windows of ``wide`` k-mers
        while wide < w:
            step = min(wide, w - wide)
            at = np.where(least[step:] < least[:-step], at[step:], at[:-step])
            least = np.minimum(least[step:], least[:-step])
            wide += step
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return s[at], at


ROWS = "key long, id long, pos int, src long, src_pos int, many boolean"
MATCHES = "key long, id long, pos int, src long, src_pos int, via boolean, many boolean"


def _with_first(key: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Occurrences beside the first text among them that has their key: key, id, pos, src, src_pos, many.

    Those of the first text have no source; ``many`` tells whether others have it.
    """
    order = np.argsort(key)
    equal = key[order[1:]] == key[order[:-1]]
    again = np.flatnonzero(np.append(equal, False) | np.insert(equal, 0, False))  # only rows of one key are put in order of text and position
    rows = order[again]
    order[again] = rows[np.lexsort((pos[rows], ids[rows], key[rows]))]
    key, ids, pos = key[order], ids[order], pos[order]
    start = np.concatenate([[True], ~equal])
    own = np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))
    src = ids[own]
    first, group = src == ids, np.cumsum(start) - 1
    many = np.bincount(group, weights=~first)[group] > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(ids), pa.array(pos), pa.array(src, mask=first), pa.array(pos[own], mask=first), pa.array(many)], [c.split()[0] for c in ROWS.split(", ")]
    )


def _in_runs(found: Iterator[tuple[np.ndarray, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Keys, text and positions, ``RUN`` occurrences at a time, matched with their first text."""
    held, size = [], 0
    for key, i, at in found:
        if len(key):
            held.append((key.view(np.int64), np.full(len(key), i, np.int64), at.astype(np.int32)))
            size += len(key)
        if size > RUN:
            yield _with_first(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _with_first(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seed occurrences, one row each."""

    def found():
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for row, h in _text.documents(batch, "text"):
                s, at = minimizers(h)
                yield s, ids[row], at
        _text.release()

    return _in_runs(found())


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, inverse = (np.concatenate([[np.uint64(1)], np.full(len(h) - 1, x, np.uint64)]).cumprod() for x in (_text._P, _text._P_INV))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_text.mix(h) * power)])
    return _text.mix((total[n:] - total[:-n]) * inverse[: len(h) - n + 1])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of keys that several texts have beside the first of these, from rows sorted by key, id, pos.

    Rows that a task matched pass (``via``: their source is that task's first text); those of the first
    text of all are their own source.  Only the running first occurrence, and the first text's rows until
    another text is met, are kept from one batch to the next.
    """
    last, known, pending = None, False, []  # key, id and pos of the first occurrence; whether others have the key
    names = [c.split()[0] for c in MATCHES.split(", ")]

    def rows(key, ids, pos, src, src_pos, many):
        return pa.RecordBatch.from_arrays([*map(pa.array, (key, ids, pos, src)), pa.array(src_pos.astype(np.int32)), pa.array(np.zeros(len(ids), bool)), pa.array(many)], names)

    for batch in batches:
        passed = batch.filter(pc.is_valid(batch.column("src")))
        if passed.num_rows:
            yield pa.RecordBatch.from_arrays([*[passed.column(c) for c in names[:5]], pa.array(np.ones(passed.num_rows, bool)), passed.column("many")], names)
        batch = batch.filter(pc.is_null(batch.column("src")))
        if not batch.num_rows:
            continue
        key, ids, pos = (batch.column(c).to_numpy() for c in ("key", "id", "pos"))
        start = np.concatenate([[not (last and last[0] == key[0])], key[1:] != key[:-1]])
        group = np.maximum.accumulate(np.where(start, np.arange(len(key)), -1))
        own = np.maximum(group, 0)
        src = np.where(group >= 0, ids[own], last[1] if last else 0)
        src_pos = np.where(group >= 0, pos[own], last[2] if last else 0)
        last = (key[-1], src[-1], src_pos[-1])
        number = np.cumsum(start)  # 0: the key of the batch before
        many = batch.column("many").to_numpy(zero_copy_only=False)
        shared = np.bincount(number, weights=(src != ids) | many) > 0
        shared[0] |= known
        if shared[0] and pending:
            yield rows(*(np.concatenate(x) for x in zip(*pending, strict=True)))
        if shared[0] or start.any():
            pending = []
        on = shared[number]
        if on.any():
            yield rows(key[on], ids[on], pos[on], src[on], src_pos[on], many[on])
        known = bool(shared[-1])
        if not known:
            on = number == number[-1]
            pending.append((key[on], ids[on], pos[on], src[on], src_pos[on], many[on]))
    _text.release()


def first_matches(found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, pos, src, src_pos): each occurrence of a shared key beside the first one of the first text of all that has it."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A matched row only passes: it goes anywhere, not to the task of its key.
    to = F.when(F.col("src").isNull(), F.col("key")).otherwise(F.xxhash64("id"))
    met = scratch.keep(found.repartition(parts, to).sortWithinPartitions("key", "id", "pos").mapInArrow(_matches, MATCHES), name)
    firsts = met.where("many and not via").groupBy("key", F.col("id").alias("f")).agg(F.min("src").alias("g"), F.min("src_pos").alias("g_pos"))
    via = met.where("via").select("key", "id", "pos", F.col("src").alias("f")).join(firsts, ["key", "f"])
    return met.where("not via").select("id", "pos", "src", "src_pos").unionByName(via.select("id", "pos", F.col("g").alias("src"), F.col("g_pos").alias("src_pos")))


def linked_seeds(pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and positions of pairs of a text's shared seeds, near each other and of sources that no one chain explains.

    A seed is named by its first occurrence of all; pairs of one source on nearly one diagonal are left to its chain.
    """
    order = np.lexsort((src_pos, pos))
    pos, src, src_pos = pos[order], src[order], src_pos[order]
    if not ((src[1:] != src[:-1]) | (np.abs(src_pos[1:] - src_pos[:-1] - pos[1:] + pos[:-1]) > BAND)).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    name = _text.mix(src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _text.mix(src_pos.astype(np.uint64)))
    second = _text.mix(name ^ np.uint64(0xD6E8FEB86659FD93))
    keys, at = [], []
    for d in range(1, min(LINKED, len(pos) - 1) + 1):
        step = pos[d:] - pos[:-d]
        on = ((step > 0) & (step <= GAP) & ((src[d:] != src[:-d]) | (np.abs(src_pos[d:] - src_pos[:-d] - step) > BAND))).nonzero()[0]
        keys.append(name[on] + second[on + d])
        at.append(pos[on])
    return (_text.mix(np.concatenate(keys)), np.concatenate(at)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def runs(pos: np.ndarray, src: np.ndarray, k: int = K, reach: int = K + W) -> list[tuple[int, int, int]]:
    """Matches on one diagonal that touch or nearly touch, as (start, source start, words)."""
    if len(pos) == 1:
        return [(int(pos[0]), int(src[0]), k)]
    order = np.lexsort((pos, pos - src))
    p, d = pos[order], (pos - src)[order]
    cut = np.flatnonzero((d[1:] != d[:-1]) | (p[1:] - p[:-1] > reach))
    lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(p) - 1]])
    return sorted((int(p[a]), int(p[a] - d[a]), int(p[b] - p[a] + k)) for a, b in zip(lo, hi, strict=True))


class MaxTree:
    """Fenwick tree of maxima over places 1..n: a place's value may rise and fall, a range is asked for its largest."""

    def __init__(self, n: int):
        self.n, self.value, self.most = n, [(0.0, -1)] * (n + 1), [(0.0, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        old, most = self.value[i], self.most
        self.value[i] = value
        while i <= self.n:
            if value >= old:
                if most[i] >= value:  # and so are those above
                    return
                best = value
            elif most[i] > old:  # another place's, above as well
                return
            else:
                best, step, low = self.value[i], 1, i & -i
                while step < low:
                    if most[i - step] > best:
                        best = most[i - step]
                    step <<= 1
            most[i] = best
            i += i & -i

    def largest(self, low: int, high: int) -> tuple[float, int]:
        """Of the places low + 1 to high."""
        best = (0.0, -1)
        while high > low:
            if high - (high & -high) >= low:
                best = max(best, self.most[high])
                high -= high & -high
            else:
                best = max(best, self.value[high])
                high -= 1
        return best


def chains(anchors: list[tuple[int, int, int]], gap: int = GAP) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of anchors: each anchor's best predecessor ends before it in both texts, ``gap`` words at most.

    The score of a link is the predecessor's score less the cost of the words between and of the shift.
    A Fenwick tree over the ends in the source holds score plus cost of the end's place, for the anchors
    whose end lies ``gap`` words back at most; its largest value in the source's range is the
    predecessor of least gap cost.  While these anchors are few they are looked through instead.  The last
    anchor on the same diagonal, which has no shift, is asked as well.
    """
    if len(anchors) == 1:
        return [list(anchors)]
    order = sorted(range(len(anchors)), key=lambda i: anchors[i][0])
    closing = sorted(range(len(anchors)), key=lambda i: anchors[i][0] + anchors[i][2])
    closed = [anchors[i][0] + anchors[i][2] for i in closing]
    few = all(x > closed[i] + gap for i, x in enumerate(closed[FEW:]))  # no more than FEW ends within gap words
    if not few:
        ends = sorted((s + n, i) for i, (_, s, n) in enumerate(anchors))
        place = {i: at + 1 for at, (_, i) in enumerate(ends)}
        tree = MaxTree(len(anchors))
    near_, diagonal = [], {}  # end in the source and value of the anchors closed so far
    score, before, low, c = [0.0] * len(anchors), [-1] * len(anchors), 0, 0
    for i in order:
        p, s, n = anchors[i]
        while c < len(closing) and closed[c] <= p:
            j = closing[c]
            q, t, m = anchors[j]
            value = (score[j] + GAP_COST * (q + t + 2 * m), j)
            if few:
                near_.append((t + m, value))
            else:
                tree.put(place[j], value)
            diagonal[q - t] = j
            c += 1
        while low < c and closed[low] < p - gap:
            if not few:
                tree.put(place[closing[low]], (0.0, -1))
            low += 1
        if few:
            largest = max((value for end, value in near_[low:c] if s - gap <= end <= s), default=(0.0, -1))
        else:
            largest = tree.largest(bisect_left(ends, (s - gap, -1)), bisect_left(ends, (s + 1, -1)))
        asked = (largest[1], diagonal.get(p - s, -1))
        best = 0.0
        for j in asked:
            if j < 0:
                continue
            q, t, m = anchors[j]
            a, b = p - q - m, s - t - m
            if a <= gap and 0 <= b <= gap:
                linked = score[j] - GAP_COST * (a + b) - SHIFT_COST * min(abs(a - b), 20)
                if linked > best:
                    best, before[i] = linked, j
        score[i] = n + best
    used, out = [False] * len(anchors), []
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(anchors[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def near(found: list[list[tuple[int, int, int]]]) -> list[list[list[tuple[int, int, int]]]]:
    """Chains of two texts in groups: a group's stretch of either text is hardly longer than its chains with what is around them."""
    if len(found) == 1:
        return [found]
    out, span, size = [], None, 0
    for c in sorted(found, key=lambda c: c[0]):
        own = (c[0][0], c[-1][0] + c[-1][2], c[0][1], c[-1][1] + c[-1][2])
        joined = span and (min(span[0], own[0]), max(span[1], own[1]), min(span[2], own[2]), max(span[3], own[3]))
        length = own[1] - own[0] + 2 * AROUND
        if joined and max(joined[1] - joined[0], joined[3] - joined[2]) <= size + length:
            out[-1].append(c)
            span, size = joined, size + length
        else:
            out.append([c])
            span, size = own, length
    return out


def equal_runs(x: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, step: int) -> np.ndarray:
    """Words that the texts at ``a`` and ``b`` of ``x`` share from there on, in direction ``step``, in lockstep."""
    n, most, on, wide = np.zeros(len(a), np.int64), np.minimum(na, nb), np.arange(len(a)), 16
    on = on[most > 0]
    while len(on):
        i = n[on][:, None] + np.arange(wide)
        inside = i < most[on][:, None]
        i = np.where(inside, i, 0)
        same = inside & (x[a[on][:, None] + step * i] == x[b[on][:, None] + step * i])
        run = np.where(same.all(1), wide, same.argmin(1))
        n[on] += run
        on = on[run == wide]
        wide = min(2 * wide, 1024) if len(on) < 1000 else 16
    return n


_POINT = 1 << 24  # a point of the score; matches are counted below it
_AHEAD = 16  # rows whose words are taken at once


def extend(x: np.ndarray, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of both texts that their best common start takes, and its matches, for many pairs of places in lockstep.

    Banded alignments, row by row of the first text; one ends after a loss of ``DROP`` points.
    """
    took, src_took, same = (np.zeros(len(a), np.int64) for _ in range(3))
    shift = np.arange(-BAND, BAND + 1)
    slope = shift * _POINT  # scores of a row are kept with the cost of their shift added: moves along the row are free
    low = -(1 << 50)
    on = np.flatnonzero((na > 0) & (nb > 0))
    n, m = na[on], nb[on]
    row = np.where((shift >= 0) & (shift <= m[:, None]), 0, low)
    best = np.zeros(len(on), np.int64)
    i = 0
    while len(on):
        ahead = i % _AHEAD
        if not ahead:  # the words of the next rows
            x_a = x[a[on][:, None] + step * np.minimum(i + np.arange(_AHEAD), n[:, None] - 1)]
            x_b = x[b[on][:, None] + step * np.clip(i + np.arange(-BAND, BAND + _AHEAD), 0, m[:, None] - 1)]
        i += 1
        match = x_a[:, ahead, None] == x_b[:, ahead : ahead + len(shift)]
        new = row + np.where(match, _POINT + 1, -_POINT)
        np.maximum(new[:, :-1], row[:, 1:] - 2 * _POINT, out=new[:, :-1])
        np.maximum.accumulate(new, 1, out=new)
        if (m < i + BAND).any():
            new[shift > (m - i)[:, None]] = low
        score = new - slope
        k = score.argmax(1)
        top = score[np.arange(len(on)), k]
        least = best - DROP * _POINT
        up = top > best
        which = on[up]
        took[which], src_took[which], same[which] = i, i + shift[k[up]], top[up] % _POINT
        row = np.where(score >= least[:, None], new, low)
        best = np.where(up, top, best)
        live = (top >= least) & (i < n)
        if not live.all():
            on, n, m, row, best, x_a, x_b = (v[live] for v in (on, n, m, row, best, x_a, x_b))
    return took, src_took, same


def align(x: np.ndarray, chain: np.ndarray, of: np.ndarray, first: np.ndarray, src_first: np.ndarray, n: np.ndarray, src_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages and equal runs of chains: start, end, source start and end, matches, for each chain and each anchor.

    ``chain`` has an anchor (start, source start, words) in a row, ``of`` its chain's number from 0 in
    order; of each chain ``first`` and ``src_first`` are the places of its texts in ``x``, ``n`` and
    ``src_n`` their words.  The two ends run as far as the texts agree.
    """
    p, s, m = chain.T.astype(np.int64)
    fa, fb, na, nb = first[of], src_first[of], n[of], src_n[of]
    left = equal_runs(x, fa + p - 1, p, fb + s - 1, s, -1)
    right = equal_runs(x, fa + p, na - p, fb + s, nb - s, 1)
    runs_ = np.stack([p - left, p + right, s - left, s + right, left + right], 1)
    head = np.concatenate([[True], of[1:] != of[:-1]])
    tail = np.concatenate([of[1:] != of[:-1], [True]])
    # Ends, beyond the equal words.
    pa_, sa = (p - left)[head], (s - left)[head]
    u, v, w = extend(x, first + pa_ - 1, pa_, src_first + sa - 1, sa, -1)
    q, t = (p + np.maximum(right, m))[tail], (s + np.maximum(right, m))[tail]
    u2, v2, w2 = extend(x, first + q, n - q, src_first + t, src_n - t, 1)
    same = w + w2 + left[head] + np.maximum(right, m)[tail]
    inner = np.flatnonzero(~tail)  # anchors with another behind them: their words and the gap
    if len(inner):
        e, d = (p + m)[inner], (s + m)[inner]
        ga, gb = p[inner + 1] - e, s[inner + 1] - d
        fa, fb = fa[inner], fb[inner]
        y, z, c = extend(x, fa + e, ga, fb + d, gb, 1)
        _, _, c2 = extend(x, fa + e + ga - 1, ga - y, fb + d + gb - 1, gb - z, -1)
        np.add.at(same, of[inner], m[inner] + c + c2)
    return np.stack([pa_ - u, q + u2, sa - v, t + v2, same], 1), runs_


PASSAGE = "doc_id long, src_doc_id long, start long, end long, src_start long, src_end long, n_words long, n_same long, score double"


def cover(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The fewest spans (start, end, ...) that have all words of all of them."""
    out, end, best = [], -1, None
    for span in sorted(set(spans), key=lambda r: (r[0], -r[1], r)):
        if best is not None and span[0] > end:
            out.append(best)
            end, best = best[1], None
        if span[1] > end and (span[0] > end or best is None or span[1] > best[1]):
            if span[0] > end:
                end = span[0]
            best = span if best is None or span[1] > best[1] else best
    return out + ([best] if best is not None else [])


def _inside(spans: np.ndarray, found: list) -> np.ndarray:
    """Whether each span (start, end) lies in one of the spans found, which may overlap."""
    if not len(found) or not len(spans):
        return np.zeros(len(spans), bool)
    f = np.array(sorted(found))
    i = np.searchsorted(f[:, 0], spans[:, 0], "right") - 1
    return (i >= 0) & (np.maximum.accumulate(f[:, 1])[np.maximum(i, 0)] >= spans[:, 1])


def find_passages(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", min_words: int = 50, min_share: float = 0.75) -> DataFrame:
    """Passages that texts share: doc_id, src_doc_id, start, end, src_start, src_end, n_words, n_same, score.

    A passage of at least ``min_words`` words (positions count ``[^\\x20\\x09-\\x0D]+`` words, A-Z folded,
    ``end`` excluded) of which at least ``min_share`` match in order a passage of the text ``src_doc_id``,
    a smaller key: the first of all texts that holds a seed of it, two joined seeds or a window of ``min_words`` of it, so
    the result depends on the table alone.  Every exact repeat of ``min_words`` words is covered; a fuzzy one is
    found if the first text of one of its seeds, or of ``LEAST_LINKED`` of its joined ones, is its partner.  Its seeds are chained over gaps of ``GAP`` words at
    most, and an alignment ends where it loses ``DROP`` points or leaves a band of ``BAND`` words: parts beyond
    that are passages of their own, and of those that a text shares with one other the
    fewest are given that have all words of all.  Repeats inside one text and rows of null key or text
    are left out; of rows that share a key the one with the greatest text counts.  Short and empty texts
    and an empty table give no rows.
    """
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    met = first_matches(d.mapInArrow(_seeds, ROWS), scratch, "seeds")
    met = met.groupBy("id").agg(F.collect_list(F.struct("pos", "src", "src_pos")).alias("m"))
    kind = "id long, src long, chains binary"
    linked = np.int64(-(2**63))  # in place of a source: joined seeds

    def chain_up(batches):
        for batch in batches:
            ids, srcs, out = [], [], []

            def add(i, src, rows):
                ids.append(i)
                srcs.append(src)
                out.append(rows.astype(np.int32).tobytes())

            column = batch.column("m")
            values, ends = column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            every = [values.field(f).to_numpy().astype(np.int64) for f in ("pos", "src", "src_pos")]
            for i, low, high in zip(batch.column("id").to_pylist(), ends[:-1], ends[1:], strict=True):
                pos, src, src_pos = (x[low:high] for x in every)
                # In a window that other texts have, all seeds are shared: so many, so close together.  Where they stand once in
                # this text and in none before it, the others find them here.
                p = np.sort(pos)
                p = p[np.concatenate([[True], p[1:] != p[:-1]])]
                first = src == i
                if first.any():
                    times = np.bincount(src_pos[first], minlength=p[-1] + 1)
                    times[pos[~first]] = 0
                    known = times[p] == 1
                else:
                    known = np.zeros(len(p), bool)
                cut = (p[1:] - p[:-1] > W).nonzero()[0]
                lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(p) - 1]])
                areas = []
                for x, y in zip(lo, hi, strict=True):
                    if p[y] - p[x] >= min_words - K - 2 * (W - 1):
                        b = p[x : y + 1][~known[x : y + 1]]  # seeds that a window must hold
                        gaps = np.flatnonzero(np.diff(b) > min_words)
                        for u, v in zip(np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b) - 1]]), strict=True) if len(b) else ():
                            areas.append((max(p[x] - W + 1, b[u] - min_words + K, 0), min(p[y] + K + W - 1, b[v] + min_words)))
                if areas:
                    add(i, None, np.array(areas))
                keys, at = linked_seeds(pos, src, src_pos)
                if len(keys):
                    ids.append(i)
                    srcs.append(linked)
                    out.append(np.stack([keys.view(np.int64), at]).tobytes())
                pos, src, src_pos = (x[~first] for x in (pos, src, src_pos))
                if not len(pos):
                    continue
                order = np.lexsort((pos, src))
                pos, src, src_pos = pos[order], src[order], src_pos[order]
                cut = [0, *((src[1:] != src[:-1]).nonzero()[0] + 1).tolist(), len(src)]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    for group in near(chains(runs(pos[x:y], src_pos[x:y]))):
                        add(i, int(src[x]), np.array([(n, *a) for n, c in enumerate(group) for a in c]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(srcs, pa.int64()), pa.array(out, pa.binary())], ["id", "src", "chains"])
        _text.release()

    chained = scratch.keep(met.mapInArrow(chain_up, kind), "chains")
    scratch.drop("seeds")
    areas, joined, chained = chained.where("src is null"), chained.where(F.col("src") == int(linked)), chained.where(F.col("src") != int(linked))

    def joined_seeds(batches):
        def occurrences():
            for batch in batches:
                for i, raw in zip(batch.column("id").to_pylist(), batch.column("chains").to_pylist(), strict=True):
                    keys, at = np.frombuffer(raw, np.int64).reshape(2, -1)
                    yield keys.view(np.uint64), i, at

        return _in_runs(occurrences())

    def chain_linked(batches):
        for batch in batches:
            ids, srcs, out = [], [], []
            for i, src, m in zip(batch.column("id").to_pylist(), batch.column("src").to_pylist(), batch.column("m"), strict=True):
                at = np.unique(np.stack([m.values.field(f).to_numpy().astype(np.int64) for f in ("pos", "src_pos")]), axis=1)
                for group in near(chains(runs(*at))):
                    ids.append(i)
                    srcs.append(src)
                    out.append(np.array([(n, *a) for n, c in enumerate(group) for a in c], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(srcs, pa.int64()), pa.array(out, pa.binary())], ["id", "src", "chains"])
        _text.release()

    # Partners by joined seeds, where the seeds alone led to others.
    pairs = first_matches(joined.mapInArrow(joined_seeds, ROWS), scratch, "linked").where("src <> id")
    pairs = pairs.groupBy("id", "src").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m")).where(F.size("m") >= LEAST_LINKED)
    pairs = pairs.join(chained.select("id", "src").distinct(), ["id", "src"], "left_anti").select("id", "src", "m")
    extra = scratch.keep(pairs.mapInArrow(chain_linked, kind), "linked_chains")
    scratch.drop("linked")
    chained = chained.unionByName(extra)

    def hashed(batches):
        for batch in batches:
            raw = [(h >> np.uint64(32)).astype(np.uint32).tobytes() for _, h in _text.documents(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "h"])

    wanted = areas.select("id").unionByName(chained.select("id")).unionByName(chained.select(F.col("src").alias("id"))).distinct()
    texts = d.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text"))
    texts = scratch.keep(texts.mapInArrow(hashed, "id long, h binary"), "texts")
    found = scratch.keep(_aligned(chained, texts, min_words, min_share, scratch, "aligned"), "aligned", LOCKSTEP)
    scratch.drop("aligned_near")

    # Windows that no equal run explains.
    runs_ = found.where("equal_run").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    left = areas.select("id", F.col("chains").alias("areas")).join(runs_, "id", "left")

    def unexplained(batches):
        for batch in batches:
            ids, out = [], []
            for i, a, r in zip(*[batch.column(x).to_pylist() for x in ("id", "areas", "runs")], strict=True):
                at = np.unique(np.concatenate([np.arange(x, max(x, y - min_words + 1)) for x, y in np.frombuffer(a, np.int32).reshape(-1, 2).tolist()]))
                at = at[~_inside(np.stack([at, at + min_words], 1), [(x["start"], x["end"]) for x in r or ()])]
                if len(at):
                    ids.append(i)
                    out.append(at.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "at"])

    left = scratch.keep(left.mapInArrow(unexplained, "id long, at binary"), "unexplained")
    left = left.join(_picked(texts, left.select("id")), "id")

    def windows(batches):
        def occurrences():
            for batch in batches:
                for i, h, at in zip(*[batch.column(x).to_pylist() for x in ("id", "h", "at")], strict=True):
                    at = np.frombuffer(at, np.int32)
                    s = window_hashes(np.frombuffer(h, np.uint32).astype(np.uint64), min_words)
                    at = at[at < len(s)]
                    yield s[at], i, at

        return _in_runs(occurrences())

    def join_windows(batches):
        for batch in batches:
            out = []
            for m in batch.column("m"):
                pos, src = (m.values.field(f).to_numpy().astype(np.int64) for f in ("pos", "src_pos"))
                out.append(np.array([(n, *a) for n, a in enumerate(runs(pos, src, min_words, 1))], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("src"), pa.array(out, pa.binary())], ["id", "src", "chains"])

    whole = first_matches(left.mapInArrow(windows, ROWS), scratch, "windows").where("src <> id")
    whole = whole.groupBy("id", "src").agg(F.collect_list(F.struct("pos", "src_pos")).alias("m")).mapInArrow(join_windows, kind)
    whole = scratch.keep(whole, "whole")
    texts = _picked(texts, whole.select("id").unionByName(whole.select(F.col("src").alias("id"))))
    more = _aligned(whole, texts, min_words, min_share, scratch, "whole")
    return found.unionByName(more).drop("equal_run").where("n_words > 0").distinct()


def _aligned(pairs: DataFrame, texts: DataFrame, min_words: int, min_share: float, scratch: Scratch, name: str) -> DataFrame:
    """Passages of pairs (id, src, chains), and with ``equal_run`` their equal runs of ``min_words`` (these are passages as well).

    The stretches around a row's chains are aligned first and sent alone; where an alignment comes to the end of
    one within its text, the row's whole texts are.
    """
    first = scratch.keep(_alignments(pairs, texts, min_words, min_share, AROUND), f"{name}_near", LOCKSTEP)
    again = _alignments(first.where("open is not null").select(F.col("doc_id").alias("id"), F.col("src_doc_id").alias("src"), F.col("open").alias("chains")), texts, min_words, min_share, None)
    return first.where("open is null").unionByName(again).drop("open")


def _picked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Of ``texts`` those that ``keys`` names, before anything is shuffled where the keys are few enough to be sent to all tasks."""
    keys = keys.distinct()
    few = keys.limit(PICKED + 1).count() <= PICKED
    return texts.join(F.broadcast(keys) if few else keys, "id", "left_semi")


def _alignments(pairs: DataFrame, texts: DataFrame, min_words: int, min_share: float, around: int | None) -> DataFrame:
    """Passages of pairs, equal runs, and the chains whose alignment is ``open``: it would see more than the stretches.

    The pairs of a source of many are dealt to several tasks, each with a copy of its text.
    """

    def stretches(batches):
        for batch in batches:
            rows = [np.frombuffer(c, np.int32).reshape(-1, 4) for c in batch.column("chains").to_pylist()]
            at = [np.maximum(0, np.array([(c[:, 1].min(), c[:, 2].min()) for c in rows]).reshape(-1, 2) - around), np.array([((c[:, 1] + c[:, 3]).max(), (c[:, 2] + c[:, 3]).max()) for c in rows]).reshape(-1, 2) + around]
            cols = [pa.array(x.astype(np.int32)) for x in (at[0][:, 0], at[1][:, 0], at[0][:, 1], at[1][:, 1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], ["id", "src", "chains", "a0", "a1", "b0", "b1"])

    pairs = pairs.select("id", "src", "chains")
    if around is None:
        pairs = pairs.select("*", *[F.lit(x).alias(c) for c, x in (("a0", 0), ("a1", (1 << 29) - 1), ("b0", 0), ("b1", (1 << 29) - 1))])
    else:
        pairs = pairs.mapInArrow(stretches, "id long, src long, chains binary, a0 int, a1 int, b0 int, b1 int")
    part = lambda h, a, b: F.expr(f"substring({h}, {a} * 4 + 1, ({b} - {a}) * 4)")
    size = lambda h: (F.octet_length(h) / 4).cast("int")
    if around is None:
        texts = _picked(texts, pairs.select("id").unionByName(pairs.select(F.col("src").alias("id"))))
    degree = pairs.groupBy("src").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
    dealt = pairs.join(degree, "src").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    dealt = dealt.join(texts, "id").withColumn("ha", part("h", "a0", "a1")).withColumn("na", size("h")).drop("h")
    source = texts.withColumnRenamed("id", "src").join(degree, "src").select("src", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("h"))
    both = dealt.join(source, ["src", "salt"]).withColumn("hb", part("h", "b0", "b1")).withColumn("nb", size("h")).drop("h")

    def run(batches):
        names = [c.split()[0] for c in f"{PASSAGE}, equal_run boolean, open binary".split(", ")]
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, at = _text.flat(batch.column("chains"))
            of_row = np.repeat(np.arange(batch.num_rows), np.diff(at) // 16)
            i, s, a0, b0, whole_a, whole_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "src", "a0", "b0", "na", "nb"))
            c = raw.view(np.int32).reshape(-1, 4) - np.stack([np.zeros_like(a0), a0, b0, np.zeros_like(a0)], 1)[of_row]
            new = np.concatenate([[True], (of_row[1:] != of_row[:-1]) | (c[1:, 0] != c[:-1, 0])])
            of, row = np.cumsum(new) - 1, of_row[new]
            (ha, at_a), (hb, at_b) = (_text.flat(batch.column(x)) for x in ("ha", "hb"))
            na, nb = np.diff(at_a) // 4, np.diff(at_b) // 4
            x = np.concatenate([ha.view(np.uint32), hb.view(np.uint32)])
            spans, runs_ = align(x, c[:, 1:], of, at_a[row] // 4, (len(ha) + at_b[row]) // 4, na[row], nb[row])
            na, nb, a0, b0, whole_a, whole_b = (v[row] for v in (na, nb, a0, b0, whole_a, whole_b))
            # A stretch's end that isn't its text's, reached by an alignment or nearly so.
            x = spans[:, :4] + DROP * np.array([-1, 1, -1, 1])
            stopped = (x[:, 0] <= 0) & (a0 > 0) | (x[:, 2] <= 0) & (b0 > 0) | (x[:, 1] >= na) & (a0 + na < whole_a) | (x[:, 3] >= nb) & (b0 + nb < whole_b)
            stopped = np.isin(row, row[stopped])
            spans[:, :4] += np.stack([a0, a0, b0, b0], 1)
            runs_[:, :4] += np.stack([a0, a0, b0, b0], 1)[of]
            keys = list(zip(i[row].tolist(), s[row].tolist(), strict=True))
            good = ~stopped & (spans[:, 1] - spans[:, 0] >= min_words) & (spans[:, 4] >= min_share * (spans[:, 1] - spans[:, 0]))
            long_ = (runs_[:, 4] >= min_words) & ~stopped[of]
            of_pair: dict[tuple, list] = {}
            for which, rows in ((np.flatnonzero(good), spans[good]), (of[long_], runs_[long_])):
                for c, r in zip(which.tolist(), rows.tolist(), strict=True):
                    of_pair.setdefault(keys[c], []).append(tuple(r))
            out = [(*pair, a, b, x, y, b - a, m, m / max(b - a, y - x), False, None) for pair, rows in of_pair.items() for a, b, x, y, m in cover(rows)]
            explained = {(*keys[c], *r) for c, r in zip(of[long_].tolist(), runs_[long_].tolist(), strict=True)}
            out += [(*r[:6], 0, r[6], 1.0, True, None) for r in sorted(explained)]
            raw = batch.column("chains")
            out += [(*keys[c], 0, 0, 0, 0, 0, 0, 0.0, False, raw[int(row[c])].as_py()) for c in np.flatnonzero(stopped & np.append(True, row[1:] != row[:-1])).tolist()]
            cols = list(zip(*out, strict=True)) if out else [()] * 11
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:8]], pa.array(cols[8], pa.float64()), pa.array(cols[9], pa.bool_()), pa.array(cols[10], pa.binary())], names)
        _text.release()

    return both.select("id", "src", "chains", "ha", "hb", "a0", "b0", "na", "nb").mapInArrow(run, f"{PASSAGE}, equal_run boolean, open binary")


def cut_passages(docs: DataFrame, passages: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the words of the passages that repeat an earlier text, columns unchanged.

    The remaining words are joined by single spaces; a text without passages stays as it is, as does a null text
    or a row of a null key.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, words = F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}")
    spans = passages.groupBy(F.col("doc_id").alias("repeating")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = plain.join(spans, own == F.col("repeating"), "left")
    split = F.regexp_extract_all(words, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    inside = lambda i: F.exists("spans", lambda s: (s["start"] <= i) & (i < s["end"]))
    kept = F.array_join(F.filter(split, lambda w, i: ~inside(i)), " ")
    out = [F.when(F.col("spans").isNull(), words).otherwise(kept) if c == text else F.col(f"c{i}") for i, c in enumerate(names)]
    return joined.select(*out).toDF(*names)

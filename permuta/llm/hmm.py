"""LM scoring with a hidden Markov model over word classes.

Vocabulary: every word of the training texts, counted over all of them.  The most frequent words are
classes of their own; any other word belongs to the class of its last two bytes.  States emit classes
and a class emits its words by their counts, so the model covers an open vocabulary with parameters
of a fixed size.  Baum-Welch runs over all training texts, whole: tasks compute expected counts with a
scaled forward-backward pass, and the sums over partitions give the next parameters.  Scores are exact: the
scaled forward recursion over the whole text plus the words' probabilities within their classes.
Words are known by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permuta.llm import _text
from permuta.llm._store import Scratch, arrow_rows

#: States, words with a class of their own, classes of the other words, words whose counts all tasks hold.
STATES, OWN, SHARED, HELD = 8, 4096, 256, 1 << 16
#: Words of a long text that run in one row of the lockstep, words of all rows in training, Baum-Welch steps.
PIECE, WORDS, STEPS = 512, 150_000, 5
#: The end of a text is a word of this hash.
END = np.uint64(0xE17A3B5D9C0F4261)
#: Distinct words a task counts before it passes them on.
FLUSH = 400_000


def _words(batch: pa.RecordBatch):
    """Word hashes, word ends (last two bytes as a class number) and word ranges of runs of texts."""
    for a, b, data, off in _text.chunks(*_text.flat(batch.column("text"))):
        starts, at = _text.words(data, off, _text.NOT_SPACE)
        h = _text.word_hashes(data, starts, _text.NOT_SPACE)
        if len(starts):
            size = np.add.reduceat(_text.NOT_SPACE[data].astype(np.int64), starts)
            last = _text.FOLD[data[starts + size - 1]].astype(np.uint64)
            prior = np.where(size > 1, _text.FOLD[data[starts + np.maximum(size - 2, 0)]], 0).astype(np.uint64)
            tail = (_text.mix(last * np.uint64(257) + prior) % np.uint64(SHARED)).astype(np.int64)
        else:
            tail = np.zeros(0, np.int64)
        yield a, b, h, tail, at


def count_words(texts: DataFrame) -> DataFrame:
    """(word, tail, c): occurrences of each word and of the end in all texts; ``tail`` is -1 for the end."""

    def run(batches):
        held, size, ends = [], 0, 0

        def counted():
            h, first, c = np.unique(np.concatenate([x for x, _, _ in held]), return_index=True, return_inverse=True)
            n = np.bincount(c, np.concatenate([x for _, _, x in held]), len(h)).astype(np.int64)
            return h, np.concatenate([x for _, x, _ in held])[first], n

        def rows(h, tail, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], ["word", "tail", "c"])

        for batch in batches:
            ends += batch.num_rows
            for _, _, h, tail, _ in _words(batch):
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                held.append((u, tail[first], n))
                size += len(u)
                if size > FLUSH:
                    held = [counted()]
                    size = len(held[0][0])
                    if size > FLUSH // 2:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*counted())
        if ends:
            yield rows(np.array([END]), np.array([-1]), np.array([ends], np.int64))

    return texts.mapInArrow(run, "word long, tail int, c long").groupBy("word").agg(F.min("tail").alias("tail"), F.sum("c").alias("c"))


def _most(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, tails and counts of the most frequent words, by descending count: whole counts only, ``limit`` at most."""
    cell = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 32))
    total, least = 0, None
    for r in counts.groupBy(cell.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        if total + r["n"] > limit:
            break
        total, least = total + r["n"], r["s"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(cell >= least).orderBy(F.desc("c"), "word").toPandas()
    return got["word"].to_numpy(np.int64).view(np.uint64), got["tail"].to_numpy(np.int64), got["c"].to_numpy(np.int64)


@dataclass
class Vocabulary:
    """Frequent words in order of their hashes with count and class; totals of the words and of the shared classes."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    words: int
    distinct: int
    class_words: np.ndarray
    class_distinct: np.ndarray
    #: Words counted more often than this are all held; None: no word but the end need be.
    least: int | None = None

    @property
    def n_classes(self) -> int:
        return OWN + SHARED

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is held, and its place."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return self.keys[i] == h, i


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of all counts: what every task needs, of a fixed size."""
    h, tail, c = _most(counts, HELD)
    least = int(c.min()) if len(c) else None
    end = counts.where(F.col("word") == int(END.view(np.int64))).first()
    if end and END not in h:  # held however rare it is
        h, tail, c = np.append(h, END), np.append(tail, -1), np.append(c, end["c"])
    own = np.arange(len(h)) < OWN - 1
    own |= h == END
    classes = np.where(own, np.cumsum(own) - 1, OWN + tail)
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    class_words, class_distinct = np.zeros(SHARED, np.int64), np.zeros(SHARED, np.int64)
    for r in counts.where("tail >= 0").groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        class_words[r["tail"]], class_distinct[r["tail"]] = r["n"], r["v"]
    for t, n in zip(tail[own], c[own], strict=True):
        if t >= 0:
            class_words[t] -= n
            class_distinct[t] -= 1
    order = np.argsort(h)
    return Vocabulary(h[order], c[order], classes[order], int(total["n"] or 0), int(total["v"]), class_words, class_distinct, least)


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, id, held_out, ids, known, base, inner, rare): texts as classes, and the words not held.

    ``base`` sums log10 of count plus one over the held words.  ``inner`` sums the logarithms of words'
    probabilities within a shared class; of the words not held, whose hashes are in ``rare``, it has
    the denominator only.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        v = held.value
        count_log = np.log10(v.counts + 1.0)
        shared = v.classes >= OWN
        slot = np.where(shared, v.classes - OWN, 0)
        below = np.log10(v.class_words + v.class_distinct + 1.0)
        inner_log = np.where(shared, count_log - below[slot], 0.0)
        end_known, end_at = v.find(np.array([END]))
        for batch in batches:
            ids, known, base, inner, rare = [], [], [], [], []
            for a, b, h, tail, at in _words(batch):
                on, i = v.find(h)
                cls = np.where(on, v.classes[i] if len(v.keys) else 0, OWN + tail).astype(np.uint16)
                if len(v.keys):
                    logs = np.where(on, count_log[i], 0.0), np.where(on, inner_log[i], -below[tail])
                else:
                    logs = np.zeros(len(h)), -below[tail]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in logs]
                seen = np.concatenate([[0], np.cumsum(on)])
                for k in range(b - a):
                    lo, hi = at[k], at[k + 1]
                    end = v.classes[end_at[0]] if end_known[0] else OWN
                    ids.append(np.append(cls[lo:hi], np.uint16(end)).tobytes())
                    known.append(int(seen[hi] - seen[lo]) + int(end_known[0]))
                    base.append(float(sums[0][hi] - sums[0][lo]) + (float(count_log[end_at[0]]) if end_known[0] else 0.0))
                    inner.append(float(sums[1][hi] - sums[1][lo]))
                    rare.append(h[lo:hi][~on[lo:hi]].view(np.int64))
            sizes = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("row", "id", "held_out")], pa.array(ids, pa.binary()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(inner, pa.float64()), words],
                ["row", "id", "held_out", "ids", "known", "base", "inner", "rare"],
            )

    kinds = "row long, id long, held_out boolean, ids binary, known long, base double, inner double, rare array<long>"
    return docs.mapInArrow(run, kinds)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


def _by_step(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces laid out step by step, longest first: their order, the classes, where each step starts, pieces that reach it."""
    n = np.array([len(p) for p in pieces])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    flat = np.concatenate([pieces[i] for i in order])
    at = np.cumsum(n) - n
    live = np.searchsorted(-n, -np.arange(n[0]), "left")
    begin = np.cumsum(live) - live
    step = np.repeat(np.arange(n[0]), live)
    return order, flat[at[np.arange(len(flat)) - begin[step]] + step].astype(np.int64), begin, live


def _transfers(model: Model, pieces: list[np.ndarray]) -> np.ndarray:
    """For each piece the matrix that takes the state before its first word is seen to the one after its last (a scale aside)."""
    order, x, begin, live = _by_step(pieces)
    k = len(model.start)
    out = np.empty((len(pieces), k, k))
    r = np.eye(k) * model.emit[x[: live[0]]][:, None, :]
    for t in range(1, len(live)):
        m = live[t]
        if m < len(r):
            out[order[m : len(r)]] = r[m:]
            r = r[:m]
        r = (r.reshape(-1, k) @ model.move).reshape(m, k, k) * model.emit[x[begin[t] : begin[t] + m]][:, None, :]
        r /= r.sum((1, 2))[:, None, None]
    out[order[: len(r)]] = r
    return out


def _forward_backward(model: Model, pieces: list[np.ndarray], before: np.ndarray, after: np.ndarray):
    """Expected moves (without the factor ``move``) and emissions inside pieces; of each piece the expected first
    state, the last state by the words up to it, and the weight of the first state in the step to it.

    ``before`` is the distribution of a piece's first state by the words of the pieces before, ``after``
    weighs its last state by the words of those behind it.
    """
    order, x, begin, live = _by_step(pieces)
    before, after = before[order], after[order]
    k = len(model.start)
    e = model.emit[x]
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((len(e), 1))
    for t, m in enumerate(live):
        now = slice(begin[t], begin[t] + m)
        a = (before if t == 0 else alpha[begin[t - 1] : begin[t - 1] + m] @ model.move) * e[now]
        scale[now] = a.sum(1, keepdims=True)
        alpha[now] = a / scale[now]
    moves, last = np.zeros((k, k)), np.empty((len(pieces), k))
    for t in range(len(live) - 1, -1, -1):
        on, m = live[t + 1] if t + 1 < len(live) else 0, live[t]
        if on < m:  # pieces that end here
            ends = slice(begin[t] + on, begin[t] + m)
            last[on:m] = alpha[ends]
            beta[ends] = after[on:m] / (alpha[ends] * after[on:m]).sum(1, keepdims=True)
        if on:
            then = slice(begin[t + 1], begin[t + 1] + on)
            weighted = e[then] * beta[then] / scale[then]
            moves += alpha[begin[t] : begin[t] + on].T @ weighted
            beta[begin[t] : begin[t] + on] = weighted @ model.move.T
    first = np.arange(len(pieces))
    enter = e[first] * beta[first] / scale[first]
    alpha *= beta
    emissions = np.column_stack([np.bincount(x, alpha[:, z], len(model.emit)) for z in range(k)])
    back = np.argsort(order)
    return moves, emissions, alpha[first][back], last[back], enter[back]


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions of whole texts (class sequences), by scaled forward-backward.

    A text longer than ``PIECE`` is worked on in pieces, as many as ``WORDS`` allows at once, which
    bounds the memory.  The pieces' transfer matrices first give the state before each piece by all
    words ahead of it and its weight by all words behind, so the counts are those of the uncut text,
    moves across the cuts included.
    """
    texts = [t for t in texts if len(t)]
    k = len(model.start)
    moves, emissions = np.zeros((k, k)), np.zeros((len(model.emit), k))
    if not texts:
        return np.zeros(k), moves, emissions
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    goes_on = np.concatenate([np.arange(0, len(t), PIECE) > 0 for t in texts])
    cut = np.append(goes_on[1:], False)

    def blocks(which: np.ndarray):
        size = np.cumsum([len(pieces[i]) for i in which])
        return np.split(which, np.flatnonzero(np.diff(size // WORDS)) + 1) if len(which) else []

    before, after = np.repeat(model.start[None, :], len(pieces), 0), np.ones((len(pieces), k))
    of_long = np.flatnonzero(goes_on | cut)
    turn = {}
    for block in blocks(of_long):
        turn.update(zip(block.tolist(), _transfers(model, [pieces[i] for i in block]), strict=True))
    for i in np.flatnonzero(goes_on).tolist():
        a = before[i - 1] @ turn[i - 1]
        before[i] = a / a.sum() @ model.move
    for i in np.flatnonzero(cut)[::-1].tolist():
        b = model.move @ (turn[i + 1] @ after[i + 1])
        after[i] = b / b.sum()

    first, last, enter = np.empty_like(before), np.empty_like(before), np.empty_like(before)
    for block in blocks(np.arange(len(pieces))):
        m, e, first[block], last[block], enter[block] = _forward_backward(model, [pieces[i] for i in block], before[block], after[block])
        moves += m
        emissions += e
    moves += last[cut].T @ enter[goes_on]
    return first[~goes_on].sum(0), moves * model.move, emissions


def _first_model(encoded: DataFrame, vocab: Vocabulary) -> Model:
    """States lean to the classes of one training text each, the texts being those of smallest hash."""
    counts = np.full(vocab.n_classes, 0.5)
    own = vocab.classes < OWN
    counts[vocab.classes[own]] += vocab.counts[own]
    counts[OWN:] += vocab.class_words
    emit = np.repeat((counts / counts.sum())[:, None], STATES, 1)
    # Chosen by what the texts hold, so that the layout of the table doesn't matter; of a long one a stretch, by hash as well.
    h = F.xxhash64("ids")
    start = F.pmod(h, F.greatest(F.floor((F.length("ids") - 4000) / 2), F.lit(0)) + F.lit(1)) * 2 + F.lit(1)
    rows = encoded.where(F.length("ids") > 120).select(h.alias("h"), F.substring("ids", start.cast("int"), F.lit(4000)).alias("ids")).distinct().orderBy("h", "ids").limit(STATES).collect()
    for z, r in enumerate(rows):
        seed = np.bincount(np.frombuffer(bytes(r["ids"]), np.uint16), minlength=vocab.n_classes).astype(float)
        emit[:, z] = 0.5 * emit[:, z] + 0.5 * (seed + emit[:, z]) / (seed.sum() + 1)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def train(encoded: DataFrame, vocab: Vocabulary, steps: int = STEPS) -> Model:
    """Baum-Welch over all rows of ``encoded``; sums of counts are aggregated by Spark, parameters have a fixed size."""
    model = _first_model(encoded, vocab)
    prior = model.emit.mean(1, keepdims=True)
    k, c = STATES, vocab.n_classes
    for _ in range(steps):
        held = encoded.sparkSession.sparkContext.broadcast(model)

        def run(batches, held=held):
            total = None
            for batch in batches:
                rows, size = [], 0
                for r in [*batch.column("ids"), None]:
                    if r is not None:
                        rows.append(np.frombuffer(r.as_py(), np.uint16))
                        size += len(rows[-1])
                    if rows and (r is None or size > WORDS):
                        got = expected_counts(held.value, rows)
                        total = got if total is None else [a + b for a, b in zip(total, got, strict=True)]
                        rows, size = [], 0
            if total is not None:
                flat = np.concatenate([x.ravel() for x in total])
                on = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(flat[on])], ["i", "v"])

        got = encoded.select("ids").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(k + k * k + c * k)
        flat[got["i"].to_numpy()] = got["v"].to_numpy()
        start, move, emit = flat[:k] + 1, flat[k : k + k * k].reshape(k, k) + 0.1, flat[k + k * k :].reshape(c, k)
        # A class unseen in a state keeps some of its share in the corpus.
        emit = emit + prior * (1 + 0.001 * emit.sum(0))
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def forward(model: Model, rows: list[bytes]) -> np.ndarray:
    """log10 likelihood of each whole class sequence, by the scaled forward recursion in lockstep."""
    seqs = [np.frombuffer(r, np.uint16) for r in rows]
    n = np.array([len(s) for s in seqs])
    order = np.argsort(-n, kind="stable")
    at = np.cumsum(n) - n
    flat = np.concatenate(seqs) if len(seqs) else np.zeros(0, np.uint16)
    n, at = n[order], at[order]
    score = np.zeros(len(seqs))
    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    a = np.repeat(model.start[None, :], len(seqs), 0)
    for t in range(len(live)):
        m = live[t]
        a = a[:m] if t == 0 else a[:m] @ model.move
        a = a * model.emit[flat[at[:m] + t]]
        s = a.sum(1)
        score[:m] += np.log10(s)
        a /= s[:, None]
    out = np.empty(len(seqs))
    out[order] = score
    return out


def score_texts(docs: DataFrame, held_out: Column, scratch: Scratch, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Learn from the rows that aren't held out and score every row.

    One row for each row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.
    Null and empty texts are the end alone.  Repeated rows, null and repeated keys are scored row by
    row.  Without training rows every word is unknown; an empty table gives no rows.
    """
    d = docs.select(F.col(key).cast("long").alias("id"), held_out.alias("held_out"), F.col(text).alias("text"))
    counts = scratch.keep(count_words(d.where(~F.col("held_out")).select("text")), "counts")
    vocab = vocabulary(counts)
    with arrow_rows(d.sparkSession, 2000):
        encoded = scratch.keep(encode(d.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text"), vocab), "encoded")
    model = train(encoded.where(~F.col("held_out")), vocab)

    # Words that no task holds: join with the table of counts, then sums for each row.  A word that the
    # training texts lack adds nothing to them.
    rare = encoded.select("row", F.explode("rare").alias("word"))
    few = counts if vocab.least is None else counts.where(F.col("c") <= vocab.least)
    joined = rare.join(few.select("word", F.log10(F.col("c") + F.lit(1.0)).alias("l")), "word")
    sums = joined.groupBy("row").agg(F.sum("l").alias("l"), F.count("*").alias("k"))

    held = d.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            got = forward(held.value, batch.column("ids").to_pylist())
            rest = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(got), pa.array([len(r.as_py()) // 2 for r in batch.column("ids")], pa.int64())], [*rest.schema.names, "classes", "n_tokens"])

    scored = encoded.select("row", "id", "held_out", "known", "base", "inner", "ids").mapInArrow(
        run, "row long, id long, held_out boolean, known long, base double, inner double, classes double, n_tokens long"
    )
    scored = scored.join(sums, "row", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0))
    size = F.log10(F.lit(float(vocab.words + vocab.distinct + 1)))
    return scored.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + part("k")).cast("long").alias("n_known"),
        F.lit(vocab.words).cast("long").alias("train_tokens"),
        (F.col("base") + part("l") - F.col("n_tokens") * size).alias("base_score"),
        (F.col("classes") + F.col("inner") + part("l")).alias("score"),
    )

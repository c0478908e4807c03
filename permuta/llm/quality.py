"""Quality classifier: a sparse ensemble of rules from tree paths, with lasso logistic weights.

Statistics of whole texts are computed in Arrow batches.  Small boosted trees on a bounded sample of
labelled rows propose conjunctions of conditions on them; an L1-penalised logistic regression keeps
few; those become one Spark column expression that scores every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permuta.llm import _text

#: Labelled rows that a fit uses at most (documented bound of the fit; statistics and scores cover all rows).
SAMPLE = 8000
FEATURES = [
    "log_bytes", "log_words", "mean_word", "long_words", "distinct_words", "top_word", "upper", "digits", "punctuation", "symbols",
    "bars", "marks", "high_bytes", "line_words", "distinct_lines", "symbol_words",
]

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digits": (_B >= 48) & (_B <= 57),
    "punctuation": np.isin(_B, list(b".,;:'\"()-")),
    "marks": np.isin(_B, list(b"!?")),
    "bars": np.isin(_B, list(b"|<>{}[]=\\/")),
    "symbols": np.isin(_B, list(b"#$%&*@^~_+`")),
    "high": _B >= 128,
    "newline": _B == 10,
}


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of each text's values."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[off[1:]] - total[off[:-1]]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    n = off[1:] - off[:-1]
    share = {c: _sums(mask[data], off) / np.maximum(n, 1) for c, mask in _CLASSES.items()}
    starts, at = _text.words(data, off, _text.NOT_SPACE)
    h = _text.word_hashes(data, starts, _text.NOT_SPACE)
    count = at[1:] - at[:-1]
    word_bytes = _sums(_text.NOT_SPACE[data], off)
    if len(starts):
        symbol = _CLASSES["symbols"] | _CLASSES["bars"] | _CLASSES["marks"]
        odd = np.add.reduceat((symbol & _text.NOT_SPACE)[data].astype(np.int64), starts) > 0
        size = np.add.reduceat(_text.NOT_SPACE[data].astype(np.int64), starts)
    else:
        odd = size = np.zeros(0)
    edges = np.zeros(len(data), bool)
    edges[off[:-1][n > 0]] = True
    edges[1:] |= data[:-1] == 10
    lines = np.flatnonzero(edges)
    line_hash = _text.word_hashes(data, lines, _B != 10) if len(lines) else np.zeros(0, np.uint64)
    line_at = np.searchsorted(lines, off)
    distinct, top, line_distinct = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
    for i in range(len(n)):
        if count[i]:
            c = np.unique(h[at[i] : at[i + 1]], return_counts=True)[1]
            distinct[i], top[i] = len(c) / count[i] ** 0.7, c.max() / count[i]
        if line_at[i + 1] > line_at[i]:
            line_distinct[i] = len(np.unique(line_hash[line_at[i] : line_at[i + 1]])) / (line_at[i + 1] - line_at[i])
    words_ = np.maximum(count, 1)
    return np.column_stack([
        np.log1p(n), np.log1p(count), word_bytes / words_, _sums(size >= 20, at) / words_, distinct, top, share["upper"], share["digits"], share["punctuation"], share["symbols"],
        share["bars"], share["marks"], share["high"], count / np.maximum(line_at[1:] - line_at[:-1], 1), line_distinct, _sums(odd, at) / words_,
    ])


def with_statistics(docs: DataFrame, text: str = "text", prefix: str = "stat_") -> DataFrame:
    """``docs`` with one double column for each feature; null text counts as empty."""
    names = [prefix + f for f in FEATURES]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])

    def run(batches):
        for batch in batches:
            parts = [statistics(data, off) for _, _, data, off in _text.chunks(*_text.flat(batch.column(text)))]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in np.ascontiguousarray(x.T)]], names=schema.names)

    return kept.mapInArrow(run, schema)


Condition = tuple[int, bool, float]  # feature, above, threshold


def _grow(x: np.ndarray, g: np.ndarray, w: np.ndarray, cuts: list[np.ndarray], depth: int, rows: np.ndarray, path: tuple[Condition, ...], out: list) -> None:
    """One regression tree on gradients; every node below the root is a rule, every leaf has a value."""
    if path:
        out.append(path)
    best = None
    if depth:
        total, weight = g[rows].sum(), w[rows].sum()
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            slot = np.searchsorted(cut, x[rows, f], "left")
            sg = np.cumsum(np.bincount(slot, g[rows], len(cut) + 1))[:-1]
            sw = np.cumsum(np.bincount(slot, w[rows], len(cut) + 1))[:-1]
            gain = sg**2 / (sw + 1) + (total - sg) ** 2 / (weight - sw + 1) - total**2 / (weight + 1)
            k = int(gain.argmax())
            if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, float(cut[k]))
    if best is None:
        return
    _, f, cut = best
    below = x[rows, f] <= cut
    _grow(x, g, w, cuts, depth - 1, rows[below], (*path, (f, False, cut)), out)
    _grow(x, g, w, cuts, depth - 1, rows[~below], (*path, (f, True, cut)), out)


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    on = np.ones(len(x), bool)
    for f, above, cut in rule:
        on &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return on


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class RuleEnsemble:
    """Conjunctive rules with weights; the score is the logistic function of their sum."""

    bias: float
    rules: list[tuple[float, tuple[Condition, ...]]]

    def column(self, prefix: str = "stat_") -> Column:
        """The score as a Spark column over the feature columns."""
        z = F.lit(self.bias)
        for weight, rule in self.rules:
            on = F.lit(True)
            for f, above, cut in rule:
                c = F.col(prefix + FEATURES[f])
                on = on & ((c > F.lit(cut)) if above else (c <= F.lit(cut)))
            z = z + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, steps: int = 400) -> RuleEnsemble:
    """Boosted trees for rules, then proximal gradient steps for the lasso; one class gives a constant."""
    prior = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3))
    bias = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(bias, [])
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 60)))[:-1] for f in range(x.shape[1])]
    z, rules = np.full(len(y), bias), {}
    every = np.arange(len(y))
    for _ in range(trees):
        p = _sigmoid(z)
        nodes: list = []
        _grow(x, y - p, p * (1 - p), cuts, depth, every, (), nodes)
        if not nodes:
            break
        own = {n: _holds(x, n) for n in nodes}
        leaves = [n for n in nodes if not any(m[: len(n)] == n and m != n for m in nodes)]
        step = np.zeros(len(y))
        for n in leaves:
            on = own[n]
            step[on] = (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1)
        z = z + rate * np.clip(step, -4, 4)
        rules.update(own)
    names = list(rules)
    a = np.column_stack([np.ones(len(y)), *rules.values()]).astype(np.float64)
    beta = np.zeros(a.shape[1])
    beta[0] = bias
    look, momentum = beta.copy(), 1.0
    size = 4.0 / np.linalg.eigvalsh(a.T @ a / len(y))[-1]
    for _ in range(steps):
        grad = a.T @ (_sigmoid(a @ look) - y) / len(y)
        new = look - size * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - size * penalty, 0)
        momentum, last = (1 + np.sqrt(1 + 4 * momentum**2)) / 2, momentum
        look = new + (last - 1) / momentum * (new - beta)
        beta = new
    return RuleEnsemble(float(beta[0]), [(float(b), n) for b, n in zip(beta[1:], names, strict=True) if abs(b) > 1e-9])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit on rows of ``docs`` that ``labels`` marks 0 or 1: all of them, or about ``sample`` by hash of the key.

    Repeated rows count as often as they stand; null keys, labels or other values are left out.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)").dropDuplicates(["k", "y"])
    n = marked.count()
    if n > sample:
        marked = marked.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(marked, "k")
    got = with_statistics(rows.select("text", "y", "k")).drop("text").orderBy("k").toArrow()
    x = np.column_stack([got.column("stat_" + f).to_numpy() for f in FEATURES])
    model = fit_rules(x, got.column("y").to_numpy().astype(np.float64))
    del got, x
    _text.release()
    return model


def score(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score double (0 to 1) and predicted int (1 if score >= threshold, else 0).

    Null text scores as empty text does.  Columns named score or predicted are replaced.
    """
    d = with_statistics(docs.drop("score", "predicted"), text)
    d = d.withColumn("score", model.column()).drop(*["stat_" + f for f in FEATURES])
    return d.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))

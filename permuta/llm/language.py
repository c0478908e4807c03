"""Language ID by hierarchical discrimination.

Letter n-grams are hashed into a fixed number of features.  A first set of one-versus-one linear
support vector machines chooses the language family, a second set inside the family the language.
Linear scores of relative frequencies are means over positions, so a text is scored by table lookups
along its bytes and any length takes the same memory.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permuta.llm import _text

#: Labelled texts that a fit uses at most, dealt evenly to the languages, and windows cut from each.
SAMPLE, WINDOWS = 1400, 2
BITS = 11
#: Families of ISO 639-1 codes; another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_B = np.arange(256)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
#: Letters folded, everything else one separator.
_CODE = np.where(_LETTER, _text.FOLD, 32).astype(np.uint64)


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of 1 to 3 bytes ending at each kept byte, and each text's range of kept bytes."""
    code = _CODE[data]
    first = np.zeros(len(data), bool)
    first[off[:-1][off[:-1] < len(data)]] = True
    before = np.concatenate([[np.uint64(32)], code[:-1]])
    before[first] = 32
    keep = ~((code == 32) & (before == 32))
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    code, before = code[keep], before[keep]
    before2 = np.concatenate([np.full(min(1, len(code)), 32, np.uint64), before[:-1]])
    before2[at[:-1][at[:-1] < len(code)]] = 32
    two = code | before << np.uint64(8)
    out = np.empty((3, len(code)), np.int32)
    for i, v in enumerate((code | np.uint64(1 << 30), two | np.uint64(2 << 30), two | before2 << np.uint64(16) | np.uint64(3 << 30))):
        out[i] = (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    return out, at


def _has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode("utf-8", "ignore"))


def features(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of the hashed n-grams, one row for each text."""
    off = np.cumsum([0, *map(len, texts)])
    grams, at = _grams(np.frombuffer(b"".join(texts), np.uint8), off)
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for i in range(len(texts)):
        if at[i + 1] > at[i]:
            x[i] = np.bincount(grams[:, at[i] : at[i + 1]].ravel(), minlength=1 << BITS) / (at[i + 1] - at[i])
    return x


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 150) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by accelerated gradient; the last weight is the bias.

    Classes weigh alike, whatever their numbers of rows.
    """
    a = np.column_stack([x, np.ones(len(x), x.dtype)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    v = np.ones(a.shape[1], x.dtype)
    for _ in range(20):
        v = a.T @ (weight * (a @ v))
        norm = np.linalg.norm(v)
        v /= norm
    lam = 1e-4 / c
    rate = 1 / (2 * norm * 1.1 + lam)
    w = look = np.zeros(a.shape[1], x.dtype)
    m = 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (a @ look))
        new = look - rate * (lam * look - 2 * (a.T @ (weight * y * slack)))
        m, last = (1 + np.sqrt(1 + 4 * m * m)) / 2, m
        look, w = new + (last - 1) / m * (new - w), new
    return w


@dataclass
class Hierarchy:
    """Families and their languages; columns of ``weights`` are the machines in the order of ``pairs``."""

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]  # level ("" or family), class of positive side, of negative side
    weights: np.ndarray
    bias: np.ndarray

    def choose(self, level: str, classes: list[str], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number by votes, then by summed margins; and the weakest winning probability."""
        votes, sums = np.zeros((len(margin), len(classes))), np.zeros((len(margin), len(classes)))
        sure = np.ones((len(margin), len(classes)))
        for k, (where, a, b) in enumerate(self.pairs):
            if where != level:
                continue
            i, j, m = classes.index(a), classes.index(b), margin[:, k]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            p = 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
            sure[:, i] = np.minimum(sure[:, i], p)
            sure[:, j] = np.minimum(sure[:, j], 1 - p)
        best = (votes + sums / (1 + 2 * np.abs(sums).max(initial=0))).argmax(1)
        return best, sure[np.arange(len(margin)), best]

    def predict(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, score = np.empty(len(margin), object), np.zeros(len(margin))
        family, p = self.choose("", self.families, margin)
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            own = self.languages[name]
            best, q = self.choose(name, own, margin[rows])
            out[rows] = np.array(own, object)[best] if len(rows) else []
            score[rows] = np.minimum(p[rows], q)
        return out, score


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy:
    by_family = defaultdict(set)
    for lang in langs:
        by_family[_FAMILY.get(lang, lang)].add(lang)
    families = sorted(by_family)
    languages = {f: sorted(v) for f, v in by_family.items()}
    lang, family = np.array(langs, object), np.array([_FAMILY.get(v, v) for v in langs], object)
    scale = 1 / (x.std(0) + 1e-4) if len(x) else np.ones(1 << BITS)
    scale = (scale / np.sqrt(len(scale))).astype(np.float32)
    pairs, weights = [], []
    for level, labels, classes in [("", family, families), *[(f, lang, languages[f]) for f in families]]:
        for a, b in combinations(classes, 2):
            rows = (labels == a) | (labels == b)
            pairs.append((level, a, b))
            weights.append(svm(x[rows] * scale, np.where(labels[rows] == a, 1, -1).astype(np.float32)))
    w = np.array(weights).T if weights else np.zeros(((1 << BITS) + 1, 0))
    return Hierarchy(families, languages, pairs, (w[:-1].T * scale).T.astype(np.float64), w[-1].astype(np.float64))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Hierarchy:
    """Fit on rows with text and language: all, or of each language about its part of ``sample`` by hash of text and key.

    Each text gives itself and ``WINDOWS`` windows of 2 to 30 of its words, so that short texts are learned too.
    """
    d = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("h")).where("t is not null and l is not null")
    n = {r["l"]: r["n"] for r in d.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Hierarchy([], {}, [], np.zeros((1 << BITS, 0)), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(v) for k, c in n.items() for v in (k, int(min(1.0, sample / len(n) / c) * (1 << 20)))]), F.col("l"))
    rows = d.where(F.pmod("h", F.lit(1 << 20)) < share)

    def run(batches):
        for batch in batches:
            for t, lang_, h in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                raw = t.encode()
                cut, rng = raw.split(), np.random.default_rng(abs(h))
                texts = [raw]
                for _ in range(WINDOWS if cut else 0):
                    size = int(rng.integers(2, 31))
                    at = int(rng.integers(0, max(1, len(cut) - size + 1)))
                    texts.append(b" ".join(cut[at : at + size]))
                texts = [x for x in texts if _has_letter(x)]
                x = features(texts)
                for i in range(len(texts)):
                    on = np.flatnonzero(x[i])
                    yield pa.RecordBatch.from_pydict({"h": [h], "l": [lang_], "i": [on.astype(np.int32)], "v": [x[i, on]]})

    got = rows.mapInArrow(run, "h long, l string, i array<int>, v array<float>").orderBy("l", "h").toPandas()
    x = np.zeros((len(got), 1 << BITS), np.float32)
    for r, (i, v) in enumerate(zip(got["i"], got["v"], strict=True)):
        x[r, i] = v
    return fit(x, got["l"].tolist())


def identify(docs: DataFrame, model: Hierarchy, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string and score double added.

    Null text and text without a letter give ``und`` with score 0, and so does a model that saw no
    language; every other row gets a learned language.  Columns named lang_pred or score are replaced.
    """
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            lang, score = [], []
            for a, b, data, off in _text.chunks(*_text.flat(batch.column(text))):
                grams, at = _grams(data, off)
                n = np.maximum(at[1:] - at[:-1], 1)[:, None]
                margin = np.zeros((b - a, len(model.pairs)))
                for k in range(len(model.pairs)):
                    w = model.weights[:, k]
                    total = np.concatenate([[0], np.cumsum(w[grams[0]] + w[grams[1]] + w[grams[2]])])
                    margin[:, k] = (total[at[1:]] - total[at[:-1]]) / n[:, 0] + model.bias[k]
                letters = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 128))])
                plain = letters[off[1:]] > letters[off[:-1]]
                some = [bool(plain[i]) or _has_letter(data[off[i] : off[i + 1]].tobytes()) for i in range(b - a)]
                got, p = model.predict(margin) if model.families else ([None] * (b - a), np.zeros(b - a))
                lang += [v if on and v is not None else "und" for v, on in zip(got, some, strict=True)]
                score += [float(v) if on else 0.0 for v, on in zip(p, some, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return kept.mapInArrow(run, schema)

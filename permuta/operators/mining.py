"""Order-preserving patterns of series and their forgetting-weighted support.

An occurrence of a pattern of m ranks is a window of m neighbouring, pairwise distinct values in that
order; its weight is that of the window's last position.  The mined set is closed over parents: a
pattern of m + 1 ranks is reported if its support reaches the threshold and its first m and last m
values' patterns were reported.  (A threshold alone isn't enough: the pattern of the first m
values can have less support than the whole.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions import fuse_ranks, is_tie_free, prefix, rank_encode, suffix
from permuta.functions.thresholds import check_threshold
from permuta.operators.levels import STARTS, closed_levels
from permuta.sources.series import base_table
from permuta.storage import cut

#: Positions of a chunk: windows of a long series are formed by many tasks.
CHUNK = 1 << 10
#: Lengths whose windows are formed from one sorted pass.
BLOCK = 4


def tie_free_windows(base: DataFrame, m: int, chunk: int = CHUNK) -> DataFrame:
    """(series_id, pos, n, k, w, values): windows of m pairwise distinct values, by their last position.

    A position that is missing ends windows as a tie does.
    """
    rows = _last_values(base, m, chunk).where((F.size("values") == m) & (F.col("_at")[0] == F.col("pos") - (m - 1)))
    return rows.where(is_tie_free(F.col("values"))).select("series_id", "pos", "n", "k", "w", "values")


def _last_values(base: DataFrame, m: int, chunk: int) -> DataFrame:
    """Base rows with the values of the last ``m`` rows and their positions (``_at``), fewer at the start of a series.

    Series are cut into chunks of positions; the last m - 1 rows of a chunk are repeated in the next, so
    no window is lost and no task holds a whole series.
    """
    if m - 1 > chunk:
        raise ValueError("a window must fit into a chunk")
    own = F.floor((F.col("pos") - 1) / chunk)
    copies = F.when((F.col("pos") - 1) % chunk >= chunk - (m - 1), F.array(own, own + 1)).otherwise(F.array(own))
    # Ranking costs far more than the bytes of a window tell, so the number of tasks is stated and not merged by size.
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = base.where(F.col("v").isNotNull()).withColumn("_chunk", F.explode(copies)).repartition(parts, "series_id", "_chunk")
    window = Window.partitionBy("series_id", "_chunk").orderBy("pos").rowsBetween(-(m - 1), 0)
    return rows.withColumns({"values": F.collect_list("v").over(window), "_at": F.collect_list("pos").over(window)}).where(F.col("_chunk") == own)


def windows_of_lengths(base: DataFrame, low: int, high: int, chunk: int = CHUNK) -> DataFrame:
    """``window_occurrences`` of every length from ``low`` to ``high``, from one sorted pass over the series."""
    each = []
    for m in range(low, high + 1):
        values = F.slice("values", -m, m)
        whole = (F.size("values") >= m) & (F.try_element_at("_at", F.lit(-m)) == F.col("pos") - (m - 1))
        each.append(F.when(whole & is_tie_free(values), F.struct(F.lit(m).alias("m"), rank_encode(values).alias("pattern"))))
    rows = _last_values(base, high, chunk).withColumn("_w", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return rows.select("series_id", "_w.m", "pos", "n", "k", "w", "_w.pattern")


def window_occurrences(base: DataFrame, m: int, chunk: int = CHUNK) -> DataFrame:
    """(series_id, m, pos, n, k, w, pattern): every occurrence of every pattern of m ranks."""
    return tie_free_windows(base, m, chunk).select("series_id", F.lit(m).alias("m"), "pos", "n", "k", "w", rank_encode(F.col("values")).alias("pattern"))


def pattern_support(occurrences: DataFrame) -> DataFrame:
    """(series_id, m, pattern, support, cnt, first_pos, last_pos, n, k), partial sums before the shuffle."""
    return occurrences.groupBy("series_id", "m", "pattern").agg(
        F.sum("w").alias("support"), F.count("*").alias("cnt"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.max("n").alias("n"), F.max("k").alias("k")
    )


def frequent(patterns: DataFrame, minsup: float, parents: DataFrame | None = None) -> DataFrame:
    """Patterns that reach the threshold (inclusive) and, given ``parents``, whose two parents are among those."""
    kept = patterns.where(F.col("support") >= check_threshold(minsup))
    return kept if parents is None else with_parents(kept, parents, ["series_id"])


def with_parents(patterns: DataFrame, parents: DataFrame, within: list[str]) -> DataFrame:
    """Patterns whose prefix and suffix are both patterns of ``parents`` with equal ``within`` columns."""
    known = parents.select(*within, F.col("pattern").alias("_q"))
    for part in (prefix, suffix):
        patterns = patterns.withColumn("_q", part(F.col("pattern"))).join(known, [*within, "_q"], "left_semi").drop("_q")
    return patterns


def seed_occurrences(base: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Occurrences of the two patterns of two ranks, with the window's first and last value."""
    rows = tie_free_windows(base, 2, chunk)
    return rows.select("series_id", F.lit(2).alias("m"), "pos", "n", "k", "w", rank_encode(F.col("values")).alias("pattern"), F.col("values")[0].alias("first"), F.col("values")[1].alias("last"))


def extend_occurrences(occurrences: DataFrame) -> DataFrame:
    """Occurrences of m + 1 ranks from those of m: one ends a position before the other.

    Two windows that overlap in all but one value agree there, so this join on positions pairs patterns by
    key and fuses their occurrences at once; equal first and last values give none.
    """
    p = occurrences.select("series_id", "m", (F.col("pos") + 1).alias("pos"), F.col("pattern").alias("p"), "first")
    q = occurrences.select("series_id", "pos", "n", "k", "w", F.col("pattern").alias("q"), "last")
    both = p.join(q, ["series_id", "pos"]).where("first <> last")
    return both.select("series_id", (F.col("m") + 1).alias("m"), "pos", "n", "k", "w", fuse_ranks(F.col("p"), F.col("q"), F.col("first"), F.col("last")).alias("pattern"), "first", "last")


def mine(series: DataFrame, minsup: float, k: float | None = None, semantics: str = "closure", max_len: int | None = None, strategy: str = "auto", chunk: int | None = None) -> DataFrame:
    """All patterns of at least two ranks: (series_id, m, pattern, support, cnt, first_pos, last_pos, n, k).

    ``series`` is (series_id, pos, v); null and NaN values end windows as ties do.  ``semantics``: closure, or
    threshold (support alone).  ``strategy``: auto mines the closure by doubling the length (``levels``); windows ranks
    every window of a length, ``BLOCK`` lengths in one pass; positions joins the occurrences of frequent patterns, which
    shrink from level to level.  The last two take a checkpointed table each level, and end at an empty one.
    ``chunk``: positions of a series that are worked on together.
    """
    check_threshold(minsup)
    if semantics not in ("closure", "threshold"):
        raise ValueError("semantics is closure or threshold")
    if strategy not in ("auto", "windows", "positions") or semantics == "threshold" and strategy == "positions":
        raise ValueError("strategy is auto, windows or, for the closure, positions")
    base = cut(series if "w" in series.columns else base_table(series.where(F.col("v").isNotNull()).select("series_id", "pos", "v"), k))
    if semantics == "closure" and strategy == "auto":
        found = [x.drop("held") for x in closed_levels(base, [minsup], max_len, chunk or STARTS)]
    else:
        found = _level_by_level(base, minsup, semantics, max_len, strategy, chunk or CHUNK)
    return _union(found) if found else cut(pattern_support(window_occurrences(base, 2)).limit(0))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _level_by_level(base: DataFrame, minsup: float, semantics: str, max_len: int | None, strategy: str, chunk: int) -> list[DataFrame]:
    found, level, occurrences = [], None, None
    supports, known_to = None, 1
    m = 2
    while max_len is None or m <= max_len:
        if strategy == "positions":
            occurrences = cut(seed_occurrences(base, chunk) if occurrences is None else extend_occurrences(occurrences))
            level = cut(frequent(pattern_support(occurrences), minsup))
            known = level.select("series_id", "pattern")
            occurrences = cut(occurrences.join(known, ["series_id", "pattern"], "left_semi"))
        else:
            if m > known_to:
                known_to = max(m, min(x for x in (m + BLOCK - 1, max_len, chunk + 1) if x is not None))
                supports = cut(frequent(pattern_support(windows_of_lengths(base, m, known_to, chunk)), minsup))
            same = supports.where(F.col("m") == m)
            level = cut(with_parents(same, level, ["series_id"])) if semantics == "closure" and m > 2 else same
        found.append(level)
        # An occurrence of a longer pattern is one of its suffix, so nothing follows an empty level.
        if level.isEmpty():
            break
        m += 1
    return found


def mine_sweep(series: DataFrame, minsups: list[float], k: float | None = None, max_len: int | None = None, chunk: int | None = None) -> DataFrame:
    """``mine`` for several thresholds at once: its columns and minsup, the closure of each threshold.

    Windows are walked once for all thresholds; a pattern then stands once for each threshold that it and all its prefixes reach.
    """
    sigmas = sorted({check_threshold(x) for x in minsups})
    if not sigmas:
        raise ValueError("there is no threshold")
    base = cut(series if "w" in series.columns else base_table(series.where(F.col("v").isNotNull()).select("series_id", "pos", "v"), k))
    found = closed_levels(base, sigmas, max_len, chunk or STARTS)
    if not found:
        return cut(pattern_support(window_occurrences(base, 2)).limit(0).withColumn("minsup", F.lit(0.0)))
    each = F.explode(F.slice(F.array(*[F.lit(float(x)) for x in sigmas]), F.lit(1), F.col("held")))
    return _union(found).withColumn("minsup", each).drop("held")


def candidate_pairs(patterns: DataFrame) -> DataFrame:
    """Pairs (p, q) of one series and length where q's first m - 1 ranks continue p's last m - 1.

    The longest common order is the join key, so Spark hashes or merges on it; columns of p and q
    carry their pattern, support, cnt, first_pos and last_pos.
    """
    facts = ("support", "cnt", "first_pos", "last_pos")
    p = patterns.select("series_id", "m", "n", "k", suffix(F.col("pattern")).alias("key"), F.col("pattern").alias("p"), *[F.col(c).alias(f"p_{c}") for c in facts])
    q = patterns.select("series_id", "m", prefix(F.col("pattern")).alias("key"), F.col("pattern").alias("q"), *[F.col(c).alias(f"q_{c}") for c in facts])
    return p.join(q, ["series_id", "m", "key"])

"""Column expressions over rank patterns; all of them are Spark built-ins.

A pattern is an ``array<int>`` holding a permutation of 1..m: the relative order of m neighbouring values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def forgetting_weight(k: Column | float, n: Column, pos: Column) -> Column:
    """exp(-k (n - pos)): 1 at the last position, less the older an occurrence is."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.exp(-k * (n - pos))


def rank_encode(values: Column) -> Column:
    """Ranks 1..m of pairwise distinct values."""
    # The outer lambda binds the sorted values: inside the inner one they would be sorted for every value.
    ranks = F.transform(F.array(F.sort_array(values)), lambda ordered: F.transform(values, lambda x: F.array_position(ordered, x).cast("int")))
    return F.get(ranks, F.lit(0))


def is_tie_free(values: Column) -> Column:
    """Whether all values are comparable (no null, no NaN) and pairwise distinct."""
    # Nulls come first in a sorted array, and NaN is the greatest value.
    comparable = F.get(F.sort_array(values), F.lit(0)).isNotNull() & ~F.isnan(F.array_max(values))
    return (F.size(values) == 0) | comparable & (F.size(F.array_distinct(values)) == F.size(values))


def prefix(pattern: Column) -> Column:
    """Order of all ranks but the last; empty for a pattern of one rank."""
    return rank_encode(F.slice(pattern, 1, F.greatest(F.size(pattern) - 1, F.lit(0))))


def suffix(pattern: Column) -> Column:
    """Order of all ranks but the first."""
    return rank_encode(F.slice(pattern, 2, F.greatest(F.size(pattern) - 1, F.lit(0))))


def step_direction(value: Column, previous: Column) -> Column:
    """1 for a strict rise, -1 for a strict fall; null for a tie, a NaN or a missing neighbour."""
    defined = ~F.isnan(value) & ~F.isnan(previous)
    return F.when(defined & (value > previous), 1).when(defined & (value < previous), -1)


def group_label(pattern: Column) -> Column:
    """First two steps: up up 1, up down 2, down up 3, down down 4; a pattern of two ranks has 1 (up) or 2."""
    up1, up2 = pattern[0] < pattern[1], F.get(pattern, F.lit(1)) < F.get(pattern, F.lit(2))
    long_ = F.when(up1 & up2, 1).when(up1, 2).when(up2, 3).otherwise(4)
    return F.when(F.size(pattern) == 2, F.when(up1, 1).otherwise(2)).otherwise(long_)


def groups_compatible(p: Column, q: Column) -> Column:
    """Whether p's second step is q's first; always so for patterns of two ranks."""
    gp, gq = group_label(p), group_label(q)
    return (F.size(p) <= 2) | (gp.isin(1, 3) & gq.isin(1, 2)) | (gp.isin(2, 4) & gq.isin(3, 4))


def fuse_ranks(p: Column, q: Column, first: Column, last: Column) -> Column:
    """Pattern of m + 1 values from those of its first and last m, given its first and last value.

    The first rank is p's, one more if the last value is below it; the middle keeps p's ranks, one more
    where q ranks it above the last; the last rank is q's, one more if the first value is below it.
    """
    m = F.size(p)
    end = F.element_at(q, -1)
    middle = F.zip_with(F.slice(p, 2, m - 1), F.slice(q, 1, m - 1), lambda x, y: x + (y > end).cast("int"))
    return F.concat(F.array(p[0] + (first > last).cast("int")), middle, F.array(end + (first < last).cast("int")))


def pattern_text(pattern: Column) -> Column:
    """``[1, 3, 2]``."""
    return F.concat(F.lit("["), F.array_join(pattern.cast("array<string>"), ", "), F.lit("]"))


def text_pattern(text: Column) -> Column:
    """Inverse of ``pattern_text``; a part that isn't an integer raises."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.cast("int"))


def ceil_log2(x: Column) -> Column:
    """Least whole e with 2^e >= x, 0 for x <= 1."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.ceil(F.log2(x))).cast("int")

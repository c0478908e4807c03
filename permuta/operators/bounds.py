"""Upper bounds on the support of a pair's children, and how often they rule a pair out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permuta.storage import cut

EPSILON = 1e-12
#: Positions whose occurrences are counted together.
CHUNK = 1 << 16
#: From this count on, and from this ratio on, a pair's counts of occurrences are very unequal.
SKEW_LEAST, SKEW_RATIO = 256, 8


def pair_bounds(pairs: DataFrame) -> DataFrame:
    """Pairs with low, high (range of possible last positions), residual_bound and card_bound."""
    low = F.greatest(F.col("p_first_pos") + 1, F.col("q_first_pos"))
    high = F.least(F.col("p_last_pos") + 1, F.col("q_last_pos"))
    high_weight = F.exp(-F.col("k") * (F.col("n") - F.col("high")))
    return (
        pairs.withColumn("low", low)
        .withColumn("high", high)
        .withColumn("residual_bound", F.least(F.col("p_support") * F.exp("k"), F.col("q_support")))
        .withColumn("card_bound", F.least("p_cnt", "q_cnt") * high_weight)
    )


def _below(bound: str, minsup: float) -> Column:
    return F.col(bound) + EPSILON < minsup


def counts_up_to(occurrences: DataFrame, asked: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``asked`` (series_id, pattern, pos and other columns) with ``upto``: occurrences of the pattern up to the position, itself included.

    Occurrences and questions are sorted together by position in chunks of a pattern, and the counts of the chunks
    before are added, a table of one row a pattern and chunk; so neither a frequent pattern nor many
    questions about one meet in a task.  Where all questions are about first chunks nothing is added.
    """
    others = [c for c in asked.columns if c not in ("series_id", "pattern", "pos")]
    one = occurrences.select("series_id", "pattern", "pos", F.lit(0).alias("_asks"))
    both = one.unionByName(asked.select("series_id", "pattern", "pos", F.lit(1).alias("_asks"), *others), allowMissingColumns=True).withColumn("_chunk", F.floor(F.col("pos") / chunk))
    key = ["series_id", "pattern", "_chunk"]
    inside = F.count_if(F.col("_asks") == 0).over(Window.partitionBy(*key).orderBy("pos", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = cut(both.withColumn("_inside", inside).where("_asks = 1").drop("_asks"))
    near = counted.where("_chunk <= 0").select(*asked.columns, F.col("_inside").alias("upto"))
    far = counted.where("_chunk > 0")
    if far.isEmpty():
        return near
    sizes = both.groupBy(*key).agg(F.count_if(F.col("_asks") == 0).alias("_n"))
    earlier = Window.partitionBy("series_id", "pattern").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(c).alias(f"{c}_") for c in key], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("series_id").eqNullSafe(F.col("series_id_")) & (F.col("pattern") == F.col("pattern_")) & (F.col("_chunk") == F.col("_chunk_"))
    return near.unionByName(far.join(before, same).select(*asked.columns, (F.col("_inside") + F.col("_before")).alias("upto")))


def bound_tiers(pairs: DataFrame, occurrences: DataFrame, minsup: float, chunk: int = CHUNK) -> DataFrame:
    """Pairs with range_bound and tier: the first of residual, span, card, range that rules the pair out, or pass.

    The range bound counts the occurrences of both sides that can take part, by two look-ups of running
    counts a side; it is null for pairs that another bound rules out.
    """
    b = pair_bounds(pairs)
    early = F.when(_below("residual_bound", minsup), "residual").when(F.col("low") > F.col("high"), "span").when(_below("card_bound", minsup), "card")
    b = cut(b.withColumn("early", early))
    ends = [(side, shift, sign) for side, shift in (("p", 1), ("q", 0)) for sign in (1, -1)]
    each = [F.struct(F.col(side).alias("pattern"), (F.col("high" if sign > 0 else "low") - (shift + (sign < 0))).alias("pos"), F.lit(side).alias("side"), F.lit(sign).alias("sign")) for side, shift, sign in ends]
    asked = b.where(F.col("early").isNull()).select("series_id", "m", "p", "q", F.inline(F.array(*each)))
    counted = counts_up_to(occurrences, asked, chunk)
    key = ["series_id", "m", "p", "q"]
    inside = counted.groupBy(*key).agg(*[F.sum(F.when(F.col("side") == x, F.col("sign") * F.col("upto"))).alias(f"{x}_in") for x in ("p", "q")])
    same = F.col("series_id").eqNullSafe(F.col("series_id_"))
    for c in key[1:]:
        same = same & (F.col(c) == F.col(f"{c}_"))
    b = b.join(inside.withColumnsRenamed({c: f"{c}_" for c in key}), same, "left").drop(*[f"{c}_" for c in key])
    b = b.withColumn("range_bound", F.least("p_in", "q_in") * F.exp(-F.col("k") * (F.col("n") - F.col("high"))))
    tier = F.when(F.col("early").isNotNull(), F.col("early")).when(_below("range_bound", minsup), "range").otherwise("pass")
    return b.withColumn("tier", tier).drop("early", "p_in", "q_in")


def prune_rate(pairs: DataFrame, minsup: float) -> DataFrame:
    """For each series and length: pairs, those that each cheap bound rules out, and the share that any does.

    Every candidate pair counts, in one aggregation; the mined set doesn't depend on it.
    """
    b = pair_bounds(pairs)
    residual, span, card = _below("residual_bound", minsup), F.col("low") > F.col("high"), _below("card_bound", minsup)
    pruned = F.count_if(residual | span | card)
    counts = {"by_residual": residual, "by_span": span, "by_card": card}
    return b.groupBy("series_id", "m").agg(F.count("*").alias("pairs"), *[F.count_if(c).alias(n) for n, c in counts.items()], (pruned / F.count("*")).alias("prune_rate"))


def skew_rate(pairs: DataFrame, least: int = SKEW_LEAST, ratio: int = SKEW_RATIO) -> DataFrame:
    """For each series and length: pairs and the share of those whose counts of occurrences are very unequal.

    Unequal: the larger count is ``least`` or more and ``ratio`` times the smaller or more.
    """
    large, small = F.greatest("p_cnt", "q_cnt"), F.least("p_cnt", "q_cnt")
    skewed = F.count_if((large >= least) & (large >= ratio * small))
    return pairs.groupBy("series_id", "m").agg(F.count("*").alias("pairs"), (skewed / F.count("*")).alias("skew_rate"))

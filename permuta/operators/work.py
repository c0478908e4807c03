"""Work counters and density of a mined generation, defined over its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.operators.mining import candidate_pairs, extend_occurrences


def pair_mass(patterns: DataFrame) -> DataFrame:
    """(series_id, m, patterns, pairs, fan_out): pairs with a fitting key, and their mean for a pattern."""
    sizes = patterns.groupBy("series_id", "m").agg(F.count("*").alias("patterns"))
    pairs = candidate_pairs(patterns).groupBy("series_id", "m").agg(F.count("*").alias("pairs"))
    out = sizes.join(pairs, ["series_id", "m"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return out.withColumn("fan_out", F.col("pairs") / F.col("patterns"))


def occurrence_density(patterns: DataFrame) -> DataFrame:
    """(series_id, m, occurrences, covered, density): occurrences over the spans from first to last, 0 without spans."""
    covered = F.sum(F.col("last_pos") - F.col("first_pos") + 1)
    out = patterns.groupBy("series_id", "m").agg(F.sum("cnt").alias("occurrences"), covered.alias("covered"))
    return out.withColumn("density", F.when(F.col("covered") > 0, F.col("occurrences") / F.col("covered")).otherwise(F.lit(0.0)))


def work_counters(patterns: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(series_id, m, freq_patterns, pair_checks, candidates, fusions, support_ops) of a step from m to m + 1.

    A pair has two possible children if p's first rank equals q's last, else one; support operations are
    the position matches of frequent patterns, ties at the ends included.
    """
    pairs = candidate_pairs(patterns)
    twice = F.when(F.col("p")[0] == F.element_at("q", -1), 2).otherwise(1)
    made = pairs.groupBy("series_id", "m").agg(F.count("*").alias("pair_checks"), F.sum(twice).alias("candidates"))
    known = patterns.select("series_id", "pattern")
    o = occurrences.join(known, ["series_id", "pattern"], "left_semi").select("series_id", "m", "pos")
    steps = o.join(o.select("series_id", (F.col("pos") + 1).alias("pos")), ["series_id", "pos"]).groupBy("series_id", "m").agg(F.count("*").alias("support_ops"))
    sizes = patterns.groupBy("series_id", "m").agg(F.count("*").alias("freq_patterns"))
    out = sizes.join(made, ["series_id", "m"], "left").join(steps, ["series_id", "m"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("series_id", "m", "freq_patterns", zero("pair_checks"), zero("candidates"), F.coalesce("pair_checks", F.lit(0)).alias("fusions"), zero("support_ops"))


def generation_trace(mined: DataFrame) -> DataFrame:
    """(series_id, m, input_patterns, input_occurrences, density, output_patterns, pairs) of each level of a mined set."""
    levels = occurrence_density(mined).join(pair_mass(mined), ["series_id", "m"])
    following = mined.groupBy("series_id", (F.col("m") - 1).alias("m")).agg(F.count("*").alias("output_patterns"))
    out = levels.join(following, ["series_id", "m"], "left")
    return out.select("series_id", "m", F.col("patterns").alias("input_patterns"), F.col("occurrences").alias("input_occurrences"), "density", F.coalesce("output_patterns", F.lit(0)).alias("output_patterns"), "pairs")


__all__ = ["extend_occurrences", "generation_trace", "occurrence_density", "pair_mass", "work_counters"]

"""Aggregates over benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.storage import cut

#: Values of a key that one task may hold to find their median.
FEW_VALUES = 200_000
#: Values that cut a key's range into parts of about equal counts.
GRID = 128
#: A key with more values left is hot: what is known of it is sent to its rows.
HOT = 1 << 20


def summarize_runs(runs: DataFrame, key: list[str], value: str, few: int = FEW_VALUES) -> DataFrame:
    """Key with n_runs, mean, std (sample, 0 for fewer than two), median, min, max and geo_mean of the value.

    The median is exact.  Where a key has more than ``few`` values it is found by ``exact_medians``.
    """
    v = F.col(value)
    sums = [
        F.count(v).alias("n_runs"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.exp(F.avg(F.ln(v))).alias("geo_mean"),
    ]
    largest = runs.groupBy(*key).agg(F.count(v).alias("n")).agg(F.max("n")).first()[0] or 0
    order = [*key, "n_runs", "mean", "std", "median", "min", "max", "geo_mean"]
    if largest <= few:
        return runs.groupBy(*key).agg(*sums, F.percentile(v, 0.5).alias("median")).select(*order)
    medians = exact_medians(runs, key, value, few)
    return _null_safe_join(runs.groupBy(*key).agg(*sums), medians, key, "left").select(*order)


def _null_safe_join(a: DataFrame, b: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    other = b.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(key)})
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return a.join(other, same, how).drop(*[f"_{i}" for i in range(len(key))])


def _join_known(rows: DataFrame, known: DataFrame, hot: DataFrame | None, key: list[str]) -> DataFrame:
    """``rows`` with what is ``known`` of their keys, a row a key; keys that aren't known go.

    Rows of ``hot`` keys stay where they are, the others may be gathered at their key.
    """
    if hot is None:
        return _null_safe_join(rows, known, key)
    spread = _null_safe_join(rows, F.broadcast(_null_safe_join(known, F.broadcast(hot), key)), key)
    return spread.unionByName(_null_safe_join(_null_safe_join(rows, F.broadcast(hot), key, "left_anti"), _null_safe_join(known, F.broadcast(hot), key, "left_anti"), key))


def exact_medians(rows: DataFrame, key: list[str], value: str, few: int = FEW_VALUES, hot: int = HOT) -> DataFrame:
    """(key, median) of keys that have a value: the middle value, or the mean of the two middle ones.

    A pass lays a grid of some ``GRID`` quantiles over each key's values that are left (a sketch of fixed size, summed in each
    task first), counts the values of each part, and keeps only the parts with the middle ones; so the
    values left fall by about ``GRID`` a pass, and no task ever holds more than ``few`` of a key.  Rows of a key with more than
    ``hot`` values are never shuffled: there is one such key at most for each ``hot`` rows, so these are broadcast.
    """
    left = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("v"))
    sizes = left.groupBy(*key).agg(F.count("*").alias("n"))
    # Ranks of the middle values among those left, from 0, and the number left.
    state = cut(sizes.select(*key, F.floor((F.col("n") - 1) / 2).alias("lo"), F.floor(F.col("n") / 2).alias("hi"), F.col("n").alias("left")))
    found = None
    while True:
        # Small keys are none of the hot ones.
        least_hot = max(hot, few)
        keys, n_small, n_hot = state.agg(F.count("*"), F.count_if(F.col("left") <= few), F.count_if(F.col("left") > least_hot)).first()
        hot_keys = state.where(F.col("left") > least_hot).select(*key) if n_hot else None
        small = state.where(F.col("left") <= few)
        held = _join_known(left if n_small else left.limit(0), small, hot_keys, key).groupBy(*key, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("x"))
        at = lambda c: F.get("x", F.col(c).cast("int"))
        done = held.select(*key, ((at("lo") + at("hi")) / 2).alias("median"))
        big = state.where(F.col("left") > few)
        if keys == n_small:
            return done if found is None else found.unionByName(done)
        found = cut(done if found is None else found.unionByName(done))
        own = _join_known(left, big, hot_keys, key)
        grid = own.groupBy(*key).agg(F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], 100 * GRID).alias("grid"))
        # The parts of a key: each grid value by itself and what lies between two; all copies of a value are in one part.
        grid = grid.withColumn("grid", F.array_sort(F.array_distinct("grid")))
        placed = _join_known(own, cut(grid), hot_keys, key)
        below = F.size(F.filter("grid", lambda g: g < F.col("v")))
        placed = placed.withColumn("part", 2 * below + F.when(F.array_contains("grid", F.col("v")), 1).otherwise(0))
        counts = placed.groupBy(*key, "lo", "hi", "part").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        # At most 2 GRID + 3 rows a key.
        parts = counts.groupBy(*key, "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("part", "c", "least", "most"))).alias("p"))
        upto = F.aggregate("p", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["c"])))
        parts = cut(parts.withColumn("start", upto))
        each = parts.select(*key, "lo", "hi", F.inline(F.zip_with("p", F.slice("start", F.lit(1), F.size("p")), lambda x, s: F.struct(x["part"].alias("part"), x["c"].alias("c"), x["least"].alias("least"), x["most"].alias("most"), s.alias("s")))))
        middle = each.where((F.col("s") <= F.col("hi")) & (F.col("s") + F.col("c") > F.col("lo")))
        spans = middle.groupBy(*key, "lo", "hi").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.min("s").alias("s"), F.sum("c").alias("c"), F.max("part").alias("last"), F.min("part").alias("first"), F.max(F.struct("part", "least")).alias("upper"), F.min(F.struct("part", "most")).alias("lower"))
        spans = cut(spans)
        # Where the ranks fall into two parts, they are the end of one and the start of the next; else one value may take both.
        single = (F.col("least") == F.col("most")) | (F.col("first") != F.col("last"))
        found = cut(found.unionByName(spans.where(single).select(*key, ((F.col("lower.most") + F.col("upper.least")) / 2).alias("median"))))
        rest = spans.where(~single)
        state = cut(rest.select(*key, (F.col("lo") - F.col("s")).alias("lo"), (F.col("hi") - F.col("s")).alias("hi"), F.col("c").alias("left")))
        limits = rest.select(*key, "least", "most")
        left = cut(_join_known(left, limits, hot_keys, key).where(F.col("v").between(F.col("least"), F.col("most"))).select(*key, "v"))


def result_summary(mined: DataFrame, minsup: float) -> DataFrame:
    """(Dataset, minsup, Length, FreqPatterns, MaxPattern, Support) of each series of a mined set: its values, patterns, longest pattern and summed support."""
    return mined.groupBy(F.col("series_id").alias("Dataset")).agg(
        F.lit(float(minsup)).alias("minsup"), F.max("n").alias("Length"), F.count("*").alias("FreqPatterns"), F.max("m").alias("MaxPattern"), F.sum("support").alias("Support")
    )


def best_config(summary: DataFrame, case: list[str], config: str, value: str) -> DataFrame:
    """The configuration of least value of each case; ties go to the first name."""
    best = summary.groupBy(*case).agg(F.min(F.struct(F.col(value).alias("v"), F.col(config).alias("c"))).alias("b"))
    return best.select(*case, F.col("b.c").alias("best"), F.col("b.v").alias("best_value"))


def win_counts(summary: DataFrame, case: list[str], config: str, value: str) -> DataFrame:
    """Cases that each configuration is best in; configurations without a win count 0."""
    best = best_config(summary, case, config, value).groupBy(F.col("best").alias(config)).agg(F.count("*").alias("wins"))
    return summary.select(config).distinct().join(best, config, "left").select(config, F.coalesce("wins", F.lit(0)).alias("wins"))


def relative_to(summary: DataFrame, case: list[str], config: str, value: str, baseline: str) -> DataFrame:
    """Each configuration's value over the baseline's of the same case."""
    base = summary.where(F.col(config) == baseline).select(*case, F.col(value).alias("_base"))
    return summary.join(base, case).select(*case, config, (F.col(value) / F.col("_base")).alias("ratio"))


def against_baseline(baseline: DataFrame, variant: DataFrame, value: str, key: tuple[str, ...] = ("Dataset", "minsup")) -> DataFrame:
    """Key, base, variant and ratio (base over variant) of the keys that both sides have.

    A key that a side holds twice is no pair: the query raises there when it runs.
    """
    sides = []
    for name, rows in (("base", baseline), ("variant", variant)):
        one = rows.groupBy(*key).agg(F.count("*").alias("_rows"), F.first(value).alias(name))
        checked = F.when(F.col("_rows") > 1, F.raise_error(F.concat(F.lit(f"repeated key in {name}: "), F.to_json(F.struct(*key))))).otherwise(F.col(name))
        sides.append(one.select(*key, checked.cast("double").alias(name)))
    return sides[0].join(sides[1], list(key)).withColumn("ratio", F.col("base") / F.col("variant"))


def pivot_metric(summary: DataFrame, case: str, config: str, value: str, configs: list[str]) -> DataFrame:
    """One row a case, one column a configuration."""
    return summary.groupBy(case).pivot(config, configs).agg(F.first(value))


def unstable_counters(runs: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """(key, counter): counters that differ between the runs of a key."""
    spread = runs.groupBy(*key).agg(*[(F.min(c) != F.max(c)).alias(c) for c in counters])
    named = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in counters]), lambda x: x.isNotNull())
    return spread.select(*key, F.explode(named).alias("counter"))


def first_run_values(runs: DataFrame, key: list[str], columns: list[str], run: str = "run") -> DataFrame:
    """The columns' values in the first run of each key."""
    return runs.groupBy(*key).agg(*[F.min_by(c, run).alias(c) for c in columns])


def average_runs(runs: DataFrame, key: list[str], counters: list[str], time: str, memory: str) -> DataFrame:
    """Counters of the first run, mean and sample deviation of time and memory, and the number of runs."""
    means = runs.groupBy(*key).agg(
        *[F.avg(c).alias(c) for c in (time, memory)], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in (time, memory)], F.count("*").alias("Runs")
    )
    return first_run_values(runs, key, counters).join(means, key)

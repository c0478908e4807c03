"""Queries over ``events`` and ``orders``: one for each operator, with pattern columns as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permuta import functions as fn
from permuta import operators as op
from permuta import sources as src
from permuta.operators.compare import check_compared, differing_parts, first_differences, status_tally
from permuta.operators.prep import concat_sizes
from permuta.operators.summary import average_runs
from permuta.plans.sql import SQL
from permuta.sources.sinks import normalized_digest, rank_by_support, write_client_report, write_number_text
from permuta.storage import cut, new_folder

#: Threshold of the registered queries; no support of the test tables lies within 1e-6 of it.
SIGMA = 4.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series for each event type, by time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return src.positions(rows, ["ts", "event_id"], "value", "event_type", F.date_trunc("day", F.col("ts")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of order prices for each customer."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return src.positions(rows, ["o_orderdate", "o_orderkey"], "o_totalprice", "o_custkey")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.base_table(events(spark, sf_dir))


def level(spark: SparkSession, sf_dir: str, m: int) -> DataFrame:
    """Frequent patterns of m ranks of the closure, a written table."""
    return op.mine(events(spark, sf_dir), SIGMA, max_len=m).where(F.col("m") == m)


def shown(patterns: DataFrame) -> DataFrame:
    return patterns.select("series_id", "m", fn.pattern_text(F.col("pattern")).alias("pattern"), F.round("support", 6).alias("support"), "cnt", "first_pos", "last_pos")


def series_weights(spark, sf_dir):
    return base(spark, sf_dir).select("series_id", "pos", "v", "n", F.round("w", 9).alias("w"))


def events_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same series numbered without buckets."""
    return src.positions(spark.read.parquet(f"{sf_dir}/events.parquet"), ["ts", "event_id"], "value", "event_type")


def positions_by_range(spark, sf_dir):
    return events_by_range(spark, sf_dir)


def step_directions(spark, sf_dir):
    rows = src.previous_values(events_by_range(spark, sf_dir)).withColumn("step", fn.step_direction(F.col("v"), F.col("previous")))
    return rows.groupBy("series_id").agg(F.count_if(F.col("step") == 1).alias("ups"), F.count_if(F.col("step") == -1).alias("downs"), F.count_if(F.col("step").isNull()).alias("ties"))


def seed_support_m2(spark, sf_dir):
    return shown(op.frequent(op.pattern_support(op.seed_occurrences(base(spark, sf_dir))), SIGMA))


def _window_ranks(m):
    def query(spark, sf_dir):
        rows = op.window_occurrences(base(spark, sf_dir), m)
        return rows.select("series_id", "pos", fn.pattern_text(F.col("pattern")).alias("pattern"))

    return query


def _support_threshold(m):
    return lambda spark, sf_dir: shown(op.frequent(op.pattern_support(op.window_occurrences(base(spark, sf_dir), m)), SIGMA))


def _closure(m):
    return lambda spark, sf_dir: shown(level(spark, sf_dir, m))


def closure_all(spark, sf_dir):
    return shown(op.mine(events(spark, sf_dir), SIGMA))


def closure_all_positions(spark, sf_dir):
    return shown(op.mine(events(spark, sf_dir), SIGMA, strategy="positions"))


def closure_orders(spark, sf_dir):
    return shown(op.mine(orders(spark, sf_dir), 2.5))


def mine_threshold(spark, sf_dir):
    return shown(op.mine(events(spark, sf_dir), SIGMA, semantics="threshold", max_len=4))


def minsup_sweep(spark, sf_dir):
    found = op.mine_sweep(events(spark, sf_dir), fn.parse_thresholds("40,48,52,56,60,200"))
    return found.groupBy("series_id", "minsup").agg(F.count("*").alias("patterns"), F.max("m").alias("longest"), F.round(F.sum("support"), 6).alias("mass"))


def sweep_closure(spark, sf_dir):
    """Every level that a threshold reaches, for thresholds up to the whole mass of a pattern."""
    found = op.mine_sweep(events(spark, sf_dir), [8.0, 30.0, 90.0, 200.0])
    return found.groupBy("series_id", "minsup", "m").agg(F.count("*").alias("patterns"), F.round(F.sum("support"), 6).alias("mass"))


def closure_rising(spark, sf_dir):
    """The running total of each customer's orders: one pattern a length, up to the length of the series."""
    totals = orders(spark, sf_dir).withColumn("v", F.sum("v").over(Window.partitionBy("series_id").orderBy("pos")))
    return shown(op.mine(totals, 0.5))


def prefix_suffix_keys(spark, sf_dir):
    p = level(spark, sf_dir, 4).withColumnRenamed("pattern", "p")
    pattern = F.col("p")
    return p.select("series_id", fn.pattern_text(pattern).alias("pattern"), fn.pattern_text(fn.prefix(pattern)).alias("pre"), fn.pattern_text(fn.suffix(pattern)).alias("suf"))


def _candidate_pairs(m):
    def query(spark, sf_dir):
        pairs = op.candidate_pairs(level(spark, sf_dir, m))
        compatible = fn.groups_compatible(F.col("p"), F.col("q"))
        return pairs.select("series_id", fn.pattern_text(F.col("p")).alias("p"), fn.pattern_text(F.col("q")).alias("q"), compatible.alias("compatible"))

    return query


def pair_mass_by_level(spark, sf_dir):
    out = op.pair_mass(op.mine(events(spark, sf_dir), SIGMA, max_len=4))
    return out.withColumn("fan_out", F.round("fan_out", 6))


def group_labels(spark, sf_dir):
    p = level(spark, sf_dir, 3)
    return p.select("series_id", fn.pattern_text(F.col("pattern")).alias("pattern"), fn.group_label(F.col("pattern")).alias("grp"))


def _position_fusion(m):
    def query(spark, sf_dir):
        o = op.seed_occurrences(base(spark, sf_dir))
        for _ in range(m - 2):
            o = op.extend_occurrences(o)
        return shown(op.pattern_support(o))

    return query


def bound_tiers(spark, sf_dir):
    """Pairs of patterns mined at 1 and bounded at 1.5, so that every tier has some."""
    b = cut(src.base_table(orders(spark, sf_dir)))
    o, p = op.window_occurrences(b, 3), op.mine(b, 1.0, max_len=3).where("m = 3")
    tiers = op.bound_tiers(op.candidate_pairs(p), o, 1.5)
    return tiers.groupBy("tier").agg(F.count("*").alias("pairs"), F.round(F.sum("residual_bound"), 4).alias("residual"), F.round(F.sum("card_bound"), 4).alias("card"), F.round(F.sum("range_bound"), 4).alias("ranged"))


def skew_rate(spark, sf_dir):
    return op.skew_rate(op.candidate_pairs(level(spark, sf_dir, 4))).withColumn("skew_rate", F.round("skew_rate", 6))


def prune_rate(spark, sf_dir):
    return op.prune_rate(op.candidate_pairs(level(spark, sf_dir, 4)), SIGMA).withColumn("prune_rate", F.round("prune_rate", 6))


def occurrence_density(spark, sf_dir):
    return op.occurrence_density(level(spark, sf_dir, 4)).withColumn("density", F.round("density", 9))


def work_counters(spark, sf_dir):
    return op.work_counters(level(spark, sf_dir, 3), op.window_occurrences(base(spark, sf_dir), 3))


def generation_trace(spark, sf_dir):
    b = op.mine(events(spark, sf_dir), SIGMA)
    return op.generation_trace(b).withColumn("density", F.round("density", 9))


def canonical_text(spark, sf_dir):
    lines = src.canonical_lines(level(spark, sf_dir, 3).withColumn("support", F.round("support", 6)))
    return lines.select("series_id", "line")


def compare_sets(spark, sf_dir):
    """The same level with the default forgetting rate and with twice as much."""
    a = level(spark, sf_dir, 4)
    twice = base(spark, sf_dir).withColumn("k", 2 * F.col("k")).withColumn("w", fn.forgetting_weight(F.col("k"), F.col("n"), F.col("pos")))
    return op.comparison_status(a, op.mine(twice, SIGMA, max_len=4).where("m = 4")).withColumn("max_diff", F.round("max_diff", 6))


def compare_strategies(spark, sf_dir):
    """Ranked windows against fused positions: must be the same."""
    b = base(spark, sf_dir)
    ranked = cut(op.pattern_support(op.window_occurrences(b, 3)))
    fused = cut(op.pattern_support(op.extend_occurrences(op.seed_occurrences(b))))
    # Sums differ in their last bits by the order of adding, so six decimals are compared.
    compared = cut(op.comparison_status(*[x.withColumn("support", F.round("support", 6)) for x in (ranked, fused)]))
    check_compared(compared)
    return status_tally(compared)


def status_cases(spark, sf_dir):
    """A level against itself with one fault for each of five series; the sixth status has no series."""
    a = level(spark, sf_dir, 3).withColumn("support", F.round("support", 6))
    s = F.col("series_id")
    moved = F.when(s == "click", 1e-8).when(s == "error", 6e-7).when(s == "purchase", 0.5).otherwise(0.0)
    b = a.withColumn("support", F.col("support") + moved).where((s != "signup") | (F.element_at("pattern", 1) != 1)).where(s != "view")
    return op.comparison_status(a, b).withColumn("max_diff", F.round("max_diff", 4))


def common_patterns(spark, sf_dir):
    """Patterns of three and four ranks that the series of clicks, purchases and views share."""
    p = op.mine(events(spark, sf_dir), SIGMA, max_len=4).where("m > 2").withColumn("pattern", fn.pattern_text(F.col("pattern")))
    return op.common_keys([p.where(F.col("series_id") == x) for x in ("click", "purchase", "view")], ["m", "pattern"])


def variant_ratios(spark, sf_dir):
    """Configuration c1 against c2, one row a return flag and supplier."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = ["l_returnflag", "l_suppkey"]
    cases = rows.where("l_linenumber <= 2").groupBy(*key, "l_linenumber").agg(F.avg("l_extendedprice").alias("Time_s"))
    out = op.against_baseline(cases.where("l_linenumber = 1"), cases.where("l_linenumber = 2"), "Time_s", tuple(key))
    return out.select(*key, *[F.round(c, 6).alias(c) for c in ("base", "variant", "ratio")])


def set_differences(spark, sf_dir):
    p = shown(level(spark, sf_dir, 4))
    high = p.where("support >= 52")
    return first_differences(p, high).select("series_id", F.array_join("only_a", ";").alias("only_a"), F.coalesce(F.array_join("only_b", ";"), F.lit("")).alias("only_b"))


def normalized_sha(spark, sf_dir):
    return normalized_digest(level(spark, sf_dir, 3).withColumn("support", F.round("support", 4)), 4)


def repeat_series(spark, sf_dir):
    return op.repeat_series(events(spark, sf_dir), 3)


def unpivot_clients(spark, sf_dir):
    wide = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    wide = wide.withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return op.unpivot_clients(wide, "row", ["l_quantity", "l_extendedprice", "l_discount"])


def _clients(spark, sf_dir):
    wide = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").alias("a"), (F.col("o_custkey") * 2.0).alias("b"))
    return op.unpivot_clients(wide, "row", ["a", "b"])


def interleave_series(spark, sf_dir):
    return op.interleave_clients(_clients(spark, sf_dir), ["a", "b"], "both")


def concatenate_series(spark, sf_dir):
    return op.concatenate_clients(events(spark, sf_dir), ["click", "purchase", "view"], "joined")


def concatenated_sizes(spark, sf_dir):
    """The first one and three of five clients, end to end; ten aren't there."""
    clients, out = ["click", "error", "purchase", "signup", "view"], None
    series = events(spark, sf_dir).select("series_id", "pos", "v")
    for size in concat_sizes("1,3,10", len(clients)):
        part = op.concatenate_clients(series, clients[:size], f"clients_{size}")
        out = part if out is None else out.unionByName(part)
    return out


def number_text_lines(spark, sf_dir):
    whole = events(spark, sf_dir).withColumn("v", F.floor("v"))
    return src.number_lines(whole, 20)


def client_stats(spark, sf_dir):
    return op.client_stats(events(spark, sf_dir))


def _runs(spark, sf_dir):
    """Line items as benchmark rows: data set, configuration, run, time and a counter."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_returnflag").alias("Dataset"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("Configuration"), (F.col("l_suppkey") % 10).alias("run"), F.col("l_extendedprice").alias("Time_s"), F.col("l_quantity").alias("Fusions"))


def _summary(spark, sf_dir):
    return op.summarize_runs(_runs(spark, sf_dir), ["Dataset", "Configuration"], "Time_s")


def bench_summary(spark, sf_dir):
    s = _summary(spark, sf_dir)
    return s.select("Dataset", "Configuration", "n_runs", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "min", "max", "geo_mean")])


def best_config(spark, sf_dir):
    return op.best_config(_summary(spark, sf_dir), ["Dataset"], "Configuration", "median").withColumn("best_value", F.round("best_value", 4))


def win_counts(spark, sf_dir):
    return op.win_counts(_summary(spark, sf_dir), ["Dataset"], "Configuration", "median")


def relative_to_baseline(spark, sf_dir):
    return op.relative_to(_summary(spark, sf_dir), ["Dataset"], "Configuration", "median", "c1").withColumn("ratio", F.round("ratio", 6))


def pivot_methods(spark, sf_dir):
    out = op.pivot_metric(_summary(spark, sf_dir), "Dataset", "Configuration", "median", ["c1", "c2", "c3"])
    return out.select("Dataset", *[F.round(c, 4).alias(c) for c in ("c1", "c2", "c3")])


def unstable_counters(spark, sf_dir):
    return op.unstable_counters(_runs(spark, sf_dir), ["Dataset", "Configuration"], ["run", "Fusions"])


def same_work(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return op.same_work(rows, ["o_orderpriority"], ["o_orderstatus"])


def run_averages(spark, sf_dir):
    """Repeated runs of one data set are the lines of an order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("Dataset"), F.col("l_extendedprice").alias("run"), F.col("l_extendedprice").alias("Time_s"), F.col("l_tax").alias("MaxMem_MB"), F.col("l_quantity").alias("Fusions"))
    out = average_runs(rows, ["Dataset"], ["Fusions"], "Time_s", "MaxMem_MB")
    return out.select("Dataset", "Fusions", "Runs", *[F.round(c, 7).alias(c) for c in ("Time_s", "MaxMem_MB", "Time_s_std", "MaxMem_MB_std")])


def topk_patterns(spark, sf_dir):
    rounded = level(spark, sf_dir, 4).withColumn("support", F.round("support", 6))
    return rank_by_support(rounded).where("rank <= 10").select("series_id", fn.pattern_text(F.col("pattern")).alias("pattern"), "support", F.col("rank").cast("long").alias("rank"))


def canonical_files(spark, sf_dir):
    """Two results written side by side, a file a series, and read back."""
    p, folder = level(spark, sf_dir, 3).withColumn("support", F.round("support", 6)), new_folder(spark, "canonical")
    for minsup in fn.parse_thresholds("4, 200.0"):
        src.write_canonical_files(p.where(F.col("support") >= minsup), folder, minsup)
    return src.read_canonical(spark, folder)


def text_files(spark, sf_dir):
    """Series written as text files and read back by several tasks, two of them by their names."""
    folder = new_folder(spark, "text")
    write_number_text(events(spark, sf_dir).withColumn("v", F.floor("v")), folder)
    return src.read_text_series(spark, folder, r"(click|view)\.txt")


def file_checksums(spark, sf_dir):
    folder = new_folder(spark, "text")
    write_number_text(events(spark, sf_dir).withColumn("v", F.floor("v")), folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return src.file_digests(spark, folder, "*.txt", 1 << 12).select(name.alias("file"), "bytes", "sha256")


def client_report(spark, sf_dir):
    folder = new_folder(spark, "report")
    write_client_report(op.client_stats(events(spark, sf_dir)), folder)
    return spark.read.csv(folder, header=True, schema="Client string, Rows long, NonZero long, FirstNonZeroRow long, MaxValue double, OutputFile string")


def semicolon_clients(spark, sf_dir):
    """A wide table with decimal commas, written, read for two of its clients and unpivoted."""
    rows, folder = spark.read.parquet(f"{sf_dir}/orders.parquet"), new_folder(spark, "wide")
    comma = lambda c: F.regexp_replace(F.format_string("%.2f", F.col(c).cast("double")), r"\.", ",")
    wide = rows.select(F.col("o_orderkey").cast("string").alias("ts"), comma("o_totalprice").alias("MT_001"), comma("o_custkey").alias("MT_002"), comma("o_orderkey").alias("MT_003"))
    wide.write.csv(folder, sep=";", header=True, quote='"', quoteAll=True)
    return op.unpivot_clients(src.read_semicolon_csv(spark, folder, ["MT_001", "MT_003"]), "ts", ["MT_001", "MT_003"])


def _run_files(spark, sf_dir):
    """Line items as result files of two methods, a file for each run."""
    rows, folder = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), new_folder(spark, "runs")
    cases = rows.where("l_linenumber <> 3").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.min("l_extendedprice").alias("t"), F.max("l_quantity").alias("f"))
    name = F.format_string("%s_run_%02d.csv", F.when(F.col("l_linestatus") == "F", "fast").otherwise("open"), F.col("l_linenumber").cast("int"))
    line = F.concat_ws(",", F.concat("l_returnflag", F.lit(".txt")), F.lit("2.5"), F.format_string("%.2f", F.col("t").cast("double")), F.col("f").cast("long").cast("string"))
    src.write_named_files(cases.select(name.alias("name"), line.alias("line")), folder, "Dataset,minsup,Time_s,Fusions")
    return folder


def run_files(spark, sf_dir):
    """Runs of one method and the numbers of those that are missing."""
    rows, missing = src.read_runs(spark, _run_files(spark, sf_dir), "fast", 8)
    return rows.select("Dataset", F.col("run").cast("long").alias("run"), F.round("Time_s", 2).alias("Time_s"), F.col("Fusions").cast("long").alias("Fusions"), F.lit(",".join(map(str, missing))).alias("missing"))


def method_files(spark, sf_dir):
    folder = _run_files(spark, sf_dir)
    out = src.read_methods(spark, {"a": f"{folder}/fast_run_01.csv", "b": f"{folder}/open_run_02.csv"})
    return out.select("method", "Dataset", "minsup", F.round("Time_s", 2).alias("Time_s"), F.col("Fusions").cast("long").alias("Fusions"))


def text_patterns(spark, sf_dir):
    """Patterns from their text, with the least power of two that reaches their count."""
    p = shown(level(spark, sf_dir, 4))
    return p.select("series_id", "pattern", F.element_at(fn.text_pattern(F.col("pattern")), -1).alias("last"), fn.ceil_log2(F.col("cnt")).alias("bits"))


def result_differences(spark, sf_dir):
    """Parts of two digest lists that differ, where one side lacks a pattern and another's support has moved."""
    a = level(spark, sf_dir, 3).withColumn("support", F.round("support", 6))
    b = a.where((F.col("series_id") != "click") | (F.element_at("pattern", 1) != 1)).withColumn("support", F.col("support") + F.when(F.col("series_id") == "view", 0.5).otherwise(0.0))
    return differing_parts(a, b)


def file_comparison(spark, sf_dir):
    """``status_cases`` over two folders of written files."""
    a = level(spark, sf_dir, 3).withColumn("support", F.round("support", 6))
    s = F.col("series_id")
    moved = F.when(s == "click", 1e-8).when(s == "error", 6e-7).when(s == "purchase", 0.5).otherwise(0.0)
    b = a.withColumn("support", F.col("support") + moved).where((s != "signup") | (F.element_at("pattern", 1) != 1)).where(s != "view")
    folders = [src.write_canonical_files(x, new_folder(spark, "compared"), SIGMA) for x in (a, b)]
    out = op.compare_folders(spark, *folders)
    return out.select("file", "status", F.round("max_diff", 4).alias("max_diff"), "raw_a", "raw_b")


def summary_file(spark, sf_dir):
    """A summary of the whole closure, written and read back."""
    folder = new_folder(spark, "summary")
    src.write_summary(op.result_summary(op.mine(events(spark, sf_dir), SIGMA), SIGMA), folder)
    rows = spark.read.csv(folder, header=True, schema="Dataset string, minsup double, Length long, FreqPatterns long, MaxPattern long, Support double")
    return rows.withColumn("Support", F.round("Support", 6))


def hot_medians(spark, sf_dir):
    """Exact medians of keys with more values than a task may hold, by counting passes."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", F.col("l_extendedprice").alias("Time_s"))
    s = op.summarize_runs(rows, ["l_linestatus"], "Time_s", few=500)
    return s.select("l_linestatus", "n_runs", *[F.round(c, 4).alias(c) for c in ("median", "min", "max")])


QUERIES = {
    "series_weights": series_weights,
    "step_directions": step_directions,
    "seed_support_m2": seed_support_m2,
    **{f"window_ranks_m{m}": _window_ranks(m) for m in (3, 4, 5)},
    **{f"support_threshold_m{m}": _support_threshold(m) for m in (3, 4, 5)},
    **{f"closure_m{m}": _closure(m) for m in (3, 4, 5, 6)},
    **{f"candidate_pairs_m{m}": _candidate_pairs(m) for m in (3, 4)},
    **{f"position_fusion_m{m}": _position_fusion(m) for m in (3, 4)},
    **{
        f.__name__: f
        for f in (
            closure_all, closure_all_positions, closure_orders, mine_threshold, minsup_sweep, sweep_closure, prefix_suffix_keys, pair_mass_by_level, group_labels, bound_tiers, skew_rate, prune_rate,
            occurrence_density, work_counters, generation_trace, canonical_text, compare_sets, compare_strategies, status_cases, common_patterns, variant_ratios, set_differences, normalized_sha, repeat_series, unpivot_clients,
            interleave_series, concatenate_series, number_text_lines, client_stats, bench_summary, best_config, win_counts, relative_to_baseline, pivot_methods, unstable_counters,
            same_work, run_averages, topk_patterns, positions_by_range, closure_rising, canonical_files, text_files, file_checksums, client_report, semicolon_clients, run_files, method_files,
            text_patterns, result_differences, hot_medians, file_comparison, summary_file, concatenated_sizes,
        )
    },
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: SQL[k] for k in QUERIES if k in SQL}

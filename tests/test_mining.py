import math
import random

import pytest
from brute import closure, norm, occurrences
from pyspark.sql import functions as F

from permuta import functions as fn
from permuta import operators as op
from permuta import sources as src
from permuta.operators import bounds, levels

EXAMPLE = [15, 32, 29, 27, 34, 33, 25, 20, 28, 23]


def table(spark, *series):
    rows = [(f"s{i}", p + 1, float(v)) for i, t in enumerate(series) for p, v in enumerate(t)]
    return spark.createDataFrame(rows, "series_id string, pos long, v double")


def mined(df, sid="s0"):
    return {tuple(r["pattern"]): r["support"] for r in df.where(F.col("series_id") == sid).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    assert all(math.isclose(a[p], b[p], abs_tol=1e-6) for p in a)


def test_worked_example(spark):
    got = mined(op.mine(table(spark, EXAMPLE), 1.5, k=0.1))
    assert {p: round(s, 4) for p, s in got.items()} == {(1, 2): 1.9607, (2, 1): 4.2753, (1, 3, 2): 2.1669, (3, 2, 1): 2.1084, (2, 1, 3): 1.5114}


def test_worked_example_occurrences(spark):
    base = src.base_table(table(spark, EXAMPLE), 0.1)
    got = {}
    for m in (2, 3, 4):
        for r in op.window_occurrences(base, m).collect():
            got.setdefault(tuple(r["pattern"]), []).append(r["pos"])
    assert sorted(got[1, 3, 2]) == [3, 6, 10] and sorted(got[3, 2, 1]) == [4, 7, 8] and got[1, 4, 3, 2] == [4] and got[2, 4, 3, 1] == [7]


def test_closure_needs_frequent_parents(spark):
    series = table(spark, EXAMPLE)
    assert set(mined(op.mine(series, 2.05, k=0.1))) == {(2, 1), (3, 2, 1)}
    assert set(mined(op.mine(series, 2.05, k=0.1, semantics="threshold", max_len=3))) == {(2, 1), (3, 2, 1), (1, 3, 2)}


@pytest.mark.parametrize("strategy", ["windows", "positions"])
def test_no_pattern_is_lost_to_an_order_of_pairs(spark, strategy):
    got = mined(op.mine(table(spark, [4, 3, 2, 5]), 0.5, k=0.5, strategy=strategy))
    assert {p: round(s, 4) for p, s in got.items()} == {(2, 1): 0.9744, (1, 2): 1.0, (3, 2, 1): 0.6065, (2, 1, 3): 1.0, (3, 2, 1, 4): 1.0}


@pytest.mark.parametrize("seed", range(3))
def test_random_series_with_ties(spark, seed):
    rng = random.Random(seed)
    series = [[rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for _ in range(5)] + [[], [1], [2, 2], [1, 2]]
    k, sigma = rng.choice([None, 0.0, 0.05]), rng.choice([0.4, 1.0, 1.7])
    for strategy, chunk in (("windows", None), ("positions", None), ("auto", None), ("auto", 4)):
        got = op.mine(table(spark, *series), sigma, k=k, strategy=strategy, chunk=chunk)
        for i, t in enumerate(series):
            same(mined(got, f"s{i}"), closure(t, sigma, k))


def test_small_chunks_lose_no_window(spark):
    t = random.Random(5).sample(range(1000), 57)
    base = src.base_table(table(spark, t), 0.02)
    for m in (2, 3, 5):
        got = {(tuple(r["pattern"]), r["pos"]) for r in op.window_occurrences(base, m, chunk=4).collect()}
        assert got == {(p, pos) for p, at in occurrences(t, m, 0.02).items() for pos, _ in at}


def test_monotone_series_gives_one_pattern_a_length(spark):
    got = mined(op.mine(table(spark, range(16)), 0.5, k=0.0))
    assert set(got) == {tuple(range(1, m + 1)) for m in range(2, 17)}


def test_long_patterns_take_few_jobs(spark):
    n = 4096
    tracker, before = spark.sparkContext.statusTracker(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    series = spark.range(1, n + 1).select(F.lit("s0").alias("series_id"), F.col("id").alias("pos"), (F.col("id") * 3.0).alias("v"))
    got = op.mine(series, 0.5, k=0.0)
    want = F.transform(F.sequence(F.lit(1), F.col("m")), lambda x: x)
    row = got.agg(F.count("*").alias("rows"), F.count_if(F.col("pattern") == want).alias("rising"), F.sum("cnt").alias("windows"), F.sum(F.abs(F.col("support") - F.col("cnt"))).alias("off")).first()
    assert (row["rows"], row["rising"], row["windows"], row["off"]) == (n - 1, n - 1, sum(n - m + 1 for m in range(2, n + 1)), 0.0)
    assert len(tracker.getJobIdsForGroup(None)) - before < 250


def test_long_random_walks_match_brute_force(spark):
    rng = random.Random(11)
    rise = [10 * i + rng.random() for i in range(40)]
    series = [rise + rise[::-1] + rise, [5 * (i % 20) + i / 100 for i in range(90)], rise[:30] + [rise[29]] + rise[:30]]
    for chunk in (None, 16):
        got = op.mine(table(spark, *series), 1.5, k=0.0, chunk=chunk)
        for i, t in enumerate(series):
            same(mined(got, f"s{i}"), closure(t, 1.5, 0.0))
    assert max(len(p) for p in closure(series[1], 1.5, 0.0)) > 32


def test_lengths_bound_and_missing_positions(spark):
    rows = table(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]).where("pos <> 6")
    for top in (None, 1, 2, 3, 7, 8, 9, 20):
        got = mined(op.mine(rows, 0.5, k=0.0, max_len=top))
        assert set(got) == {tuple(range(1, m + 1)) for m in range(2, min(top or 6, 6) + 1)}
    assert got[1, 2] == 9.0


def test_ranks_above_127_by_position_join(spark):
    base = src.base_table(table(spark, range(140)), 0.0)
    o = op.seed_occurrences(base)
    p, q = list(range(1, 131)), list(range(1, 131))
    row = spark.createDataFrame([(p, q, 1.0, 2.0)], "p array<int>, q array<int>, a double, b double")
    assert row.select(fn.fuse_ranks(F.col("p"), F.col("q"), F.col("a"), F.col("b")).alias("r")).first()["r"] == list(range(1, 132))
    assert o.count() == 139


def test_ties_nan_and_null(spark):
    nan = float("nan")
    got = mined(op.mine(table(spark, [1, 1, 2, nan, 3, 0]), 0.1, k=0.0))
    assert got == {(1, 2): 1.0, (2, 1): 1.0}
    assert mined(op.mine(table(spark, [0.0, -0.0]), 0.1, k=0.0)) == {}
    holes = spark.createDataFrame([("s0", 1, None), ("s0", 2, 1.0), ("s0", 3, 2.0)], "series_id string, pos long, v double")
    assert set(mined(op.mine(holes, 0.1))) == {(1, 2)}


def test_threshold_is_inclusive(spark):
    assert mined(op.mine(table(spark, [1, 2, 1, 2]), 2.0, k=0.0)) == {(1, 2): 2.0}


def test_bad_parameters(spark):
    for sigma in (0, -1, float("inf"), float("nan")):
        with pytest.raises(ValueError):
            op.mine(table(spark, [1, 2]), sigma)
    with pytest.raises(ValueError):
        op.mine(table(spark, [1, 2]), 1.0, k=-0.1)
    with pytest.raises(ValueError):
        op.mine(table(spark, [1, 2]), 1.0, semantics="other")


def test_keys_of_length_four(spark):
    rows = spark.createDataFrame([([1, 2, 4, 3],), ([1, 3, 2, 4],), ([1, 4, 3, 2],)], "p array<int>")
    got = [tuple(map(tuple, r)) for r in rows.select(fn.prefix(F.col("p")), fn.suffix(F.col("p"))).collect()]
    assert got == [((1, 2, 3), (1, 3, 2)), ((1, 3, 2), (2, 1, 3)), ((1, 3, 2), (3, 2, 1))]


def test_groups_follow_from_keys(spark):
    from itertools import permutations

    pairs = [(list(p), list(q)) for p in permutations(range(1, 5)) for q in permutations(range(1, 5)) if norm(p[1:]) == norm(q[:-1])]
    df = spark.createDataFrame(pairs, "p array<int>, q array<int>")
    assert df.where(~fn.groups_compatible(F.col("p"), F.col("q"))).isEmpty()


def test_bounds_never_rule_out_a_frequent_child(spark):
    t = random.Random(9).sample(range(1000), 120)
    base, sigma = src.base_table(table(spark, t), 0.05), 0.8
    occ = op.window_occurrences(base, 3)
    patterns = op.frequent(op.pattern_support(occ), 0.05)
    tiers = op.bound_tiers(op.candidate_pairs(patterns), occ, sigma)
    ruled = {(tuple(r["p"]), tuple(r["q"])): r["tier"] for r in tiers.collect()}
    high = op.bound_tiers(op.candidate_pairs(patterns), occ, 3.0)
    assert "pass" in ruled.values() and {"residual"} <= {r["tier"] for r in high.collect()}
    for r in op.pattern_support(op.window_occurrences(base, 4)).where(F.col("support") >= sigma).collect():
        p = tuple(r["pattern"])
        assert ruled[norm(p[:-1]), norm(p[1:])] == "pass"


def test_positions_by_bucket(spark):
    rows = [(i, "a" if i % 3 else "b", float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "o int, s string, v double").repartition(7)
    plain = src.positions(df, ["o"], "v", "s").collect()
    bucketed = src.positions(df, ["o"], "v", "s", F.floor(F.col("o") / 16))
    assert sorted(plain) == sorted(bucketed.drop("n").collect())
    assert [(r["series_id"], r["pos"], r["v"]) for r in sorted(plain)] == [(s, p + 1, v) for s in "ab" for p, v in enumerate([v for _, t, v in rows if t == s])]
    assert {(r["series_id"], r["n"]) for r in bucketed.collect()} == {("a", 133), ("b", 67)}


def test_one_series_is_numbered_by_many_tasks(spark, monkeypatch):
    from permuta.sources import series as module

    written, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda d: written.append(cut(d)) or written[-1])
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.2 else "s", rng.choice([None, *range(500)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = src.number_rows(df, ["g"], ["o", "i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written[0].where("g = 's'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    for g in (None, "s"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert sorted((r["pos"], r["i"]) for r in got.collect() if r["g"] == g) == [(p + 1, r[2]) for p, r in enumerate(own)]
    assert src.number_rows(df.limit(0), ["g"], ["o"]).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        src.number_rows(df.withColumn("_at", F.lit(1)), ["g"], ["o"])


def test_previous_values_over_chunks(spark):
    series = table(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5], [7])
    for chunk in (1, 2, 4, 100):
        got = {(r["series_id"], r["pos"]): r["previous"] for r in src.previous_values(series, chunk).collect()}
        assert [got["s0", p] for p in range(1, 10)] == [None, 3, 1, 4, 1, 5, 9, 2, 6] and got["s1", 1] is None and len(got) == 10


def test_lengths_of_many_series(spark, monkeypatch):
    from permuta.sources import series as module

    rows = table(spark, [1, 2, 3], [4], [5, 6])
    want = sorted(map(tuple, src.with_lengths(rows).collect()))
    monkeypatch.setattr(module, "FEW_SERIES", 0)
    assert sorted(map(tuple, src.with_lengths(rows).collect())) == want and {r[3] for r in want} == {1, 2, 3}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_range_bound_counts_every_occurrence(spark, chunk):
    t = random.Random(2).sample(range(1000), 150)
    base = src.base_table(table(spark, t, t[::-1]), 0.02)
    occ = op.window_occurrences(base, 3)
    pairs = op.candidate_pairs(op.frequent(op.pattern_support(occ), 0.01))
    at = {}
    for r in occ.collect():
        at.setdefault((r["series_id"], tuple(r["pattern"])), []).append(r["pos"])
    seen = set()
    for sigma in (0.9, 4.0, 6.0, 12.0):
        for r in op.bound_tiers(pairs, occ, sigma, chunk).collect():
            p, q = at[r["series_id"], tuple(r["p"])], at[r["series_id"], tuple(r["q"])]
            seen.add(r["tier"])
            if r["range_bound"] is not None:
                inside = min(sum(r["low"] - 1 <= x <= r["high"] - 1 for x in p), sum(r["low"] <= x <= r["high"] for x in q))
                assert math.isclose(r["range_bound"], inside * math.exp(-r["k"] * (r["n"] - r["high"])))
                assert r["tier"] == ("range" if r["range_bound"] + 1e-12 < sigma else "pass")
            else:
                assert r["tier"] in ("residual", "span", "card")
    assert {"residual", "pass"} <= seen


def test_scalars(spark):
    assert fn.parse_thresholds("0.5, 2") == [0.5, 2.0] and fn.parse_thresholds(None)[0] == 2.0
    assert [fn.threshold_label(x) for x in (2.0, 2.5, 0.05, 100.0)] == ["2", "2p5", "0p05", "100"]
    row = spark.createDataFrame([([3, 1, 2],)], "p array<int>").select(fn.pattern_text(F.col("p")).alias("t"))
    assert row.first()["t"] == "[3, 1, 2]" and row.select(fn.text_pattern(F.col("t")).alias("p")).first()["p"] == [3, 1, 2]
    assert [r[0] for r in spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "x double").select(fn.ceil_log2(F.col("x"))).collect()] == [0, 1, 4]


def test_sweep_is_the_closure_of_each_threshold(spark):
    rng = random.Random(5)
    series = table(spark, [rng.randrange(30) for _ in range(300)], [rng.random() for _ in range(120)])
    keep = lambda d: sorted((r["series_id"], r["m"], tuple(r["pattern"]), round(r["support"], 9)) for r in d.collect())
    swept = op.mine_sweep(series, [9.0, 3.0, 20.0])
    for sigma in (3.0, 9.0, 20.0):
        assert keep(swept.where(swept.minsup == sigma)) == keep(op.mine(series, sigma))
    assert op.mine_sweep(series, [1e6]).count() == 0


def test_block_ends_where_supports_fall_below_the_threshold():
    # Of random values a pattern of m ranks has 1 / m! of the windows; of a rising series all of them.
    falling = {m: 760_000 / math.factorial(m) for m in range(2, 8)}
    assert levels._next_top(falling, 7, 40.0) == 8 and levels._next_top(falling, 7, 4.0) == 9
    assert levels._next_top({6: 500.0, 7: 500.0}, 7, 4.0) == 15 and levels._next_top({7: 500.0}, 7, 4.0) == 15


def test_short_series_are_mined_in_one_pass(spark, monkeypatch):
    rng = random.Random(5)
    base = src.base_table(table(spark, list(range(30)), [rng.randint(0, 40) for _ in range(60)], [rng.random() for _ in range(200)], [2.0, 2.0])).checkpoint()
    written, real = [], levels.cut
    monkeypatch.setattr(levels, "cut", lambda x: written.append(x) or real(x))
    short = mined_of(levels.closed_levels(base, [1.5, 4.0]))
    assert len(written) == 1
    monkeypatch.setattr(levels, "FEW_PATTERNS", 3)
    assert mined_of(levels.closed_levels(base, [1.5, 4.0], starts=16)) == short
    assert len(written) > 4


def mined_of(tables):
    return {(r["series_id"], tuple(r["pattern"]), round(r["support"], 9), r["cnt"], r["first_pos"], r["last_pos"], r["held"]) for x in tables for r in x.collect()}


def test_counts_of_first_chunks_need_no_join(spark):
    at = {"x": [1, 2, 5, 9, 14], "y": [3, 4]}
    o = spark.createDataFrame([("s", [1, 2] if g == "x" else [2, 1], p) for g, own in at.items() for p in own], "series_id string, pattern array<int>, pos long")
    asked = [(g, p) for g in at for p in (0, 1, 4, 9, 20)]
    q = spark.createDataFrame([("s", [1, 2] if g == "x" else [2, 1], p, g) for g, p in asked], "series_id string, pattern array<int>, pos long, name string")
    for chunk in (4, 100):
        got = bounds.counts_up_to(o, q, chunk)
        assert sorted((r["name"], r["pos"], r["upto"]) for r in got.collect()) == sorted((g, p, sum(x <= p for x in at[g])) for g, p in asked)
        assert ("Join" in got._jdf.queryExecution().executedPlan().toString()) == (chunk == 4)

import hashlib
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F
from test_mining import table

from permuta import operators as op
from permuta import sources as src
from permuta.operators import summary
from permuta.operators.compare import check_compared, differing_parts, status_tally
from permuta.operators.prep import concat_sizes
from permuta.operators.summary import average_runs, first_run_values
from permuta.sources.sinks import write_number_text, write_summary


def test_text_series(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 1 2.5\n3\t4e1\n")
    (tmp_path / "b.TXT").write_text("7")
    (tmp_path / "c.csv").write_text("9")
    rows = src.read_text_series(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("a.txt", 1, 1.0), ("a.txt", 2, 2.5), ("a.txt", 3, 3.0), ("a.txt", 4, 40.0), ("b.TXT", 1, 7.0)]
    assert {r[0] for r in src.read_text_series(spark, str(tmp_path), "a.*").collect()} == {"a.txt"}
    (tmp_path / "d.txt").write_text("x")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        src.read_text_series(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("separator", ["\n", " "])
def test_text_of_one_file_is_read_by_many_tasks(spark, tmp_path, separator):
    rng = random.Random(1)
    numbers = [str(rng.choice([rng.randint(0, 9), rng.randint(10**9, 10**10), rng.random()])) for _ in range(400)]
    text = "".join(x + rng.choice([separator, separator * 3, " \t", "\n"]) for x in numbers)
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("  \n ")
    (tmp_path / "c.txt").write_text("1")
    # The first block ends inside the first number longer than a digit.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(i for i in range(40, 4000) if text[i - 1 : i + 1].isdigit())))
    try:
        got = src.read_text_series(spark, str(tmp_path), separator=separator)
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 10
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, rows)) == [*[("a.txt", i + 1, float(x)) for i, x in enumerate(numbers)], ("c.txt", 1, 1.0)]


def test_semicolon_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"";"A";"B"\n"2011-01-01 00:15:00";1,5;0\n"2011-01-01 00:30:00";2;3,25\n')
    assert [tuple(r)[1:] for r in src.read_semicolon_csv(spark, str(tmp_path / "x.csv")).collect()] == [(1.5, 0.0), (2.0, 3.25)]
    with pytest.raises(ValueError, match="unknown clients: Z"):
        src.read_semicolon_csv(spark, str(tmp_path / "x.csv"), ["Z"])


def test_canonical_round_trip(spark, tmp_path):
    mined = op.mine(table(spark, [3, 1, 2, 5, 4, 6, 0, 1, 2]), 1.0)
    out = src.write_canonical(mined, str(tmp_path), 2.5)
    assert out.endswith("minsup_2p5")
    got = {r["pattern"]: round(r["support"], 10) for r in src.read_canonical(spark, f"{out}/series_id=s0").collect()}
    want = {r["pattern"]: round(r["support"], 10) for r in src.canonical_lines(mined).collect()}
    assert got == want


def test_number_text(spark, tmp_path):
    write_number_text(table(spark, range(45), [7]), f"{tmp_path}/o", 20)
    lines = (tmp_path / "o" / "s0.txt").read_text().splitlines()
    assert [len(x.split()) for x in lines] == [20, 20, 5] and " ".join(lines).split() == [str(float(x)) for x in range(45)]
    assert sorted(os.listdir(tmp_path / "o")) == ["s0.txt", "s1.txt"]


def test_named_files_appear_together_or_not_at_all(spark, tmp_path):
    lines = spark.createDataFrame([("a.csv", "2"), ("b.csv", "9"), ("a.csv", "1")], "name string, line string")
    out = f"{tmp_path}/out"
    src.write_named_files(lines, out, "head")
    assert {n: (tmp_path / "out" / n).read_text() for n in os.listdir(out)} == {"a.csv": "head\n1\n2\n", "b.csv": "head\n9\n"}
    bad = lines.withColumn("line", F.when(F.col("name") == "b.csv", F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    for broken in (bad, lines.withColumn("name", F.lit("x/y"))):
        with pytest.raises(Exception, match="lost|no file can be named"):
            src.write_named_files(broken, out)
        assert sorted(os.listdir(tmp_path)) == ["out"] and sorted(os.listdir(out)) == ["a.csv", "b.csv"]
    src.write_named_files(lines.where("name = 'b.csv'"), out)
    assert os.listdir(out) == ["b.csv"]


def test_files_are_hashed_piece_by_piece(spark, tmp_path):
    data = bytes(range(256)) * 100
    (tmp_path / "x y.bin").write_bytes(data)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "one.bin").write_bytes(b"1")
    got = {os.path.basename(r["path"]): (r["bytes"], r["sha256"]) for r in src.file_digests(spark, str(tmp_path), block=1000).collect()}
    assert got == {"x y.bin": (len(data), hashlib.sha256(data).hexdigest()), "one.bin": (1, hashlib.sha256(b"1").hexdigest())}


@pytest.mark.parametrize("few", [3, 40, 10**6])
def test_exact_medians_of_large_keys(spark, few):
    rng = random.Random(few)
    draw = {"a": lambda: rng.random(), "b": lambda: rng.choice([1.0, 2.0]), "c": lambda: 5.0, None: lambda: rng.gauss(0, 1e9), "d": lambda: float(rng.randint(0, 3)) if rng.random() < 0.5 else rng.random() * 3}
    rows = [(g, f()) for g, f in draw.items() for _ in range(rng.randint(900, 1001))] + [("e", 1.0), ("e", 2.0), ("f", None), ("g", 7.0), *[("h", float(i)) for i in [0] * 50 + [1] * 50]]
    df = spark.createDataFrame(rows, "g string, t double")
    got = {r["g"]: (r["n_runs"], r["median"]) for r in op.summarize_runs(df, ["g"], "t", few).collect()}
    for g in {r[0] for r in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g] == (len(own), statistics.median(own) if own else None)


def test_differences_are_located(spark):
    a = op.mine(table(spark, [rng for rng in random.Random(1).sample(range(10**6), 400)], [1, 2]), 0.01, max_len=5)
    changed = a.where("series_id = 's0' and m = 4").first()["pattern"]
    b = a.withColumn("support", F.when((F.col("pattern") == F.lit(changed)) & (F.col("series_id") == "s0"), F.col("support") + 1).otherwise(F.col("support")))
    assert differing_parts(a, a, lines=16).isEmpty()
    parts = differing_parts(a, b, lines=16).collect()
    assert len(parts) == 1 and parts[0]["series_id"] == "s0" and parts[0]["lines_a"] == parts[0]["lines_b"] < a.count() / 4
    lacks = differing_parts(a, a.where(F.col("pattern") != F.lit(changed)), lines=10**6).first()
    assert lacks["lines_a"] == lacks["lines_b"] + 1


def test_runs_and_averages(spark, tmp_path):
    for run, t in ((1, 1.0), (3, 3.0)):
        (tmp_path / f"hj_run_0{run}.csv").write_text(f"Dataset,minsup,Time_s,MaxMem_MB,Fusions\nd.txt,2,{t},10,{run}\n")
    rows, missing = src.read_runs(spark, str(tmp_path), "hj", 3)
    assert missing == [2]
    r = average_runs(rows, ["Dataset", "minsup"], ["Fusions"], "Time_s", "MaxMem_MB").first()
    assert (r["Fusions"], r["Time_s"], round(r["Time_s_std"], 6), r["Runs"]) == (1, 2.0, 1.414214, 2)
    assert first_run_values(rows, ["Dataset"], ["Time_s"]).first()["Time_s"] == 1.0
    assert [tuple(x) for x in op.unstable_counters(rows, ["Dataset"], ["Fusions", "MaxMem_MB"]).collect()] == [("d.txt", "Fusions")]
    bench = src.read_benchmark(spark, str(tmp_path / "hj_run_01.csv"), "hj").first()
    assert (bench["Dataset"], bench["method"], bench["minsup"]) == ("d", "hj", 2.0)


def test_manifest(spark, tmp_path):
    (tmp_path / "f.txt").write_bytes(b"abc")
    assert src.checksum_manifest(spark, str(tmp_path), "*.txt").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_comparison_statuses(spark):
    a = op.mine(table(spark, [3, 1, 2, 5, 4], [1, 2]), 0.5)
    moved = lambda d: a.withColumn("support", F.col("support") + d)
    status = lambda b: {r["series_id"]: r["status"] for r in op.comparison_status(a, b).collect()}
    assert set(status(a).values()) == {"SHA256_MATCH"}
    assert status(moved(3e-9))["s1"] == "NORMALIZED_SHA256_MATCH"
    assert set(status(moved(1e-3)).values()) == {"SUPPORT_MISMATCH"}
    assert status(a.where("m = 2"))["s0"] == "PATTERN_SET_MISMATCH"
    assert status(a.where("series_id = 's0'"))["s1"] == "MISSING_FILE"
    check_compared(op.comparison_status(a, a))
    with pytest.raises(AssertionError):
        check_compared(op.comparison_status(a, moved(1.0)))
    assert status_tally(op.comparison_status(a, a)).first()["raw"] == 2


def test_preparation(spark):
    s = table(spark, [1, 2], [3, 4])
    assert sorted((r["series_id"], r["pos"], r["v"]) for r in op.repeat_series(s, 2).where("series_id = 's0'").collect()) == [("s0", 1, 1.0), ("s0", 2, 2.0), ("s0", 3, 1.0), ("s0", 4, 2.0)]
    mixed = op.interleave_clients(s, ["s0", "s1"], "x").orderBy("pos").collect()
    assert [r["v"] for r in mixed] == [1.0, 3.0, 2.0, 4.0] and [r["pos"] for r in mixed] == [1, 2, 3, 4]
    assert [r["v"] for r in op.concatenate_clients(s, ["s0", "s1"], "x").orderBy("pos").collect()] == [1.0, 2.0, 3.0, 4.0]
    assert concat_sizes(None, 6) == [1, 5] and concat_sizes("2,3", 2) == [2]
    stats = op.client_stats(table(spark, [0, 0, -5])).first()
    assert (stats["n_rows"], stats["non_zero"], stats["first_non_zero_row"], stats["max_value"]) == (3, 1, 3, 0.0)


def test_client_report(spark, tmp_path):
    src.write_client_report(op.client_stats(table(spark, [0, 2], [3, 4])), f"{tmp_path}/r")
    rows = spark.read.csv(f"{tmp_path}/r", header=True)
    assert rows.columns == ["Client", "Rows", "NonZero", "FirstNonZeroRow", "MaxValue", "OutputFile"]
    assert sorted(tuple(r) for r in rows.collect()) == [("s0", "2", "1", "2", "2.0", "s0.txt"), ("s1", "2", "2", "1", "4.0", "s1.txt")]


def test_no_runs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        src.read_runs(spark, str(tmp_path), "hj", 3)


def test_canonical_files(spark, tmp_path):
    mined = op.mine(table(spark, [3, 1, 2, 5, 4], [1, 2]), 0.5)
    folder = src.write_canonical_files(mined, str(tmp_path), 0.5)
    assert sorted(os.listdir(folder)) == ["s0_minsup_0p5.csv", "s1_minsup_0p5.csv"]
    for sid in ("s0", "s1"):
        path = f"{folder}/{sid}_minsup_0p5.csv"
        lines = open(path).read().splitlines()
        assert lines[0] == "pattern,support" and lines[1:] == sorted(lines[1:])
        want = {r["pattern"] for r in src.canonical_lines(mined.where(mined.series_id == sid)).collect()}
        assert {r["pattern"] for r in src.read_canonical(spark, path).collect()} == want


def test_canonical_files_side_by_side(spark, tmp_path):
    (tmp_path / "a_minsup_2.csv").write_text('pattern,support\n"[1, 2]",3.0\n"[2, 1]",1.0\n"[2, 1]",2.0\n')
    (tmp_path / "b_minsup_2.csv").write_text('pattern,support\n"[1, 2]",7.0\n')
    got = sorted(map(tuple, src.read_canonical(spark, str(tmp_path)).collect()))
    assert got == [("a_minsup_2.csv", "[1, 2]", 3.0), ("a_minsup_2.csv", "[2, 1]", 2.0), ("b_minsup_2.csv", "[1, 2]", 7.0)]


def test_methods_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dataset,minsup,Time_s\nd.txt,2,1.5\n")
    (tmp_path / "b.csv").write_text("Dataset,minsup,Time_s,Fusions\nd.txt,2,3.0,7\n")
    rows = src.read_methods(spark, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "b.csv")})
    assert sorted((r["method"], r["Dataset"], r["Time_s"], r["Fusions"]) for r in rows.collect()) == [("a", "d", 1.5, None), ("b", "d", 3.0, 7)]
    pair = op.against_baseline(rows.where("method = 'b'"), rows.where("method = 'a'"), "Time_s").first()
    assert (pair["base"], pair["variant"], pair["ratio"]) == (3.0, 1.5, 2.0)
    with pytest.raises(Exception, match="repeated key"):
        op.against_baseline(rows, rows, "Time_s").collect()


def test_common_keys(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "p string, x int")
    two = spark.createDataFrame([("b",), (None,), ("c",)], "p string")
    assert {r["p"] for r in op.common_keys([one, two], ["p"]).collect()} == {"b", None}
    assert op.common_keys([one], ["p"]).count() == 3


def test_folders_are_compared_by_file(spark, tmp_path):
    a = op.mine(table(spark, [3, 1, 2, 5, 4], [1, 2], [2, 1, 3]), 0.5)
    b = a.withColumn("support", F.col("support") + F.when(F.col("series_id") == "s0", 3e-9).otherwise(0.0)).where("series_id <> 's2'")
    x, y = src.write_canonical_files(a, f"{tmp_path}/a", 0.5), src.write_canonical_files(b, f"{tmp_path}/b", 0.5)
    got = {r["file"]: r for r in op.compare_folders(spark, x, y).collect()}
    assert {f: r["status"] for f, r in got.items()} == {"s0_minsup_0p5.csv": "NORMALIZED_SHA256_MATCH", "s1_minsup_0p5.csv": "SHA256_MATCH", "s2_minsup_0p5.csv": "MISSING_FILE"}
    for f, r in got.items():
        for side, folder in (("a", x), ("b", y)):
            there = os.path.join(folder, f)
            assert r[f"raw_{side}"] == (hashlib.sha256(open(there, "rb").read()).hexdigest() if os.path.exists(there) else None)
    assert got["s0_minsup_0p5.csv"]["normalized_a"] == got["s0_minsup_0p5.csv"]["normalized_b"] and got["s2_minsup_0p5.csv"]["normalized_b"] is None


def test_summary_has_declared_columns(spark, tmp_path):
    mined = op.mine(table(spark, [3, 1, 2, 5, 4]), 0.5)
    summary = op.result_summary(mined, 0.5)
    write_summary(summary, f"{tmp_path}/s")
    row = spark.read.csv(f"{tmp_path}/s", header=True).first()
    assert (row["Dataset"], row["minsup"], row["Length"], int(row["FreqPatterns"])) == ("s0", "0.5", "5", mined.count())
    with pytest.raises(ValueError, match="Fusions"):
        write_summary(summary.withColumn("Fusions", F.lit(1)), f"{tmp_path}/t")


@pytest.mark.parametrize("hot", [10, 950, 10**6])
def test_rows_of_hot_keys_are_not_gathered(spark, hot):
    rng = random.Random(hot)
    rows = [(g, rng.random() if g != "c" else 5.0) for g, n in (("a", 2000), (None, 1500), ("b", 60), ("c", 999), ("d", 400)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, t double").repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    joined = []
    real, summary.cut = summary.cut, lambda x: joined.append(x._jdf.queryExecution().executedPlan().toString()) or real(x)
    try:
        got = {r["g"]: r["median"] for r in summary.exact_medians(df, ["g"], "t", 50, hot).collect()}
    finally:
        summary.cut = real
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {g: statistics.median(v for k, v in rows if k == g) for g in {r[0] for r in rows}}
    # With every key hot what is known of the keys is broadcast wherever rows meet it.
    assert hot > 10 or any("BroadcastHashJoin" in x for x in joined)

import math
import os
import random

import pytest
from brute import closure, occurrences
from pyspark.sql import functions as F

from permuta.streaming.occurrences import stream_windows, support_at
from permuta.streaming.supports import stream_supports, use_rocksdb


def test_stream_gives_the_batch_occurrences(spark, tmp_path):
    rng = random.Random(2)
    series = {s: [rng.randint(0, 9) for _ in range(30)] for s in "ab"}
    kinds = "series_id string, seq long, v double"
    for part in range(3):
        rows = [(s, i, float(t[i])) for s, t in series.items() for i in range(10 * part, 10 * part + 10)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream_windows(stream, 3).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    lengths = spark.createDataFrame([(s, len(t)) for s, t in series.items()], "series_id string, n long")
    got = {(r["series_id"], tuple(r["pattern"])): (round(r["support"], 9), r["cnt"]) for r in support_at(spark.table("found"), lengths, 0.1).collect()}
    want = {(s, p): (round(sum(w for _, w in at), 9), len(at)) for s, t in series.items() for p, at in occurrences(t, 3, 0.1).items()}
    assert got == want and spark.table("found").where(F.col("pos") < 3).isEmpty()


def run_stream(spark, tmp_path, batches, **options):
    """Rows that came out after each batch."""
    kinds = "series_id string, ts double, seq long, v double"
    out = []
    use_rocksdb(spark)
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(kinds).parquet(f"{tmp_path}/in")
            query = stream_supports(stream, **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out{0}")
            query.awaitTermination()
            done = spark.read.parquet(f"{tmp_path}/out0").collect() if i or os.listdir(f"{tmp_path}/out0") else []
            out.append([r for r in done if r not in [x for y in out for x in y]])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out


def test_supports_of_a_stream_equal_the_batch_at_each_trigger(spark, tmp_path):
    rng = random.Random(8)
    values = {s: [rng.choice([float(rng.randint(0, 9)), rng.random(), None]) if rng.random() < 0.1 else rng.random() for _ in range(60)] for s in "ab"}
    batches = []
    for part in range(3):
        rows = [(s, float(i), i, v[i]) for s, v in values.items() for i in range(20 * part, 20 * part + 20)]
        rng.shuffle(rows)
        batches.append(rows)
    got = run_stream(spark, tmp_path, batches, minsup=0.8, k=0.05, max_len=5)
    for part, rows in enumerate(got):
        for s, v in values.items():
            upto = [math.nan if x is None else x for x in v[: 20 * part + 20]]
            want = closure(upto, 0.8, 0.05, max_len=5)
            have = {tuple(r["pattern"]): r for r in rows if r["series_id"] == s}
            assert have.keys() == want.keys() and {r["n"] for r in have.values()} == {len(upto)} and len(want) > 10
            assert all(math.isclose(have[p]["support"], want[p], rel_tol=1e-9) for p in want)
            counts = {p: [pos for pos, _ in at] for m in range(2, 6) for p, at in occurrences(upto, m, 0.05).items()}
            assert all((r["cnt"], r["first_pos"], r["last_pos"], r["late"]) == (len(counts[p]), counts[p][0], counts[p][-1], 0) for p, r in have.items())


def test_rows_that_come_late(spark, tmp_path):
    rng = random.Random(9)
    v = [rng.random() for _ in range(50)]
    order = sorted(range(50), key=lambda i: i + rng.uniform(0, 4))
    first, second = order[:25], [i for i in order[25:] if i != 49]
    # A row of a time already handled is late; the last one moves all others on.
    batches = [[("s", float(i), i, v[i]) for i in first], [*[("s", float(i), i, v[i]) for i in second], ("s", 3.0, 99, 7.0)], [("s", 1000.0, 1000, 0.5)]]
    got = run_stream(spark, tmp_path, batches, minsup=0.5, k=0.1, max_len=4, delay=5.0)
    last = {tuple(r["pattern"]): r for r in got[-1]}
    want = closure(v[:49], 0.5, 0.1, max_len=4)
    assert last.keys() == want.keys() and {(r["n"], r["late"]) for r in last.values()} == {(49, 1)}
    assert all(math.isclose(last[p]["support"], want[p], rel_tol=1e-9) for p in want)


def test_stream_needs_sound_parameters(spark, tmp_path):
    rows = spark.createDataFrame([], "series_id string, ts double, seq long, v double")
    for bad in ({"minsup": 0.0, "k": 0.1, "max_len": 3}, {"minsup": 1.0, "k": -0.1, "max_len": 3}, {"minsup": 1.0, "k": 0.1, "max_len": 1}):
        with pytest.raises(ValueError):
            stream_supports(rows, **bad)

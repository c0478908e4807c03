"""Preparing series: repeating, reshaping and combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.sources.series import with_lengths


def repeat_series(series: DataFrame, times: int) -> DataFrame:
    """Each series end to end ``times`` times."""
    rows = (series if "n" in series.columns else with_lengths(series)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.select("series_id", (F.col("r") * F.col("n") + F.col("pos")).alias("pos"), "v")


def unpivot_clients(wide: DataFrame, row: str, clients: list[str]) -> DataFrame:
    """(series_id, pos, v): one series for each client column of a wide table; ``row`` counts from 1."""
    values = [F.struct(F.lit(c).alias("series_id"), F.col(f"`{c}`").cast("double").alias("v")) for c in clients]
    rows = wide.select(F.col(row).cast("long").alias("pos"), F.explode(F.array(*values)).alias("x"))
    return rows.select("x.series_id", "pos", "x.v")


def interleave_clients(series: DataFrame, clients: list[str], name: str) -> DataFrame:
    """One series that takes a value of every client in turn: pos = (row - 1) * size + client number from 1."""
    number = F.array_position(F.array(*[F.lit(c) for c in clients]), F.col("series_id"))
    rows = series.where(F.col("series_id").isin(clients))
    return rows.select(F.lit(name).alias("series_id"), ((F.col("pos") - 1) * len(clients) + number).alias("pos"), "v")


def concatenate_clients(series: DataFrame, clients: list[str], name: str) -> DataFrame:
    """One series of the clients' series one after the other."""
    rows = series.where(F.col("series_id").isin(clients))
    number = F.array_position(F.array(*[F.lit(c) for c in clients]), F.col("series_id"))
    sizes = rows.groupBy("series_id").agg(F.count("*").alias("n")).withColumn("i", number)
    # One row at most for each client asked for, so one task sums them up.
    earlier = Window.partitionBy(F.lit(name)).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("series_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(before, "series_id").select(F.lit(name).alias("series_id"), (F.col("pos") + F.col("before")).alias("pos"), "v")


def concat_sizes(sizes: str | None, clients: int) -> list[int]:
    """Numbers of clients to combine, 1, 5 and 10 by default; those above the clients there are left out."""
    wanted = [1, 5, 10] if not sizes else [int(x) for x in sizes.split(",")]
    if any(x < 1 for x in wanted):
        raise ValueError("a number of clients must be 1 or more")
    return [x for x in wanted if x <= clients]


def client_stats(series: DataFrame) -> DataFrame:
    """(client, n_rows, non_zero, first_non_zero_row, max_value); the maximum starts at 0."""
    on = F.col("v") != 0
    return series.groupBy(F.col("series_id").alias("client")).agg(
        F.count("*").alias("n_rows"), F.count_if(on).alias("non_zero"), F.min(F.when(on, F.col("pos"))).alias("first_non_zero_row"), F.greatest(F.lit(0.0), F.max("v")).alias("max_value")
    )

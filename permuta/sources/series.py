"""Series tables: (series_id, pos, v) with positions from 1, and the base table with weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permuta.functions import forgetting_weight
from permuta.storage import cut

#: Lengths of so many series are broadcast, some 100 bytes each.
FEW_SERIES = 20_000
#: Positions of a series that a task looks at together.
CHUNK = 1 << 16


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """``df`` with the 1-based number of each row in its group, by ``order``, nulls first; a null group is a group.

    Rows are range-partitioned by (group, order), so a group of any size is sorted by as many tasks as its
    share of the rows; a row's number is its place in its partition and the rows of its group in the
    partitions before, a table of one row a group and partition.  The order must be total, or equal rows may swap.
    """
    taken = {"_at", "_first", "_before", "_part", *[f"_g{i}" for i in range(len(group))]} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"reserved columns: {', '.join(sorted(taken))}")
    by = [F.col(f"`{c}`") for c in [*group, *order]]
    rows = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    keys = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(group)]
    # The upper bits of the id are the partition, the lower 33 the place in it.
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(*keys, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    names = [f"_g{i}" for i in range(len(group))]
    earlier = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_first", "_n"))
    same = part == F.col("_part")
    for i, c in enumerate(group):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}"))
    numbered = rows.join(sizes, same).withColumn(name, F.col("_at") + F.col("_before") + 1)
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], name)


def positions(df: DataFrame, order_by: list[str], value: str, series_id: Column | str, bucket: Column | None = None) -> DataFrame:
    """(series_id string, pos long, v double): rows of each series in the given order; by buckets also n, the length of the series.

    ``bucket`` is a non-decreasing function of the order, such as the day of a timestamp.  With it a
    long series is numbered bucket by bucket in one plan: positions inside a bucket plus the running
    count of the buckets before, a small table.  Without it rows are range-partitioned by series and order
    (``number_rows``), which sorts a single huge series by all tasks and checkpoints it.
    The order must be total in a series, or equal rows may swap.
    """
    sid = F.col(series_id) if isinstance(series_id, str) else series_id
    rows = df.select(sid.cast("string").alias("series_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_by)], (F.col(value).cast("double") + F.lit(0.0)).alias("v"), (bucket if bucket is not None else F.lit(0)).alias("_b"))
    order = [f"_o{i}" for i in range(len(order_by))]
    if bucket is None:
        return number_rows(rows.drop("_b"), ["series_id"], order).select("series_id", "pos", "v")
    sizes = rows.groupBy("series_id", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("series_id", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("series_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("series_id")).alias("n"))
    inside = rows.withColumn("_pos", F.row_number().over(Window.partitionBy("series_id", "_b").orderBy(*order)))
    joined = inside.join(before.withColumnRenamed("series_id", "_s").withColumnRenamed("_b", "_c"), F.col("series_id").eqNullSafe(F.col("_s")) & F.col("_b").eqNullSafe(F.col("_c")))
    return joined.select("series_id", (F.col("_pos") + F.col("_before")).cast("long").alias("pos"), "v", "n")


def with_lengths(series: DataFrame) -> DataFrame:
    """Series rows with n, their number in the series.

    Lengths are counted first, a row a series; up to ``FEW_SERIES`` of them are broadcast, so that a series isn't
    gathered at its key; more are joined, when no series holds most of the rows of a task.
    """
    lengths = cut(series.groupBy(F.col("series_id").alias("_s")).agg(F.count("*").alias("n")))
    few = lengths.count() <= FEW_SERIES
    return series.join(F.broadcast(lengths) if few else lengths, F.col("series_id").eqNullSafe(F.col("_s"))).drop("_s")


def previous_values(series: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Series rows with ``previous``: the value of the row before, null at the start.

    Positions count from 1 without a gap.  A series is dealt to tasks in chunks of positions; the last row
    of a chunk is repeated in the next.
    """
    own = F.floor((F.col("pos") - 1) / chunk)
    copies = F.when(F.col("pos") % chunk == 0, F.array(own, own + 1)).otherwise(F.array(own))
    rows = series.withColumn("_chunk", F.explode(copies))
    rows = rows.withColumn("previous", F.lag("v").over(Window.partitionBy("series_id", "_chunk").orderBy("pos")))
    return rows.where(F.col("_chunk") == own).drop("_chunk")


def base_table(series: DataFrame, k: float | None = None) -> DataFrame:
    """Series rows with n (length) and w (forgetting weight); k defaults to 1/n for each series."""
    if k is not None and not k >= 0:
        raise ValueError("k must be 0 or more")
    rate = F.lit(float(k)) if k is not None else F.lit(1.0) / F.col("n")
    joined = series if "n" in series.columns else with_lengths(series)
    # A negative zero counts as zero.
    return joined.select("series_id", "pos", (F.col("v") + F.lit(0.0)).alias("v"), "n", rate.alias("k"), forgetting_weight(rate, F.col("n"), F.col("pos")).alias("w"))

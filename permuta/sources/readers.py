"""Readers: text series, semicolon CSV, canonical patterns and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _file_name():
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)


def read_text_series(spark: SparkSession, path: str, file_regex: str | None = None, separator: str = "\n") -> DataFrame:
    """One series for each ``.txt`` file (any case): whitespace-separated numbers in reading order.

    ``file_regex`` must match a whole file name.  A part that isn't a number raises.  The series id is the file name.
    A large file is read by several tasks, each from a block that ends after a ``separator``; the numbers in the blocks
    before, found from the blocks' starts in the file, are a block's offset.  ``separator`` is one white space; where a file has
    all numbers in one line, ask for a space, since what stands between two separators is one row.
    """
    lines = spark.read.text(path, lineSep=separator)
    lines = lines.select(F.url_decode(_file_name()).alias("series_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.where(F.lower("series_id").endswith(".txt"))
    if file_regex is not None:
        lines = lines.where(F.col("series_id").rlike(f"^(?:{file_regex})$"))
    lines = lines.withColumn("parts", F.filter(F.split("value", r"\s+"), lambda x: x != "")).withColumn("n", F.size("parts")).where("n > 0").drop("value")
    blocks = lines.groupBy("series_id", "block").agg(F.sum("n").alias("n"))
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = blocks.select(F.col("series_id").alias("_s"), F.col("block").alias("_b"), earlier(["series_id"], "block").alias("before"))
    # The rows of a block come in order, so their numbers do.
    lines = lines.withColumn("inside", earlier(["series_id", "block"], "at"))
    lines = lines.join(before, (F.col("series_id") == F.col("_s")) & (F.col("block") == F.col("_b")))
    parts = lines.select("series_id", (F.col("before") + F.col("inside")).alias("start"), F.posexplode("parts").alias("p", "x"))
    return parts.select("series_id", (F.col("start") + F.col("p") + 1).cast("long").alias("pos"), F.col("x").cast("double").alias("v"))


def read_semicolon_csv(spark: SparkSession, path: str, clients: list[str] | None = None) -> DataFrame:
    """(ts, one double column for each client): ``;``-separated, quoted first column, decimal commas.

    ``clients`` names the columns wanted; an unknown name raises.
    """
    raw = spark.read.csv(path, sep=";", header=True, quote='"')
    names = raw.columns[1:]
    wanted = names if clients is None else clients
    unknown = sorted(set(wanted) - set(names))
    if unknown:
        raise ValueError(f"unknown clients: {', '.join(unknown)}")
    values = [F.regexp_replace(F.col(f"`{c}`"), ",", ".").cast("double").alias(c) for c in wanted]
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("ts"), *values)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """(file, pattern string, support double) from canonical files; of a pattern repeated in a file the last row there holds."""
    rows = spark.read.csv(path, header=True, schema="pattern string, support double", quote='"', recursiveFileLookup=True)
    rows = rows.select(F.url_decode(_file_name()).alias("file"), "pattern", "support", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"))
    return rows.groupBy("file", "pattern").agg(F.max_by("support", "_at").alias("support"))


def read_benchmark(spark: SparkSession, path: str, method: str) -> DataFrame:
    """A benchmark table with a method column, minsup as double and data set names without ``.txt``."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows.withColumns({"method": F.lit(method), "minsup": F.col("minsup").cast("double"), "Dataset": F.regexp_replace("Dataset", r"\.txt$", "")})


def read_methods(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The benchmark tables of all methods under each other; a column that one lacks is null there."""
    out = None
    for method, path in paths.items():
        rows = read_benchmark(spark, path, method)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("there is no method")
    return out


def read_runs(spark: SparkSession, folder: str, algorithm: str, runs: int) -> tuple[DataFrame, list[int]]:
    """Rows of ``<algorithm>_run_NN.csv`` with their run number, and the runs 1 to ``runs`` that are missing.

    No file at all raises.
    """
    glob = f"{algorithm}_run_*.csv"
    if spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path").isEmpty():
        raise FileNotFoundError(f"no runs of {algorithm} in {folder}")
    rows = spark.read.csv(folder, header=True, inferSchema=True, pathGlobFilter=glob)
    rows = rows.withColumn("run", F.regexp_extract(_file_name(), r"_run_(\d+)\.csv$", 1).cast("int")).where(F.col("run").between(1, runs))
    there = {r["run"] for r in rows.select("run").distinct().collect()}
    return rows, [r for r in range(1, runs + 1) if r not in there]

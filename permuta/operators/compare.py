"""Comparing two results: sets, supports, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permuta.sources.files import file_digests, stream_digests
from permuta.sources.readers import read_canonical
from permuta.sources.sinks import digest_list

TOLERANCE = 1e-6


def compare_patterns(a: DataFrame, b: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(series_id, n_a, n_b, only_a, only_b, max_diff, status) of two tables (series_id, pattern, support).

    status: PATTERN_SET_MISMATCH, SUPPORT_MISMATCH (a difference above ``tolerance``) or
    CONTENT_MATCH_TOLERANCE; MISSING_FILE for a series that only one side has.
    """
    left = a.select("series_id", "pattern", F.col("support").alias("sa"))
    right = b.select("series_id", "pattern", F.col("support").alias("sb"))
    both = left.join(right, ["series_id", "pattern"], "full")
    out = both.groupBy("series_id").agg(
        F.count("sa").alias("n_a"),
        F.count("sb").alias("n_b"),
        F.count_if(F.col("sb").isNull()).alias("only_a"),
        F.count_if(F.col("sa").isNull()).alias("only_b"),
        F.coalesce(F.max(F.abs(F.col("sa") - F.col("sb"))), F.lit(0.0)).alias("max_diff"),
    )
    status = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), "MISSING_FILE").when(F.col("only_a") + F.col("only_b") > 0, "PATTERN_SET_MISMATCH")
    return out.withColumn("status", status.when(F.col("max_diff") > tolerance, "SUPPORT_MISMATCH").otherwise("CONTENT_MATCH_TOLERANCE"))


def first_differences(a: DataFrame, b: DataFrame, n: int = 5) -> DataFrame:
    """(series_id, only_a, only_b): the first ``n`` pattern texts that one side lacks."""
    keys = ["series_id", "pattern"]
    sides = []
    for name, x, y in (("only_a", a, b), ("only_b", b, a)):
        rest = x.select(*keys).join(y.select(*keys), keys, "left_anti")
        # Spark keeps the first n of each task before the rows meet.
        rest = rest.withColumn("_r", F.row_number().over(Window.partitionBy("series_id").orderBy("pattern"))).where(F.col("_r") <= n)
        sides.append(rest.groupBy("series_id").agg(F.sort_array(F.collect_list("pattern")).alias(name)))
    return sides[0].join(sides[1], "series_id", "full")


def comparison_status(a: DataFrame, b: DataFrame, decimals: int = 6, tolerance: float = TOLERANCE) -> DataFrame:
    """``compare_patterns`` for tables of mined patterns, with SHA256_MATCH and NORMALIZED_SHA256_MATCH first."""
    from permuta.functions import pattern_text

    text = lambda t: t.select("series_id", pattern_text(F.col("pattern")).alias("pattern"), "support")
    out = compare_patterns(text(a), text(b), tolerance)
    for digits, status in ((decimals, "NORMALIZED_SHA256_MATCH"), (10, "SHA256_MATCH")):
        parts = differing_parts(a, b, digits).groupBy("series_id").agg(F.count("*").alias("n")).select(F.col("series_id").alias("_s"), F.lit(True).alias("differ"))
        out = out.join(parts, F.col("series_id").eqNullSafe(F.col("_s")), "left").withColumn("status", F.when(F.col("differ").isNull(), status).otherwise(F.col("status"))).drop("differ", "_s")
    return out


def differing_parts(a: DataFrame, b: DataFrame, decimals: int = 6, lines: int = 4096) -> DataFrame:
    """(series_id, part, lines_a, lines_b): parts of two results' digest lists that aren't the same; none if the results are."""
    x = digest_list(a, decimals, lines).select("series_id", "part", F.col("lines").alias("lines_a"), F.col("sha256").alias("_a"))
    y = digest_list(b, decimals, lines).select(F.col("series_id").alias("_s"), F.col("part").alias("_p"), F.col("lines").alias("lines_b"), F.col("sha256").alias("_b"))
    both = x.join(y, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")), "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.coalesce("series_id", "_s").alias("series_id"), F.coalesce("part", "_p").alias("part"), zero("lines_a"), zero("lines_b"))


def compare_folders(spark: SparkSession, a: str, b: str, decimals: int = 6, tolerance: float = TOLERANCE) -> DataFrame:
    """(file, status, max_diff, raw_a, raw_b, normalized_a, normalized_b) of two folders of canonical files, matched by name.

    raw is the digest of the file as it was written, normalized that of its sorted lines with ``decimals``; a file that
    one side lacks has nulls there.  status as in ``comparison_status``.
    """
    text, raw, normal = [], [], []
    for side, folder in (("a", a), ("b", b)):
        rows = read_canonical(spark, folder).withColumnRenamed("file", "series_id")
        text.append(rows)
        files = file_digests(spark, folder, "*.csv").select(F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1)).alias("series_id"), F.col("sha256").alias(f"raw_{side}"))
        raw.append(files)
        lines = rows.withColumn("line", F.format_string(f'"%s",%.{decimals}f', F.col("pattern"), F.col("support")))
        normal.append(stream_digests(lines, ["line"]).withColumnRenamed("sha256", f"normalized_{side}"))
    out = compare_patterns(*text, tolerance)
    for more in (*raw, *normal):
        out = out.join(more, "series_id", "left")
    status = F.when(F.col("raw_a") == F.col("raw_b"), "SHA256_MATCH").when(F.col("normalized_a") == F.col("normalized_b"), "NORMALIZED_SHA256_MATCH").otherwise(F.col("status"))
    return out.select(F.col("series_id").alias("file"), status.alias("status"), "max_diff", "raw_a", "raw_b", "normalized_a", "normalized_b")


def status_tally(compared: DataFrame) -> DataFrame:
    """One row: raw, normalized, tolerance and failed comparisons."""
    s = F.col("status")
    kinds = {"raw": "SHA256_MATCH", "normalized": "NORMALIZED_SHA256_MATCH", "tolerance": "CONTENT_MATCH_TOLERANCE"}
    failed = F.count_if(~s.isin(*kinds.values())).alias("failed")
    return compared.agg(*[F.count_if(s == v).alias(k) for k, v in kinds.items()], failed)


def check_compared(compared: DataFrame) -> None:
    """Raise if nothing was compared or anything failed."""
    row = status_tally(compared).first()
    if sum(row) == 0:
        raise FileNotFoundError("there is nothing to compare")
    if row["failed"]:
        raise AssertionError(f"{row['failed']} comparisons failed")


def common_keys(results: list[DataFrame], key: list[str]) -> DataFrame:
    """Distinct keys that every one of the results has; null keys are equal."""
    if not results:
        raise ValueError("there is no result")
    out = results[0].select(*key).distinct()
    for more in results[1:]:
        out = out.intersect(more.select(*key))
    return out


def same_work(runs: DataFrame, key: list[str], counters: list[str]) -> DataFrame:
    """Keys with the number of different counter values among their configurations, and whether it is one."""
    out = runs.groupBy(*key).agg(F.countDistinct(F.struct(*counters)).alias("variants"))
    return out.withColumn("same", F.col("variants") == 1)

"""Sinks: canonical pattern files, summaries, numeric text and checksum manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from permuta.functions import pattern_text, threshold_label
from permuta.sources.files import file_digests, stream_digests, write_named_files


def canonical_lines(patterns: DataFrame) -> DataFrame:
    """(series_id, pattern, support, line): the text of each pattern and its canonical line, support with ten decimals."""
    text = pattern_text(F.col("pattern"))
    return patterns.select("series_id", text.alias("pattern"), "support", F.format_string('"%s",%.10f', text, F.col("support")).alias("line"))


def write_canonical(patterns: DataFrame, path: str, minsup: float) -> str:
    """One folder a threshold, one part for each series, lines sorted by pattern text under ``pattern,support``."""
    out = f"{path}/minsup_{threshold_label(minsup)}"
    lines = canonical_lines(patterns).select("series_id", "pattern", F.format_string("%.10f", "support").alias("support"))
    lines.repartition("series_id").sortWithinPartitions("series_id", "pattern").write.partitionBy("series_id").csv(out, header=True, quote='"', mode="overwrite")
    return out


def write_canonical_files(patterns: DataFrame, path: str, minsup: float) -> str:
    """``<series>_minsup_<label>.csv`` for each series in a folder of the threshold: ``pattern,support``, sorted by pattern text; the folder.

    The files appear together or not at all.  A series whose name has a slash raises.
    """
    out = f"{path}/minsup_{threshold_label(minsup)}"
    lines = canonical_lines(patterns)
    name = F.concat("series_id", F.lit(f"_minsup_{threshold_label(minsup)}.csv"))
    write_named_files(lines.select(name.alias("name"), "pattern", "line"), out, "pattern,support", ["pattern"])
    return out


#: Columns of a summary file, in order.
SUMMARY = ["Dataset", "minsup", "Length", "FreqPatterns", "MaxPattern", "Support"]


def write_summary(metrics: DataFrame, path: str) -> None:
    """A folder of CSV parts with the columns of ``SUMMARY``, in that order; other columns raise."""
    other = sorted(set(metrics.columns) ^ set(SUMMARY))
    if other:
        raise ValueError(f"not the columns of a summary: {', '.join(other)}")
    metrics.select(*SUMMARY).write.csv(path, header=True, mode="overwrite")


def number_lines(series: DataFrame, line_width: int) -> DataFrame:
    """(series_id, line_no, value): ``line_width`` numbers on each line, in order of position."""
    line = F.floor((F.col("pos") - 1) / line_width)
    rows = series.groupBy("series_id", line.alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("x"))
    return rows.select("series_id", "line_no", F.array_join(F.transform("x", lambda r: r["v"].cast("string")), " ").alias("value"))


def write_number_text(series: DataFrame, path: str, line_width: int = 20) -> None:
    """``<series>.txt`` for each series in a folder, lines in order."""
    lines = number_lines(series, line_width).select(F.concat("series_id", F.lit(".txt")).alias("name"), "line_no", F.col("value").alias("line"))
    write_named_files(lines, path, order=["line_no"])


def write_client_report(stats: DataFrame, path: str) -> None:
    names = {"client": "Client", "n_rows": "Rows", "non_zero": "NonZero", "first_non_zero_row": "FirstNonZeroRow", "max_value": "MaxValue", "output_file": "OutputFile"}
    out = stats if "output_file" in stats.columns else stats.withColumn("output_file", F.concat("client", F.lit(".txt")))
    out.select(*[F.col(a).alias(b) for a, b in names.items()]).write.csv(path, header=True, mode="overwrite")


def checksum_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, sha256) of every file below ``path`` that fits the glob, of any size."""
    return file_digests(spark, path, glob).select("path", "sha256")


def rounded_lines(patterns: DataFrame, decimals: int) -> DataFrame:
    """(series_id, pattern text, line): canonical lines with supports of so many decimals."""
    text = pattern_text(F.col("pattern"))
    return patterns.select("series_id", text.alias("pattern"), F.format_string(f'"%s",%.{decimals}f', text, F.col("support")).alias("line"))


def normalized_digest(patterns: DataFrame, decimals: int = 6) -> DataFrame:
    """(series_id, sha256) of a result's sorted lines with rounded supports."""
    return stream_digests(rounded_lines(patterns, decimals), ["line"])


def digest_list(patterns: DataFrame, decimals: int = 6, lines: int = 4096) -> DataFrame:
    """(series_id, part, lines, sha256): a result as a list of digests of about ``lines`` lines each.

    Lines fall into a series' parts by the hash of their pattern, as many parts as its count asks for, to a power of 8; the
    same pattern falls into the same part of any result with as many parts, and a line that one side lacks spoils one part only.
    """
    each = rounded_lines(patterns, decimals)
    sizes = each.groupBy(F.col("series_id").alias("_s")).agg(F.count("*").alias("n"))
    bits = (3 * F.ceil(F.log2(F.greatest(F.col("n") / lines, F.lit(1.0))) / 3)).cast("int")
    rows = each.join(sizes, F.col("series_id").eqNullSafe(F.col("_s"))).withColumn("part", F.pmod(F.xxhash64("pattern"), F.call_function("shiftleft", F.lit(1).cast("long"), bits)))
    held = rows.groupBy("series_id", "part").agg(F.count("*").alias("lines"), F.sort_array(F.collect_list("line")).alias("x"))
    return held.select("series_id", "part", "lines", F.sha2(F.array_join("x", "\n"), 256).alias("sha256"))


def rank_by_support(patterns: DataFrame) -> DataFrame:
    """Patterns with rank inside series and length, by support descending, ties by pattern."""
    order = Window.partitionBy("series_id", "m").orderBy(F.desc("support"), "pattern")
    return patterns.withColumn("rank", F.row_number().over(order))

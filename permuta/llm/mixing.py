"""Mixing sources to target weights: Pareto order sampling over whole copies.

Every source gets a target of words; a document of a source is expected ``target / words``
times.  The whole part of that rate is allocated as certain copies.  For the fraction p left,
documents are ranked by their random odds ``u / (1 - u)`` divided by the inclusion odds
``p / (1 - p)``, and the head of that order is taken until the source's remaining words are met.
All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permuta.llm._store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of the Pareto rank; sums over them replace one long running sum for each source.
BUCKETS = 4096
#: So many sources at most are sent to the rows; a table of more meets them by a shuffle.
SOURCES = 4096
#: Parts into which each source's rows are dealt for that shuffle: one source may hold most rows.
SALTS = 64


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, cycle: tuple[int, ...], share: float, max_repeat: int) -> DataFrame:
    """Words each source should give.

    ``sizes`` has (source, source_size).  Sources in code-point order, null last, weigh the cycle's
    numbers in turn and share ``share`` of all words; a target above ``max_repeat`` times its
    source's size stops there and the excess goes to the others by weight.  With sources ordered
    by cap / weight, the capped ones are a head of that order, so running sums give the level.
    This table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in cycle]), ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int"))
    t = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(int(max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    caps_before, w_before = (F.coalesce(F.sum(c).over(order), F.lit(0)) for c in ("cap", "w"))
    # The level rises as long as sources below it are capped and falls after that: its maximum holds.
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - caps_before) / (F.sum("w").over(every) - w_before)
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return t.select("source", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap").cast("double")).alias("target"))


def with_copies(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    cycle: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    max_repeat: int = 3,
    seed: int = 17,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_copies (0 to ``max_repeat``) added.

    A source's taken words differ from its target by at most half of one document.  Null text has
    size 0; null source is a source of its own, last in order; null keys share one random number.
    Rows alike in source, key and size are taken or left together, so repeated rows and ties give the
    same result on every run.  An empty table gives no rows.  Columns of these names are replaced; all
    other columns come back unchanged, whatever they are called.

    Where a source's order is cut is found from sums over ranges of the rank and from the rows of the
    one range in which its words run out; every row is then decided by itself.  Keys, sources and sizes
    are written once, and so is what is known of each source after a step, so no step repeats another's work.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*added)
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, source, key = (f"c{names.index(c)}" for c in (text, source, key))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    u = uniform(F.col(key), seed)
    part = F.col("_part")
    ranked = (u / (F.lit(1.0) - u)) / (part / (F.lit(1.0) - part))
    slot = F.least(F.floor(F.lit(float(BUCKETS)) * F.col("_rank") / (F.lit(1.0) + F.col("_rank"))), F.lit(BUCKETS - 1))

    def placed(rows: DataFrame, by_source: DataFrame) -> DataFrame:
        if few:
            joined = rows.join(F.broadcast(by_source), rows["_source"].eqNullSafe(by_source["_s"]))
        else:
            dealt = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("_part_of", F.pmod(F.xxhash64(key, "_size"), F.lit(SALTS)).cast("int"))
            # A file's size says little about the rows dealt from it, so it isn't asked.
            joined = rows.join(dealt.hint("merge"), rows["_source"].eqNullSafe(dealt["_s"]) & (F.col("_part_of") == F.col("_salt"))).drop("_salt", "_part_of")
        return joined.withColumn("_rank", F.when(part > 0, ranked)).withColumn("_slot", F.when(part > 0, slot))

    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.keep(docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("_size")).withColumnRenamed("_key", key), "sizes")
    t = targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), cycle, share, max_repeat)
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    t = t.select(F.col("source").alias("_s"), F.col("source_size").alias("_words"), F.col("target").alias("_target"))
    t = t.withColumn("_whole", F.floor(rate)).withColumn("_part", rate - F.col("_whole")).withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_words"))
    t = scratch.keep(t, "targets")
    few = t.count() <= SOURCES

    sums = placed(rows, t).where(part > 0).groupBy("_s", "_slot", "_rest").agg(F.sum("_size").alias("words"))
    run = Window.partitionBy("_s").orderBy("_slot")
    sums = sums.withColumn("after", F.sum("words").over(run)).where(F.col("after") >= F.col("_rest"))
    edge = sums.groupBy("_s").agg(F.min(F.struct("_slot", (F.col("after") - F.col("words")).alias("before"))).alias("e")).select(F.col("_s").alias("_es"), F.col("e._slot").alias("_edge"), F.col("e.before").alias("_before"))
    t = scratch.keep(t.join(edge, t["_s"].eqNullSafe(edge["_es"]), "left").drop("_es"), "edges")
    inner = placed(rows, t).where(F.col("_slot") == F.col("_edge"))
    inside = Window.partitionBy("_s", "_slot").orderBy("_rank", key, "_size").rowsBetween(Window.unboundedPreceding, -1)
    inner = inner.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    place = F.struct("_rank", F.col(key).alias("k"), "_size")
    last = inner.where(F.col("_start") + F.col("_size") / 2 <= F.col("_rest")).groupBy(F.col("_s").alias("_ls")).agg(F.max(place).alias("_last"))
    t = scratch.keep(t.join(last, t["_s"].eqNullSafe(last["_ls"]), "left").drop("_ls", "_before"), "cuts")
    scratch.drop("sizes")

    out = placed(docs.withColumn("_source", F.col(source)).withColumn("_size", size), t)
    taken = (part > 0) & (F.col("_edge").isNull() | (F.col("_slot") < F.col("_edge")) | (F.col("_slot") == F.col("_edge")) & F.coalesce(place <= F.col("_last"), F.lit(False)))
    copies = (F.col("_whole") + F.when(taken, 1).otherwise(0)).cast("int")
    return out.select(*[F.col(c) for c in docs.columns], "_size", "_words", "_target", copies).toDF(*names, *added)


def pareto_mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **settings) -> DataFrame:
    """The mixture: each row of ``docs`` as often as ``with_copies`` takes it, columns unchanged."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    taken = with_copies(plain, *[f"c{names.index(c)}" for c in (text, source, key)], **settings)
    repeat = F.explode(F.expr("CASE WHEN mix_copies > 0 THEN sequence(1, mix_copies) ELSE array() END"))
    return taken.withColumn("mix_copy", repeat).select(*plain.columns).toDF(*names)

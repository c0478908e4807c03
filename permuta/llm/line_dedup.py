"""Incremental line dedup: exact reference counts of line keys, and sharded cuckoo filters of the frequent ones.

A line's key is the line without white space at its ends, A-Z lower-cased; keys are held as 128-bit hashes.
``counts`` says exactly in how many documents each key stands.  Keys that reach the threshold are put into the
filter of their shard, keys that fall below it are deleted from it, so after a deletion the index finds what it would
find had the documents never come.  Filters are small enough to travel to the documents, whose texts are never
shuffled; what a filter holds by chance is found among the exact counts and excepted.  Where the filters exceed
``FILTER_BYTES``, lines are joined with the counts instead, with the same result.
"""

from __future__ import annotations

import random
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permuta.llm._store import Scratch
from permuta.llm._text import mix

#: Frequent keys that a shard's filter is made for; it has twice the slots.
SHARD_KEYS = 1 << 14
#: Fingerprints of a bucket.
SLOTS = 4
#: Filters of this size in all are sent to the tasks, and this many keys that they hold by chance.
FILTER_BYTES, CHANCE_KEYS = 32 << 20, 100_000
#: Moves before a filter counts as full.
KICKS = 500

SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = "shard int, buckets int, full boolean, fingerprints binary"


def text_lines(text: Column) -> Column:
    """Lines of a text between line feeds; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # Of pure ASCII, ``lower`` changes A-Z alone, and is much faster than a translation.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(text: Column) -> Column:
    """(h1, h2) of each line's key; null for an empty key, which never counts."""
    keys = F.transform(text_lines(text), line_key)
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))


def key_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, docs): the rows of ``docs`` in whose text each key stands, summed in each task first."""
    once = docs.select(F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("k")).where("k IS NOT NULL")
    return once.groupBy("k.h1", "k.h2").agg(F.count("*").alias("docs"))


class Cuckoo:
    """Fingerprints of 32 bits in buckets of four; a key has two buckets, each told by the other and the fingerprint."""

    def __init__(self, fingerprints: np.ndarray):
        self.table = fingerprints.reshape(-1, SLOTS)

    @classmethod
    def empty(cls, buckets: int) -> Cuckoo:
        return cls(np.zeros(buckets * SLOTS, np.uint32))

    def _places(self, h1: np.ndarray, h2: np.ndarray):
        mask = np.uint64(len(self.table) - 1)
        mark = np.maximum(h2.astype(np.uint64) & np.uint64(0xFFFFFFFF), np.uint64(1))  # 0 is a free slot
        first = mix(h1.astype(np.uint64)) & mask
        return mark.astype(np.uint32), first.astype(np.int64), (first ^ (mix(mark) & mask)).astype(np.int64)

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(h1, h2)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, h1: np.ndarray, h2: np.ndarray) -> bool:
        """Whether all keys found room; a key inserted twice is there twice."""
        chance, mask = random.Random(0), len(self.table) - 1
        rows = self.table.tolist()
        for mark, a, b in zip(*(x.tolist() for x in self._places(h1, h2)), strict=True):
            at = a if 0 in rows[a] else b
            for _ in range(KICKS):
                if 0 in rows[at]:
                    rows[at][rows[at].index(0)] = mark
                    break
                i = chance.randrange(SLOTS)
                mark, rows[at][i] = rows[at][i], mark
                at ^= int(mix(np.array([mark], np.uint64))[0]) & mask
            else:
                return False
        self.table = np.array(rows, np.uint32)
        return True

    def delete(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """Take out one fingerprint of each key; the keys must have been inserted."""
        for mark, a, b in zip(*self._places(h1, h2), strict=True):
            at = a if (self.table[a] == mark).any() else b
            self.table[at, np.flatnonzero(self.table[at] == mark)[0]] = 0


def _shard(shards: int) -> Column:
    """Shard by the upper bits of h1, as ``_lookup`` tells it; the signed shift keeps the sign, the positive modulus drops it."""
    return F.pmod(F.shiftright("h1", 40), F.lit(shards)).cast("int")


def _change_filter(key, old: pa.Table, keys: pa.Table) -> pa.Table:
    """A shard's filter after its keys have come or gone; ``full`` if it has no room."""
    if old.num_rows:
        cuckoo = Cuckoo(np.frombuffer(old["fingerprints"][0].as_py(), np.uint32).copy())
    else:
        need = max(SHARD_KEYS, keys.num_rows)
        cuckoo = Cuckoo.empty(1 << int(2 * need / SLOTS - 1).bit_length())
    h1, h2, up = (keys[c].to_numpy() for c in ("h1", "h2", "change"))
    cuckoo.delete(h1[up < 0], h2[up < 0])
    full = not cuckoo.insert(h1[up > 0], h2[up > 0])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "buckets": pa.array([len(cuckoo.table)], pa.int32()), "full": [full], "fingerprints": pa.array([cuckoo.table.tobytes()], pa.binary())})


class LineIndex:
    """Reference counts and filters in a shared folder, a version for each change; ``open`` goes on from the last whole one.

    ``least``: documents from which a key is frequent.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, least: int = 10):
        self.spark, self.scratch, self.least, self.version, self.shards, self.made = spark, scratch, least, 0, 1, ""
        self.counted = ""

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> LineIndex:
        state = spark.read.json(f"{root}/state/*").orderBy(F.desc("version")).first()
        index = cls(spark, Scratch.at(spark, root), state["least"])
        index.version, index.shards, index.made, index.counted = (state[c] for c in ("version", "shards", "made", "counted"))
        return index

    @property
    def counts(self) -> DataFrame:
        """(h1, h2, docs) of every key that stands in a document."""
        if not self.version:
            return self.spark.createDataFrame([], "h1 long, h2 long, docs long")
        return self.spark.read.parquet(self.scratch.path(self.counted)).where("docs > 0").select("h1", "h2", "docs")

    @property
    def filters(self) -> DataFrame:
        """A row for each shard that has had frequent keys."""
        if not self.version:
            return self.spark.createDataFrame([], FILTERS)
        return self.spark.read.schema(FILTERS).parquet(self.scratch.path(self.made))

    @property
    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("docs") >= self.least).select("h1", "h2")

    def insert(self, docs: DataFrame) -> None:
        """Count every row of ``docs``, also one whose id was counted before."""
        self._change(key_counts(docs))

    def delete(self, docs: DataFrame) -> None:
        """Take back rows that were inserted; if a key was counted less often, this raises and the index stays as it was."""
        self._change(key_counts(docs).withColumn("docs", -F.col("docs")))

    def _change(self, delta: DataFrame) -> None:
        new, nothing = self.version + 1, self.spark.createDataFrame([], FILTERS)
        # A change that failed leaves tables behind that no state names.
        tag = f"{new}-{uuid.uuid4().hex}"
        both = self.counts.withColumn("was", F.col("docs")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        after = both.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.sum("was").alias("was"))
        known = F.when(F.col("docs") < 0, F.raise_error(F.lit("documents are deleted that were not inserted"))).otherwise(F.col("docs"))
        on, off = F.col("docs") >= self.least, F.col("was") >= self.least
        change = F.when(on & ~off, 1).when(off & ~on, -1).otherwise(0)
        counts = self.scratch.keep(after.select("h1", "h2", known.cast("long").alias("docs"), change.cast("int").alias("change")), f"counts{tag}")
        every = counts.where(F.col("docs") >= self.least).withColumn("change", F.lit(1))
        frequent, shards = every.count(), self.shards
        fresh = not self.version or frequent > SHARD_KEYS * shards * 3 // 2
        if fresh:
            shards = 1 << max(0, -(-frequent // SHARD_KEYS) - 1).bit_length()
        while True:
            made = f"filters{tag}-{shards}"
            old, keys = (nothing, every) if fresh else (self.filters, counts.where("change <> 0"))
            by = _shard(shards).alias("shard")
            changed = old.groupBy("shard").cogroup(keys.withColumn("shard", by).groupBy("shard")).applyInArrow(_change_filter, FILTERS)
            if self.scratch.keep(changed, made).where("full").isEmpty():
                break
            # A filter can't be widened without its keys: all are made anew from the exact counts.
            fresh, shards = True, shards * 2
        state = {"version": new, "least": self.least, "shards": shards, "made": made, "counted": f"counts{tag}"}
        self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in state.items()]).write.json(self.scratch.path(f"state/{tag}"))
        self.version, self.shards, self.made, self.counted = new, shards, made, state["counted"]

    def clean(self, docs: DataFrame, counted: bool = False) -> DataFrame:
        """``docs`` with n_lines, n_dropped and kept_text: the text without its lines of frequent keys.

        ``counted``: all of ``docs`` have been inserted, so their keys needn't be counted again.  Null and empty
        texts have one empty line, which stays; a caller's columns of the three names are replaced.
        """
        names = docs.columns
        plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
        text = F.col(f"c{names.index('text')}")
        size = self.filters.agg(F.sum(F.octet_length("fingerprints"))).first()[0] or 0
        rows = None
        if size <= FILTER_BYTES:
            tables = [None] * self.shards
            for r in self.filters.collect():
                tables[r["shard"]] = np.frombuffer(r["fingerprints"], np.uint32)
            sent = self.spark.sparkContext.broadcast(tables)
            rare = self.counts.where(F.col("docs") < self.least) if counted else key_counts(docs).join(self.frequent, ["h1", "h2"], "left_anti")
            chance = rare.select("h1", "h2").mapInArrow(_held(sent), "h1 long, h2 long").take(CHANCE_KEYS + 1)
            if len(chance) <= CHANCE_KEYS:
                rows = plain.withColumn("drop", _drops(sent, {(r[0], r[1]) for r in chance})(line_hashes(text)))
        if rows is None:
            rows = self._joined(plain, text)
        lines = text_lines(text)
        kept = F.array_join(F.filter(lines, lambda x, i: ~F.get(F.col("drop"), i)), "\n")
        own = [i for i, c in enumerate(names) if c not in ("n_lines", "n_dropped", "kept_text")]
        dropped = F.size(F.filter("drop", lambda x: x))
        out = rows.select(*[f"c{i}" for i in own], F.size("drop").cast("long"), dropped.cast("long"), kept)
        return out.toDF(*[names[i] for i in own], "n_lines", "n_dropped", "kept_text")

    def _joined(self, plain: DataFrame, text: Column) -> DataFrame:
        """Lines joined with the exact counts, for filters too large to send; a key in many documents is split by Spark's join."""
        rows = self.scratch.keep(plain.withColumn("rid", F.monotonically_increasing_id()), f"rows-{uuid.uuid4().hex}")
        lines = rows.select("rid", F.posexplode(line_hashes(text)).alias("i", "k")).where("k IS NOT NULL").select("rid", "i", "k.h1", "k.h2")
        drops = lines.join(self.frequent, ["h1", "h2"]).groupBy("rid").agg(F.collect_set("i").alias("at"))
        drop = F.transform(text_lines(text), lambda x, i: F.coalesce(F.array_contains("at", i), F.lit(False)))
        return rows.join(drops, "rid", "left").withColumn("drop", drop)


def _lookup(tables: list, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys the filter of their shard holds."""
    shard = (h1 >> 40) % len(tables)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(len(tables) + 1))
    out = np.zeros(len(h1), bool)
    for s, table in enumerate(tables):
        at = order[ends[s] : ends[s + 1]]
        if table is not None and len(at):
            out[at] = Cuckoo(table).holds(h1[at], h2[at])
    return out


def _held(sent):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_lookup(sent.value, b.column("h1").to_numpy(), b.column("h2").to_numpy())))

    return run


def _drops(sent, chance: set):
    """For each line whether its key is frequent: in its filter, and not by chance."""

    @F.arrow_udf("array<boolean>")
    def drops(hashes: pa.Array) -> pa.Array:
        values, sizes = hashes.flatten(), hashes.value_lengths().to_numpy()
        there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
        h1, h2 = (values.field(i).take(pa.array(there)).to_numpy() for i in (0, 1))
        hit = _lookup(sent.value, h1, h2)
        if chance:
            for i in np.flatnonzero(hit):
                hit[i] = (h1[i], h2[i]) not in chance
        out = np.zeros(len(values), bool)
        out[there[hit]] = True
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(out))

    return drops

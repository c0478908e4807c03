"""N-gram Jaccard join with adaptive multi-match prefixes.

A text is the set of its distinct 5-word shingles (64-bit hashes); equal sets are one entity.  In an
order of ascending frequency two sets of overlap >= a share l shingles in their prefixes of size - a + l,
for every l.  Each entity picks the l of least estimated cost from the frequencies in its prefix and
then needs l shared prefix shingles of a partner.  The shorter partner of a pair posts a shorter
prefix (its overlap bound is stronger), which keeps shingles of shared passages out of the index.

Only components are asked for, so a group of n near copies needn't give n * n pairs: in every bucket of
a prefix shingle the members are first verified against one pivot of like size.  The prefix join
then only pairs entities that these links left in different components, which loses no link between
components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permuta.llm import _text
from permuta.llm._components import components
from permuta.llm._store import Scratch

#: Counters of the frequency sketch, counters of a slice of it, shingles that a task adds at once.
COUNTERS, SLICE, FLUSH = 1 << 23, 1 << 15, 1_000_000
#: Steps of a counter for each doubling.
FINE = 8
#: Largest number of shared prefix shingles; cost of a verification in posting reads.
LEVELS, VERIFY = 6, 40
#: Rounds of links to other pivots end when less than this share of the tried pairs link.
YIELD = 0.1
#: Posting rows that a task holds before it passes them on.
RUN = 400_000
POSTINGS = "shingle long, ent long, n int, pos int, need int, level int, rank int, probe boolean"
#: A rank is the size class and below it how rare a set's prefix is: the least rank of a class is its centre.
CENTRE = 1 << 12
#: 64-bit words of an entity's bitmap: each of its bits is the parity of the shingles that hash to it.
PARITY = 32
POSTING = [c.split()[0] for c in POSTINGS.split(", ")]


def _size_class(n: np.ndarray) -> np.ndarray:
    """Sets of one class are so alike in size that they can link: the smaller has over 86 % of the larger."""
    return np.floor(np.log(n) / np.log(1.155)).astype(np.int64)


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    return np.unique(_text.shingle_hashes(h, k))


def entity(s: np.ndarray) -> int:
    """A 64-bit name of a set, with its size mixed in."""
    total = np.array([np.sum(_text.mix(s ^ np.uint64(0xD6E8FEB86659FD93))) + np.uint64(len(s))], np.uint64)
    return int(_text.mix(total).view(np.int64)[0])


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _tally(h: np.ndarray) -> pa.RecordBatch:
    """Rows (1, slice, weight, null, places) that add up to the occurrences of ``h`` by counter.

    A counter seen c times is in the rows of weights 1, 1, 2, 4 ... up to c in all, at least half of c.
    ``places`` are 16-bit places in the slice, or a bitmap of it where that is shorter.
    """
    at, c = np.unique(_counter(h), return_counts=True)
    slices, weights, places = [], [], []
    weight, reach = 1, 1
    while len(at):
        cut = np.searchsorted(at, np.arange(0, COUNTERS + 1, SLICE))
        for i in np.flatnonzero(np.diff(cut)):
            own = (at[cut[i] : cut[i + 1]] - i * SLICE).astype(np.uint16)
            if len(own) * 16 >= SLICE:
                bits = np.zeros(SLICE, bool)
                bits[own] = True
                own = np.packbits(bits)
            slices.append(int(i))
            weights.append(weight)
            places.append(own.tobytes())
        weight, reach = reach, 2 * reach
        at, c = at[c >= reach], c[c >= reach]
    kind = pa.array(np.ones(len(slices), np.int32))
    return pa.RecordBatch.from_arrays([kind, pa.array(slices, pa.int64()), pa.array(weights, pa.int64()), pa.nulls(len(slices), pa.int64()), pa.array(places, pa.binary()), *[pa.nulls(len(slices), pa.int64())] * PARITY], _PROFILE)


_BITS = [f"bits{i}" for i in range(PARITY)]
_PROFILE = ["kind", "id", "n", "ent", "places", *_BITS]


def parities(s: np.ndarray) -> np.ndarray:
    """Bitmap of a set: two sets differ in at least as many elements as their bitmaps in bits."""
    odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: id, size, entity and bitmap of each row; kind 1: slice, weight and places of shingles in the frequency sketch."""

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            n, ents, bits = [], [], np.zeros((batch.num_rows, PARITY), np.int64)
            for row, h in _text.documents(batch, "text"):
                s = shingle_set(h, k)
                e = entity(s) if len(s) else None
                n.append(len(s))
                ents.append(e)
                bits[row] = parities(s)
                if e is not None and e not in seen:
                    seen.add(e)
                    held.append(s)
                    size += len(s)
                if size > FLUSH:
                    yield _tally(np.concatenate(held))
                    held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), batch.column("id"), pa.array(n, pa.int64()), pa.array(ents, pa.int64()), pa.nulls(len(n), pa.binary()), *map(pa.array, bits.T.copy())], _PROFILE)
        if held:
            yield _tally(np.concatenate(held))
        _text.release()

    return docs.mapInArrow(run, "kind int, id long, n long, ent long, places binary" + "".join(f", {c} long" for c in _BITS))


def _frequencies(sketch: DataFrame, parts: int) -> np.ndarray:
    """About the number of texts of each counter, as ``FINE`` times the logarithm to base 2 of one more (8 bits a counter).

    Every shingle is counted.  The sketch has a fixed size: with more shingles each counter has more of
    the rare ones beside its own, so what stands out is a frequency far above the mean.  It shapes the
    order of shingles alone; any order gives the same links.
    """

    def add(batches):
        own, total = None, np.zeros(SLICE, np.int64)

        def row():
            level = np.minimum(np.round(FINE * np.log2(1 + total)), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([level.tobytes()], pa.binary())], ["id", "level"])

        for batch in batches:
            for i, weight, places in zip(*[batch.column(c).to_pylist() for c in ("id", "n", "places")], strict=True):
                if i != own:
                    if own is not None:
                        yield row()
                    own = i
                    total[:] = 0
                if len(places) * 8 == SLICE:
                    total += weight * np.unpackbits(np.frombuffer(places, np.uint8)).astype(np.int64)
                else:
                    total[np.frombuffer(places, np.uint16)] += weight
        if own is not None:
            yield row()

    level = np.zeros(COUNTERS, np.uint8)
    in_order = sketch.select("id", "n", "places").repartition(parts, "id").sortWithinPartitions("id")
    for r in in_order.mapInArrow(add, "id long, level binary").collect():  # COUNTERS bytes
        level[r["id"] * SLICE : (r["id"] + 1) * SLICE] = np.frombuffer(bytes(r["level"]), np.uint8)
    return level


def _postings(docs: DataFrame, k: int, percent: int, held) -> DataFrame:
    """Prefix shingles of each entity that a task meets: shingle, ent, n, pos, need, level, rank, probe, pivot, key.
    ``held`` is the broadcast of ``_frequencies``.

    ``rank`` orders entities by size class and then by the frequency of their prefix: a text that others are
    edited copies of has the fewest shingles of its own.  ``need`` is the entity's number of shared shingles as the longer partner, ``level`` the least need
    that reaches the shingle as the shorter one.  Of entities of like size with one shingle that a task
    holds together the first is the others' ``pivot``, and only its row has the shingle as ``key``: a
    shingle of very many texts sends a few rows to its bucket.  A first with company is its own pivot.
    """

    def run(batches):
        frequency = held.value
        about = np.exp2(np.arange(256) / FINE) - 1
        seen, out, size = set(), [], 0

        def grouped():
            shingle, ent, n, pos, need, level, rank, probe = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((ent, rank, shingle))
            shingle, ent, n, pos, need, level, rank, probe = (x[order] for x in (shingle, ent, n, pos, need, level, rank, probe))
            like = rank // CENTRE
            start = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (like[1:] != like[:-1])])
            first = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
            company = np.bincount(first, minlength=len(first))[first] > 1
            key = np.where(start, shingle.view(np.int64), _text.mix(shingle ^ ent.view(np.uint64)).view(np.int64))
            small = [pa.array(x.astype(np.int32, copy=False)) for x in (n, pos, need, level, rank)]
            return pa.RecordBatch.from_arrays([_as_long(shingle), pa.array(ent), *small, pa.array(probe), pa.array(ent[first], mask=~company), pa.array(key)], [*POSTING, "pivot", "key"])

        for batch in batches:
            for _, h in _text.documents(batch, "text"):
                s = shingle_set(h, k)
                n = len(s)
                if not n or (e := entity(s)) in seen:
                    continue
                seen.add(e)
                df = frequency[_counter(s)]
                order = np.argsort(df, kind="stable")  # equal ones by hash
                long_ = n - (percent * n + 99) // 100
                short = n - (2 * percent * n + 99 + percent) // (100 + percent)
                read = np.cumsum(about[df[order]])
                levels = range(1, min(LEVELS, n - long_) + 1)
                need = min(levels, key=lambda m: read[long_ + m - 1] * (1 + VERIFY / m))
                rows = min(n, max(long_ + need, short + LEVELS))
                pos = np.arange(rows, dtype=np.int32)
                common = int(FINE * 32 - df[order[:rows]].mean()) * CENTRE // (FINE * 32 + 1)
                rank = int(_size_class(n)) * CENTRE + common
                whole = lambda x: np.full(rows, x, np.int32)
                out.append((s[order[:rows]], np.full(rows, e, np.int64), whole(n), pos, whole(need), np.maximum(1, pos - short + 1), whole(rank), pos < long_ + need))
                size += rows
                if size > RUN:
                    yield grouped()
                    out, size, seen = [], 0, set()
        if out:
            yield grouped()
        _text.release()

    return docs.mapInArrow(run, f"{POSTINGS}, pivot long, key long")


def _buckets(batches):
    """Rows of shingles that several entities post, each with its pivot, from rows sorted by key, rank, ent,
    with the rows that had company in their task first among those of one entity.

    Rows that a task gave a pivot other than themselves pass.  The rest meets the firsts of other tasks:
    the first of a size class is the pivot, and a row without company anywhere goes.  One row and the
    running pivot are all that is kept between batches, however many rows a shingle has.
    """
    rest, last = None, None  # a row that may be alone; shingle, entity, size class and pivot of the row before
    names = [*POSTING, "pivot"]
    for batch in batches:
        passed = pc.fill_null(pc.not_equal(batch.column("pivot"), batch.column("ent")), False)
        if pc.any(passed).as_py():
            yield batch.filter(passed).select(names)
        batch = batch.filter(pc.invert(passed))
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
            rest = None
        if not batch.num_rows:
            continue
        sh, ent, rank = (batch.column(c).to_numpy() for c in ("shingle", "ent", "rank"))
        size = rank // CENTRE
        before = np.concatenate([[sh[0] if last and last[0] == sh[0] else ~sh[0]], sh[:-1]])
        ent_before = np.concatenate([[last[1] if last else 0], ent[:-1]])
        keep = ~((sh == before) & (ent == ent_before))
        i = np.flatnonzero(keep)
        if not len(i):
            continue
        sh, ent, size = sh[i], ent[i], size[i]
        start = np.concatenate([[not (last and last[0] == sh[0])], sh[1:] != sh[:-1]])
        alone = start & np.concatenate([start[1:], [True]])
        new = start | np.concatenate([[not (last and last[2] == size[0])], size[1:] != size[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(len(i)), -1))
        pivot = np.where(group >= 0, ent[np.maximum(group, 0)], last[3] if last else 0)
        if start[-1]:  # only the next batch tells whether it is alone
            rest = batch.slice(int(i[-1]), 1)
            last = (sh[-2], ent[-2], size[-2], pivot[-2]) if len(i) > 1 else last
            alone[-1] = True
        else:
            last = (sh[-1], ent[-1], size[-1], pivot[-1])
        company = pc.is_valid(batch.column("pivot")).to_numpy(zero_copy_only=False)[i]
        on = ~alone | company
        if rest is not None:
            on[-1] = False
        if on.any():
            kept = batch.take(pa.array(i[on])).select(POSTING)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(pivot[on])], names)
    if rest is not None and rest.column("pivot")[0].is_valid:
        yield pa.RecordBatch.from_arrays([*rest.select(POSTING).columns, rest.column("ent")], names)


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that were not verified before, in either order."""
    known = tried.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    return pairs.join(known, (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q")), "left_anti")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of pairs (a, b) of entities those whose sets pass, from the texts of one row of each entity."""
    wanted = pairs.select(F.col("a").alias("ent")).unionByName(pairs.select(F.col("b").alias("ent"))).distinct()
    where = rows.join(wanted, "ent", "left_semi").groupBy("ent").agg(F.min("id").alias("id")).select("id").distinct()

    def sets(batches):
        last = None  # rows that repeat a key stand together
        for batch in batches:
            ents, raw = [], []
            for _, h in _text.documents(batch, "text"):
                s = shingle_set(h, k)
                if len(s) and (e := entity(s)) != last:
                    ents.append(e)
                    raw.append(s.tobytes())
                    last = e
            yield pa.RecordBatch.from_arrays([pa.array(ents, pa.int64()), pa.array(raw, pa.binary())], ["ent", "s"])

    found = scratch.keep(docs.join(where, "id", "left_semi").select("text").mapInArrow(sets, "ent long, s binary"), f"{name}_sets")

    def check(batches):
        for batch in batches:
            on = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                i = np.searchsorted(y, x)
                both = int((y[np.minimum(i, len(y) - 1)] == x).sum())
                on.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    both = pairs.join(found.select(F.col("ent").alias("b"), F.col("s").alias("sb")), "b").join(found.select(F.col("ent").alias("a"), F.col("s").alias("sa")), "a")
    found = scratch.keep(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), name)
    scratch.drop(f"{name}_sets")
    return found


def _shared(apart: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """What two entities of different components share in their prefixes: a, b, x_n, y_n, y_need, shared, x_pos, y_pos.

    ``apart`` has a row for each entity of a shingle.  Shingles that just the same entities hold in the same
    roles are one bucket, so a pair meets once for all of them: ``shared`` is their number, and the
    positions are those of the last.  The shorter partner is a, by name where sizes are equal.
    """
    short = F.col("level") <= LEVELS
    role = F.xxhash64("ent", "probe", short)
    holders = apart.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(role).alias("bucket")).where("lo <> hi").select("shingle", "bucket")
    b = apart.join(holders, "shingle").groupBy("bucket", "ent").agg(
        *[F.max(c).alias(c) for c in ("n", "pos", "need", "c", "probe")], F.max(short).alias("short"), F.count("*").alias("shared")
    )
    b = b.join(bits, "ent")
    # Partners of x have x_n to 100 / percent * x_n shingles: they are in one or two classes of size.
    size = lambda n: F.floor(F.log(n) / F.log(F.lit(100 / percent))).cast("int")
    x = b.where("short").select("bucket", "shared", *[F.col(c).alias(f"x_{c}") for c in ("ent", "n", "pos", "c", *_BITS)])
    x = x.withColumn("size", F.explode(F.sequence(size(F.col("x_n")), size(F.col("x_n") * F.lit(100.0001 / percent)))))
    y = b.where("probe").select("bucket", size(F.col("n")).alias("size"), *[F.col(c).alias(f"y_{c}") for c in ("ent", "n", "pos", "need", "c", *_BITS)])
    # What can still be shared after the last common shingle bounds the overlap.
    left = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) + F.least("x_pos", "y_pos")
    # What their bitmaps differ in the sets differ in as well.
    differ = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in _BITS), F.lit(0))
    on = x.join(y, ["bucket", "size"]).where(
        (F.col("x_c") != F.col("y_c"))
        & ((F.col("x_n") < F.col("y_n")) | (F.col("x_n") == F.col("y_n")) & (F.col("x_ent") < F.col("y_ent")))
        & (100 * F.col("x_n") >= percent * F.col("y_n"))
        & ((100 + percent) * left >= percent * (F.col("x_n") + F.col("y_n")))
        & ((100 + percent) * (F.col("x_n") + F.col("y_n") - differ) >= 2 * percent * (F.col("x_n") + F.col("y_n")))
    )
    return on.select(F.col("x_ent").alias("a"), F.col("y_ent").alias("b"), "x_n", "y_n", "y_need", "shared", "x_pos", "y_pos")


def join_components(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """One row for each row of ``docs``: key, n_shingles, component_id.

    Rows link when 100 * intersection >= percent * union of their shingle sets (lower-cased A-Z, words
    ``[^\\x20\\x09-\\x0D]+``, the whole sequence where there are fewer than ``k``).  ``component_id`` is the
    smallest key reachable; null and wordless texts link with nothing and keep their own key.  Repeated
    rows and equal texts link; null keys take part and never name a component that has another key.
    """
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = scratch.keep(_profiles(d, k), "profiles")
    rows = profiles.where("kind = 0").select("id", "n", "ent")
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frequencies = d.sparkSession.sparkContext.broadcast(_frequencies(profiles.where("kind = 1"), parts))
    posted = _postings(d, k, percent, frequencies)
    sorted_ = posted.repartition(parts, "key").sortWithinPartitions("key", "rank", "ent", F.col("pivot").isNull())
    buckets = scratch.keep(sorted_.mapInArrow(_buckets, f"{POSTINGS}, pivot long"), "buckets")
    frequencies.destroy()

    # Links to pivots: of each entity the two pivots it meets most often.
    met = buckets.where("ent <> pivot").groupBy(F.col("ent").alias("b"), F.col("pivot").alias("a")).agg(F.count("*").alias("c"))
    first = met.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).where("r <= 2").select("a", "b")
    first = scratch.keep(first, "star_pairs")
    links = _verified(first, rows, d, k, percent, scratch, "star_links")
    reached = components(links, scratch, "star")

    # More links to the largest component of each bucket in a set's size class and the ones beside it: to its
    # centre first, then to another member each round.
    like = F.floor(F.col("rank") / CENTRE).cast("int")
    tried, b, r = first, buckets.drop("pivot"), 0
    while True:
        b = b.join(reached, b["ent"] == reached["id"], "left").withColumn("c", F.coalesce("component", "ent")).drop("id", "component")
        mixed = b.groupBy("shingle").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("shingle")
        b = scratch.keep(b.join(mixed, "shingle", "left_semi"), f"labelled{r}")
        scratch.drop(f"labelled{r - 1}" if r else "buckets")
        order = F.xxhash64("ent", F.lit(r)) if r else F.col("rank").cast("long")
        parts_ = b.groupBy("shingle", like.alias("like"), "c").agg(F.count("*").alias("size"), F.min(F.struct(order.alias("h"), "ent")).alias("one"))
        main = parts_.groupBy("shingle", "like").agg(F.max(F.struct("size", F.col("c").alias("main"), F.col("one.ent").alias("a"))).alias("m"))
        main = main.select("shingle", F.explode(F.sequence(F.col("like") - 1, F.col("like") + 1)).alias("like"), "m.main", "m.a")
        met = b.withColumn("like", like).join(main, ["shingle", "like"]).where("c <> main").groupBy(F.col("ent").alias("b"), "a").agg(F.count("*").alias("c"))
        more = met.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("c"), "a"))).where("r <= 3").select("a", "b")
        more = scratch.keep(_untried(more, tried), f"pairs{r}")
        tried = tried.unionByName(more)
        links = _verified(more, rows, d, k, percent, scratch, f"links{r}")
        if links.isEmpty():
            break
        reached = components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links), scratch, f"round{r}_")
        b, r = b.drop("c"), r + 1
        if links.count() < YIELD * more.count():
            break
    held = f"labelled{r if 'c' in b.columns else r - 1}"
    if "c" not in b.columns:
        b = b.join(reached, b["ent"] == reached["id"], "left").withColumn("c", F.coalesce("component", "ent"))

    # The prefix join between entities still in different components.
    apart = scratch.keep(b.select("shingle", "ent", "n", "pos", "need", "level", "probe", "c").dropDuplicates(["shingle", "ent"]), "apart")
    scratch.drop(held)
    bits = profiles.where("kind = 0").groupBy("ent").agg(*[F.first(c).alias(c) for c in _BITS])
    # All common shingles up to the last match are counted, so the rest bounds what may follow.
    pair = _shared(apart, bits, percent).groupBy("a", "b", "x_n", "y_n").agg(
        F.sum("shared").alias("m"), F.max("y_need").alias("need"), F.max("x_pos").alias("x_last"), F.max("y_pos").alias("y_last")
    )
    most = F.col("m") + F.least(F.col("x_n") - 1 - F.col("x_last"), F.col("y_n") - 1 - F.col("y_last"))
    second = _untried(pair.where((F.col("m") >= F.col("need")) & ((100 + percent) * most >= percent * (F.col("x_n") + F.col("y_n")))).select("a", "b"), tried)
    second = scratch.keep(second, "prefix_pairs")
    more = _verified(second, rows, d, k, percent, scratch, "prefix_links")
    if not more.isEmpty():
        reached = components(reached.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, "all")

    out = rows.join(reached.withColumnRenamed("id", "ent"), "ent", "left").withColumn("c", F.coalesce("component", "ent"))
    smallest = out.where("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    out = out.join(smallest, "c", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_first_of_group(docs: DataFrame, scratch: Scratch, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that represent their component (the smallest key), columns unchanged.

    Rows are told apart by a written number, not by their key: of rows of a component that repeat the
    smallest key the first written stays, and rows that link with nothing all stay, whatever their key.
    Null keys come after all others.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    docs = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    group = join_components(docs, scratch, text, row, k, percent).select(row, F.col("component_id").alias("_group"))
    keys = docs.select(F.col(row), F.col(key).cast("long").alias("_key")).join(group, row)
    first = keys.groupBy("_group").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", row)).alias("_first"))
    return docs.join(first.select(F.col(f"_first.{row}")), row, "left_semi").drop(row)

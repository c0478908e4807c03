"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Equal vectors are one class with a count.  Classes are assigned to the nearest of a label's
centroids.  Two unit vectors with cosine >= t are within d = sqrt(2 - 2t) of each other; if y is nearest to
centroid c' and x to c, x lies within d of the plane between c and c', that is x.(c - c') <= d|c - c'|.
So x visits exactly the cells for which that holds and no link is lost between cells.  A pair is
compared in the lower of its two home cells only.  A cell and its guests are sent once as long as each
fits a block of ``BLOCK_BYTES``; only larger cells are compared block against block, so that what is
shuffled grows with the vectors and their guests and not with pairs of blocks.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permuta.llm._components import components, local_components
from permuta.llm._store import Scratch

#: Vectors that a cell should hold, and bytes that all centroids may have (about twice that at most); cells grow where more would be needed.
CELL, CENTER_BYTES = 1500, 16_000_000
#: Bytes and least vectors of a block, and vectors of a side of one product inside a task.
BLOCK_BYTES, BLOCK, TILE = 8_000_000, 1024, 1024
#: Most cells of several blocks that are broadcast; more are joined.
BROADCAST_CELLS = 200_000
ROUNDS = 4


def _unit_rows(col) -> Iterator[np.ndarray | None]:
    """Unit vectors in double precision; None for null, empty, zero, or null or non-finite components."""
    for v in col:
        x = v.as_py()
        if not x or any(c is None for c in x):
            yield None
            continue
        x = np.array(x, np.float64)
        top = np.abs(x).max()
        if not np.isfinite(top) or top == 0:
            yield None
            continue
        x = x / top
        yield x / np.sqrt(x @ x)


def _classes(vectors: DataFrame) -> DataFrame:
    """One row for each distinct usable vector of a label: cid, rep, m, part, unit (float64 bytes)."""

    def run(batches):
        for batch in batches:
            keep, unit = [], []
            for i, x in enumerate(_unit_rows(batch.column("v"))):
                if x is not None:
                    keep.append(i)
                    unit.append(x.tobytes())
            b = batch.take(pa.array(keep, pa.int64())).select(["cid", "rep", "m", "part"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit, pa.binary())], ["cid", "rep", "m", "part", "unit"])

    rows = vectors.where("id is not null and label is not null and v is not null")
    one = rows.groupBy("cid").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("part").alias("part"), F.first("v").alias("v"))
    return one.mapInArrow(run, "cid long, rep long, m long, part string, unit binary")


def _matrix(col) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def _by_part(batch: pa.RecordBatch, wanted) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Rows and vectors of each part of a batch that is ``wanted``."""
    rows = defaultdict(list)
    for i, part in enumerate(batch.column("part").to_pylist()):
        if part in wanted:
            rows[part].append(i)
    unit = batch.column("unit")
    for part, own in rows.items():
        yield part, np.array(own), _matrix(unit.take(pa.array(own)))


def _chunks(x: np.ndarray, centers: np.ndarray) -> Iterator[np.ndarray]:
    """Slices of ``x`` whose products with all centroids stay small."""
    step = max(1, (1 << 21) // len(centers))
    for a in range(0, len(x), step):
        yield x[a : a + step]


def _linked(x: np.ndarray, y: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of linked rows of ``x`` and ``y``, tile by tile; each pair once where both are the ``same``."""
    for a in range(0, len(x), TILE):
        for b in range(a if same else 0, len(y), TILE):
            near = x[a : a + TILE] @ y[b : b + TILE].T >= threshold
            i, j = np.nonzero(np.triu(near, 1) if same and a == b else near)
            if len(i):
                yield a + i, b + j


def fit_cells(classes: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Unit centroids of each part (label and length) of more than one cell, by Lloyd steps over all its classes.

    A part that one cell holds has no centroid, so the number of labels costs the driver nothing.  Starts
    are the classes of smallest hash; sums of a step are aggregated over partitions in two steps.
    """
    spark = classes.sparkSession
    sizes = classes.groupBy("part").agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("width")).where(F.col("n") > CELL)
    needed = sizes.agg(F.sum(F.ceil(F.col("n") / CELL) * F.col("width")).alias("b")).first()["b"]
    if not needed:
        return {}
    cell = math.ceil(CELL * max(1.0, needed / CENTER_BYTES))
    # Parts of more than ``cell`` classes: no more than there are centroids.
    k = {r["part"]: math.ceil(r["n"] / cell) for r in sizes.where(F.col("n") > cell).collect()}
    if not k:
        return {}
    big = spark.createDataFrame(list(k.items()), "part string, k long").join(sizes, "part")
    chance = (3 * F.col("k") / F.col("n") * (1 << 30)).cast("long")
    starts = classes.join(F.broadcast(big.select("part", chance.alias("chance"))), "part").where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) <= F.col("chance"))
    centers = defaultdict(list)
    for r in starts.select("part", "unit").orderBy(F.xxhash64("cid"), "cid").toArrow().to_pylist():
        if len(centers[r["part"]]) < k[r["part"]]:
            centers[r["part"]].append(np.frombuffer(r["unit"], np.float64))
    out = {p: np.array(c) for p, c in centers.items()}
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(out)

        def sums(batches, held=held):
            total = {}
            for batch in batches:
                for part, _, x in _by_part(batch, held.value):
                    for chunk in _chunks(x, held.value[part]):
                        cell = (chunk @ held.value[part].T).argmax(1)
                        order = np.argsort(cell, kind="stable")
                        own, first = np.unique(cell[order], return_index=True)
                        for c, s in zip(own.tolist(), np.add.reduceat(chunk[order], first), strict=True):
                            total[part, c] = total[part, c] + s if (part, c) in total else s
            if total:
                at = np.cumsum([0, *map(len, total.values())]).astype(np.int32)
                flat = pa.ListArray.from_arrays(at, np.concatenate(list(total.values())))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in total]), pa.array([c for _, c in total], pa.int64()), flat], ["part", "cell", "s"])

        got = classes.mapInArrow(sums, "part string, cell long, s array<double>").withColumn("dealt", F.spark_partition_id() % 64)
        # One array for each of a 64th of the partitions, then one for each of these.
        for keys in (["part", "cell", "dealt"], ["part", "cell"]):
            got = got.groupBy(*keys).agg(F.collect_list("s").alias("all"))
            got = got.select(*keys, F.aggregate("all", F.transform(F.col("all")[0], lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("s"))
        for batch in got.toArrow().to_batches():
            lists = batch.column("s")
            for i, (part, c) in enumerate(zip(batch.column("part").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
                s = lists[i].values.to_numpy()
                if norm := np.linalg.norm(s):
                    out[part][c] = s / norm
        held.unpersist()
    return out


def link_vectors(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and not null, their vectors are as long as each other and the
    cosine in double precision is at least ``threshold``.  Null, empty, zero and non-finite vectors,
    vectors with null components and rows with a null id link with nothing (a null id has a null
    component and is not kept).  Equal vectors link with each other; a repeated row counts as another
    vector.  An empty table gives no rows.
    """
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    v = v.withColumn("part", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string"))).withColumn("cid", F.xxhash64("label", "v"))
    classes = scratch.keep(_classes(v), "classes")
    centers = fit_cells(classes)
    held = classes.sparkSession.sparkContext.broadcast(centers)
    reach = math.sqrt(2 - 2 * threshold) + 1e-9

    def place(batches):
        """Home cell (guest false) and visited lower cells (guest true) of each class; parts without centroids are one cell."""
        for batch in batches:
            n = batch.num_rows
            home, take, cell = np.zeros(n, np.int32), [], []
            for part, rows, x in _by_part(batch, held.value):
                c, at = held.value[part], 0
                for chunk in _chunks(x, c):
                    own = rows[at : at + len(chunk)]
                    at += len(chunk)
                    dot = chunk @ c.T
                    best = dot.argmax(1)
                    home[own] = best
                    met, which = np.unique(best, return_inverse=True)
                    gap = np.sqrt(np.maximum(0, 2 - 2 * c[met] @ c.T))[which]
                    near = dot[np.arange(len(chunk)), best][:, None] - dot <= reach * gap + 1e-9
                    near &= np.arange(len(c))[None, :] < best[:, None]
                    i, d = np.nonzero(near)
                    take.append(own[i])
                    cell.append(d)
            guests = np.concatenate([np.zeros(0, np.int64), *take])
            b = batch.take(pa.array(np.concatenate([np.arange(n), guests])))
            cells = np.concatenate([home, *cell]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(np.arange(len(cells)) >= n)], [*b.schema.names, "cell", "guest"])

    placed = scratch.keep(classes.mapInArrow(place, "cid long, rep long, m long, part string, unit binary, cell int, guest boolean"), "placed")
    sizes = placed.groupBy("part", "cell").agg(F.count_if(~F.col("guest")).alias("homes"), F.count_if("guest").alias("guests"), F.max(F.octet_length("unit")).alias("width"))
    block = F.greatest(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / F.col("width")))
    blocks = sizes.select("part", "cell", F.greatest(F.lit(1), F.ceil(F.col("homes") / block)).cast("int").alias("nh"), F.ceil(F.col("guests") / block).cast("int").alias("ng"))
    blocks = scratch.keep(blocks.where("nh > 1 or ng > 1"), "blocks")
    if blocks.count() <= BROADCAST_CELLS:
        blocks = F.broadcast(blocks)
    placed = placed.join(blocks, ["part", "cell"], "left").withColumns({"nh": F.coalesce("nh", F.lit(1)), "several": F.col("nh").isNotNull(), "ng": F.coalesce("ng", F.lit(0))})
    block = F.pmod(F.xxhash64("cid"), F.when(F.col("guest"), F.greatest(F.lit(1), "ng")).otherwise(F.col("nh"))).cast("int")
    # Units (i, j): home block i against home block j >= i, or against guest block j - nh.  A cell of one block and its guests are unit (0, 0).
    units = F.when(~F.col("several"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
    units = units.when(F.col("guest"), F.transform(F.sequence(F.lit(0), F.col("nh") - 1), lambda i: F.struct(i.alias("i"), (F.col("nh") + F.col("block")).alias("j"))))
    units = units.otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nh") + F.col("ng") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("i"), F.greatest(j, F.col("block")).alias("j")))
    )
    work = placed.withColumn("block", block).select("cid", "rep", "m", "unit", "part", "cell", "guest", "block", F.explode(units).alias("u"))
    work = work.withColumn("side", F.when(F.col("guest"), F.lit(1)).when(F.col("block") == F.col("u.i"), F.lit(0)).otherwise(F.lit(1)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # one unit: two blocks
        side = t.column("side").to_numpy()
        x = _matrix(t.column("unit"))
        cid, rep, m = (t.column(c).to_numpy() for c in ("cid", "rep", "m"))
        first = np.flatnonzero(side == 0)
        pairs = [(first, np.flatnonzero(side == 1), False)]
        if t.column("i")[0].as_py() == t.column("j")[0].as_py():
            pairs.append((first, first, True))
        links, ends = np.zeros(len(x), np.int64), []
        for a, b, same in pairs:
            for i, j in _linked(x[a], x[b], same, threshold):
                i, j = a[i], b[j]
                links += (np.bincount(i, m[j], len(x)) + np.bincount(j, m[i], len(x))).astype(np.int64)
                # Of a tile's links, those that hold its components together.
                met, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                label = local_components(len(met), at[: len(i)], at[len(i) :])
                ends.append(np.stack([met, met[label]]))
        on = np.flatnonzero(links)
        i, j = np.concatenate([np.zeros((2, 0), np.int64), *ends], 1)
        label = local_components(len(x), i, j)
        edge = np.flatnonzero(label != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([0, 1], [len(on), len(edge)]).astype(np.int32)), pa.array(np.concatenate([cid[on], rep[edge]])), pa.array(np.concatenate([links[on], rep[label[edge]]]))],
            ["kind", "a", "b"],
        )

    work = work.select("cid", "rep", "m", "unit", "side", "part", "cell", F.col("u.i").alias("i"), F.col("u.j").alias("j"))
    found = scratch.keep(work.groupBy("part", "cell", "i", "j").applyInArrow(compare, "kind int, a long, b long"), "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    reached = components(found.where("kind = 1").select("a", "b"), scratch).withColumnRenamed("id", "rep")
    classes = classes.select("cid", "rep", "m").join(counts, "cid", "left").join(reached, "rep", "left")
    out = v.withColumn("cid", F.when(F.col("id").isNotNull() & F.col("label").isNotNull(), F.col("cid"))).select("id", "cid").join(classes, "cid", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def keep_representatives(vectors: DataFrame, scratch: Scratch, threshold: float = 0.93, vec_id: str = "vec_id", **names: str) -> DataFrame:
    """The rows of ``vectors`` that represent their group (the smallest id), columns unchanged; rows of a null id link with nothing and stay."""
    plain = vectors.toDF(*[f"c{i}" for i in range(len(vectors.columns))])
    kept = link_vectors(vectors, scratch, threshold, vec_id, **names).where("kept").select("vec_id").distinct()
    own = plain[f"c{vectors.columns.index(vec_id)}"]
    with_id = plain.join(kept, own == kept["vec_id"], "left_semi")
    return with_id.unionByName(plain.where(own.isNull())).toDF(*vectors.columns)

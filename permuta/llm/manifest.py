"""Merkle manifest of a table: trees of digests whose nodes carry the interval of leaf ranks that they cover.

Leaves are numbered inside their group (range partitions and running counts, so a group of any size is
sorted by many tasks).  A node of level ``l`` over ``[lo, hi]`` stands in bucket ``lo >> l`` of its group and
level, so a node is attached to its ancestors by an equality of group and bucket plus containment of the
interval; what a parent's interval has besides the node's own names its sibling.  ``SPAN_BITS`` levels
are worked out at once from the leaves of one bucket of that level, so tasks hold 1024 digests, and a table of
n leaves takes log n / 10 rounds.  Group roots are the leaves of a top tree, built alike.

All of it is DataFrame code.  Digests are lowercase hex strings; intermediate tables are written to the
shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permuta.llm._store import Scratch
from permuta.sources.series import number_rows

#: Levels worked out in one pass over a bucket's digests.
SPAN_BITS = 10
#: A step of a path: the sibling (null where the run has one node) and whether it stands to the left.
STEP = "array<struct<left: boolean, digest: string>>"


def encoded(*columns: Column) -> Column:
    """The fields of a leaf one after another: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns])


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _next_level(nodes: Column) -> Column:
    """Digests of the runs of two nodes; a last run of one is hashed alone."""
    last = F.ceil(F.size(nodes) / 2) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: digest(F.concat(F.get(nodes, 2 * k), F.coalesce(F.get(nodes, 2 * k + 1), F.lit("")))))


def _levels(leaves: Column, height: Column) -> Column:
    """Digests level by level: ``height`` levels above the leaves."""
    up = F.slice(F.sequence(F.lit(1), F.greatest(height, F.lit(1))), F.lit(1), height)
    return F.aggregate(up, F.array(leaves), lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1)))))


def _path(levels: Column, height: Column, i: Column) -> Column:
    """Steps from node ``i`` of a bucket up to the bucket's root: at each level the rest of the parent's interval."""
    up = F.slice(F.sequence(F.lit(0), F.greatest(height - 1, F.lit(0))), F.lit(1), height)

    def step(level):
        at = F.call_function("shiftright", i, level).cast("int")
        return F.struct((at % 2 == 1).alias("left"), F.get(F.get(levels, level), at + 1 - 2 * (at % 2)).alias("digest"))

    return F.transform(up, step)


@dataclass
class Manifest:
    """The written rounds of the trees: ``rounds[j]`` has one row a bucket (g, leaves, count, b, lo, hi, height, levels).

    ``count`` is the group's number of nodes at the round's lowest level, ``leaves`` that of its leaves; a
    group's last bucket has its root.  The lowest round has ``carried`` too, the leaves' other columns.
    """

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        """(g, digest): the root of each group."""
        return _union([r.where(_last()).select("g", F.get(F.element_at("levels", -1), F.lit(0)).alias("digest")) for r in self.rounds])

    def nodes(self) -> DataFrame:
        """(g, level, lo, hi, digest) of every node; lo and hi are the ranks of the first and last leaf below it."""
        out = []
        for j, r in enumerate(self.rounds):
            # The top of a bucket is a node of the next round, if there is one for its group.
            levels = F.when(_last(), F.col("levels")).otherwise(F.slice("levels", F.lit(1), F.col("height")))
            each = r.select("g", "leaves", "b", F.posexplode(levels).alias("up", "digests")).select("g", "leaves", "b", "up", F.posexplode("digests").alias("i", "digest"))
            level = F.col("up") + j * SPAN_BITS
            k = F.call_function("shiftleft", F.col("b"), F.lit(SPAN_BITS) - F.col("up")) + F.col("i")
            hi = F.least(F.call_function("shiftleft", k + 1, level), F.col("leaves")) - 1
            out.append(each.select("g", level.alias("level"), F.call_function("shiftleft", k, level).alias("lo"), hi.alias("hi"), "digest"))
        return _union(out)


def _last() -> Column:
    """Whether a bucket holds its group's root."""
    return F.col("count") <= (1 << SPAN_BITS)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def build(numbered: DataFrame, scratch: Scratch, name: str) -> Manifest:
    """The tree of each group of ``numbered`` (g, r, digest, and columns to carry): r counts a group's leaves from 0 without a gap.

    A group's tree has ceil(log2(its leaves)) levels above the leaves.  No rows give no tree.
    """
    carried = [c for c in numbered.columns if c not in ("g", "r", "digest")]
    sizes = numbered.groupBy("g").agg(F.count("*").alias("leaves")).withColumnRenamed("g", "_g")
    cur = numbered.join(sizes, F.col("g").eqNullSafe(F.col("_g"))).drop("_g").withColumn("count", F.col("leaves"))
    rounds = []
    while True:
        # ceil(log2(count)) from whole numbers: the binary digits of count - 1.
        height = F.when(F.col("count") == 1, 0).when(_last(), F.length(F.bin(F.col("count") - 1))).otherwise(SPAN_BITS).cast("int")
        extra = [] if rounds else carried
        packed = cur.groupBy("g", "leaves", "count", F.shiftright("r", SPAN_BITS).alias("b")).agg(F.sort_array(F.collect_list(F.struct("r", "digest", *extra))).alias("x"))
        covered = 1 << (SPAN_BITS * (len(rounds) + 1))
        shown = [F.transform("x", lambda s: F.struct(*[s[c].alias(c) for c in extra])).alias("carried")] if extra else []
        packed = packed.select(
            "g", "leaves", "count", "b", (F.col("b") * covered).alias("lo"), (F.least((F.col("b") + 1) * covered, F.col("leaves")) - 1).alias("hi"), height.alias("height"),
            _levels(F.transform("x", lambda s: s["digest"]), height).alias("levels"), *shown,
        )
        rounds.append(scratch.keep(packed, f"{name}{len(rounds)}"))
        rest = rounds[-1].where(~_last())
        if rest.isEmpty():
            return Manifest(rounds)
        cur = rest.select("g", F.col("b").alias("r"), F.get(F.element_at("levels", -1), F.lit(0)).alias("digest"), "leaves", F.ceil(F.col("count") / (1 << SPAN_BITS)).alias("count"))


def paths(tree: Manifest, above: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The lowest round with ``outer``, the steps from each bucket's root to the top.

    ``above`` (g, outer) has the steps above each group's root, none if it is None.  Going down, a bucket is
    attached to the bucket of the round above that contains its interval.
    """
    outer = None
    for j in range(len(tree.rounds) - 1, -1, -1):
        own = tree.rounds[j]
        last = own.where(_last())
        if above is None:
            reached = last.withColumn("outer", F.expr(f"cast(array() as {STEP})"))
        else:
            reached = last.join(above.select(F.col("g").alias("_g"), "outer"), F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        if outer is not None:
            up = outer.select(*[F.col(c).alias(f"_{c}") for c in ("g", "b", "lo", "hi", "height", "levels", "outer")])
            inside = F.col("g").eqNullSafe(F.col("_g")) & (F.shiftright("b", SPAN_BITS) == F.col("_b")) & (F.col("lo") >= F.col("_lo")) & (F.col("hi") <= F.col("_hi"))
            steps = F.concat(_path(F.col("_levels"), F.col("_height"), F.col("b") % (1 << SPAN_BITS)), F.col("_outer"))
            reached = reached.unionByName(own.where(~_last()).join(up, inside).select(*own.columns, steps.alias("outer")))
        outer = reached if j == 0 else scratch.keep(reached, f"{name}{j}")
    return outer


def proof_digest(path: Column) -> Column:
    """Digest of the siblings of a path, from the leaf upwards."""
    return digest(F.array_join(F.filter(F.transform(path, lambda s: s["digest"]), lambda d: d.isNotNull()), ""))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def step(acc, s):
        return digest(F.when(s["digest"].isNull(), acc).when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])))

    return F.aggregate(path, leaf, step)


def verify_documents(docs: DataFrame, scratch: Scratch, suspect: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``documents``.

    A tree for each lang, leaves ascending by doc_id, null first, rows of one id by digest; langs bytewise, null first.  ``suspect``:
    rows whose n_chars is read one too large when their path is folded.  Repeated rows are leaves of their
    own; an empty table gives no rows; other columns don't count.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = digest(encoded(*fields))
    changed = digest(encoded(*[f + 1 if c == 3 else f for c, f in enumerate(fields)]))
    suspect = suspect if suspect is not None else F.lit(False)
    rows = docs.select(F.col("lang").alias("g"), "doc_id", leaf.alias("digest"), F.when(suspect, changed).alias("tampered"))
    numbered = number_rows(scratch.keep(rows, "leaves"), ["g"], ["doc_id", "digest"], "r").withColumn("r", F.col("r") - 1)
    trees = build(numbered, scratch, "tree")
    tops = number_rows(trees.roots().withColumn("top", F.lit(0)), ["top"], ["g"], "r")
    top = build(tops.select(F.col("top").alias("g"), (F.col("r") - 1).alias("r"), "digest", F.col("g").alias("lang")), scratch, "top")
    # Of the top tree each leaf is a group: its digest and the steps above it.
    above = paths(top, None, scratch, "reached").withColumn("x", _each_leaf(lambda s, i, leaf, path: F.struct(s["lang"].alias("g"), leaf.alias("subroot"), path.alias("outer"))))
    above = scratch.keep(above.select(F.inline("x")), "above")
    root = top.roots().first()  # one digest

    def shown(s, i, leaf, path):
        return F.struct(s["doc_id"].alias("doc_id"), leaf.alias("leaf"), proof_digest(path).alias("proof_sha256"), fold(F.coalesce(s["tampered"], leaf), path).alias("folded_root"))

    each = paths(trees, above.select("g", "outer"), scratch, "paths").select("g", F.inline(_each_leaf(shown)))
    out = each.join(above.select(F.col("g").alias("_g"), "subroot"), F.col("g").eqNullSafe(F.col("_g")))
    return out.withColumn("root", F.lit(root["digest"] if root else None).cast("string")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _each_leaf(shown) -> Column:
    """``shown(carried, i, digest, path)`` of every leaf of a bucket of the lowest round."""

    def one(s, i):
        # The outer lambda binds the path, which would else be worked out for each use.
        path = F.concat(_path(F.col("levels"), F.col("height"), i), F.col("outer"))
        leaf = F.get(F.get(F.col("levels"), F.lit(0)), i)
        return F.get(F.transform(F.array(path), lambda p: shown(s, i, leaf, p)), F.lit(0))

    return F.transform("carried", one)

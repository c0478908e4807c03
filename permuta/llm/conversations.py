"""Repair of conversation structure by a dynamic program over grammar-compressed role and fault sequences.

A row is one of nine symbols: to delete (blank or duplicate), or its role's initial (s, u, a, other) with or
without a truncated end.  Re-Pair replaces the most frequent pairs of neighbouring symbols in all sequences
by rules; counting and replacing are Spark SQL over the distinct sequences.  A symbol's effect is a
min-plus matrix over four states (nothing yet, after s, after u, after a) whose cells hold the least cost and
its audit, the letters of the edits, as a rope; a rule's matrix is the product of its two symbols', worked
out once, bottom-up, and shared by all conversations.  Of equal costs the ASCII-least audit is
kept; two audits of one cell and cost never extend each other, so products keep that order.

Rows are range-partitioned by conversation and turn, so a conversation of any length is dealt to many tasks and
cut into pieces of bounded size.  Pieces of conversations that may go on elsewhere are evaluated as whole
matrices and joined piece by piece; SHA-256 alone reads such a conversation's text in sequence, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permuta.llm._store import Scratch

#: Rows and characters of text from which a piece ends.
PIECE_ROWS, PIECE_CHARS = 1024, 1 << 20
#: Re-Pair rounds; a round takes the most frequent pairs that share no symbol. They shape the work, never the result.
ROUNDS, PAIRS = 8, 64
#: Sequences whose best audit a worker remembers.
REMEMBERED = 1 << 14

#: Costs of edits.
INSERT, RETAIN_TRUNCATED, DELETE, REROLE = 5, 5, 2, 1
START, AFTER_S, AFTER_U, AFTER_A = range(4)
USER = ((START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U))
ASSISTANT = ((AFTER_U, AFTER_A),)
MOVES = {"s": ((START, AFTER_S),), "u": USER, "a": ASSISTANT, "o": ()}
#: Terminals in order: delete, then each initial whole and truncated.
TERMINALS = "abcdefghi"
KINDS = [None, *[(who, cut) for who in "suao" for cut in (False, True)]]
FIRST_RULE = 0x1000


class Rope:
    """A cost and a string of edits, joined without copying."""

    __slots__ = ("code", "cost", "left", "right", "size", "text")
    MOD, BASE = (1 << 61) - 1, 911382323

    def __init__(self, cost: int, text: str = "", left: Rope | None = None, right: Rope | None = None):
        self.cost, self.text, self.left, self.right = cost, text, left, right
        if left is None:
            self.size, code = len(text), 0
            for c in text:
                code = (code * self.BASE + ord(c)) % self.MOD
            self.code = code
        else:
            self.size = left.size + right.size
            self.code = (left.code * pow(self.BASE, right.size, self.MOD) + right.code) % self.MOD

    def then(self, other: Rope) -> Rope:
        if not other.size and not other.cost:
            return self
        return other if not self.size and not self.cost else Rope(self.cost + other.cost, "", self, other)

    def letters(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                out.append(r.text)
            else:
                todo += [r.right, r.left]
        return "".join(out)

    def before(self, other: Rope) -> bool:
        """Less by cost, then by letters; equal parts are skipped by their hash."""
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b = [self], [other]
        while a and b:
            x, y = a[-1], b[-1]
            if x.size == y.size and x.code == y.code:
                a.pop(), b.pop()
            elif x.left is not None and (y.left is None or x.size >= y.size):
                a.pop()
                a += [x.right, x.left]
            elif y.left is not None:
                b.pop()
                b += [y.right, y.left]
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                for stack, r in ((a, x), (b, y)):
                    stack.pop()
                    if r.size > n:
                        stack.append(Rope(0, r.text[n:]))
        return bool(b)


Matrix = dict[tuple[int, int], Rope]


def _put(m: Matrix, cell: tuple[int, int], rope: Rope) -> None:
    if cell not in m or rope.before(m[cell]):
        m[cell] = rope


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = {}
    for (i, j), x in a.items():
        for (k, n), y in b.items():
            if j == k:
                _put(out, (i, n), x.then(y))
    return out


def _inserts() -> Matrix:
    """No insertion, or the fewest that lead from a state to another."""
    once: Matrix = {cell: Rope(INSERT, "I") for cell in USER + ASSISTANT}
    out: Matrix = {(i, i): Rope(0) for i in range(4)}
    for _ in range(3):
        for cell, rope in product(out, once).items():
            _put(out, cell, rope)
    return out


INSERTS = _inserts()


def terminal_matrix(kind: tuple[str, bool] | None) -> Matrix:
    """What a row does, with any insertions before it."""
    own: Matrix = {(i, i): Rope(DELETE, "D") for i in range(4)}
    if kind is not None:
        who, cut = kind
        extra = RETAIN_TRUNCATED if cut else 0
        for cell in MOVES[who]:
            _put(own, cell, Rope(extra, "K"))
        for cell in USER + ASSISTANT:
            _put(own, cell, Rope(REROLE + extra, "R"))
    return product(INSERTS, own)


def rule_matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """Matrices of all symbols, rules bottom-up: (symbol, pair) with both symbols of the pair before it."""
    out = {c: terminal_matrix(k) for c, k in zip(TERMINALS, KINDS, strict=True)}
    for symbol, (left, right) in rules:
        out[symbol] = product(out[left], out[right])
    return out


def compressed(sequence: str, rules: list[tuple[str, str]]) -> str:
    for symbol, pair in rules:
        sequence = sequence.replace(pair, symbol)
    return sequence


def best_end(row: Matrix) -> Rope:
    """The best way from the start to a whole conversation, insertions at its end included."""
    ends = product({c: r for c, r in row.items() if c[0] == START}, INSERTS)
    none, whole = ends.get((START, START)), ends[START, AFTER_A]
    return whole if none is None or whole.before(none) else none


def learn_grammar(sequences: DataFrame, rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """Re-Pair rules (symbol, pair) over (seq, n): distinct sequences and how often they stand.

    Spark counts pairs over all sequences; the driver gets the ``PAIRS`` most frequent ones.  Pairs of a round share no
    symbol, so they never overlap, and one pass replaces them all.
    """
    rules: list[tuple[str, str]] = []
    text = F.col("seq")
    for _ in range(rounds):
        left = sequences.select(text.alias("s"), "n").where(F.length("s") > 1)
        pairs = left.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"), "n")
        top = pairs.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(PAIRS).collect()
        used: set[str] = set()
        for row in top:
            if not used & set(row["pair"]):
                used |= set(row["pair"])
                symbol = chr(FIRST_RULE + len(rules))
                rules.append((symbol, row["pair"]))
                text = F.replace(text, F.lit(row["pair"]), F.lit(symbol))
        if not top:
            break
    return rules


def repaired_lines(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """``role:text`` of the rows that an audit gives, and the state after them; ``state`` is the one before."""
    out, rows = [], iter(zip(roles, texts, strict=True))
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        following = AFTER_A if state == AFTER_U else AFTER_U
        if edit == "K":
            following = AFTER_S if role[:1] == "s" else following
        else:
            role = "assistant" if following == AFTER_A else "user"
        out.append(f"{role}:{text}")
        state = following
    return out, state


def inject_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there) with faults by the CRC of ``conv_id:turn``; a dropped row stays as a row not ``there``.

    Null ids, turns, roles and texts count as one space in texts and keys; null turns stay null as turns.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    one = F.struct(F.when(fault == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), (fault != 0).alias("there"))
    copies = F.when(fault == 3, F.array(one, one)).otherwise(F.array(one))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.inline(copies))


def _symbol(role: Column, text: Column) -> Column:
    """Number of a row's terminal, duplicates apart."""
    bare = F.btrim(text, F.lit(" \t\n\v\f\r"))
    whole = F.right(bare, F.lit(1)).isin(".", "!", "?")
    initial = F.substring(role, 1, 1)
    who = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(bare == "", 0).otherwise(1 + 2 * who + F.when(whole, 0).otherwise(1)).cast("int")


COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
ENDS = ("min_turn", "max_turn")


def _piece_schema(kind: T.DataType) -> T.StructType:
    fields = [("conv_id", kind), ("part", T.IntegerType()), ("no", T.LongType()), ("edge", T.BooleanType()), *[(c, T.LongType()) for c in COUNTS + ENDS], ("first", T.StringType()), ("last", T.StringType()), ("seq", T.StringType())]
    return T.StructType([T.StructField(*f) for f in fields] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("roles", "texts")])


LEGAL = {"su", "ua", "au"}


def cut_pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations in order: their counts, symbols, roles and texts.

    ``rows``: (conv_id, turn, role, text, there); they are ordered by turn, null first, equal turns by role and
    a hash of the text.  A piece is an ``edge`` if its conversation may have others: it is the first or last of its task, or was cut.
    """
    key = F.unhex(F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")))
    there = rows.where("there").select("conv_id", "turn", "role", "text", key.alias("h"), F.lit(2).alias("kind"), _symbol(F.col("role"), F.col("text")).alias("sym"))
    # The first row of each role and text is announced by a small row that sorts right before it.
    first = there.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("t"))
    first = first.select("conv_id", "t.turn", "role", F.lit(None).cast("string").alias("text"), "h", F.lit(1).alias("kind"), F.lit(0).alias("sym"))
    gone = rows.where("not there").select("conv_id").distinct()
    null = F.lit(None)
    gone = gone.select("conv_id", null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("binary").alias("h"), F.lit(0).alias("kind"), F.lit(0).alias("sym"))
    by = ["conv_id", "turn", "role", "h"]
    every = there.unionByName(first).unionByName(gone).repartitionByRange(*by).sortWithinPartitions(*by, "kind")
    schema = _piece_schema(rows.schema["conv_id"].dataType)
    types = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])
    every = every.select("conv_id", "turn", "role", "text", "kind", "sym", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, piece, conv, announced, chars, convs = [], None, None, False, 0, 0

        def new():
            return {"conv_id": conv, "part": part, "no": 0, "edge": convs == 1, **dict.fromkeys(COUNTS, 0), "min_turn": None, "max_turn": None, "first": None, "last": None, "seq": [], "roles": [], "texts": []}

        def table():
            for p in done:
                p["seq"] = "".join(p["seq"])
            out = pa.RecordBatch.from_pylist(done, types)
            done.clear()
            return out

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            part = batch.column(6)[0].as_py() if batch.num_rows else 0
            for c, turn, role, text, kind, sym in zip(*columns, strict=True):
                if piece is None or c != conv:
                    if piece is not None:
                        done.append(piece)
                    conv, convs, chars, announced = c, convs + 1, 0, False
                    piece = new()
                if kind != 2:
                    announced = kind == 1
                    continue
                if piece["n"] >= PIECE_ROWS or chars >= PIECE_CHARS:
                    piece["edge"] = True
                    done.append(piece)
                    no, chars = piece["no"] + 1, 0
                    piece = new() | {"no": no, "edge": True}
                who = role[:1]
                piece["n"] += 1
                if not sym:
                    piece["blank"] += 1
                elif not announced:
                    piece["duplicate"] += 1
                    sym = 0
                elif sym % 2 == 0:
                    piece["truncated"] += 1
                announced = False
                if piece["last"] is not None and piece["last"] + who not in LEGAL:
                    piece["illegal"] += 1
                if piece["first"] is None:
                    piece["first"] = who
                piece["last"] = who
                if turn is not None:
                    piece["turns"] += turn != piece["max_turn"]
                    piece["max_turn"] = turn
                    if piece["min_turn"] is None:
                        piece["min_turn"] = turn
                piece["seq"].append(TERMINALS[sym])
                piece["roles"].append(role)
                piece["texts"].append(text)
                chars += len(text) + len(role)
            # The last piece waits: its conversation may go on in the next batch.
            if done:
                yield table()
        if piece is not None:
            piece["edge"] = True
            done.append(piece)
            yield table()

    return every.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _report(conv_id, p: dict, cost: int, audit: str, digest: str | None) -> dict:
    gaps = 0 if p["min_turn"] is None else p["max_turn"] - p["min_turn"] + 1 - p["turns"]
    return {"conv_id": conv_id, "gaps": gaps, **{c: p[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired_sha256": digest}


def _report_schema(kind: T.DataType, *more: T.StructField) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return T.StructType([T.StructField("conv_id", kind), *longs, T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()), *more])


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for every conv_id of ``rows``.

    ``rows``: (conv_id, turn, role, text, there), null ids a conversation of their own.  A role with an empty initial can't be
    kept.  A conversation of no rows that are ``there`` has zeros, an empty audit and the empty string's digest; no rows, no result.
    """
    kind = rows.schema["conv_id"].dataType
    pieces = scratch.keep(cut_pieces(rows), "pieces")
    sequences = scratch.keep(pieces.where("n > 1").groupBy("seq").agg(F.count("*").alias("n")), "sequences")
    rules = learn_grammar(sequences)
    whole = pieces.where("not edge").mapInArrow(_finish_whole(rules, _report_schema(kind)), _report_schema(kind))
    return whole.unionByName(_joined(pieces.where("edge"), rules, kind, scratch))


def _types(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _arrow(f.dataType)) for f in schema])


def _finish_whole(rules: list[tuple[str, str]], schema: T.StructType):
    """Reports of conversations that are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices, types = rule_matrices(rules), _types(schema)

        @lru_cache(maxsize=REMEMBERED)
        def best(sequence: str) -> tuple[int, str]:
            row: Matrix = {(START, START): Rope(0)}
            for symbol in compressed(sequence, rules):
                row = product(row, matrices[symbol])
            rope = best_end(row)
            return rope.cost, rope.letters()

        for batch in batches:
            out = []
            for p in batch.to_pylist():
                cost, audit = best(p["seq"])
                out.append(_report(p["conv_id"], p, cost, audit, _sha(repaired_lines(audit, START, p["roles"], p["texts"])[0])))
            yield pa.RecordBatch.from_pylist(out, types)

    return run


CELLS = "array<struct<i: int, j: int, cost: long, audit: string>>"
AUDITS = "array<struct<part: int, no: long, state: int, edits: string>>"


def _joined(pieces: DataFrame, rules: list[tuple[str, str]], kind: T.DataType, scratch: Scratch) -> DataFrame:
    """Reports of conversations of one or more pieces."""
    facts = pieces.drop("edge", "roles", "texts")
    celled = T.StructType([*facts.schema.fields[:-1], T.StructField("cells", _ddl(CELLS))])

    def evaluate(batches):
        matrices, types = rule_matrices(rules), _types(celled)
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                whole: Matrix = {(i, i): Rope(0) for i in range(4)}
                for symbol in compressed(p.pop("seq"), rules):
                    whole = product(whole, matrices[symbol])
                out.append(p | {"cells": [{"i": i, "j": j, "cost": r.cost, "audit": r.letters()} for (i, j), r in whole.items()]})
            yield pa.RecordBatch.from_pylist(out, types)

    reported = _report_schema(kind, T.StructField("audits", _ddl(AUDITS)))
    ordered = facts.mapInArrow(evaluate, celled).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    reports = scratch.keep(ordered.mapInArrow(_chain(reported), reported), "reports")
    # Each piece gets its part of the audit, and its lines; their digest needs them in order.
    parts = reports.select(F.col("conv_id").alias("_c"), F.inline("audits")).withColumnsRenamed({"part": "_p", "no": "_n"})
    own = pieces.select("conv_id", "part", "no", "roles", "texts")
    own = own.join(parts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("no") == F.col("_n"))).drop("_c", "_p", "_n")
    lined = T.StructType([*pieces.select("conv_id", "part", "no").schema.fields, T.StructField("lines", T.StringType())])

    def lines(batches):
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                rows = repaired_lines(p["edits"], p["state"], p["roles"], p["texts"])[0]
                out.append({"conv_id": p["conv_id"], "part": p["part"], "no": p["no"], "lines": "\n".join(rows) if rows else None})
            yield pa.RecordBatch.from_pylist(out, _types(lined))

    hashed = T.StructType([T.StructField("_c", kind), T.StructField("digest", T.StringType())])

    def digests(batches):
        conv, sha, any_ = None, None, False
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if sha is None or p["conv_id"] != conv:
                    if sha is not None:
                        out.append({"_c": conv, "digest": sha.hexdigest()})
                    conv, sha, any_ = p["conv_id"], hashlib.sha256(), False
                if p["lines"] is not None:
                    sha.update((b"\n" if any_ else b"") + p["lines"].encode())
                    any_ = True
            yield pa.RecordBatch.from_pylist(out, _types(hashed))
        if sha is not None:
            yield pa.RecordBatch.from_pylist([{"_c": conv, "digest": sha.hexdigest()}], _types(hashed))

    found = own.mapInArrow(lines, lined).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(digests, hashed)
    out = reports.drop("audits", "repaired_sha256").join(found, F.col("conv_id").eqNullSafe(F.col("_c")))
    return out.withColumn("repaired_sha256", F.col("digest")).drop("_c", "digest")


def _ddl(text: str) -> T.DataType:
    return T._parse_datatype_string(text)


def _chain(schema: T.StructType):
    """One report a conversation from its pieces' matrices, which come sorted by conversation and place."""

    def close(conv, total, row):
        # A state has its best rope and the way there: piece, state before it, its edits, the way before.
        rope = best_end({(START, j): r for j, (r, _) in row.items()})
        for (j, end), tail in INSERTS.items():
            if j in row and end in (START, AFTER_A):
                t = row[j][0].then(tail)
                if (t.cost, t.size, t.code) == (rope.cost, rope.size, rope.code):
                    break
        audits, way = [], row[j][1]
        while way is not None:
            (part, no), state, edits, way = way
            audits.append({"part": part, "no": no, "state": state, "edits": edits})
        audits.reverse()
        audits[-1]["edits"] += tail.letters()
        return _report(conv, total, rope.cost, rope.letters(), None) | {"audits": audits}

    def run(batches):
        types = _types(schema)
        conv, total, row, open_ = None, None, None, False
        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if not open_ or p["conv_id"] != conv:
                    if open_:
                        out.append(close(conv, total, row))
                    conv, open_ = p["conv_id"], True
                    total = dict.fromkeys(COUNTS, 0) | {"min_turn": None, "max_turn": None, "last": None}
                    row = {START: (Rope(0), None)}
                total["illegal"] += total["last"] is not None and p["first"] is not None and total["last"] + p["first"] not in LEGAL
                total["turns"] -= total["max_turn"] is not None and total["max_turn"] == p["min_turn"]
                for c in COUNTS:
                    total[c] += p[c]
                total["last"] = total["last"] if p["last"] is None else p["last"]
                total["min_turn"] = p["min_turn"] if total["min_turn"] is None else total["min_turn"]
                total["max_turn"] = total["max_turn"] if p["max_turn"] is None else p["max_turn"]
                new = {}
                for c in p["cells"]:
                    if c["i"] in row:
                        before, way = row[c["i"]]
                        rope = before.then(Rope(c["cost"], c["audit"]))
                        if c["j"] not in new or rope.before(new[c["j"]][0]):
                            new[c["j"]] = rope, ((p["part"], p["no"]), c["i"], c["audit"], way)
                row = new
            yield pa.RecordBatch.from_pylist(out, types)
        if open_:
            yield pa.RecordBatch.from_pylist([close(conv, total, row)], types)

    return run

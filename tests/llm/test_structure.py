"""Line dedup, manifest and conversation repair against plain-Python definitions."""

import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from llm_brute import DATA
from pyspark.sql import functions as F

from permuta.llm import conversations, line_dedup, manifest
from permuta.llm._store import Scratch, table

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SPACE = " \t\n\v\f\r"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- lines


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def cleaned(texts, least, counted=None):
    seen = {}
    for t in counted if counted is not None else texts:
        for k in {line_key(x) for x in (t or "").split("\n")} - {""}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if seen.get(line_key(x), 0) < least]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


LINES = ["", " ", "Home", "home ", "\tHOME\r", "Ärger", "ärger", "İx", "i̇x", "a\x00b", "x" * 3000, *[f"line {i}" for i in range(40)]]


def random_texts(rng, n):
    return [rng.choice([None, "", "\n", "\n\n"]) if rng.random() < 0.1 else "\n".join(rng.choices(LINES, k=rng.randint(1, 9))) for _ in range(n)]


def shown(frame):
    return [(r["n_lines"], r["n_dropped"], r["kept_text"]) for r in frame.orderBy("doc_id").collect()]


def state(index):
    marks = {r["shard"]: sorted(np.frombuffer(r["fingerprints"], np.uint32).tolist()) for r in index.filters.collect()}
    return sorted(map(tuple, index.counts.collect())), marks


@pytest.mark.parametrize("way", ["filters", "join", "chance", "full"])
def test_lines_of_many_documents_go(spark, docs, scratch, monkeypatch, way):
    texts = random_texts(random.Random(1), 60)
    if way == "join":
        monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    if way == "chance":  # marks of few bits: many keys are held by chance
        monkeypatch.setattr(line_dedup.Cuckoo, "_places", lambda self, a, b: (np.full(len(a), 7, np.uint32), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)))
        monkeypatch.setattr(line_dedup.Cuckoo, "insert", lambda self, a, b: self.table.__setitem__((0, 0), 7) is None or True)
    if way == "full":  # shards that don't hold their keys are dealt anew
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
        monkeypatch.setattr(line_dedup, "KICKS", 1)
    d = docs(texts).withColumns({"n_lines": F.lit("x"), "c0": F.lit(1), "drop": F.lit(2), "text2": "text"})
    index = line_dedup.LineIndex(spark, scratch, 5)
    index.insert(d)
    assert way != "full" or index.shards > 1
    for counted in (True, False):
        out = index.clean(d, counted)
        assert shown(out) == cleaned(texts, 5)
        assert out.columns == [*[c for c in d.columns if c != "n_lines"], "n_lines", "n_dropped", "kept_text"]


def test_deleted_documents_leave_no_trace(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rng = random.Random(2)
    a, b = random_texts(rng, 40), random_texts(rng, 40)
    index = line_dedup.LineIndex(spark, Scratch(spark, "lines"), 6)
    index.insert(docs(a))
    before = state(index)
    index.insert(docs(b))
    assert shown(index.clean(docs(a))) == cleaned(a, 6, a + b)
    again = line_dedup.LineIndex.open(spark, index.scratch.root)
    again.delete(docs(b))
    counts, marks = state(again)
    assert counts == before[0] and sorted(x for m in marks.values() for x in m if x) == sorted(x for m in before[1].values() for x in m if x)
    assert shown(again.clean(docs(a))) == cleaned(a, 6) and shown(again.clean(docs(b))) == cleaned(b, 6, a)
    version = again.version
    with pytest.raises(Exception, match="not inserted"):
        again.delete(docs(["never seen"]))
    assert again.version == version and shown(again.clean(docs(a))) == cleaned(a, 6)
    again.delete(docs(a))
    assert again.counts.isEmpty() and shown(again.clean(docs(a))) == cleaned(a, 6, [])


def test_no_documents_no_lines(spark, docs, scratch):
    index = line_dedup.LineIndex(spark, scratch, 2)
    index.insert(docs([]))
    assert index.clean(docs([]), True).collect() == [] and shown(index.clean(docs(["a\nb", None]))) == [(2, 0, "a\nb"), (1, 0, "")]


def test_cuckoo_filter_holds_what_it_was_given():
    rng = np.random.default_rng(3)
    h1, h2 = rng.integers(-(2**63), 2**63, (2, 3000))
    cuckoo = line_dedup.Cuckoo.empty(1024)
    assert cuckoo.insert(h1, h2) and cuckoo.holds(h1, h2).all()
    assert cuckoo.insert(h1[:50], h2[:50])
    cuckoo.delete(h1[:100], h2[:100])
    assert cuckoo.holds(h1[:50], h2[:50]).all() and cuckoo.holds(h1[100:], h2[100:]).all() and not cuckoo.holds(h1[50:100], h2[50:100]).any()
    assert not line_dedup.Cuckoo.empty(2).insert(h1[:9], h2[:9])


# --- manifest


def encoded(*values):
    return "".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values)


def tree(leaves):
    """Root, the steps of each leaf as (left, sibling), and the levels."""
    paths, at, levels = [[] for _ in leaves], list(range(len(leaves))), [list(leaves)]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        for x in range(len(leaves)):
            paths[x].append((at[x] & 1, cur[at[x] ^ 1] if at[x] ^ 1 < len(cur) else None))
            at[x] >>= 1
        levels.append([sha("".join(cur[i : i + 2])) for i in range(0, len(cur), 2)])
    return levels[-1][0], paths, levels


def manifest_rows(rows, bad):
    groups = {}
    for d, t, lang, s, n in rows:
        groups.setdefault(lang, []).append((d, sha(encoded(d, s, lang, n, t)), sha(encoded(d, s, lang, None if n is None else n + 1, t))))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in groups[lang]])
    root, above, _ = tree([trees[x][0] for x in langs])
    out = []
    for i, lang in enumerate(langs):
        for (d, leaf, changed), path in zip(groups[lang], trees[lang][1], strict=True):
            cur = changed if bad(d) else leaf
            for left, s in path + above[i]:
                cur = sha(cur if s is None else s + cur if left else cur + s)
            out.append((d, leaf, trees[lang][0], root, sha("".join(s for _, s in path + above[i] if s)), cur, cur == root))
    return sorted(out, key=str), {x: trees[x][2] for x in langs}


def sevenths(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 0


def seventh_rows():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


@pytest.mark.parametrize("bits", [1, 2, 10])
@pytest.mark.parametrize("sizes", [[1], [2], [1, 1, 1], [8, 5, 1, 16, 4], [33, 1], [3, 40]])
def test_manifest(spark, docs, scratch, monkeypatch, bits, sizes):
    if bits == 10 and sum(sizes) < 20:
        pytest.skip("one round either way")
    monkeypatch.setattr(manifest, "SPAN_BITS", bits)
    langs = [None, "", "en", "Zz", "é"]
    rows = [(None if i % 9 == 4 else i, f"té{i}" if i % 5 else None, lang, None if i % 3 else "") for lang, n in zip(langs, sizes, strict=False) for i in range(n)]
    rows += rows[:1]
    d = docs(rows).withColumns({"g": F.lit(1), "r": F.lit(1), "digest": F.lit("x"), "leaves": F.lit(0)})
    want, _ = manifest_rows([tuple(r)[:5] for r in d.collect()], sevenths)
    got = manifest.verify_documents(d, scratch, seventh_rows()).collect()
    assert sorted(map(tuple, got), key=str) == want


@pytest.mark.parametrize("bits", [1, 3])
def test_manifest_nodes_cover_intervals(spark, scratch, monkeypatch, bits):
    monkeypatch.setattr(manifest, "SPAN_BITS", bits)
    leaves = {None: 1, "a": 13, "b": 8}
    rows = [(g, r, sha(f"{g}{r}")) for g, n in leaves.items() for r in range(n)]
    built = manifest.build(spark.createDataFrame(rows, "g string, r long, digest string"), scratch, "t")
    want = {(g, lv, k << lv, min((k + 1) << lv, n) - 1, h) for g, n in leaves.items() for lv, level in enumerate(tree([x[2] for x in rows if x[0] == g])[2]) for k, h in enumerate(level)}
    got = [tuple(r) for r in built.nodes().collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in built.roots().collect()} == {(g, h) for g, lv, lo, hi, h in want if lo == 0 and hi == leaves[g] - 1 and not any(x[0] == g and x[1] > lv for x in want)}


def test_manifest_of_nothing(spark, docs, scratch):
    assert manifest.verify_documents(docs([]), scratch).collect() == []


# --- conversations


def plain_best(rows):
    """(cost, audit) of (kind, role initial, truncated) rows, cell by cell without grammar or matrices."""
    inf = (10**9, "")
    cur = [(0, ""), inf, inf, inf]

    def insert(cells):
        for _ in range(4):
            for i, j in ((0, 2), (1, 2), (3, 2), (2, 3)):
                cells[j] = min(cells[j], (cells[i][0] + 5, cells[i][1] + "I"))
        return cells

    for gone, who, cut in rows:
        cur, new = insert(cur), [inf] * 4
        for i in range(4):
            c, a = cur[i]
            new[i] = min(new[i], (c + 2, a + "D"))
            if gone:
                continue
            for role, j in (("s", 1), ("u", 2), ("a", 3)):
                if j == (2 if i != 2 else 3) or j == 1 and i == 0:
                    if who == role:
                        new[j] = min(new[j], (c + 5 * cut, a + "K"))
                    if role != "s":
                        new[j] = min(new[j], (c + 1 + 5 * cut, a + "R"))
        cur = new
    cur = insert(cur)
    return min(cur[0], cur[3])


def exhaustive(rows, inserts=3):
    """Every edit sequence with at most ``inserts`` insertions whose roles fit the pattern."""
    best = (10**9, "")
    for where in (w for k in range(inserts + 1) for w in itertools.combinations_with_replacement(range(len(rows) + 1), k)):
        slots = []
        for i in range(len(rows) + 1):
            slots += [None] * where.count(i)
            slots += [rows[i]] if i < len(rows) else []
        options = [[("I", "u", 5), ("I", "a", 5)] if r is None else [("D", "", 2)] if r[0] else [("D", "", 2), ("K", r[1], 5 * r[2]), ("R", "u", 1 + 5 * r[2]), ("R", "a", 1 + 5 * r[2])] for r in slots]
        for pick in itertools.product(*options):
            if re.fullmatch("(s?(ua)+)?", "".join(p[1] for p in pick)):
                best = min(best, (sum(p[2] for p in pick), "".join(p[0] for p in pick)))
    return best


def symbol(row):
    return conversations.TERMINALS[0 if row[0] else conversations.KINDS.index((row[1], row[2]))]


def test_matrices_find_the_cheapest_and_least_audit():
    rng = random.Random(4)
    kinds = [(True, "", False), *[(False, w, c) for w in "suao" for c in (False, True)]]
    cases = [[rng.choice(kinds) for _ in range(rng.randint(0, 4))] for _ in range(150)]
    long_ = [[rng.choice(kinds) for _ in range(rng.randint(5, 120))] for _ in range(60)]
    rules = [("X", "bc"), ("Y", "dd"), ("Z", "XX"), ("W", "af"), ("V", "WZ")]
    matrices = conversations.rule_matrices(rules)
    for rows in cases + long_:
        got = []
        for grammar in ([], rules):
            whole = {(i, i): conversations.Rope(0) for i in range(4)}
            for s in conversations.compressed("".join(map(symbol, rows)), grammar):
                whole = conversations.product(whole, matrices[s])
            end = conversations.best_end(whole)
            got.append((end.cost, end.letters()))
        assert got[0] == got[1] == plain_best(rows)
        if len(rows) <= 4:
            assert got[0] == exhaustive(rows)


def faulty(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def conversation_rows(original):
    out = {}
    damaged = faulty(original)
    for conv in {r[0] for r in original}:
        rows = [r[1:] for r in damaged if r[0] == conv]
        md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r)))
        seen, kinds, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            if fault:
                count[fault] += 1
            seen.add((role, text))
            kinds.append((fault in ("blank", "duplicate"), role[:1] if role[:1] in ("s", "u", "a") else "o", fault == "truncated"))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = plain_best(kinds)
        left, kept = iter(rows), []
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (0, "", "")
            if edit != "D":
                there = len(kept) - (1 if kept and kept[0][0][:1] == "s" else 0)
                kept.append((role if edit == "K" else "assistant" if there % 2 else "user", text))
        out[conv] = (conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)))
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(rows, spark):
    got = conversations.repair(conversations.inject_faults(rows), Scratch(spark, "conversations"))
    out = [tuple(r) for r in got.select(*COLUMNS).collect()]
    assert len({r[0] for r in out}) == len(out)
    return {r[0]: r for r in out}


@needs_data
def test_conversations_of_the_table(spark):
    rows = table(spark, DATA, "conversations")
    want = conversation_rows([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert repaired(rows, spark) == want and len(want) > 5


@pytest.mark.parametrize("piece", [1, 3, 1024])
def test_conversations_with_odd_rows(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece)
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "uploader"]
    texts = ["Well.", "Why?", "No end", "", " \t", None, "x" * 5000 + ".", "é.", "é", "Well. "]
    rows = []
    for conv, n in [(None, 7), (0, 1), (1, 90), (2, 12), (3, 2), *[(c, rng.randint(1, 8)) for c in range(4, 40)]]:
        for i in range(n):
            turn = None if rng.random() < 0.05 else i + rng.randint(0, 1)
            rows.append((conv, turn, rng.choice(roles[:3]) if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts)))
    rows += [rows[3]] * 3 + [(99, i, "user", "Same.") for i in range(30)]
    gone = next(t for t in range(10**6) if zlib.crc32(f"777:{t}".encode()) % 20 == 0)
    rows.append((777, gone, "user", "Dropped."))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"there": F.lit("x"), "kind": F.lit(1), "seq": F.lit("q")}).repartition(3)
    want = conversation_rows(rows)
    got = repaired(df, spark)
    assert got == want and got[777] == (777, 0, 0, 0, 0, 0, 0, "", sha(""))


def test_no_conversations(spark):
    assert repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), spark) == {}


def test_grammar_takes_frequent_pairs(spark):
    sequences = spark.createDataFrame([("bcbcbc", 3), ("dddd", 1), ("a", 9)], "seq string, n long")
    rules = conversations.learn_grammar(sequences)
    assert rules[0][1] == "bc" and all(len(p) == 2 for _, p in rules)
    expand = lambda s: "".join(expand(dict(rules)[c]) if c in dict(rules) else c for c in s)
    for s in ("bcbcbc", "dddd", "adbcbd"):
        assert expand(conversations.compressed(s, rules)) == s

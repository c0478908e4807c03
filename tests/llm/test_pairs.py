"""N-gram Jaccard join, embedding links, substring passages and components."""

import random

import numpy as np
import pyarrow as pa
import pytest
from llm_brute import components as brute_components
from llm_brute import jaccard_components, words
from pyspark.sql import functions as F

from permuta.llm import near_vectors, ngram_join, substrings
from permuta.llm._components import components

RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(t, n, rng=RNG):
    w = t.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
    return " ".join(w)


def test_components_of_long_paths(spark, scratch):
    order = list(range(60))
    RNG.shuffle(order)
    links = list(zip(order[:40], order[1:41], strict=True)) + [(order[50], order[51]), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    want = brute_components(range(60), links)
    assert got == {i: want[i] for i in got} and len(got) == 43
    assert components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0


def corpus():
    base = [text(n) for n in (3, 4, 5, 6, 12, 40, 80, 200, 200)]
    rows = list(base)
    for b in base:
        for n in (0, 1, 2, 3, 5, 8):
            rows.append(edited(b, n) if n else b.upper())
    shared = text(60)
    rows += [f"{text(RNG.randint(2, 60))} {shared} {text(RNG.randint(2, 40))}" for _ in range(12)]
    rows += [shared + " " + text(n) for n in (5, 8, 10, 14, 18, 20)]
    rows += [None, "", " \t\n", "one", "ONE", "x " * 3000]
    return rows


def test_join_matches_brute_force(docs, scratch):
    rows = corpus()
    got = {r["doc_id"]: r for r in ngram_join.join_components(docs(rows), scratch).collect()}
    sizes, want = jaccard_components(dict(enumerate(rows)))
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("seed", range(2))
def test_join_matches_brute_force_near_the_threshold(docs, scratch, seed):
    rng = random.Random(seed)
    base = [text(rng.randint(8, 90), rng) for _ in range(4)]
    rows = [edited(rng.choice(base), rng.randint(0, 6), rng) for _ in range(70)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs(rows), scratch).collect()}
    assert got == jaccard_components(dict(enumerate(rows)))[1]


def test_join_of_edge_tables(spark, docs, scratch):
    assert ngram_join.join_components(docs([]), scratch.__class__(spark, "empty")).count() == 0
    t = text(30)
    rows = docs([(None, t), (5, t), (5, t), (9, t), (None, None)]).withColumn("ent", F.lit("x")).withColumn("id", F.lit(0)).withColumn("n", F.lit(0))
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in ngram_join.join_components(rows, scratch).collect())
    assert got == [("5", "5"), ("5", "5"), ("9", "5"), ("None", "5"), ("None", "None")]


@pytest.mark.parametrize("last", [False, True])
def test_pivots_keep_their_postings_when_equal_texts_stand_apart(spark, docs, scratch, monkeypatch, last):
    postings = ngram_join._postings
    in_order = lambda *a: scratch.keep(postings(*a).coalesce(1).sortWithinPartitions(F.col("pivot").isNull() == last), "posted")
    monkeypatch.setattr(ngram_join, "_postings", in_order)
    monkeypatch.setattr(scratch, "drop", lambda name: None)  # the buckets are looked at below
    rng = random.Random(8)
    base = [text(60, rng) for _ in range(6)]
    alone = docs(list(enumerate(base))).coalesce(1)
    near = docs([(10 + i, t) for i, t in enumerate(base)] + [(20 + i, edited(t, 1, rng)) for i, t in enumerate(base)]).coalesce(1)
    # Written apart, so that they are read by two tasks.
    join = ngram_join.join_components(scratch.keep(alone, "alone").union(scratch.keep(near, "near")), scratch)
    posted = spark.read.parquet(scratch.path("buckets"))
    others = posted.where("ent <> pivot").select("shingle", posted["pivot"].alias("ent")).distinct()
    assert others.count() and others.join(posted, ["shingle", "ent"], "left_anti").isEmpty()
    assert {r["doc_id"]: r["component_id"] for r in join.collect()} == {i + j: i for i in range(6) for j in (0, 10, 20)}


def test_a_pair_meets_once_for_all_that_just_the_two_share(docs, scratch, monkeypatch):
    shared, met = ngram_join._shared, []
    monkeypatch.setattr(ngram_join, "_shared", lambda *a: met.extend(shared(*a).collect()) or shared(*a))
    rng = random.Random(5)
    starts, ends = [text(343, rng) for _ in range(4)], [text(57, rng) for _ in range(8)]
    rows = [f"{starts[i // 2]} {t}" for i, t in enumerate(ends)]  # of two with one start 74.8 % is shared
    rows += [f"{t} {text(3, rng)}" for t in ends for _ in range(3)]  # so that the ends are frequent and the starts are the prefixes
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(docs(rows), scratch).collect()}
    assert got == jaccard_components(dict(enumerate(rows)))[1] and all(got[i] == i for i in range(8))
    pairs = {}
    for r in met:
        if r["x_n"] > 100:
            pairs.setdefault((r["a"], r["b"]), []).append(r["shared"])
    assert len(pairs) == 4 and all(sum(x) > 40 and len(x) <= 4 for x in pairs.values())


def test_one_of_each_group_stays(docs, scratch):
    t, u = text(40), text(40)
    d = docs([t, u, t + " more", None, t]).withColumn("id", F.lit(1))
    kept = ngram_join.keep_first_of_group(d, scratch)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3]


def test_rows_that_link_with_nothing_stay_whatever_their_key(docs, scratch):
    t, u, v, w, x = (text(40) for _ in range(5))
    rows = [(None, t), (None, u), (3, v), (3, w), (1, x), (3, x + " more"), (None, v), (2, t), (5, None), (5, None), (7, u), (7, u)]
    kept = ngram_join.keep_first_of_group(docs(rows), scratch)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("2", t), ("7", u), ("3", v), ("3", w), ("1", x), ("5", ""), ("5", "")])


def vector_links(rows):
    usable = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and not any(x is None or not np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            usable[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in usable for b in usable if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and usable[a] @ usable[b] >= 0.93]
    return links


@pytest.mark.parametrize(("cell", "block_bytes", "center_bytes", "broadcast"), [(1500, 1, 1 << 20, 1), (12, 1, 1 << 20, 0), (12, 1 << 20, 1 << 20, 1), (12, 1, 256, 100)])
def test_vectors_match_brute_force(spark, scratch, monkeypatch, cell, block_bytes, center_bytes, broadcast):
    monkeypatch.setattr(near_vectors, "CELL", cell)
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    monkeypatch.setattr(near_vectors, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(near_vectors, "CENTER_BYTES", center_bytes)
    monkeypatch.setattr(near_vectors, "BROADCAST_CELLS", broadcast)
    monkeypatch.setattr(near_vectors, "TILE", 7)
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + rng.normal(size=8) * 0.35], i % 2) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(40)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 8, 0), (303, [float("nan")] * 8, 0), (304, [None, *[1.0] * 7], 0), (305, rows[0][1], None), (306, [1.0] * 3, 0), (307, [2.0] * 3, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = {r["vec_id"]: r for r in near_vectors.link_vectors(df, scratch).collect()}
    links = vector_links(rows)
    ids = [r[0] for r in rows]
    want = brute_components(range(len(rows)), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    for i, vec_id in enumerate(ids):
        r = got[vec_id]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], ids[want[i]], want[i] == i)
    kept = near_vectors.keep_representatives(df, scratch.__class__(spark, "again"))
    assert kept.columns == df.columns and kept.count() == len(set(want.values()))


def test_centroids_stay_within_their_bytes(spark, scratch, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 10)
    rng = np.random.default_rng(3)
    units = rng.normal(size=(400, 8))
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows = [(i, i, 1, "a:8" if i < 300 else f"p{i}:8", units[i].tobytes()) for i in range(400)]
    classes = spark.createDataFrame(rows, "cid long, rep long, m long, part string, unit binary")
    for limit, most in ((1 << 20, 30), (640, 10)):
        monkeypatch.setattr(near_vectors, "CENTER_BYTES", limit)
        centers = near_vectors.fit_cells(classes, rounds=2)
        assert list(centers) == ["a:8"] and 1 < len(centers["a:8"]) <= most
        assert np.allclose(np.linalg.norm(centers["a:8"], axis=1), 1)


def test_vectors_of_edge_tables(spark, scratch):
    kinds = "vec_id long, embedding array<float>, label int"
    assert near_vectors.link_vectors(spark.createDataFrame([], kinds), scratch).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = near_vectors.link_vectors(spark.createDataFrame(rows, kinds), scratch.__class__(spark, "again")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in got) == [("1", 1, True), ("1", 1, True), ("None", 0, False)]


def test_passages_are_found_and_clean_texts_left(docs, scratch):
    passage, fuzzy = text(80), text(120)
    changed = fuzzy.split(" ")
    for i in (20, 55, 90):
        changed[i] = "changed"
    del changed[70]
    rows = [
        text(60) + " " + passage + " " + text(30),
        text(200),
        text(10) + " " + passage.upper() + " " + text(90),
        text(40) + " " + fuzzy,
        " ".join(changed) + " " + text(50),
        text(300),
        text(30) + " " + " ".join(passage.split(" ")[:20]) + " " + text(100),
        None,
        "",
        "same line " * 500,
        passage,
    ]
    got = substrings.find_passages(docs(rows), scratch).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(2, 0), (4, 3), (10, 0)}
    by = {r["doc_id"]: r for r in got}
    assert by[2]["start"] == 10 and by[2]["end"] >= 90 and by[2]["end"] < 94 and by[2]["src_start"] == 60
    assert by[4]["start"] == 0 and by[4]["n_words"] >= 115 and by[4]["n_same"] >= 110
    assert (by[10]["start"], by[10]["end"]) == (0, 80)


def test_chain_respects_order_and_gaps():
    chain = max(substrings.chains([(0, 0, 10), (12, 13, 10), (30, 5, 6), (24, 24, 8), (400, 40, 9)]), key=len)
    assert chain == [(0, 0, 10), (12, 13, 10), (24, 24, 8)]


def test_chain_goes_on_after_a_long_match_that_is_too_far():
    parts = [(500 + 13 * i, 500 + 13 * i, 10) for i in range(8)]
    assert sorted(substrings.chains([(0, 0, 300), *parts])) == [[(0, 0, 300)], parts]
    # Near in the text and far in the source.
    parts = [(310 + 13 * i, 900 + 13 * i, 10) for i in range(8)]
    assert sorted(substrings.chains([(0, 0, 300), *parts])) == [[(0, 0, 300)], parts]


@pytest.mark.parametrize("words", [120, 600, 5000])
def test_chains_are_the_same_with_and_without_a_tree(monkeypatch, words):
    rng, trees = random.Random(words), []
    tree = substrings.MaxTree
    monkeypatch.setattr(substrings, "MaxTree", lambda n: trees.append(n) or tree(n))
    for _ in range(30):
        anchors = sorted({(rng.randrange(words), rng.randrange(words // 4), rng.randint(6, 14)) for _ in range(60)})
        monkeypatch.setattr(substrings, "FEW", 16)
        got, before = substrings.chains(anchors), len(trees)
        assert words < 5000 or not trees  # few anchors are near each other
        monkeypatch.setattr(substrings, "FEW", 0)
        assert got == substrings.chains(anchors) and len(trees) == before + 1
        trees.clear()


def test_exact_repeats_match_brute_force(docs, scratch):
    rng = random.Random(11)
    shared = [text(rng.randint(55, 90), rng) for _ in range(4)]
    rows = [f"{text(rng.randint(5, 40), rng)} {rng.choice(shared)} {text(rng.randint(5, 40), rng)}" if rng.random() < 0.6 else text(100, rng) for _ in range(40)]
    first, want = {}, set()
    for i, t in enumerate(rows):
        w = words(t)
        for p in range(len(w) - 50):
            if first.setdefault(tuple(w[p : p + 51]), i) != i:
                want.add(i)
    got = substrings.find_passages(docs(rows), scratch)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == want
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_passages(docs(rows), got).collect()}
    assert all((cut[i] == rows[i]) == (i not in want) for i in range(len(rows)))


def test_repeats_whose_parts_stand_in_other_texts(docs, scratch):
    rng = random.Random(21)
    lines = [text(30, rng) for _ in range(6)]
    rows = [f"{text(40, rng)} {line} {text(40, rng)}" for line in lines]
    rows += [f"{text(25, rng)} {lines[a]} {lines[b]} {text(25, rng)}" for a, b in ((0, 1), (2, 3), (4, 5), (1, 0)) for _ in range(2)]
    # The window at the end of 6 is held by 7 alone; each first text of its seeds has half of it.
    got = substrings.find_passages(docs(rows), scratch).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(7, 6), (9, 8), (11, 10), (13, 12)}
    assert all(r["start"] <= 25 and r["end"] >= 85 for r in got)


def test_fuzzy_copies_whose_lines_stand_in_earlier_texts(docs, scratch):
    rng = random.Random(31)
    early, first, second = [], [], []
    for _ in range(30):
        lines = [text(20, rng).split(" ") for _ in range(4)]
        early += [f"{text(30, rng)} {' '.join(line)} {text(30, rng)}" for line in lines]
        changed = [["changed" + str(rng.random()), *line[1:]] for line in lines]
        first.append(f"{text(25, rng)} {' '.join(w for x in lines for w in x)} {text(25, rng)}")
        second.append(f"{text(25, rng)} {' '.join(w for x in changed for w in x)} {text(25, rng)}")
    n = len(early)
    got = substrings.find_passages(docs(early + first + second), scratch).collect()
    assert {(r["doc_id"], r["src_doc_id"]) for r in got} == {(n + 30 + i, n + i) for i in range(30)}
    assert all(r["start"] <= 27 and r["end"] >= 103 and r["n_same"] >= 74 for r in got)


def close(a, b, n=50, share=0.75):
    """Whether a stretch of ``n`` words of ``a`` has a local alignment with ``b`` of that share of equal words, by plain dynamic programming."""
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
        best = row[-1]
    return len(a) >= n and best >= share * len(a)


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15])
def test_fuzzy_passages_match_brute_force(docs, scratch, rate):
    """Every planted fuzzy passage is one by dynamic programming; at least 95 of 100 are found, and nothing else."""
    rng = random.Random(int(rate * 100))
    rows, want = [], set()
    for i in range(40):
        passage = text(90, rng).split(" ")
        copy = [rng.choice([[], ["x" + str(rng.random())], [w, "y" + str(rng.random())]]) if rng.random() < rate else [w] for w in passage]
        copy = [w for x in copy for w in x]
        assert close(passage, copy)
        rows += [f"{text(20, rng)} {' '.join(passage)} {text(20, rng)}", f"{text(20, rng)} {' '.join(copy)} {text(20, rng)}"]
        want.add((2 * i + 1, 2 * i))
    got = {(r["doc_id"], r["src_doc_id"]) for r in substrings.find_passages(docs(rows), scratch).collect()}
    print(f"edits of {rate:.0%}: {len(got & want)} of {len(want)}")
    assert got <= want and len(got) >= 0.95 * len(want)


def test_matches_do_not_depend_on_batches():
    rng = np.random.default_rng(2)
    key, ids, pos = np.sort(rng.integers(0, 30, 200)), rng.integers(0, 4, 200), np.arange(200, dtype=np.int32)
    order = np.lexsort((pos, ids, key))
    rows = pa.RecordBatch.from_pydict({"key": key[order], "id": ids[order], "pos": pos[order], "src": pa.nulls(200, pa.int64()), "src_pos": pa.nulls(200, pa.int32()), "many": np.zeros(200, bool)})
    want = set()
    for k in set(key.tolist()):
        at = [i for i in order if key[i] == k]
        if len({ids[i] for i in at}) > 1:
            want |= {(k, int(ids[i]), int(pos[i]), int(ids[at[0]]), int(pos[at[0]]), False, False) for i in at}
    for n in (1, 3, 200):
        got = [tuple(r.values()) for b in substrings._matches(rows.slice(i, n) for i in range(0, 200, n)) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_passages_do_not_depend_on_partitions(spark, docs, scratch):
    rng = random.Random(5)
    shared = [text(90, rng) for _ in range(2)]
    rows = []
    for i in range(24):
        w = shared[i % 2].split(" ")
        for _ in range(i // 4):
            w[rng.randrange(90)] = "edit"
        rows.append(f"{text(20, rng)} {' '.join(w)} {text(20, rng)}")
    found = []
    for n in (1, 6):
        got = substrings.find_passages(docs(rows).repartition(n, "doc_id"), scratch.__class__(spark, f"parts{n}"))
        found.append(sorted(map(tuple, got.collect())))
    assert found[0] == found[1]
    # Other sources hold an edit at the same place.
    assert {r[0] for r in found[0] if r[1] == r[0] % 2} == set(range(2, 24))


def _best_start(a, b):
    """Score and matches of the best common start, by the whole table of global alignments."""
    row = [(-j, 0) for j in range(len(b) + 1)]
    best = (0, 0)
    for i, x in enumerate(a, 1):
        new = [(-i, 0)]
        for j, y in enumerate(b, 1):
            s, m = row[j - 1]
            new.append(max((s + (1 if x == y else -1), m + (x == y)), (row[j][0] - 1, row[j][1]), (new[-1][0] - 1, new[-1][1])))
        row = new
        best = max(best, *row)
    return best


def test_extension_matches_the_whole_table(monkeypatch):
    monkeypatch.setattr(substrings, "DROP", 1000)
    monkeypatch.setattr(substrings, "BAND", 40)
    rng = np.random.default_rng(4)
    texts, places = [], []
    for _ in range(40):
        a = rng.integers(0, 4, rng.integers(0, 25))
        b = np.delete(a, rng.integers(0, len(a), 2)) if len(a) > 4 and rng.random() < 0.6 else rng.integers(0, 4, rng.integers(0, 25))
        places.append((sum(map(len, texts)), len(a), sum(map(len, texts)) + len(a), len(b)))
        texts += [a, b]
    x, (pa_, na, pb, nb) = np.concatenate(texts).astype(np.uint32), np.array(places).T
    took, src_took, same = substrings.extend(x, pa_, na, pb, nb, 1)
    back = substrings.extend(x, pa_ + na - 1, na, pb + nb - 1, nb, -1)
    for k in range(40):
        a, b = texts[2 * k].tolist(), texts[2 * k + 1].tolist()
        assert same[k] == (_best_start(a, b)[1] if a and b else 0)
        assert back[2][k] == (_best_start(a[::-1], b[::-1])[1] if a and b else 0)
        assert took[k] <= len(a) and src_took[k] <= len(b)


def test_fewest_spans_cover_all_words():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 30) for _ in range(rng.randint(1, 12)))]
        got = substrings.cover(spans)
        held = lambda z: {i for a, b in z for i in range(a, b)}
        assert held(got) == held(spans) and set(got) <= set(spans)


def test_tree_finds_the_largest_of_a_range():
    rng = random.Random(9)
    tree, value = substrings.MaxTree(13), [(0.0, -1)] * 14
    for k in range(300):
        i = rng.randint(1, 13)
        value[i] = (rng.choice([0.0, rng.random()]), k)
        tree.put(i, value[i])
        low = rng.randint(0, 13)
        high = rng.randint(low, 13)
        assert tree.largest(low, high) == max([(0.0, -1), *value[low + 1 : high + 1]])


def test_passages_of_edge_tables(docs, scratch):
    assert substrings.find_passages(docs([]), scratch).count() == 0
    t = text(70)
    rows = docs([(None, t), (1, t), (1, t), (2, t)]).withColumn("seed", F.lit(1)).withColumn("pos", F.lit(1))
    got = substrings.find_passages(rows, scratch.__class__(rows.sparkSession, "again")).collect()
    assert [(r["doc_id"], r["src_doc_id"], r["n_words"]) for r in got] == [(2, 1, 70)]


def test_tree_stops_where_nothing_above_changes():
    class Counted(list):
        writes = 0

        def __setitem__(self, i, value):
            self.writes += 1
            super().__setitem__(i, value)

    tree = substrings.MaxTree(1 << 10)
    tree.put(1, (2.0, 0))
    tree.most = Counted(tree.most)
    tree.put(3, (1.0, 1))  # 4 and all above it have the first
    tree.put(3, (0.0, -1))
    assert tree.most.writes <= 2 and tree.largest(0, 1 << 10) == (2.0, 0) and tree.largest(1, 1 << 10) == (0.0, -1)


@pytest.mark.parametrize("w", [1, 3, 8])
def test_minimizers_are_the_leftmost_least_of_their_windows(w):
    rng = random.Random(w)
    for n in (6, 7, 13, 14, 60):
        h = np.array([rng.randrange(3) for _ in range(n)], np.uint64)
        s = substrings._text.shingle_hashes(h, 6).tolist()
        windows = [range(i, i + w) for i in range(len(s) - w + 1)] or [range(len(s))]
        assert substrings.minimizers(h, 6, w)[1].tolist() == sorted({min(x, key=lambda j: (s[j], j)) for x in windows})

"""Every pipeline stage with null, repeated, empty and very long rows, clashing columns and an empty table; and the operators that keep a caller's columns."""

import os
import shutil
import sys
from collections import Counter

import pytest
from llm_brute import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from permuta.llm import mixing, near_vectors, substrings, token_output
from permuta.llm._store import table

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

CLASHES = "score predicted stat_upper n_words hits items ent id _row _group _key component_id mix_size mix_copies _s _slot text2 c0 c1 _0 _1 block start n".split()


@pytest.fixture
def odd_docs(spark, docs):
    """The small table with odd rows, and columns called like the operators' own."""
    long_ = " ".join(f"word{i % 977} stands here." for i in range(30_000))
    prose = table(spark, DATA, "documents").where("length(text) > 500").orderBy("doc_id").first()["text"]
    odd = docs([(None, None), (None, prose, "en", None), (900_001, ""), (900_002, " \t\n"), (900_003, long_, None, "a"), (900_004, prose, "en", "b"), (900_004, prose, "en", "b"), (900_005, None, None, "c")])
    every = table(spark, DATA, "documents").select(*odd.columns).unionByName(odd)
    return every.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_odd_rows(spark, odd_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd_docs, DATA)
    given = [tuple(r) for r in odd_docs.collect()]
    if name == "token_ids":
        got = out.collect()
        assert len(got) == len(given) and Counter(r["doc_id"] for r in got) == Counter(r[0] for r in given)
        ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        return
    assert out.columns == odd_docs.columns
    got = Counter(tuple(r) for r in out.collect())
    assert set(got) <= set(given) and got
    times = Counter(given)
    if name == "mixing":
        assert all(n <= 3 * times[r] for r, n in got.items())
    else:
        assert all(n <= times[r] for r, n in got.items())
    if name in ("near_duplicates", "decontamination"):  # rows without words stay
        assert all(got[r] == n for r, n in times.items() if not (r[1] or "").split())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_no_rows(spark, odd_docs, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, odd_docs.limit(0), DATA).count() == 0


def test_representatives_keep_a_callers_columns(spark, scratch):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (3, None, 1), (4, [0.0, 1.0], None), (4, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("_kept", "kept", "c0", "cid", "id", "n_links")})
    kept = near_vectors.keep_representatives(df, scratch)
    assert kept.columns == df.columns and sorted(str(r["vec_id"]) for r in kept.collect()) == ["1", "3", "4", "4", "None"]
    assert near_vectors.keep_representatives(df.limit(0), scratch.__class__(spark, "none")).count() == 0


def test_cutting_passages_keeps_a_callers_columns(spark, docs):
    passages = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (5, 0, 1)], "doc_id long, start int, end int")
    d = docs([(1, "a b c d"), (2, "a  b"), (None, "x y"), (5, None), (5, "p q")]).withColumns({c: F.lit("x") for c in ("_key", "_spans", "spans", "repeating", "c0", "start")})
    out = substrings.cut_passages(d, passages)
    assert out.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.where("text is not null").collect()) == [("1", "d"), ("2", "a  b"), ("5", "q"), ("None", "x y")]
    assert out.count() == 5 and {r["_key"] for r in out.collect()} == {"x"}


def test_mixing_steps_stay_small_and_move_no_text(spark, docs):
    d = docs([(i, "w " * (i % 7), None, "ab"[i % 2] if i % 5 else None) for i in range(300)])
    mixed = mixing.with_copies(d)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan and "Window" not in plan
    assert mixed.count() == 300


def test_mixing_of_many_sources_is_the_same(spark, docs, monkeypatch):
    d = docs([(i % 90, "w " * (i % 7), None, f"s{i % 40}" if i % 5 else None) for i in range(300)])
    few = Counter(tuple(r) for r in mixing.with_copies(d).collect())
    monkeypatch.setattr(mixing, "SOURCES", 5)
    assert Counter(tuple(r) for r in mixing.with_copies(d).collect()) == few and sum(few.values()) == 300


def test_the_driver_loads_no_tokenizer(spark, docs, scratch, tmp_path):
    import public_tokenizers

    own = str(tmp_path / "own.json")
    shutil.copy(public_tokenizers.path("byte_bpe_50k.json"), own)
    token_output.write_tokens(docs(["some text of a few words", "", None]), scratch.root, own)
    assert token_output.read_tokens(spark, scratch.root).count() == 3
    assert (own, False) not in vars(sys.modules.get("_permuta_encoders", token_output))

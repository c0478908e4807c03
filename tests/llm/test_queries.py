"""Registered contract queries against their SQL, and the pipeline against a brute-force version."""

import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_brute import DATA, hits, jaccard_components

import corpus_pipeline
from permuta.llm import mixing, quality, registry
from permuta.llm._store import table

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    return sorted(tuple(str(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got[columns]) == rows(want[columns])


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, DATA, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.learn(docs.where(~quality.held_out(docs["doc_id"], 4, 2)), table(spark, DATA, "labels"))
    good = {r["doc_id"]: text[r["doc_id"]] for r in quality.score(docs, model).where("predicted = 1").collect()}
    group = jaccard_components(good)[1]
    distinct = {i: t for i, t in good.items() if group[i] == i}
    items = [tuple(r) for r in table(spark, DATA, "benchmark").select("item_id", "text").collect()]
    clean = [i for i, t in distinct.items() if not hits(t, items)[1]]
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.with_copies(docs.where(docs["doc_id"].isin(clean))).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for i in sorted(clean):
        ids = library.encode(text[i] or "", add_special_tokens=False).ids + [0]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()) == want
    assert len(good) < len(text) and len(distinct) < len(good) and len(clean) < len(distinct) and Counter(copies.values())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_covers_its_table(spark, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    key, source = next(x for x in (("page_id", "pages"), ("conv_id", "conversations"), ("doc_id", "documents")) if x[0] in got.columns)
    there = {r[key] for r in table(spark, DATA, source).select(key).collect()}
    if name.startswith("op5"):  # a row for each passage
        assert len(got) and set(got[key]) <= there
        return
    assert set(got[key]) == there and len(got) == len(there)
    for column in set(got.columns) & {"predicted", "lang_pred", "held_out", "text", "n_chars", "n_tokens"}:
        assert got[column].notna().all()
    if "lang_pred" in got.columns:
        lang = {r["doc_id"]: r["lang"] for r in table(spark, DATA, "documents").collect()}
        rest = got[got.held_out & got.doc_id.map(lang).notna()]
        assert (rest.lang_pred == rest.doc_id.map(lang)).mean() > 0.9


def test_stage_columns(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name

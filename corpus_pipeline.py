"""A corpus from raw documents to token ids in five stages; each works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again.  All but the last return the columns of ``documents``, other columns included,
whatever they are called; an empty table gives no rows in every stage.  Null text is empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permuta.llm import decontaminate, mixing, ngram_join, quality, token_output
from permuta.llm._store import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject; each row is scored by itself, repeated rows and null keys too."""
    model = quality.learn(docs.where(~quality.held_out(F.col("doc_id"), 4, 2)), table(spark, sf_dir, "labels"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return quality.score(plain, model, f"c{docs.columns.index('text')}").where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id, null last; of rows that repeat it the first written.

    Null, empty and wordless texts link with nothing, so these rows all stay.
    """
    return ngram_join.keep_first_of_group(docs, Scratch(spark, "distinct"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; null and wordless texts hold none and stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a null source is a source of its own, rows without words follow their source's rate."""
    return mixing.pareto_mix(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the file format and read back: doc_id, start, n_tokens, ids_crc32, a row for each row of ``docs``, null keys first."""
    import public_tokenizers

    path = Scratch(spark, "corpus").root
    token_output.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return token_output.read_tokens(spark, path)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_distinct),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]

#: The first and the last stage (a trained classifier, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs

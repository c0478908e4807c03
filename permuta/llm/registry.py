"""Contract queries: each applies one operator to its whole tables and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permuta.llm import conversations, decontaminate, hmm, html_extract, language, line_dedup, manifest, mixing, near_vectors, ngram_join, quality, substrings, token_output
from permuta.llm._store import Scratch, table
from permuta.llm.oracles import ORACLES


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"), 7, 2), Scratch(spark, "hmm"))


def op2_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(table(spark, sf_dir, "documents"))
    taken = F.col("mix_size") * F.col("mix_copies")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken.alias("taken"))


def op3_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


def op4_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"), Scratch(spark, "shingles"))


def op5_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.find_passages(table(spark, sf_dir, "documents"), Scratch(spark, "passages"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "tokens").root
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return token_output.read_tokens(spark, path)


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"), 3, 1)
    model = language.learn(docs.where(~held))
    return language.identify(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op9_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = quality.held_out(F.col("doc_id"), 4, 2)
    model = quality.learn(docs.where(~held), table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op10_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_cuckoo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = line_dedup.LineIndex(spark, Scratch(spark, "lines"), least=10)
    index.insert(docs)
    return index.clean(docs, counted=True).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_nested_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    return manifest.verify_documents(table(spark, sf_dir, "documents"), Scratch(spark, "manifest"), tampered)


def op13_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.inject_faults(table(spark, sf_dir, "conversations"))
    return conversations.repair(rows, Scratch(spark, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_hidden_markov, op2_pareto_mixing, op3_spherical_kmeans, op4_adaptive_prefix_join, op5_collinear_chaining, op6_token_output, op7_language_id, op8_wu_manber, op9_rule_ensemble, op10_tag_path_ratios,
              op11_cuckoo_lines, op12_nested_intervals, op13_grammar_repair)
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}

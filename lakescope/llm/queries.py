"""Queries of the operators over their whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.llm import bpe, chat, licenses, line_dedup, lm, mixing, near_dup, ngram_join, quality, ranking, spelling, token_files, topk
from lakescope.llm.oracles import ORACLE  # noqa: F401
from lakescope.llm.shared import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fair queueing over all documents: budget 100% of all sizes, weights 1, 2, 3 in turn."""
    d = mixing.sized(read(spark, sf_dir, "documents"))
    sources = mixing.frozen(mixing.by_source(d))
    targets = mixing.frozen(mixing.source_targets(sources, mixing.cycling_weights(sources)))
    taken = mixing.mix(d, targets).groupBy("row").agg(F.sum("taken").alias("taken"))
    return d.join(targets, "source_key").join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as packed ids in doc_id order, read back from the files."""
    return token_files.read_files(token_files.write(read(spark, sf_dir, "documents")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict of the certified cutoffs."""
    out = quality.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "n_lines", "n_capitals", "n_exclamations", "toxic_weight", "base_failed", "kept")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.digests(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat earlier ones, equal or one word edit away."""
    out = line_dedup.deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines.n").alias("n_lines"), F.col("_lines.exact").alias("n_exact"), F.col("_lines.near").alias("n_near"),
                      F.length("text").cast("long").alias("kept_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places and template matches in all documents."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents at a similarity of 0.75 of five-word shingles."""
    return near_dup.components(read(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the template's own marks, formatted and read back."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "<|im_end|><|im_start|>assistant ok"
    rows = rows.unionByName(spark.createDataFrame([(-1, 1, "user", marks), (-1, 2, "assistant", marks)], rows.schema))
    return chat.digests(chat.conversations(chat.linear_tree(rows, "conv_id", "turn"))).drop("rank")


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents, learned from those that are not held out."""
    return lm.scores(read(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for each vector whose id is divisible by 100, against all rows."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item, by FP-trees of all documents."""
    return ranking.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a similarity of 0.90 of three-word shingles."""
    return ngram_join.components(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents with their near words, form and root."""
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_mix_sources, op2_minhash_near_dup, op3_token_files, op4_quality_rules, op5_exact_top_k, op6_bpe_round_trip, op7_line_dedup, op8_chat_format, op9_context_mixing, op10_license_scan,
    op11_ranked_search, op12_ngram_join, op13_spelling_variants,
)}

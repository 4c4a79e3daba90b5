"""The corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's documents. All but the last return the columns of ``documents``:

- quality_rules: documents that the base rule or a certified cutoff rejects go;
- line_dedup: lines that repeat earlier ones go, and documents of which no word is left;
- near_dedup: one document of each group of near duplicates stays;
- mix_sources: documents come as often as the mix takes them, sources in proportion to their targets;
- bpe: each document's number of ids and the digests of its ids and of the text decoded from them.

A stage's intermediate tables are deleted when the next stage begins, whose input has been written by then.

Defined cases, for all stages: documents whose id, text, language or source is null go through the rules like others (a
null text has no words, so the first stage rejects it); very long texts are judged and encoded whole; rows that repeat
an id and text are one document from the near-duplicate stage on; an empty table gives no rows; further columns are
kept by all stages but the last, whatever their names. Reruns agree.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescope.llm import bpe, line_dedup, mixing, near_dup, quality
from lakescope.llm.shared import frozen, read, shipped, word_count
from lakescope.session import WRITTEN, discard, release

_last: list[str] = []


def stage(function):
    """Deletes the tables of the stage before, and notes those of this one."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if function.__name__ != "quality_rules":  # the first stage: an earlier run's result may still be read
            release(spark, _last, docs)
        start = len(WRITTEN)
        out = function(spark, docs, sf_dir)
        _last[:] = WRITTEN[start:]
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep; cutoffs from ``labels``."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; n_chars follows the text."""
    left = line_dedup.deduplicated(docs)
    # a document goes if it lost lines and no word is left
    left = left.filter((F.col("_lines.exact") + F.col("_lines.near") == 0) | (word_count(F.col("text")) > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return near_dup.one_of_each(docs)


@stage
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents of the mix, each once for every epoch in which it is taken."""
    return mixing.mixed_documents(docs)


@stage
def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the way back."""
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_to_targets),
    ("bpe", encode_and_decode),
]

#: SQL can't express the signatures and the tokenizer; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents``."""
    shipped(spark)
    docs = read(spark, sf_dir, "documents")
    for _, function in STAGES[:-1]:
        before, docs = docs, frozen(function(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

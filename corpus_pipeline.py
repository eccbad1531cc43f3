"""Cleaning of the documents in stages: each reads what the one before has written.

The toxicity stage drops the documents that score at or over the operator's threshold; of each linked group of near-duplicates the one
with the least id stays; repeated strings are cut out of the texts (a text that is cut away wholly stays as an empty
one); the mix takes every document as many times as its source's target asks for; the last stage encodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm import bpe, jaccard_join, mixing, suffix_dedup, toxicity
from tapewright.llm.common import TABLES, drop_tables, read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, null and empty texts are scored too; learns from `labels` as the toxicity operator's query does."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more: the one with the least id. Documents without words have no links and stay."""
    return jaccard_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a repeated 200-byte string covers; n_chars counts what is left."""
    kept = suffix_dedup.deduplicated(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row, repeated ones too."""
    return bpe.encode(docs, bpe.tokenizer_path(), decoded=False).select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages learn, sort suffixes and tokenize: no SQL for them. tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of each stage but the last a table is written, and what it was made of is deleted then."""
    docs, before = read_table(spark, sf_dir, "documents"), len(TABLES)
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = written(docs, f"stage-{n}")
            drop_tables(spark, before, docs)
    return docs

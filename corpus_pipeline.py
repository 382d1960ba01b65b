"""Documents to packed training sequences: toxic ones go, near duplicates go, repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenorline.llm import neardup, packing, suffix_dedup, toxicity
from tenorline.llm.common import materialize, read
from tenorline.llm.queries import WORD_BPE


#: Bytes of a repeated passage: 50 words of five bytes each, blanks included, which is short for words.
PASSAGE = 250


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.keep_clean(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated passages; a text may end up empty, its document stays."""
    return suffix_dedup.remove(docs, PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("toxicity", without_toxic), ("minhash", one_of_each), ("suffix", without_repeats), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizers, classifiers and set similarity are beyond SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None

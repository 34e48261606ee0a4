"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and applies its decisions; all but the last return the
columns of docs. run() writes every stage's rows to the shared folder and starts the next stage from there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklode.llm import decontaminate, langid, linededup, minhash, packing
from tracklode.llm.common import cut, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, and those in which no language holds half of the letters, go."""
    return langid.keep_identified(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; a document of which nothing is left goes."""
    got = linededup.dedup_lines(docs)
    got = got.where((F.col("_tl_deleted") == 0) | (F.coalesce("text", F.lit("")) != ""))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.col("_tl_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity of at least 0.8) stays."""
    return minhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words lies in benchmark windows go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs

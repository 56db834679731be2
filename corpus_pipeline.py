"""A training-data pipeline over ``documents``: each stage calls one operator of ``seqlake.llm``.

Every stage takes the documents its predecessor kept, is judged on these alone, and returns rows
with the columns of ``documents`` (the last one: packed pieces). Columns beyond doc_id, text, lang,
source and n_chars are carried along. Null texts count as empty; an empty table passes through.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import line_dedup, mixing, packing, quality, simhash_dedup
from seqlake.session import settle


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs, shingle_words=3, max_bits=2)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier document's are cut from the texts."""
    out = line_dedup.dedup_units(docs)
    out = out.drop(out.columns[-1])    # the spans that were cut
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often, and as far, as the mix takes their words."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    cut = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN, capacity=2048, end_id=0)
    return packing.pack(cut, capacity=2048)


STAGES = [("quality_classifier", quality_stage), ("simhash_near_dedup", near_dedup_stage),
          ("substring_dedup", substring_stage), ("source_mixing", mixing_stage), ("best_fit_packing", packing_stage)]

ORACLE_SQL = None   # learned scores, hashed fingerprints and random draws are beyond SQL: tests/llm/test_pipeline.py holds every stage against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs

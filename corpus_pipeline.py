"""A corpus from raw documents to packed sequences, in four stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bidweave.llm import compression, jaccard, langid, packing
from bidweave.llm.common import discard, materialise, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands.

    Null and empty texts go; repeated rows and rows without doc_id are judged as any other; an empty table gives no rows.
    """
    return compression.keep_compressible(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their own labels teach.

    Null and letterless texts go; without labels all do; repeated rows and rows without doc_id are judged as any other.
    """
    return langid.keep_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least doc_id.

    Rows without doc_id or words stay; rows that repeat a doc_id and its text become one; an empty table gives no rows.
    """
    return jaccard.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences.

    Every row is packed, repeated ones as often as they occur; a null text is an end id alone; an empty table gives no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("packing", pack)]

#: Neither zstandard nor the tokenizer can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if last:
            discard(spark, last)
        last = path
    release(spark, last)
    return docs

"""Corpus preparation in stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a table; all but the last return the columns of ``documents``.

Defined cases, for every stage: null ids are kept and treated as an id after all
others; a null text is an empty one; columns with other names are carried along;
an empty table gives an empty table; texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import bpe_encode
from quire.llm.common import row_hash, row_id, stored, without_rows
from quire.llm.decontaminate import decontaminate
from quire.llm.minhash import drop_near_duplicates
from quire.llm.quality_rules import quality_rules
from quire.llm.suffix_dedup import cut_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have no words and go. Rows are told apart by id and
    text: equal rows share their fate, rows with one id and two texts need not.
    A null source is a host of its own.
    """
    key = F.struct(row_id().alias("doc_id"), row_hash().alias("h"))
    verdicts = quality_rules(docs.select(key.alias("doc_id"), "text", "source"))
    return without_rows(docs, verdicts.filter(~F.col("kept")).select("doc_id.doc_id", "doc_id.h"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id.

    Of equal rows one stays; of rows that tie in id the one with the smaller hash
    of its text. All texts without words are one class.
    """
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that an earlier document holds, and their new length.

    All rows stay, also those of which nothing is left; equal rows are cut
    alike; rows with one id do not cut each other.
    """
    return cut_texts(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Rows are told apart by id and text, as above; null and empty texts stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, items).filter("contaminated")
    return without_rows(docs, found.select(row_id().alias("doc_id"), "h"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding gives the text back) of every row; an empty text has no ids."""
    return bpe_encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("suffix-array dedup", repeats), ("decontamination", clean_of_benchmark), ("BPE", tokens)]

#: SQL has no form of the near-duplicate classes and the vocabulary's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline over ``documents``: each stage is one operator, applied to all that the stage before kept.

Rows: a null or empty text is not toxic, has no near copies, no repeated bytes and no benchmark item, so it stays and is packed as one end-of-document token, once for each id; null ids,
languages, sources and lengths don't decide anything and stay; repeated rows, and rows of one id with one text, are copies of which one stays; an id with several texts keeps
each that is no copy of another; very long texts are looked at whole; other columns stay up to the last stage, whatever their names; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import decontaminate, ngram_join, packing, suffix_dedup, toxicity
from pathloom.llm.scratch import Scratch


#: Bytes from which a repeated string is a passage that goes: 50 words of four letters and a blank.  The operator's own default of 400 is its query's contract;
#: here it would leave most passages of 50 to 60 words, which have about 280 to 400 bytes.  Of the strings so long those of over 50 words are passages;
#: a shorter phrase of long words stays.
PASSAGE_BYTES, PASSAGE_WORDS = 250, 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects are gone."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that word shingles link, the one with the least id stays."""
    return ngram_join.keep_one(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of ``PASSAGE_BYTES`` and ``PASSAGE_WORDS`` or more are cut from the texts; a text that loses all of itself is gone."""
    return suffix_dedup.remove(docs, suffix_dedup.DedupParams(length=PASSAGE_BYTES, min_words=PASSAGE_WORDS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item are gone."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows over all that is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_dedup", remove_repeated_strings),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: a fitted classifier and a tokenizer are no SQL; the tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written as Parquet to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs

"""A training corpus from raw documents: quality, near copies, repeated passages, the mix of sources, sequences.

Every stage takes rows with null and repeated ids, null and empty texts, and further columns of any name; all but the last
return the columns they are given.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import crf, mixing, packing, simhash, suffix
from kinloom.llm.base import stage
from kinloom.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field rejects go.

    A null text is judged as an empty one.  Without labels of both classes every document is judged by the one there is, and kept if there is none.
    """
    return crf.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row stays: of the smallest id, or without one if none has an id.

    Null and empty texts and those of white space alone are one group.  Of equal rows one stays.
    """
    return simhash.one_row_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat elsewhere are taken out of the texts; documents of which nothing is left go.

    Null texts stay null; a character that loses a byte goes whole; n_chars is counted anew.
    """
    cut = suffix.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).filter(F.col("text").isNull() | (F.trim("text") != ""))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most.

    Documents are taken whole: the one in which a source's budget ends comes once more if half of it or more is taken, so that a source's
    words differ from its target by half a document at most (and by what equal rows share).  Documents without words, null
    texts among them, are not taken.  A null source is one source, the last.
    """
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences; a row that is there twice is two documents."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate documents", near_copies),
    ("repeated passages", repeated_passages),
    ("source mix", mixture),
    ("best-fit packing", sequences),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = stage(docs, f"pipeline-{i}")
    return docs

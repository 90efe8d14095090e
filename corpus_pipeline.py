"""From documents to token ids: quality, repeated lines, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read back as the next one's docs.  All but the last return the columns of documents.  Further columns
pass through all but the last, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rushes.llm.common import read, written
from rushes.llm.decontaminate import drop_contaminated
from rushes.llm.line_dedup import drop_repeated_lines
from rushes.llm.near_dedup import drop_near_duplicates
from rushes.llm.quality_classifier import drop_low_quality
from rushes.llm.sentencepiece_fst import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null and empty texts are judged like any other, repeated rows alike."""
    return drop_low_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that stand in earlier ones, null doc_ids first.

    Null and empty texts stay; documents of which only blank lines are left go, and so do later exact copies.
    """
    return drop_repeated_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least doc_id; null and empty texts are one group."""
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; texts without words stay, and all do if the benchmark is empty."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left; null and empty texts have none."""
    return encode(docs.select("doc_id", "text"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_copies), ("decontamination", benchmark), ("encoding", tokens)]

#: SQL can express neither the classifier nor the samples; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs

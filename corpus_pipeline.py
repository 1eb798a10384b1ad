"""The corpus pipeline: each stage takes all that its predecessor kept.

Every stage but the last returns the columns of documents and no others, whatever else its table has and however
that is named; an empty table gives an empty one. Very long texts are worked on whole. Ties and the rest are as
the operators' docstrings define them; what that means for the rows is said beside each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import common, decontaminate, line_dedup, near_dedup, packing, quality_classifier

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts and rows without an id are scored like others;
    repeated rows stay or go together; a score of exactly the bound stays."""
    return quality_classifier.classify(docs, common.table(spark, sf_dir, "labels")).filter("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines. One that lost lines goes where only blanks are left, or where an earlier
    document had just its text, whose short lines alone would be left. Null and empty texts and rows without an id
    stay as they are; repeated rows stay together; of equal lines, that of the smallest id and line number stays."""
    out = line_dedup.deduplicate(docs, whole=True)
    return out.filter(r"lines_removed = 0 or not whole_copy and text rlike r'(?U)\S'").select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest id. Texts without words, null ones too, and rows
    without an id stay; of repeated rows one stays."""
    return near_dedup.deduplicate(docs).select(*COLUMNS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that is mostly made of them goes. Null and empty texts stay, rows
    without an id or repeated are treated one by one."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training windows and the pieces of documents in them. Null and empty texts are in no window; rows without
    an id and repeated ones are packed like others; equal lengths go by id, then by a hash of the text."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmarks), ("packing", windows)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs

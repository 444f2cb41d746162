"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes all that the one before kept. Quality rules remove failing lines and documents that fail; near-dedup keeps
one document of each group; decontamination drops documents that hold benchmark passages; personal data is replaced by its
kind; what is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postloom.llm import decontamination, near_dedup, packing, pii, quality_rules
from postloom.llm.common import cut, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines removed. Null and empty texts fail; repeated rows are judged one by one."""
    return quality_rules.clean(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, by shingles of five words; which one, and rows without an id or repeated ones: as deduplicate() says."""
    return near_dedup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go, each judged by its own text, whatever its id."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; personal data in their texts becomes its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their sequences; a null text is empty."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("pii", redact), ("packing", pack)]
#: Tokenizing and fits have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = cut(out) if k < len(STAGES) - 1 else out
    return docs

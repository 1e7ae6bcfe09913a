"""The corpus pipeline: five operators in a row, each stage written as Parquet and read by the next.

Quality rules and toxicity drop documents, near-dedup keeps one document of each group, suffix dedup
takes repeated strings out of the texts that are left, and packing fits them into token sequences. All
stages but the last return the columns of documents.

Cases: documents with a null or empty text fail the quality rules and go; null and repeated doc_ids are
judged row by row, and near-dedup keeps one row of each group; an empty table gives no rows; further columns
pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalroom.llm import common, minhash, packing, quality, suffixes, toxicity

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("near-duplicates", minhash.stage),
    ("suffix dedup", suffixes.stage),
    ("packing", packing.stage),
]
#: Trained dictionaries, registers and tokens have no counterpart in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = common.new_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: documents to packed training sequences, stage after stage.

Each stage gets what its predecessor kept, written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackmill.llm import langid, packing, passages, simhash
from trackmill.sources.tables import materialise, table

STAGES = [
    ("language", langid.identify_language),
    ("near-duplicates", simhash.drop_near_duplicates),
    ("passages", passages.cut_passages),
    ("packing", packing.pack_documents),
]

#: No stage of these can be said in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

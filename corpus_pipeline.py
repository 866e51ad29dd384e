"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. Null and empty texts: language ID rejects them (they have no
letter), later stages keep what they are given. Ties and repeated rows: one row of each near-duplicate
group stays, that of the smallest doc_id (null ids last, then by a hash of the text). Extra columns, of
any name, pass through all stages but the last, which returns pieces of packed sequences instead of
documents; ``doc_id`` joins them to a stage's other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm.common import Stages
from factweave.llm.language_id import stage_language
from factweave.llm.packing import stage_packing
from factweave.llm.secrets import stage_secrets
from factweave.llm.simhash import stage_simhash
from factweave.llm.suffix_dedup import stage_suffix_dedup

STAGES = [
    ("language_id", stage_language),
    ("simhash_dedup", stage_simhash),
    ("suffix_dedup", stage_suffix_dedup),
    ("secret_scan", stage_secrets),
    ("packing", stage_packing),
]

#: No SQL: the stages learn a classifier, link shingle sets transitively and run a tokenizer. Tests
#: compare a whole run with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder."""
    stages = Stages(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stages.put(stage(spark, docs, sf_dir), name)
        if number:
            stages.drop(STAGES[number - 1][0])
    return docs

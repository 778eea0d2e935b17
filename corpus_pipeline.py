"""A training-data pipeline over `documents`: each stage's rows are written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm.common import prepare, stored
from netloom.llm.stages import keep_good_quality, keep_known_languages, keep_one_of_each_class, mix_to_targets, pack_sequences

STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("ngram_jaccard_join", keep_one_of_each_class),
    ("mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: No stage before the last can be expressed in SQL: trained models and sampled recursion decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole table."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs

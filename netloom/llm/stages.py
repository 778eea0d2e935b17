"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> rows kept, with the columns of documents.

Columns that a caller's documents have besides keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import boosted, language_id, mixing, ngram_join, packing, quality
from netloom.llm.common import prepare

#: Columns that operators may read; all others are put aside while they run.
READ = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The rows with the caller's other columns under names that no operator uses, and what gives the columns back."""
    names = [c if c in READ else f"__own_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID over all documents: those without a language go. A text in several languages has that of most of its letters."""
    prepare(spark)
    rows, back = _aside(docs)
    found = language_id.identify(rows, language_id.fit(rows), spans=False)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*back)


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier over all documents: those predicted 0 go. All labels may train it."""
    prepare(spark)
    rows, back = _aside(docs)
    forest = boosted.fit(*quality.training_rows(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(rows, forest).filter("predicted = 1").select(*back)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each class of near duplicates the document with the lowest id stays."""
    prepare(spark)
    rows, back = _aside(docs)
    return ngram_join.keep_first(rows).select(*back)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing by soft membership: each document stays with the probability of its rate, which is at most 1 here."""
    prepare(spark)
    labelled = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = _aside(docs)
    membership = mixing.fit_membership(rows, labelled, list(mixing.TARGETS))
    return mixing.mix(rows, membership, mixing.TARGETS, max_rate=1.0).filter("copies > 0").select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of at most 1024 tokens: the pieces, without their ids."""
    prepare(spark)
    return packing.pack(docs, packing.tokenizer_path(), keep_ids=False)

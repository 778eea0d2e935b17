"""Training, scoring and guarding of Spark ML classifiers."""

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.scalars import sanitized
from netloom.schema import FEATURES
from netloom.sources.flows import _join


def label_indexer(label: str = "label", known: list[str] | None = None):
    """Label encoder with classes in alphabetical order; unknown labels are an error.

    With `known` a fixed encoder is returned instead of one to be fitted.
    """
    if known is not None:
        from pyspark.ml.feature import StringIndexerModel

        return StringIndexerModel.from_labels(sorted(known), label, "label_index", "error")
    return StringIndexer(
        inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="error"
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight` = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    # One row per class: the class count is bounded by the label vocabulary.
    totals = counts.agg(F.struct(F.sum("_n").alias("n"), F.count("*").alias("k"))).scalar()
    weights = counts.withColumn("_t", totals).select(label, (F.col("_t.n") / (F.col("_t.k") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def classifier(
    kind: str, seed: int = 42, trees: int = 100, depth: int = 8, weight: str | None = None, rate: float = 0.1, subsample: float = 0.8, columns: str = "0.8"
):
    """`rate`, `subsample` (rows per tree) and `columns` (features per node) are for boosted trees."""
    common = {"featuresCol": "features_vec", "labelCol": "label_index", "seed": seed, "maxDepth": depth}
    if weight:
        common["weightCol"] = weight
    if kind == "rf":
        return RandomForestClassifier(numTrees=trees, **common)
    if kind == "dt":
        return DecisionTreeClassifier(**common)
    if kind == "gbt":
        booster = GBTClassifier(maxIter=trees, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns, **common)
        weighted = {"weightCol": weight} if weight else {}
        return OneVsRest(classifier=booster, featuresCol="features_vec", labelCol="label_index", rawPredictionCol="rawPrediction", **weighted)
    raise ValueError(f"unknown classifier: {kind}")


def train(
    df: DataFrame, kind: str = "rf", label: str = "label", seed: int = 42, trees: int = 100, depth: int = 8, balanced: bool = False, **boosting
) -> PipelineModel:
    """Fit label encoder, assembler and classifier on feature rows; `balanced` weighs rows by the inverse of their label's share."""
    data = class_weights(df, label) if balanced else df
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features_vec", handleInvalid="error")
    indexer = label_indexer(label).fit(data)
    model = classifier(kind, seed, trees, depth, "weight" if balanced else None, **boosting)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return Pipeline(stages=[indexer, assembler, model, back]).fit(data)


def _predict(df: DataFrame, model: PipelineModel, prefix: str) -> DataFrame:
    """Add one struct column with label, confidence, encoded label and probabilities."""
    out = df
    for stage in model.stages[1:]:
        out = stage.transform(out)
    if "probability" in out.columns:
        prob = vector_to_array("probability")
    else:
        e = F.transform(vector_to_array("rawPrediction"), lambda v: F.exp(v))
        prob = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
    out = out.withColumn("_p", prob)
    result = F.struct(
        F.col("predicted_label").alias("label"),
        F.array_max("_p").alias("confidence"),
        F.col("prediction").cast("int").alias("encoded"),
        F.col("_p").alias("probabilities"),
    )
    return out.withColumn(prefix, result).select(*df.columns, prefix)


def score(df: DataFrame, primary: PipelineModel | None, secondary: PipelineModel | None = None) -> DataFrame:
    """Score feature rows with both models. The primary decides; an absent model yields null."""
    ready = df.withColumns({f: sanitized(f) if f in df.columns else F.lit(0.0) for f in FEATURES})
    empty = F.lit(None).cast("struct<label:string,confidence:double,encoded:int,probabilities:array<double>>")
    out = _predict(ready, primary, "primary") if primary is not None else ready.withColumn("primary", empty)
    out = _predict(out, secondary, "secondary") if secondary is not None and primary is not None else out.withColumn("secondary", empty)
    return out.withColumns(
        {
            "label": F.col("primary.label"),
            "confidence": F.col("primary.confidence"),
            "encoded": F.col("primary.encoded"),
            "model_outputs": F.struct("primary", "secondary"),
        }
    ).drop("primary", "secondary")


def _digests(spark: SparkSession, path: str) -> dict[str, str]:
    """SHA-256 of every file of a saved model, computed on the workers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("f"), F.sha2("content", 256).alias("d"))
    return {r["f"]: r["d"] for r in rows.collect()}


def save_model(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    """Save the pipeline with a sidecar of feature columns and file digests."""
    spark = SparkSession.getActiveSession()
    target = _join(path, "model")
    writer = model.write().overwrite() if overwrite else model.write()
    writer.save(target)
    write_manifest(spark, path, FEATURES, "overwrite" if overwrite else "errorifexists")


def write_manifest(spark: SparkSession, path: str, features: list[str], mode: str) -> None:
    body = json.dumps({"features": features, "digests": _digests(spark, _join(path, "model"))}, sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode(mode).text(_join(path, "manifest"))


def load_model(path: str) -> PipelineModel:
    """Load a saved pipeline, refusing other feature columns or altered files."""
    spark = SparkSession.getActiveSession()
    manifest = json.loads(spark.read.text(_join(path, "manifest")).first()[0])
    if manifest["features"] != FEATURES:
        raise ValueError("the model was trained on other feature columns")
    if manifest["digests"] != _digests(spark, _join(path, "model")):
        raise ValueError("model files do not match their recorded digests")
    return PipelineModel.load(_join(path, "model"))




"""Model quality from (actual, predicted) pairs."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.schema import NORMAL


def confusion(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for every pair of known labels, zeros included. `labels` has a column `label`.

    Rows with an unknown actual label are left out; see `unknown_labels`.
    """
    counts = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    names = labels.select("label").distinct()
    # The grid has one cell per pair of classes; it is built from the sorted class list.
    classes = names.agg(F.array_sort(F.collect_set("label")).alias("c"))
    grid = classes.select(F.explode("c").alias("actual"), "c").select("actual", F.explode("c").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def unknown_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows per actual label that the model does not know."""
    counts = pairs.groupBy(F.col("actual").alias("label")).agg(F.count("*").alias("n"))
    return counts.join(labels.select("label").distinct(), "label", "left_anti")


def _ratio(a, b):
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def class_metrics(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 on an empty denominator."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = conf.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    cols = conf.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted_n"))
    out = rows.join(cols, "label", "left").withColumns(
        {"precision": _ratio(F.col("tp"), F.col("predicted_n")), "recall": _ratio(F.col("tp"), F.col("support"))}
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).select(
        "label", "precision", "recall", "f1", "support", "tp"
    )


def overall_metrics(per_class: DataFrame) -> DataFrame:
    """Accuracy and support-weighted averages as one row."""
    total = F.sum("support")

    def weighted(c):
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    return per_class.agg(
        _ratio(F.sum("tp"), total).alias("accuracy"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        total.alias("support"),
    )


def normal_fpr(conf: DataFrame, normal: str = NORMAL) -> DataFrame:
    """Share of attack rows predicted as normal traffic (the positive class is normal)."""
    attack, says_normal = F.col("actual") != normal, F.col("predicted") == normal
    fp = F.sum(F.when(attack & says_normal, F.col("n")).otherwise(0))
    tn = F.sum(F.when(attack & ~says_normal, F.col("n")).otherwise(0))
    return conf.agg(fp.alias("fp"), tn.alias("tn"), _ratio(fp, fp + tn).alias("normal_traffic_fpr"))


def report(conf: DataFrame) -> dict[str, str]:
    """JSON and markdown text of the k x k result; only class-sized tables are collected."""
    per_class = class_metrics(conf)
    classes = [r.asDict() for r in per_class.orderBy("label").collect()]
    total = overall_metrics(per_class).first().asDict()
    fpr = normal_fpr(conf).first()["normal_traffic_fpr"]
    cells = [r.asDict() for r in conf.orderBy("actual", "predicted").collect()]
    body = {"overall": total, "classes": classes, "confusion": cells, "normal_traffic_fpr": fpr}
    lines = ["# Evaluation", "", f"- accuracy: {total['accuracy']:.6f}", f"- weighted F1: {total['f1_weighted']:.6f}",
             f"- normal traffic FPR: {fpr:.6f}", "", "| label | precision | recall | f1 | support |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {c['label']} | {c['precision']:.4f} | {c['recall']:.4f} | {c['f1']:.4f} | {c['support']} |" for c in classes]
    return {"json": json.dumps(body, sort_keys=True), "markdown": "\n".join(lines)}

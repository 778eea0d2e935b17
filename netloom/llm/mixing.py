"""Mixing sources to target weights by soft membership.

A classifier fitted on the labelled table gives each document's posterior over domains. Its rate is the expected number
of copies; rates are fitted by projected gradient least squares so that the expected tokens of each domain meet a target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import prepare, read, stored

#: Domains of the labelled table, and the shares of tokens wanted.
TARGETS = {"clean": 0.96, "junk": 0.02, "toxic": 0.02}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled rows; rows with a null id or label are left out, and a repeated id counts once."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("junk")
    return labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max(kind).alias("domain"))


@dataclass
class Membership:
    """Domains, and the model of their posterior; without a model the first domain is certain."""

    domains: list[str]
    model: object | None
    features: int

    def words(self, text: str = "text") -> Column:
        return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "")

    def posterior(self, docs: DataFrame) -> DataFrame:
        """`docs` with `n_tokens` (words) and `posterior` (one number for each domain)."""
        docs = docs.withColumn("__words", self.words())
        if self.model is None:
            p = F.array(*[F.lit(float(k == 0)) for k in range(len(self.domains))])
            return docs.withColumn("n_tokens", F.size("__words").cast("long")).withColumn("posterior", p).drop("__words")
        tf = HashingTF(numFeatures=self.features, binary=True, inputCol="__words", outputCol="__features").transform(docs)
        scored = self.model.transform(tf.withColumn("n_tokens", F.size("__words").cast("long")))
        return scored.withColumn("posterior", vector_to_array("__probability")).drop("__words", "__features", "__probability", "__raw", "__prediction")


def fit_membership(docs: DataFrame, labelled: DataFrame, domains: list[str], features: int = 1 << 14, fit_rows: int = 20_000) -> Membership:
    """Multinomial regression on the words of labelled documents.

    `fit_rows` bounds the labels used (the first by hash), and so the table broadcast; it concerns the fit only. Domains
    without labelled documents are left out.
    """
    chosen = stored(labelled.filter(F.col("domain").isin(domains)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows), "mixing-labels")
    empty = Membership(domains, None, features)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("domain", empty.words().alias("__words"))
    seen = {r[0] for r in rows.select("domain").distinct().collect()}
    present = [d for d in domains if d in seen]
    if len(present) < 2:
        return Membership([*present, *(d for d in domains if d not in seen)], None, features)
    number = F.array_position(F.array(*map(F.lit, present)), F.col("domain")).cast("double") - 1
    data = HashingTF(numFeatures=features, binary=True, inputCol="__words", outputCol="__features").transform(rows.withColumn("__label", number)).select("__label", "__features")
    model = LogisticRegression(family="multinomial", maxIter=25, regParam=1e-3, standardization=False, labelCol="__label", featuresCol="__features", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__prediction").fit(data)
    return Membership(present, model, features)


def _rates(history: list[tuple[list[float], float]], max_rate: float) -> Column:
    """A document's (rate, ahead) after the steps so far.

    A step takes a multiple of the posterior from the point ahead and clips to the allowed range; the next point ahead
    lies beyond that in the direction of the step (momentum).
    """
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    if not history:
        return start
    steps = F.array(*[F.struct(F.array(*map(F.lit, move)).alias("move"), F.lit(beyond).alias("beyond")) for move, beyond in history])

    def step(at, s):
        dot = F.aggregate(F.zip_with("posterior", s["move"], lambda p, m: p * m), F.lit(0.0), lambda x, y: x + y)
        rate = F.greatest(F.lit(0.0), F.least(F.lit(max_rate), at["ahead"] - dot))
        return F.struct(rate.alias("rate"), (rate + s["beyond"] * (rate - at["rate"])).alias("ahead"))

    return F.aggregate(steps, start, step)


def fit_rates(scored: DataFrame, targets: dict[str, float], domains: list[str], max_rate: float, tolerance: float = 1e-5, most: int = 60) -> Column:
    """The column of rates, from (n_tokens, posterior) rows.

    Minimises the squared distance of expected domain tokens from their targets, each domain scaled by its own weight in
    the normal equations. The budget is the tokens of the domain with the largest target, divided by that target. A step
    is one aggregation of as many sums as there are domains; the rows stay where they are. Unreachable targets end at
    the nearest totals; it stops when totals change by less than `tolerance` of the budget.
    """
    k = len(domains)
    p = [F.get("posterior", F.lit(i)) for i in range(k)]
    t = F.col("n_tokens").cast("double")
    first = scored.agg(*[F.sum(t * p[i]).alias(f"s{i}") for i in range(k)], *[F.sum(t * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    sums = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    gram = np.array([[first[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    share = np.array([targets.get(d, 0.0) for d in domains])
    if not sums.sum() or not share.sum():
        return F.lit(1.0)
    share = share / share.sum()
    lead = int(share.argmax())
    goal = share * sums[lead] / share[lead]
    weight = 1.0 / np.maximum(np.diag(gram), 1e-3 * gram.max())  # a domain with next to no tokens can't outweigh the others
    root = np.sqrt(weight)
    step = 1.0 / np.linalg.eigvalsh(root[:, None] * gram * root).max()
    history: list[tuple[list[float], float]] = []
    ahead = before = sums
    pace = 1.0
    for _ in range(most):
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        history.append(((step * weight * (ahead - goal)).tolist(), (pace - 1) / faster))
        pace = faster
        at = scored.select("n_tokens", "posterior", _rates(history, max_rate).alias("at"))
        row = at.agg(*[F.sum(t * p[i] * F.col(f"at.{c}")).alias(f"{c}{i}") for i in range(k) for c in ("rate", "ahead")]).first()
        now, ahead = (np.array([row[f"{c}{i}"] for i in range(k)]) for c in ("rate", "ahead"))
        if np.abs(now - before).max() <= tolerance * goal.sum():
            break
        before = now
    return _rates(history, max_rate)["rate"]


def mix(docs: DataFrame, membership: Membership, targets: dict[str, float], max_rate: float = 4.0, keep_text: bool = True, seed: int = 5) -> DataFrame:
    """`docs` with n_tokens, posterior, rate and copies: the rate rounded up or down at random by a hash of doc_id.

    Null and empty texts have no tokens and the rate of their posterior. Repeated rows get equal rates and copies.
    An empty table, or a labelled table with one domain, gives rates of 1. Columns of these names are replaced.
    """
    prepare(docs.sparkSession)
    scored = membership.posterior(docs.drop("n_tokens", "posterior", "rate", "copies"))
    scored = stored(scored if keep_text else scored.drop("text"), "mixing-posterior")
    rate = fit_rates(scored.select("n_tokens", "posterior"), targets, membership.domains, max_rate)
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return scored.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def op8(spark, sf_dir: str) -> DataFrame:
    """Posterior, rate and copies of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    membership = fit_membership(docs, label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet")), list(TARGETS))
    out = mix(docs, membership, TARGETS, keep_text=False)
    return out.select("doc_id", "n_tokens", *[F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(membership.domains)], "rate", "copies")


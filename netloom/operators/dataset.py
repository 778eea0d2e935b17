"""Cleaning, mapping, splitting and recording labelled flow data sets."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from netloom.functions.scalars import finite, normalized_label, numeric
from netloom.schema import BAD_LABELS, FEATURES, LABEL, RAW_LABEL, RAW_MICROS, RAW_TO_FEATURE, WHOLE_FEATURES
from netloom.sources.flows import missing_features


def trimmed_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def clean_raw(df: DataFrame, label: str = RAW_LABEL, lineage: tuple = ("source_file",)) -> DataFrame:
    """Drop repeated rows (before any projection), then rows without a label; trim labels."""
    cols = [c for c in df.columns if c not in lineage]
    kept = df.dropDuplicates(cols)
    return kept.withColumn(label, F.trim(label)).filter(F.col(label).isNotNull() & (F.col(label) != ""))


def seconds_from_micros(df: DataFrame) -> DataFrame:
    """Durations recorded in microseconds, only when they carry their raw name."""
    return df.withColumns({c: numeric(c) / 1e6 for c in RAW_MICROS if c in df.columns})


def map_flow_columns(df: DataFrame, extra: tuple = ()) -> DataFrame:
    """The 37 features in canonical order as doubles (null when unreadable), then `extra`."""
    missing = missing_features(df.columns)
    if missing:
        raise ValueError("missing feature columns: " + ", ".join(missing))
    raw = {feature: name for name, feature in RAW_TO_FEATURE.items()}
    names = {f: raw[f] if raw[f] in df.columns else f for f in FEATURES}
    plain = {f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)}

    def value(name: str) -> Column:
        """One parse of each column; numbers need none."""
        v = F.col(f"`{name}`").cast("double") if name in plain else numeric(f"`{name}`")
        return v / 1e6 if name in RAW_MICROS else v

    return df.select(*[value(names[f]).alias(f) for f in FEATURES], *extra)


def finite_rows(df: DataFrame) -> DataFrame:
    return df.filter(reduce(Column.__and__, [finite(f) for f in FEATURES]))


def invalid_feature_counts(df: DataFrame) -> DataFrame:
    """Per feature the number of rows with a NaN, infinite or unreadable value."""
    counts = df.agg(*[F.sum((~finite(numeric(f))).cast("bigint")).alias(f) for f in FEATURES])
    return counts.unpivot([], FEATURES, "feature", "invalid_rows")


def require_valid_features(df: DataFrame) -> DataFrame:
    """The frame itself, or an error that names the columns with invalid values."""
    bad = [r["feature"] for r in invalid_feature_counts(df).collect() if r["invalid_rows"]]
    if bad:
        raise ValueError("invalid feature values: " + ", ".join(f for f in FEATURES if f in bad))
    return df


def clean_prepared(df: DataFrame) -> DataFrame:
    """The cleaning of prepared files: bad labels dropped, bad numbers 0, no negatives,
    unknown protocols and ports out of range 0, counts rounded half to even."""
    df = trimmed_names(df)
    label = F.trim(F.col(f"`{LABEL}`").cast("string"))
    rows = df.withColumn(LABEL, label).filter(label.isNotNull() & ~F.lower(label).isin(BAD_LABELS))

    def value(name: str) -> Column:
        v = numeric(name)
        return F.greatest(F.when(finite(v), v).otherwise(0.0), F.lit(0.0))

    cols = {f: F.rint(value(f)) if f in WHOLE_FEATURES else value(f) for f in FEATURES}
    cols["protocol"] = F.when(cols["protocol"].isin(0.0, 1.0, 6.0, 17.0), cols["protocol"]).otherwise(0.0)
    cols["dst_port"] = F.when(cols["dst_port"] > 65535, 0.0).otherwise(cols["dst_port"])
    typed = [cols[f].cast("bigint").alias(f) if f in WHOLE_FEATURES else cols[f].alias(f) for f in FEATURES]
    return rows.select(*typed, F.col(f"`{LABEL}`"))


def prepare(raw: DataFrame) -> DataFrame:
    """Raw labelled flows to clean labelled features."""
    cleaned = clean_raw(trimmed_names(raw))
    mapped = map_flow_columns(cleaned, (normalized_label(RAW_LABEL).alias(LABEL),))
    return finite_rows(mapped)


def label_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.groupBy(F.col(f"`{label}`").alias("label")).agg(F.count("*").alias("rows"))


def test_targets(counts: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Rows of each label that go to the test part: half-even rounding, never all of several."""
    target = F.rint(F.col("rows") * F.lit(test_size)).cast("bigint")
    capped = F.when(F.col("rows") > 1, F.least(target, F.col("rows") - 1)).otherwise(target)
    return counts.withColumn("test_rows", F.greatest(capped, F.lit(0)))


def proportional_targets(counts: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Rows of each label that go to the test part when its total is fixed: ceil(size * rows).

    Labels share the training part in proportion; what whole numbers leave over goes to
    the largest remainders (label order on ties). The table has one row per label.
    """
    everything = Window.partitionBy()
    n, rows = F.sum("rows").over(everything), F.col("rows")
    n_train = n - F.ceil(n * F.lit(test_size))
    out = counts.withColumn("_n", n).withColumn("_t", n_train.cast("bigint"))
    out = out.withColumn("_base", F.floor(rows * F.col("_t") / F.col("_n")).cast("bigint"))
    out = out.withColumn("_rest", rows * F.col("_t") % F.col("_n"))
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), "label"))
    out = out.withColumn("_rank", rank).withColumn("_need", F.col("_t") - F.sum("_base").over(everything))
    train = F.col("_base") + (F.col("_rank") <= F.col("_need")).cast("bigint")
    return out.select(*counts.columns, (rows - train).alias("test_rows"))


test_targets.__test__ = False


def stratified_split(
    df: DataFrame, label: str = LABEL, test_size: float = 0.2, seed: int = 42, buckets: int = 4096, targets=test_targets
) -> DataFrame:
    """Add `is_test`, exactly the target number of rows per label, decided by a seeded hash.

    `targets` is `test_targets` (each label rounded) or `proportional_targets` (total fixed).

    A label may hold most rows, so no global order per label is built: hash buckets per
    label are counted, whole buckets below the target are taken, and only the bucket in
    which the target falls is ranked. The same rows and seed give the same split.
    """
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    lab = F.col(f"`{label}`")
    content = [F.col(f"`{c}`") for c in df.columns]
    h = F.xxhash64(F.lit(seed), *content)
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    sizes = rows.groupBy(lab.alias("_label"), "_b").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wanted = targets(sizes.groupBy(F.col("_label").alias("label")).agg(F.sum("_n").alias("rows")), test_size)
    plan = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(
        wanted.withColumnRenamed("label", "_label"), "_label"
    )
    plan = plan.select("_label", "_b", (F.col("test_rows") - F.col("_before")).alias("_left"), "_n")
    joined = rows.join(plan, (lab == F.col("_label")) & (rows["_b"] == plan["_b"])).drop(plan["_b"])
    split_bucket = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    ranked = (
        joined.filter(split_bucket)
        .withColumn("_r", F.row_number().over(Window.partitionBy("_label", "_b").orderBy("_h", F.hash(*content))))
        .withColumn("is_test", F.col("_r") <= F.col("_left"))
        .drop("_r")
    )
    sure = joined.filter(~split_bucket).withColumn("is_test", F.col("_left") > 0)
    return sure.unionByName(ranked).select(*[F.col(f"`{c}`") for c in df.columns], "is_test")

"""Quality classifier: boosted trees over statistics of whole texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import boosted
from netloom.llm.common import batches, crc_of, prepare, read, texts

STATISTICS = [
    "log_chars", "log_words", "letters", "digits", "upper", "space", "marks", "symbols", "non_ascii", "word_mean", "word_sd", "short_words", "capital_words", "upper_words", "bare_words",
    "marked_words", "digit_words", "distinct_words", "top_word", "distinct_triples", "lines", "repeated_lines", "line_mean", "ended_lines", "sentence_words", "entropy",
]
_BYTES = np.zeros((256, 6))
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " \t\n\r", ".,;:!?'\"()-", "#$%&*+/<=>@[\\]^_`{|}~")):
    _BYTES[[ord(c) for c in _chars], _i] = 1
ENDS = (".", "!", "?", ":", '"')


def statistics(text: str) -> list[float]:
    """Numbers in the order of STATISTICS; all zero for an empty text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    share = counts @ _BYTES / size
    p = counts[counts > 0] / size
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    bare = sum(k for w, k in seen.items() if w.isalpha())
    capital = sum(k for w, k in seen.items() if w[0].isupper())
    upper = sum(k for w, k in seen.items() if len(w) > 1 and w.isupper())
    marked = sum(k for w, k in seen.items() if not w[-1].isalnum() and w[-1] not in ".,")
    digit = sum(k for w, k in seen.items() if any(map(str.isdigit, w)))
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    ended = sum(x.rstrip().endswith(ENDS) for x in lines)
    stops = int(counts[46] + counts[33] + counts[63])
    return [
        np.log1p(len(text)), np.log1p(len(words)), *share, float(counts[128:].sum() / size), float(sizes.mean()), float(sizes.std()), float((sizes <= 2).sum() / n), capital / n, upper / n, bare / n,
        marked / n, digit / n, len(seen) / n, max(seen.values(), default=0) / n, triples, np.log1p(m), 1 - len(set(lines)) / m, np.log1p(size / m), ended / m, min(200.0, n / max(1, stops)), float(-(p * np.log2(p)).sum()),
    ]


def features(values: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in values], dtype=np.float64).reshape(len(values), len(STATISTICS))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", fit_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of labelled rows.

    `fit_rows` bounds the labels used (the first by hash), and so the table broadcast and the rows brought to
    the driver; it concerns the fit only. A key with several labels counts as the lowest; null labels and keys
    are left out. Of rows that repeat a labelled key the driver gets `fit_rows` at most.
    """
    labelled = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("double").alias("y"))
    chosen = labelled.orderBy(F.xxhash64(key), key).limit(fit_rows)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(chosen), key).select("text", "y")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            found = features(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(found), pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y double, x array<double>").limit(fit_rows).toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(STATISTICS)))
    return x, got["y"].to_numpy(dtype=np.float64)


def score(docs: DataFrame, forest: boosted.Forest, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of `docs` with `score` (0 to 1) and `predicted` (1 from `threshold` on).

    Null and empty texts have all statistics zero and get the score of such a row. Columns of these two names are
    replaced. Each row is scored by itself, so repeated rows get equal scores.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(forest)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    base = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            s = shared.value.scores(features(texts(batch, text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*kept, "score", "predicted"])

    return base.mapInArrow(run, f"{schema}, score double, predicted int")


def op7(spark, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    held_out = crc_of("doc_id") % 4 == 2
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    forest = boosted.fit(*training_rows(docs, labels))
    return score(docs.withColumn("held_out", held_out), forest).drop("text")

"""Language identification of mixed-language texts.

Method: the scripts of a word narrow the candidate languages, a character-trigram model scores
the word under each candidate, and a Viterbi pass with a switching penalty labels every word.
Runs of equal labels are the spans; the language with most letters is the text's language.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import batches, crc_of, prepare, read, texts

#: First code point after each script's range, and the script. Ranges follow the Unicode blocks.
SCRIPT_ENDS = (
    (0x0250, "latin"), (0x0370, "other"), (0x0400, "greek"), (0x0530, "cyrillic"), (0x0590, "armenian"), (0x0600, "hebrew"), (0x0700, "arabic"), (0x0750, "other"), (0x0780, "arabic"), (0x0900, "other"),
    (0x0980, "devanagari"), (0x0E00, "indic"), (0x0E80, "thai"), (0x10A0, "other"), (0x1100, "georgian"), (0x1200, "hangul"), (0x1E00, "other"), (0x1F00, "latin"), (0x2000, "greek"), (0x3040, "other"),
    (0x30A0, "kana"), (0x3100, "kana"), (0x3400, "other"), (0xA000, "han"), (0xAC00, "other"), (0xD7B0, "hangul"), (0x110000, "other"),
)
_ENDS = np.array([end for end, _ in SCRIPT_ENDS])

RESULT = "lang_pred string, score double, spans array<struct<start:long,end:long,lang:string,letters:long>>"
UNKNOWN = "und"


@functools.cache
def script_of(ch: str) -> str:
    return SCRIPT_ENDS[int(np.searchsorted(_ENDS, ord(ch), side="right"))][1]


@dataclass
class LanguageModel:
    """Trigram log probabilities by language and hash bucket, and the scripts each language is written in."""

    langs: list[str]
    log_p: np.ndarray  # buckets x languages
    scripts: dict[str, list[int]]  # script -> languages
    switch: float
    max_words: int = 800_000  # words remembered by a worker before it starts anew
    _row: dict = field(default_factory=dict)  # word -> row of the arrays below, -1 for one without letters
    _scores: np.ndarray | None = None
    _sizes: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_row": {}, "_scores": None, "_sizes": None}

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of scores of each word."""
        if self._scores is None or len(self._row) > self.max_words:
            self._row, self._scores, self._sizes = {}, np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        new = [(w, letters_of(w)) for w in set(words).difference(self._row)]
        self._row.update((w, -1) for w, letters in new if not letters)
        new = [x for x in new if x[1]]
        if new:
            self._row.update((w, len(self._sizes) + i) for i, (w, _) in enumerate(new))
            found, begins = trigram_buckets([letters for _, letters in new], len(self.log_p))
            scores = np.add.reduceat(self.log_p[found], begins)
            for i, (_, letters) in enumerate(new):
                allowed = self._allowed(letters)
                if len(allowed) < len(self.langs):
                    out = np.ones(len(self.langs), bool)
                    out[allowed] = False
                    scores[i, out] = -50.0 * len(letters)
            self._scores = np.concatenate([self._scores, scores])
            self._sizes = np.concatenate([self._sizes, [len(letters) for _, letters in new]])
        return np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))

    def _allowed(self, letters: str) -> list[int]:
        """Languages written in a script of the word; all, if none is."""
        scripts = {"latin"} if letters.isascii() else set(map(script_of, letters))
        return sorted({k for s in scripts for k in self.scripts.get(s, ())}) or list(range(len(self.langs)))


#: Cut from the ends of words before anything else; other marks go one by one.
EDGES = ".,;:!?\"'()[]{}|*#%$&-_/"


def letters_of(chunk: str) -> str:
    """The letters of a word, composed and in lower case."""
    chunk = chunk.strip(EDGES)
    if chunk.isascii() and chunk.isalpha():
        return chunk.lower()
    lower = unicodedata.normalize("NFC", chunk).lower()
    return lower if lower.isalpha() else "".join(filter(str.isalpha, lower))


def trigram_buckets(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the character trigrams of words, with the words' edges marked; and where each word's trigrams begin."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes + 2)
    with np.errstate(over="ignore"):
        h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) + points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + points[2:] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    inside = np.ones(len(h), bool)
    inside[ends[:-1] - 2] = inside[ends[:-1] - 1] = False
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def chunks_of(text: str, width: int = 64) -> list[str]:
    """Words between white space; longer ones, as in scripts without spaces, in pieces of bounded width."""
    words = text.split()
    if len(text) <= width or max(map(len, words), default=0) <= width:
        return words
    return [w[i : i + width] for w in words for i in range(0, len(w), width)]


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best label of every row of each score matrix, when each change of label costs `penalty`.

    All matrices step together, the longest first, so one step is a few array operations over all texts still running.
    """
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order], dtype=np.int64)
    if not len(order) or not lengths[0]:
        return [np.zeros(0, dtype=np.int16) for _ in scores]
    steps = int(lengths[0])
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    offset = np.concatenate([[0], np.cumsum(running)])  # rows are ordered by step, then by text
    place = [offset[:n] + k for k, n in enumerate(lengths)]
    best = np.empty((offset[-1], scores[order[0]].shape[1]))
    for k, i in enumerate(order):
        best[place[k]] = scores[i]
    for t in range(1, steps):
        n = running[t]
        before, here = best[offset[t - 1] : offset[t - 1] + n], best[offset[t] : offset[t + 1]]
        here += np.maximum(before, before.max(axis=1, keepdims=True) - penalty)
    top = best.argmax(axis=1).astype(np.int16)
    switched = best < best.max(axis=1, keepdims=True) - penalty
    back = np.where(switched, top[:, None], np.arange(best.shape[1], dtype=np.int16))
    labels = top  # right for the last step of each text; the others follow from their successors
    for t in range(steps - 2, -1, -1):
        a, n = offset[t], running[t + 1]
        labels[a : a + n] = back[np.arange(a, a + n), labels[offset[t + 1] : offset[t + 2]]]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int16)] * len(scores)
    for k, i in enumerate(order):
        out[i] = labels[place[k]]
    return out


def _spans(text: str, words: list[str], rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, langs: list[str]) -> list[dict]:
    """Code point ranges of equal label; chunks without letters belong to the span before them."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    begins = np.concatenate([[0], cuts])
    sums = np.add.reduceat(weights, begins)
    at, offsets, place = 0, [0], np.flatnonzero(rows >= 0)[cuts].tolist()
    if place:
        left = iter(place)
        now = next(left)
        for k, word in enumerate(words):
            at = text.index(word, at)
            if k == now:
                offsets.append(at)
                now = next(left, None)
                if now is None:
                    break
            at += len(word)
    ends = [*offsets[1:], len(text)]
    return [{"start": a, "end": b, "lang": langs[labels[c]], "letters": int(n)} for a, b, c, n in zip(offsets, ends, begins, sums, strict=True)]


def label_texts(model: LanguageModel, values: list[str], spans: bool = True) -> list[tuple[str, float, list[dict]]]:
    """Language, share of its letters, and spans of each text."""
    if not model.langs:
        return [(UNKNOWN, 0.0, []) for _ in values]
    words = [chunks_of(t) for t in values]
    flat = model.rows([w for ws in words for w in ws])
    rows = np.split(flat, np.cumsum([len(ws) for ws in words])[:-1])
    kept = [r[r >= 0] for r in rows]
    paths = viterbi([model._scores[k] for k in kept], model.switch)
    out = []
    for text, ws, rs, k, path in zip(values, words, rows, kept, paths, strict=True):
        if not len(k):
            out.append((UNKNOWN, 0.0, []))
            continue
        weights = model._sizes[k]
        share = np.bincount(path, weights=weights, minlength=len(model.langs)) / weights.sum()
        best = int(share.argmax())
        out.append((model.langs[best], float(share[best]), _spans(text, ws, rs, path, weights, model.langs) if spans else []))
    return out


def fit_sample(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", fit_rows: int = 8000) -> DataFrame:
    """The labelled rows (text, lang) used by a fit: of each language those of the lowest hashes, about `fit_rows`; all, if it has no more.

    A language always keeps the rows of its least hash. The driver gets the row count of each language beyond `fit_rows`.
    """
    whole = 1 << 30
    name, place = F.col(lang).cast("string"), F.pmod(F.xxhash64(F.col(order), F.col(text)), F.lit(whole))
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), name.alias("lang"), place.alias("place"))
    large = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least")).filter(F.col("n") > fit_rows).collect()
    if not large:
        return rows.select("text", "lang")
    most = F.create_map(*[F.lit(x) for r in large for x in (r.lang, max(r.least, whole * fit_rows // r.n))])
    return rows.filter(F.col("place") <= F.coalesce(most[F.col("lang")], F.lit(whole))).select("text", "lang")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", fit_rows: int = 8000, buckets: int = 1 << 15, smoothing: float = 0.3, switch: float = 8.0, max_chunks: int = 200_000) -> LanguageModel:
    """Trigram counts by language from labelled rows, over whole texts.

    `fit_rows` is the expected number of labelled rows used of each language (see `fit_sample`); it concerns the fit only.
    A worker holds `max_chunks` distinct words, and those of one batch, before it counts their trigrams. The driver gets
    languages x `buckets` counts at most.
    """
    sample = fit_sample(docs, text, lang, order, fit_rows)
    names = sorted({s for _, s in SCRIPT_ENDS})

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        found: Counter = Counter()

        def flush() -> None:
            for name, seen in words.items():
                known = [(letters, n) for chunk, n in seen.items() if (letters := letters_of(chunk))]
                for letters, n in known:
                    found[name, -1 - names.index(script_of(letters[0]))] += n
                if known:
                    ids, _ = trigram_buckets([letters for letters, _ in known], buckets)
                    sums = np.bincount(ids, weights=np.repeat([n for _, n in known], [len(letters) for letters, _ in known]), minlength=buckets)
                    found.update({(name, int(b)): int(sums[b]) for b in np.flatnonzero(sums)})
            words.clear()

        for batch in batches(parts):
            for value, name in zip(texts(batch), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(name, Counter()).update(chunks_of(value))
            if sum(map(len, words.values())) > max_chunks:
                flush()
        flush()
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.string()), "b": pa.array([k[1] for k in found], pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    got = sample.mapInArrow(count, "lang string, b long, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in got})
    counts = np.zeros((len(langs), buckets))
    seen: dict[tuple[str, int], int] = {}
    for r in got:
        if r.b >= 0:
            counts[langs.index(r.lang), r.b] = r.n
        else:
            seen[names[-1 - r.b], langs.index(r.lang)] = r.n
    total = {k: sum(n for (_, j), n in seen.items() if j == k) for k in range(len(langs))}
    scripts: dict[str, list[int]] = {}
    for (script, k), n in seen.items():
        if n >= 0.01 * total[k]:  # a script in which the language is really written
            scripts.setdefault(script, []).append(k)
    log_p = np.log((counts + smoothing) / (counts.sum(axis=1, keepdims=True) + smoothing * buckets))
    return LanguageModel(langs, np.ascontiguousarray(log_p.T.astype(np.float32)), scripts, switch)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", spans: bool = True) -> DataFrame:
    """All columns of `docs` with `lang_pred`, `score` and `spans` (empty lists with spans=False).

    `score` is the share of letters in spans of that language. A null, empty or letterless text is `und` with score 0
    and no spans; so is every text if the model knows no language. Columns of these names are replaced. Ties go to the
    language first in alphabetical order. Equal texts get equal results; a very long text is one row of its batch.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    base = docs.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("letters", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches(parts):
            got = label_texts(m, texts(batch, text), spans)
            extra = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], kind)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*kept, "lang_pred", "score", "spans"])

    return base.mapInArrow(run, f"{schema}, {RESULT}")


def op9(spark, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the four fifths of them that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_of("doc_id") % 5 == 0)
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model, spans=False).drop("text", "spans")

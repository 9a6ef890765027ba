"""Quality classifier: Naive Bayes support vectors.

A text becomes indicators of n-grams: lower-cased words and pairs of words, and runs of up to three word shapes
(case, punctuation at the end, whether the word repeats the last one). Indicators are scaled by the log-count
ratios of the two classes, and a linear hinge-loss model is fitted to them by dual coordinate descent. Margins
become scores between 0 and 1 by a logistic curve, fitted on folds that the model did not see.

Scale: the fit takes a sample of labelled rows with a fixed bound (`sample_rows`, `SAMPLE_BYTES`), in one task, so that a
lost executor costs a rerun of that task. What is broadcast is one float for each of 2^FEATURE_BITS features.
Scoring is one narrow pass over the whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import mixed, texts

FEATURE_BITS = 18
#: Labelled rows of each class at most that the model is fitted on; those with the least hash of their doc_id.
SAMPLE_ROWS = 6_000
#: Bytes of a sampled text at most in the sample's budget: longer ones are not sampled. Scores read whole texts.
SAMPLE_TEXT_BYTES = 64 << 10
#: Bytes of all sampled texts that the fit reads at most, in the order of their hash: some ten times as much memory.
SAMPLE_BYTES = 48 << 20
_SHAPE = re.compile(rb"^([^0-9A-Za-z\x80-\xff]*)(.*?)([^0-9A-Za-z\x80-\xff]*)$", re.S)
_MEMO = 200_000


class _Words(dict):
    """word -> a place in `hashes`, whose rows are (lower-cased word, its shape); starts afresh beyond a bound."""

    def __init__(self) -> None:
        self.hashes = np.empty((_MEMO, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        before, core, after = _SHAPE.match(word).groups()
        text = core.decode("utf-8", "replace")
        kind = "0" if not text else "d" if text.isdigit() else "U" if len(text) > 1 and text.isupper() else "T" if text[:1].isupper() else "l" if text.islower() else "m"
        at = self[word] = len(self)
        self.hashes[at] = xxhash.xxh3_64_intdigest(word.lower()), xxhash.xxh3_64_intdigest(before + b"\0" + kind.encode() + b"\0" + after)
        return at

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > len(self.hashes):
            self.clear()
            if len(words) > len(self.hashes):
                self.hashes = np.empty((len(words), 2), np.uint64)
        return self.hashes[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def features(text: bytes | None, memo: _Words) -> np.ndarray:
    """The distinct feature numbers of a text, ascending; none for null, empty and blank texts."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.int64)
    word, shape = memo.of(words).T
    again = np.zeros(len(word), np.uint64)
    again[1:] = word[1:] == word[:-1]
    shape = mixed(shape + again)
    two = mixed(shape[:-1] + np.uint64(7)) + shape[1:]
    found = [word + np.uint64(11), mixed(word[:-1]) + word[1:], shape, two, mixed(two[:-1]) + shape[2:]]
    return np.unique(mixed(np.concatenate(found)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def fit_hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dims: int, *, cost: np.ndarray, passes: int = 30, tolerance: float = 1e-3) -> np.ndarray:
    """Weights of the L1-loss linear support vector machine by dual coordinate descent (with a last weight for the bias)."""
    w = np.zeros(dims + 1)
    alpha = np.zeros(len(y))
    norm = np.array([float(v @ v) for v in values]) + 1.0
    rng = np.random.default_rng(0)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            at, v, t = rows[i], values[i], y[i]
            g = t * (float(w[at] @ v) + w[dims]) - 1.0
            a = alpha[i]
            projected = min(g, 0.0) if a == 0.0 else max(g, 0.0) if a == cost[i] else g
            if abs(projected) < 1e-12:
                continue
            worst = max(worst, abs(projected))
            alpha[i] = min(max(a - g / norm[i], 0.0), cost[i])
            if step := (alpha[i] - a) * t:
                w[at] += step * v
                w[dims] += step
        if worst < tolerance:
            break
    return w


def _ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
    """The log-count ratio of each feature between the two classes."""
    counts = np.full((2, 1 << FEATURE_BITS), smooth)
    for k, sign in enumerate((1.0, -1.0)):
        own = [r for r, t in zip(rows, y.tolist(), strict=True) if t == sign]
        for i in range(0, len(own), 1_000):
            counts[k] += np.bincount(np.concatenate(own[i : i + 1_000]), minlength=1 << FEATURE_BITS)
    p, q = counts
    return np.log((p / p.sum()) / (q / q.sum()))


def _train(rows: list[np.ndarray], y: np.ndarray, smooth: float, cost: float, blend: float) -> tuple[np.ndarray, np.ndarray]:
    """One weight a feature, ratio included, and the bias last; and the ratios."""
    dims = 1 << FEATURE_BITS
    ratio = _ratios(rows, y, smooth)
    ends = np.cumsum([len(r) for r in rows])
    flat = np.empty(int(ends[-1]))  # one block, which goes back to the system as a whole
    values = np.split(flat, ends[:-1])
    for r, v in zip(rows, values, strict=True):
        v[:] = ratio[r]
        v /= max(float(np.linalg.norm(v)), 1e-9)
    share = (y > 0).mean()
    w = fit_hinge(rows, values, y, dims, cost=np.where(y > 0, cost * 0.5 / share, cost * 0.5 / (1 - share)))
    mean = np.abs(w[:-1]).mean()
    return np.r_[((1 - blend) * mean + blend * w[:-1]) * ratio, w[-1]], ratio


def _margin(weights: np.ndarray, ratio: np.ndarray, row: np.ndarray) -> float:
    return float(weights[row].sum()) / max(float(np.linalg.norm(ratio[row])), 1e-9) + float(weights[-1]) if len(row) else float(weights[-1])


def _logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(sample: Iterable[tuple[bytes | None, int]], *, smooth: float = 1.0, cost: float = 1.0, blend: float = 0.9, folds: int = 4, most_bytes: int = SAMPLE_BYTES) -> bytes:
    """The model as bytes, from texts and labels 0 or 1: weights, ratios, a, b. Of one class alone: a constant score. It reads texts until they have `most_bytes`."""
    memo, found, labels, used = _Words(), [], [], 0
    for text, label in sample:
        used += len(text or b"")
        if used > most_bytes and found:
            break
        found.append(features(text, memo).astype(np.int32))
        labels.append(label)
    flat = np.concatenate([np.empty(0, np.int32), *found])
    rows = np.split(flat, np.cumsum([len(f) for f in found])[:-1]) if found else []
    del found, memo
    good = np.array([k == 1 for k in labels], bool)
    dims = 1 << FEATURE_BITS
    if len(set(good.tolist())) < 2:
        share = (good.sum() + 1) / (len(good) + 2)
        return np.r_[np.zeros(dims + 1), np.zeros(dims), 1.0, np.log(share / (1 - share))].astype(np.float32).tobytes()
    y = np.where(good, 1.0, -1.0)
    margins = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        inside = np.flatnonzero(fold != k)
        if len(set(y[inside].tolist())) == 2:
            weights, ratio = _train([rows[i] for i in inside], y[inside], smooth, cost, blend)
            for i in np.flatnonzero(fold == k).tolist():
                margins[i] = _margin(weights, ratio, rows[i])
    a, b = _logistic(margins, good)
    weights, ratio = _train(rows, y, smooth, cost, blend)
    return np.r_[weights, ratio, a, b].astype(np.float32).tobytes()


class Model:
    def __init__(self, raw: bytes) -> None:
        flat = np.frombuffer(raw, np.float32).astype(np.float64)
        dims = 1 << FEATURE_BITS
        self.weights, self.ratio, (self.a, self.b) = flat[: dims + 1], flat[dims + 1 : -2], flat[-2:]
        self.memo = _Words()

    def score(self, text: bytes | None) -> float:
        m = self.a * _margin(self.weights, self.ratio, features(text, self.memo)) + self.b
        return float(1 / (1 + np.exp(-min(max(m, -30.0), 30.0))))


def training_sample(documents: DataFrame, labels: DataFrame, column: str, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """h, label, text of at most `sample_rows` labelled documents of each class that may be learnt from.

    Those are the ones whose crc32 of doc_id as text, mod 5, is not 0, and the sample is the ids with the least hash: chosen
    from the labels alone, so that a list of bounded size is broadcast to the documents. Labels other than 0 and 1 do
    not count; of several labels of a doc_id the greatest does; texts beyond SAMPLE_TEXT_BYTES are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    known = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most

    def least(label: int) -> DataFrame:
        # Hashes are even: below this bound lie some 2 x sample_rows of them, so that no task sorts the labels of all tasks.
        bound = min(2**63 - 1, -(2**63) + 2**64 * (2 * sample_rows + 1_000) // max(1, sizes.get(label, 0)))
        return known.where((F.col("label") == label) & (F.col("h") <= bound)).orderBy("h", "doc_id").limit(sample_rows)

    ids = [least(k) for k in (0, 1)]
    rows = documents.where(F.octet_length(F.coalesce("text", F.lit(""))) <= SAMPLE_TEXT_BYTES).select("doc_id", "text")
    rows = rows.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("h", "label", "text")
    return rows.orderBy("h", "text").limit(2 * sample_rows)  # rows may repeat a doc_id


def fit_on(sample: DataFrame) -> bytes:
    """Fits on a bounded sample (h, label, text), in one task. Returns the model; it has a fixed size. Without rows every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(texts(batch.column("text")), batch.column("label").to_pylist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows)], pa.binary())], ["model"])

    rows = sample.coalesce(1).sortWithinPartitions("h", "label", "text").mapInArrow(run, "model binary").take(1)
    return bytes(rows[0][0]) if rows else fit([])  # a sample without partitions runs nothing


def judges(model: bytes) -> bool:
    """Whether a model tells texts apart; one of a single class, or of no rows, gives all texts the same score."""
    return bool(np.frombuffer(model, np.float32)[: 1 << FEATURE_BITS].any())


def score_of(spark: SparkSession, model: bytes) -> Callable[[Column], Column]:
    """A function of a text column: its score, from the text alone. A null, empty or blank text gets the score of no features."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(sent.value)  # and its words go with the task
        for texts_of in batches:
            yield pd.Series([own.score(t.encode("utf-8", "surrogatepass") if t else None) for t in texts_of], dtype="float64")

    return score


def scored(documents: DataFrame, model: bytes, column: str = "score") -> DataFrame:
    """The rows with a double `column`, from their text; a column that has that name already is replaced."""
    return documents.withColumn(column, score_of(documents.sparkSession, model)("text"))


def held_out(column: str) -> Column:
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))

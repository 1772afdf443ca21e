"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each whole text gives a row of statistics (lengths, shares of kinds of characters and words,
repetition of words, pairs and lines). Trees are grown on binned statistics of a bounded
sample of labelled rows (``sample_rows``, in the order of a hash) with the logistic loss;
they are complete trees of one depth, flattened into arrays of features, thresholds and
leaves, so that a batch goes down all trees at once in numpy.

Edge cases: null and empty texts have statistics of zero and are scored like any text; rows
without a label or with a null label are scored but not learned from; several labels of one
id count as good if one is; without labels, or with one class only, every score is the
share of good rows (0.5 without rows); an empty table gives an empty table; other columns
pass through ``keep_good`` untouched under any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import append_columns, prepare, slices

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, LEAF_ROWS, SHRINK = 120, 4, 48, 0.08, 20, 2.0

STATISTICS = ("characters", "words", "word_length", "lines", "line_length", "upper", "lower", "digit", "space",
              "wide", "point", "exclaim", "bar", "sign", "short_words", "upper_words", "signed_words", "distinct_words",
              "top_word", "distinct_pairs", "stutter", "distinct_lines", "longest_word", "title_words")

_KIND = np.zeros(256, dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = (0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if _c.isdigit() and _i < 128 else 3 if _c in " \t\r\n\x0b\x0c"
                 else 4 if _i >= 128 else 5 if _c in ".,;:'\"?-" else 6 if _c == "!" else 7 if _c == "|" else 8)
_LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123)) | frozenset(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` of a whole text."""
    data = (text or "").encode("utf-8")
    w = data.split()
    if not w:
        return [float(len(data)), *[0.0] * (len(STATISTICS) - 1)]
    n, size = len(w), len(data)
    kinds = np.add.reduceat(np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)[_ORDER], _STARTS) / size
    length = np.fromiter(map(len, w), dtype=np.int64, count=n)
    count = Counter(w)
    lines = [x for x in data.split(b"\n") if x.strip()]
    signed = sum(c for x, c in count.items() if x[-1] not in _LETTERS and x[-1] not in b".,;:'\"?!-)0123456789")
    return [float(size), float(n), float(length.mean()), float(len(lines)), size / len(lines), *kinds.tolist(),
            float((length <= 3).mean()), sum(c for x, c in count.items() if len(x) > 1 and x.isupper()) / n, signed / n,
            len(count) / n, max(count.values()) / n, len(set(zip(w, w[1:]))) / max(1, n - 1),
            sum(map(bytes.__eq__, w, w[1:])) / n, len(set(lines)) / len(lines), float(length.max()),
            sum(c for x, c in count.items() if x.istitle()) / n]


_ORDER = np.argsort(_KIND, kind="stable")
_STARTS = np.searchsorted(_KIND[_ORDER], np.arange(9))


@dataclass
class Trees:
    """Complete binary trees of ``DEPTH`` levels as arrays [tree, node]; the last level holds leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.leaf[trees, node - (2 ** self.depth - 1)].sum(axis=1)

    @property
    def depth(self) -> int:
        return int(np.log2(self.leaf.shape[1])) if len(self.feature) else 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(len(texts), len(STATISTICS))
        m = self.margin(x) if len(self.feature) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(m, -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Trees:
    """Boosting with the logistic loss on quantile histograms, level by level."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        none = np.zeros((0, 1))
        return Trees(none.astype(np.int64), none, none, 0.0 if not len(y) else base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    wide, leaves = bins + 1, 2 ** depth
    feature = np.zeros((trees, leaves - 1), dtype=np.int64)
    threshold = np.full((trees, leaves - 1), np.inf)
    leaf = np.zeros((trees, leaves))
    margin = np.full(len(y), base)
    offset = np.arange(x.shape[1]) * wide
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width = 2 ** level
            local = node - (width - 1)
            at = (local[:, None] * (x.shape[1] * wide) + offset + binned).ravel()
            shape = (width, x.shape[1], wide)
            total = width * x.shape[1] * wide
            sums = [np.bincount(at, weights=np.repeat(v, x.shape[1]), minlength=total).reshape(shape) for v in (g, h, np.ones_like(g))]
            left = [s.cumsum(axis=2)[:, :, :-1] for s in sums]
            whole = [s.sum(axis=2, keepdims=True) for s in sums]
            right = [a - b for a, b in zip(whole, left)]
            gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - whole[0] ** 2 / (whole[1] + SHRINK)
            gain[(left[2] < LEAF_ROWS) | (right[2] < LEAF_ROWS)] = 0
            for k, c in enumerate(cuts):
                gain[:, k, len(c):] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            f, b = best // (wide - 1), best % (wide - 1)
            real = flat[np.arange(width), best] > 1e-9
            for i in np.flatnonzero(real):
                feature[t, width - 1 + i] = f[i]
                threshold[t, width - 1 + i] = cuts[f[i]][b[i]]
            limit = np.where(real, b, wide)
            node = 2 * node + 1 + (binned[np.arange(len(y)), f[local]] > limit[local])
        local = node - (leaves - 1)
        leaf[t] = -RATE * np.bincount(local, weights=g, minlength=leaves) / (np.bincount(local, weights=h, minlength=leaves) + SHRINK)
        margin += leaf[t][local]
    return Trees(feature, threshold, leaf, base)


def fit(docs: DataFrame, labels: DataFrame, held_out, key: str = "doc_id", text: str = "text", label: str = "quality",
        sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from a sample of the labelled rows that are not held out (``held_out``: Column -> Column)."""
    spark = docs.sparkSession
    prepare(spark)
    y = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    y = y.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("good"))
    y = y.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(sample_rows)
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(y), "id").select("text", "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [statistics(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "good"])

    got = rows.mapInArrow(run, "x array<double>, good int").toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(STATISTICS))
    order = np.lexsort(x.T)          # the sum of floats in one order, however rows arrive
    return grow(x[order], got["good"].to_numpy(dtype=np.float64)[order])


def _scored(df: DataFrame, model: Trees) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    return df.mapInArrow(run, append_columns(df.select("id"), "score double"))


def score(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1, higher: better) of every row."""
    prepare(docs.sparkSession)
    scored = _scored(docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")), model)
    return scored.select(F.col("id").alias(key), "score")


def keep_good(docs: DataFrame, model: Trees, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with all their columns."""
    prepare(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("id"), F.col(text).cast("string").alias("text"))
    return _scored(packed, model).where(F.col("score") >= threshold).select("id.*")

"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary labelled documents, spell every word
of a text by n-grams of ``ORDER`` characters inside the word (its start and end included), so
an insult is known by its stem, whatever its ending. A class has its own counts of the highest
order; it backs off, by absolute discounting and a fixed strength, to one Kneser-Ney model of
the counts of both classes, whose lower orders count the different characters in front of an
n-gram. An expression that a class knows little gets its probability from these shared counts.

A word's evidence is its toxic less its ordinary log-likelihood. Its level depends on the
language and topic of a text (shares of the classes), so the median word of the text is taken
off, but never more than nearly all ordinary training documents have as their median: a text
of insults only does not set its own level. Of what is left only the part above ``MARGIN``
counts; the sum per word of the text goes through a logistic curve to 0..1.

Counting covers all labelled training documents. A word counts once per document (what one
document repeats is one piece of evidence). Counts are kept by exact n-gram in one Spark table
that grows with the corpus; no n-grams share a count. Scoring takes the distinct n-grams of the
documents and joins them, of all orders at once, with the counts, to one value for each. Up to
``BROADCAST_GRAMS`` n-grams (counted first; 16 bytes each) their values are sent to the tasks,
beyond it they are summed to words and meet the documents by a shuffle. Values are whole numbers
of a small unit, so that both ways give the same scores to the last bit. The curve is fitted on a
fold of the training rows that counting leaves out, of which at most ``calibration_rows`` are
used, taken in the order of a hash. Documents that are named when the model is fitted share its
one set of values. Scores are written before they are returned, and what was sent is taken back.

Edge cases: null texts and texts without letters are scored as having no evidence; rows without a label or with a null label are scored but not
learned from; several labels of one id count as toxic if one is; if a class has no
documents, every score is 0 (no toxic document known) or 1; an empty table gives an empty
table; other columns pass through ``keep_ordinary`` untouched under any names.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import append_columns, prepare, slices, staged

ORDER = 6
DISCOUNT = 0.75
#: Documents that the shared model weighs as much as in a class, in each context.
STRENGTH = 100.0
#: Log-likelihood (nats per word) within which a word does not stand out from its text.
MARGIN = 1.0
#: Share of the ordinary training documents whose median word is at most the highest level.
LEVEL_SHARE = 0.99
#: One of so many training rows is kept for the curve.
CALIBRATION_FOLD = 5
CALIBRATION_ROWS = 20_000
#: Labels (12 bytes each) up to which they are broadcast; beyond it they are shuffled.
BROADCAST_LABELS = 2_000_000
#: Distinct n-grams of the documents (16 bytes each) up to which their values are broadcast: 32 MB.
BROADCAST_GRAMS = 2_000_000
#: Bytes of the words whose value a Python worker remembers within a task before it starts anew.
CACHE_BYTES = 32 << 20
#: Bytes of distinct words, and number of n-grams, that a task holds before it passes n-grams on.
COUNT_BYTES, COUNT_GRAMS = 16 << 20, 200_000
#: Characters of words, and n-grams, that are worked on at once.
PIECE = 1 << 18
THRESHOLD = 0.7

_START, _END = chr(2), chr(3)    # control characters, which no word has
#: Values of n-grams are summed as whole numbers of this fraction: in any order the same sum.
_UNIT = float(1 << 32)
words_of = re.compile(r"[^\W\d_]+").findall
#: Letters of ASCII in lower case, all other bytes as spaces.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalpha() else 32 for i in range(256))


@cache
def _letters() -> np.ndarray:
    """For each code point: itself if words have it, else a space."""
    found = _points("".join(words_of("".join(map(chr, range(sys.maxunicode + 1))))))
    out = np.full(sys.maxunicode + 1, 32, dtype="<u4")
    out[found] = found
    return out


def split(text: str | None) -> list[str]:
    """``words_of`` the text in lower case: what no word has becomes a space, in one step."""
    text = text or ""
    if text.isascii():
        return text.encode("ascii").translate(_ASCII).decode("ascii").split()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _letters()[points].tobytes().decode("utf-32-le").split()


def held_bytes(words: Iterable[str]) -> int:
    """About what words take as keys of a dictionary."""
    return sum(sys.getsizeof(w) + 120 for w in words)


def spelled(words: list[str]) -> tuple[dict[int, np.ndarray], list[int]]:
    """For each character to be foretold (the end of the word is one): the n-gram of the highest
    order that ends at it (by order), and the number of its word."""
    padded = [_START * (ORDER - 1) + w + _END for w in words]
    grams = [t[i:i + ORDER] for t in padded for i in range(len(t) - ORDER + 1)]
    return {ORDER: np.array(grams, dtype=object)}, [i for i, w in enumerate(words) for _ in range(len(w) + 1)]


def _pieces(words: Iterable[str]) -> Iterator[tuple[list[str], str]]:
    """The words in lists of about ``PIECE`` characters, and their spelling one after another."""
    start, part, size = _START * (ORDER - 1), [], 0
    for w in words:
        if part and size + len(w) > PIECE:
            yield part, start + (_END + start).join(part) + _END
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part, start + (_END + start).join(part) + _END


def grams_of(words: Iterable[str]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The n-grams of the highest order in these words, and the number of the word of each, in parts."""
    done = 0
    for part, text in _pieces(words):
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        ends = np.flatnonzero(points != ord(_START))
        word = done + np.repeat(np.arange(len(part)), [len(w) + 1 for w in part])
        done += len(part)
        for i in range(0, len(ends), PIECE):
            at = ends[i:i + PIECE]
            every = sliding_window_view(points, ORDER)[at - (ORDER - 1)].tobytes().decode("utf-32-le")
            data = np.frombuffer(every.encode(), dtype=np.uint8)
            first = np.flatnonzero((data & 0xC0) != 0x80)[::ORDER]        # bytes at which a character begins
            offsets = np.append(first, len(data)).astype(np.int32)
            yield pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), word[i:i + PIECE]


def _merged(parts: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Rows of equal ``gram`` as one, their other columns summed, as far as a task can hold them."""
    held: list[pa.Table] = []

    def together() -> pa.Table:
        names = held[0].column_names
        t = pa.concat_tables(held).group_by("gram", use_threads=False).aggregate([(c, "sum") for c in names[1:]])
        return t.select(["gram", *(f"{c}_sum" for c in names[1:])]).rename_columns(names)

    for p in parts:
        held.append(p)
        if sum(t.num_rows for t in held) > 5 * COUNT_GRAMS:
            held = [together()]
            if held[0].num_rows > COUNT_GRAMS:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from together().to_batches()


def _grams(df: DataFrame) -> DataFrame:
    """Rows with a column ``word`` once for each n-gram (``gram``) of the highest order in it."""
    at, names = df.columns.index("word"), [*df.columns, "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 17):
            grams, word = spelled(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(word)) for c in b.columns), pa.array(grams[ORDER], pa.string())], names=names)

    return df.mapInArrow(run, append_columns(df, "gram string"))


def _hashed(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the n-grams of the highest order that end at these places of a text."""
    h = np.full(len(at), 7, dtype=np.uint64)
    for k in range(ORDER):
        h = (h ^ points[at - k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) rows to documents by n-gram and class; memory is bounded by passing on."""
    held = Counter(), Counter()

    def passed() -> Iterator[pa.Table]:
        words = list(held[0].keys() | held[1].keys())
        n = [np.fromiter((h.get(w, 0) for w in words), dtype=np.int64, count=len(words)) for h in held]
        for h in held:
            h.clear()
        for grams, word in grams_of(words):
            yield pa.table({"gram": grams, "c0": n[0][word], "c1": n[1][word]})

    def parts() -> Iterator[pa.Table]:
        size = 0
        for b in slices(batches, 1 << 20):
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = set(split(text))
                size += held_bytes(w for w in words if w not in held[toxic])
                held[toxic].update(words)
                if size > 4 * COUNT_BYTES:
                    yield from passed()
                    size = 0
        yield from passed()

    return _merged(parts())


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) rows to the n-grams of their words, each once in a while."""
    def parts() -> Iterator[pa.Table]:
        seen, size = set(), 0
        for b in slices(batches, 1 << 20):
            words = set()
            for text in b.column(0).to_pylist():
                words.update(split(text))
            words = words - seen
            seen |= words
            size += held_bytes(words)
            for grams, _ in grams_of(words):
                yield pa.table({"gram": grams})
            if size > COUNT_BYTES:
                seen.clear()
                size = 0

    return _merged(parts())


def _discounted(count: Column, total: Column, kinds: Column, below: Column, strength: float = 0.0) -> Column:
    """Probability of an n-gram's last character; unknown contexts pass all on to what is below."""
    count, total, kinds = (F.coalesce(c, F.lit(0)).cast("double") for c in (count, total, kinds))
    known = total + F.lit(strength)
    return F.when(known > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + (kinds * DISCOUNT + strength) * below) / known).otherwise(below)


@dataclass
class KneserNey:
    """Spelling models as one table of exact strings (``cell``): documents or shared counts of the
    n-gram that it is (``a``, ``b``), and, as a context of longer ones, the same (``ta``, ``tb``) and
    the kinds of n-grams after it (``ka``, ``kb``, of both classes together ``k``)."""

    nodes: DataFrame | None
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    level: float = 0.0
    values: Values | None = None

    def differences(self, every: DataFrame) -> DataFrame:
        """``gram`` and ``value``, toxic less ordinary log-likelihood of the last character in
        whole ``_UNIT``s, of distinct n-grams of the highest order."""
        ends = F.array(*(F.col("gram").substr(ORDER + 1 - k, k) for k in range(1, ORDER + 1)))
        # a context has as many n-grams as there are characters, and so has an ending: no key is hot
        g = every.select(F.explode(ends).alias("g")).distinct().withColumn("front", F.col("g").substr(F.lit(1), F.length("g") - 1))
        own = self.nodes.where(F.col("a") + F.col("b") > 0).select(F.col("cell").alias("g"), "a", "b")
        around = self.nodes.where(F.col("ta") + F.col("tb") > 0).select(F.col("cell").alias("front"), "ta", "tb", "ka", "kb", "k")
        known = staged(g.join(own, "g", "left").join(around, "front", "left"), "needed")
        p = None
        for k in range(1, ORDER + 1):
            part = known.where(F.length("g") == k)
            if p is None:
                part = part.withColumn("below", F.lit(1 / 1024))      # a character that was never seen
            else:
                part = part.withColumn("short", F.substring("g", 2, k - 1)).join(p.select(F.col("g").alias("short"), F.col("p").alias("below")), "short")
            both = (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)) for x, y in (("a", "b"), ("ta", "tb")))
            p = part.withColumn("p", _discounted(*both, F.col("k"), F.col("below")))
        toxic = _discounted(F.col("b"), F.col("tb"), F.col("kb"), F.col("p"), STRENGTH)
        ordinary = _discounted(F.col("a"), F.col("ta"), F.col("ka"), F.col("p"), STRENGTH)
        return p.select(F.col("g").alias("gram"), F.round((F.log(toxic) - F.log(ordinary)) * _UNIT).cast("long").alias("value"))

    def evidence(self, values: np.ndarray) -> float:
        """What stands out as toxic, per word, in a text of these word values (whole units, in any
        order); 0 without words."""
        if not len(values):
            return 0.0
        level = min(middle_of(values), round(self.level * _UNIT)) + round(MARGIN * _UNIT)
        return int(np.maximum(values - level, 0).sum()) / len(values) / _UNIT

    def middle(self, values: np.ndarray) -> float:
        return middle_of(values) / _UNIT if len(values) else 0.0

    def probability(self, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.evidence(values) + self.offset, -50, 50))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        df = self.nodes.sparkSession.createDataFrame(list(enumerate(texts)), "id long, text string")
        values = Values.of(self, [df])
        try:
            return np.array([r["score"] for r in sorted(values.scored(df, self).collect())])
        finally:
            values.close()


def middle_of(values: np.ndarray) -> int:
    """The median, rounded down to a whole unit."""
    n = len(values)
    two = np.partition(values, [(n - 1) // 2, n // 2])
    return (int(two[(n - 1) // 2]) + int(two[n // 2])) // 2


def model_cells(train: DataFrame) -> DataFrame:
    """Sums by kind, order and n-gram of rows (text, toxic). Kinds: 0 n-grams, 1 counts of
    contexts, 2 kinds of n-grams after contexts, 3 the same of both classes together. In the
    highest order a and b are documents of class 0 and 1; below it a is the shared count, of
    different characters in front."""
    prepare(train.sparkSession)
    rows = train.select("text", "toxic").mapInArrow(_count, "gram string, c0 long, c1 long")
    grams = staged(rows.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")), "model-grams")
    ends = F.array(*(F.struct(F.lit(k).alias("k"), F.col("gram").substr(ORDER + 1 - k, k).alias("g"), "c0", "c1") for k in range(1, ORDER + 1)))
    every = grams.select(F.explode(ends).alias("x")).groupBy("x.k", "x.g").agg(F.sum("x.c0").alias("c0"), F.sum("x.c1").alias("c1"))
    k, g, one, zero = F.col("k"), F.col("g"), F.lit(1).cast("long"), F.lit(0).cast("long")
    some = lambda c: (F.col(c) > 0).cast("long")

    def row(kind, order, cell, a, b):
        return F.struct(F.lit(kind).alias("kind"), order.alias("k"), cell.alias("cell"), a.alias("a"), b.alias("b"))

    front, back, inner = g.substr(F.lit(1), k - 1), g.substr(F.lit(2), k - 1), g.substr(F.lit(2), k - 2)
    top = F.array(row(0, k, g, F.col("c0"), F.col("c1")), row(1, k, front, F.col("c0"), F.col("c1")), row(2, k, front, some("c0"), some("c1")), row(3, k, front, one, zero))
    kinds = F.when(k == ORDER, top).otherwise(F.array(row(2, k, front, one, zero)))
    below = F.when(k > 1, F.array(row(0, k - 1, back, one, zero), row(1, k - 1, inner, one, zero))).otherwise(F.slice(top, 1, 0))
    made = every.select(F.explode(F.concat(kinds, below)).alias("r"))
    return made.groupBy("r.kind", "r.k", "r.cell").agg(F.sum("r.a").alias("a"), F.sum("r.b").alias("b"))


def nodes_of(cells: DataFrame) -> DataFrame:
    """``model_cells`` gathered by string, for ``KneserNey``."""
    is_ = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0))
    # the string of a context is one shorter than its order
    highest = F.length("cell") == ORDER - 1
    return cells.groupBy("cell").agg(is_(0, "a").alias("a"), is_(0, "b").alias("b"), is_(1, "a").alias("ta"), is_(1, "b").alias("tb"), is_(2, "a").alias("ka"),
                                     is_(2, "b").alias("kb"), F.when(highest, is_(3, "a")).otherwise(is_(2, "a")).alias("k"))


def fit(train: DataFrame, also: DataFrame | None = None, text: str = "text", calibration_rows: int = CALIBRATION_ROWS) -> KneserNey:
    """Models and curve from rows (id, text, toxic), toxic 0 or 1. ``also``: documents (with their
    column ``text``) that will be scored, whose n-grams are valued together with the curve's."""
    prepare(train.sparkSession)
    fold = F.pmod(F.xxhash64(F.lit("curve"), "id"), F.lit(CALIBRATION_FOLD))
    model = KneserNey(staged(nodes_of(model_cells(train.where(fold != 0))), "model-nodes"))
    seen = model.nodes.where(F.length("cell") == ORDER).agg(F.sum("a"), F.sum("b")).first()
    if not (seen[0] and seen[1]):
        model.constant = float(bool(seen[1]))
        return model
    # the sample is chosen by ids alone; its texts stay where they are
    ids = train.where(fold == 0).select("id").orderBy(F.xxhash64("id"), "id").limit(calibration_rows)
    curve = staged(train.where(fold == 0).join(F.broadcast(ids), "id", "left_semi").select("id", "text", "toxic"), "curve")
    texts = [curve] + ([also.select(F.col(text).cast("string").alias("text"))] if also is not None else [])
    model.values = Values.of(model, texts, also)
    middle = model.values.scored(curve, model, KneserNey.middle).where("toxic = 0").select("score").toArrow()["score"].to_numpy()
    model.level = float(np.quantile(middle, LEVEL_SHARE)) if len(middle) else 0.0
    sample = model.values.scored(curve, model, KneserNey.evidence).select("score", "toxic").toArrow()
    x, y = sample["score"].to_numpy(), sample["toxic"].to_numpy().astype(np.float64)
    order = np.lexsort((y, x))
    model.slope, model.offset = _curve(x[order], y[order])
    return model


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and offset of a logistic regression of one variable, by damped Newton
    steps on the standardised variable with a weak prior (slope 1, offset -1 of those)."""
    if not len(x):
        return 1.0, -1.0
    mean, spread = x.mean(), x.std() or 1.0
    a = np.stack([(x - mean) / spread, np.ones_like(x)], axis=1)
    prior, want = np.array([1e-2, 1e-2]), np.array([1.0, -1.0])

    def loss(b: np.ndarray) -> float:
        m = a @ b
        return float(np.logaddexp(0, m).sum() - (y * m).sum() + (prior * (b - want) ** 2).sum() / 2)

    beta = want.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -50, 50)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + np.diag(prior), a.T @ (y - p) - prior * (beta - want))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = max(beta[0], 1e-6) / spread
    return float(slope), float(beta[1] - slope * mean)


@dataclass
class Lexicon:
    """Values of n-grams by hash, and of the words that a task has met lately."""

    hashes: np.ndarray
    values: np.ndarray
    known: dict = field(default_factory=dict)
    held: int = 0

    def __getstate__(self):
        return self.hashes, self.values

    def __setstate__(self, state):
        self.hashes, self.values = state
        self.forget()

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def _values_at(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), dtype=np.int64)
        for i in range(0, len(at), PIECE):
            h = _hashed(points, at[i:i + PIECE])
            where = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            if (self.hashes[where] != h).any():
                raise ValueError("the documents changed while they were scored")
            out[i:i + PIECE] = self.values[where]
        return out

    def _learn(self, words: list[str]) -> None:
        for part, text in _pieces(words):
            points = _points(text)
            each = self._values_at(points, np.flatnonzero(points != ord(_START)))
            first = np.r_[0, np.cumsum([len(x) + 1 for x in part])[:-1]]
            self.known.update(zip(part, np.add.reduceat(each, first).tolist()))

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The values of each text's words."""
        words = [split(t) for t in texts]
        if self.held > CACHE_BYTES:
            self.forget()
        new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.known]
        self.held += held_bytes(new)
        self._learn(new)
        for s in words:
            yield np.fromiter(map(self.known.__getitem__, s), dtype=np.int64, count=len(s))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, value) rows to (hash, value) rows."""
    for b in batches:
        points = _points("".join(b.column(0).to_pylist()))
        h = _hashed(points, np.arange(ORDER - 1, len(points), ORDER))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(1)], names=["h", "value"])


@dataclass
class Values:
    """Values of the distinct n-grams of some texts as a table, and as it is sent to the tasks."""

    table: DataFrame
    small: bool
    of_docs: DataFrame | None = None
    shared: object = None

    @classmethod
    def of(cls, model: KneserNey, texts: list[DataFrame], docs: DataFrame | None = None) -> Values:
        every = texts[0].select("text")
        for t in texts[1:]:
            every = every.union(t.select("text"))
        grams = staged(every.mapInArrow(_distinct, "gram string").distinct(), "grams")
        table = staged(model.differences(grams), "values")
        return cls(table, table.count() <= BROADCAST_GRAMS, docs)

    def _send(self) -> None:
        if self.shared is None:
            got = self.table.mapInArrow(_hashes, "h long, value long").toArrow()
            h, value = got["h"].to_numpy().view(np.uint64), got["value"].to_numpy()
            order = np.argsort(h)
            self.shared = self.table.sparkSession.sparkContext.broadcast(Lexicon(h[order], value[order]))

    def close(self) -> None:
        """Take back what was sent; results that are not written yet cannot be read any more."""
        if self.shared is not None:
            self.shared.destroy()
            self.shared = None

    def scored(self, df: DataFrame, model: KneserNey, by=KneserNey.probability) -> DataFrame:
        """Rows (id, text, ...) with a column score in place of the text."""
        # the tables stay behind: a task needs the numbers only
        judge = partial(by, replace(model, nodes=None, values=None))
        if not self.small:
            return _scored_by_shuffle(df, self.table, judge)
        self._send()
        at, rest, shared = df.columns.index("text"), [c for c in df.columns if c != "text"], self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = shared.value
            for b in slices(batches, 1 << 20):
                s = [judge(v) for v in lexicon.texts(b.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(s, pa.float64())], names=[*rest, "score"])
            lexicon.forget()

        return df.mapInArrow(run, append_columns(df.select(*rest), "score double"))


def _scored(df: DataFrame, docs: DataFrame, model: KneserNey, keep=None) -> DataFrame:
    """Rows (id, ..., score) of (id, text, ...), written; ``docs``: the table that they are of."""
    rest = [c for c in df.columns if c != "text"]
    if model.constant is not None:
        out = df.select(*rest, F.lit(model.constant).alias("score"))
        return out if keep is None else out.where(keep)
    named = model.values is not None and model.values.of_docs is docs
    values = model.values if named else Values.of(model, [df])
    out = values.scored(df, model)
    out = staged(out if keep is None else out.where(keep), "scores")
    values.close()
    return out


def _scored_by_shuffle(df: DataFrame, values: DataFrame, judge) -> DataFrame:
    """The same for any number of words: the words of each distinct text meet their values."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = Counter(split(text))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["digest", "word", "n"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = [judge(np.repeat(np.array([x["value"] for x in v], dtype=np.int64), [x["n"] for x in v])) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["digest", "score"])

    each = df.select(digest.alias("digest"), "text").mapInArrow(words, "digest string, word string, n long").distinct()
    each = staged(each, "text-words")
    lexicon = _grams(each.select("word").distinct()).join(values, "gram").groupBy("word").agg(F.sum("value").alias("value"))
    texts = each.join(lexicon, "word").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("values"))
    scores = staged(texts.mapInArrow(judged, "digest string, score double"), "scores")
    rest = [F.col(f"row.{c}").alias(c) for c in df.columns if c != "text"]
    rows = df.select(F.struct(*(c for c in df.columns if c != "text")).alias("row"), digest.alias("digest"))
    return rows.join(scores, "digest", "left").select(*rest, F.coalesce("score", F.lit(judge(np.zeros(0, dtype=np.int64)))).alias("score"))


def labelled(docs: DataFrame, labels: DataFrame, held_out, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, text, toxic) of the labelled rows that are not held out."""
    y = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
    y = y.groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    y = F.broadcast(y) if y.count() <= BROADCAST_LABELS else y
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(y, "id")


def score(docs: DataFrame, model: KneserNey, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    return _scored(narrow, docs, model).select(F.col("id").alias(key), "score")


def keep_ordinary(docs: DataFrame, model: KneserNey, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    prepare(docs.sparkSession)
    packed = docs.select(F.struct("*").alias("id"), F.col(text).cast("string").alias("text"))
    return _scored(packed, docs, model, F.col("score") < threshold).select("id.*")

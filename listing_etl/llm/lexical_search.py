"""Ranked lexical search with per-term geometric blocking.

The score of a document is a sum over the distinct terms that it shares with the query:
``weight(term) * impact(term, document)``, in whole numbers (see ``weight`` and ``impacts``), so
that any order of summation gives the same score.

Index: documents become sparse vectors of impacts over the terms that the queries use. Similar
vectors get near places by the signs of seeded random projections, and a cell is a range of that
order; crowded cells (equal documents) are cut by a hash of the row, so that no cell is much larger
than ``CELL_ROWS``. The cell cuts the posting list of each term into blocks of similar documents.
A block stores its summary: for each term that some query uses together with the list's term,
the largest impact among the documents of the block. One row of the index is a cell: its
documents, and the summaries of its blocks.

Search: the inner product of a query with a block's summary bounds the scores of all documents in
the block. First the cells whose blocks of the query's rarest terms have the best bounds are
scored; the ``k``-th best score found is a floor that the true ``k``-th best cannot be below. Then
all cells are visited in which a block's bound reaches the floor. There, lists whose largest
contributions do not add up to the floor are left out: a document of these only cannot reach it. A
document is skipped if it stands in none of the other lists, or in any block whose bound is below
the floor; the others are scored. Nothing is skipped for any other reason, so the result is that
of scoring every document.

The queries' terms and weights are sent to the tasks, for ``PASS_ITEMS`` queries at a time: many
queries are several passes over the documents, whose size bounds what is sent. Numbers of
documents and of terms, and the documents that hold a term, are counted over all documents.

Edge cases: null and empty texts, and texts without terms, are no documents; each row is a document
of its own, so that repeated rows and rows of one id each take a rank (equal scores: ascending
id, null ids first); items with a null id or without terms find nothing, rows of one item id are
one item (all their terms); fewer than ``k`` documents with a score above zero give fewer rows;
empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listing_etl.llm.common import prepare, slices, staged

K = 50
#: Documents of a cell, about; cells of more than twice as many are cut.
CELL_ROWS = 256
#: Queries of one pass over the documents.
PASS_ITEMS = 1000
#: Cells that give each query its floor.
SEED_CELLS = 12
#: Cells in a file of the index (a cell takes about a megabyte).
INDEX_ROWS = 8
PLANES, SEED = 24, 11

# Bytes of terms (letters and digits of ASCII, lower-cased, and all other characters).
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    """Of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Of terms that occur ``tf`` times in documents of ``length`` terms; ``total``: terms of all documents."""
    m = 100 - 50 + (50 * length * documents) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


@dataclass
class Queries:
    """The queries of a pass: their ids, and their terms by number."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        terms = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in some}), dtype=np.int64) for _, some in rows]
        return cls([i for i, _ in rows], terms, vocabulary)

    def partners(self) -> list[np.ndarray]:
        """For each term, the terms that some query uses together with it."""
        found: list[set] = [set() for _ in self.vocabulary]
        for t in self.terms:
            for x in t.tolist():
                found[x].update(t.tolist())
        return [np.array(sorted(s), dtype=np.int64) for s in found]


def counted(docs: DataFrame, queries: Queries, key: str, text: str) -> DataFrame:
    """(id, row, length, terms, tf) of the documents: how often each holds each query term."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in slices(batches):
            terms, tf, length = [], [], []
            for t in b.column(2).cast(pa.binary()):
                words = terms_of(t.as_py())
                found, n = np.unique(np.array([x for x in map(number, words) if x is not None], dtype=np.int64), return_counts=True)
                terms.append(found)
                tf.append(n)
                length.append(len(words))
            bounds = pa.array(np.cumsum([0, *map(len, terms)]), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in ((terms, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(length, pa.int64()), *lists], names=["id", "row", "length", "terms", "tf"])

    return rows.mapInArrow(run, f"id {kind}, row long, length long, terms array<int>, tf array<long>").where(F.col("length") > 0)


@dataclass
class Statistics:
    documents: int
    total: int
    weights: np.ndarray


def statistics(counts: DataFrame, size: int) -> Statistics:
    """Over all documents; one number for each query term is gathered."""
    n = counts.agg(F.count("*"), F.sum("length")).first()
    df = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect())
    return Statistics(n[0], n[1] or 0, np.array([weight(n[0], df.get(t, 0)) for t in range(size)], dtype=np.int64))


def projected(terms: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Signs of the projections of sparse vectors on ``PLANES`` planes, as whole numbers: vectors
    of a small angle agree in their leading signs."""
    x = terms[:, None].astype(np.uint64) * np.uint64(64) + np.arange(PLANES, dtype=np.uint64)[None, :] + np.uint64(SEED << 40)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    sign = np.where((x >> np.uint64(63)).astype(bool), 1.0, -1.0)
    sums = np.add.reduceat(sign * values[:, None], first, axis=0)
    return (sums > 0) @ (1 << np.arange(PLANES - 1, -1, -1))


def placed(counts: DataFrame, stats: Statistics, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, cell, terms, impacts) of the documents that hold a query term of any weight."""
    documents, total, weights = stats.documents, stats.total, stats.weights
    kind = counts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 20):
            size = np.asarray(b.column(3).value_lengths(), dtype=np.int64)
            terms, tf = (np.asarray(b.column(i).flatten(), dtype=np.int64) for i in (3, 4))
            doc = np.repeat(np.arange(len(size)), size)
            value = impacts(tf, np.asarray(b.column(2))[doc], documents, total)
            keep = weights[terms] > 0
            terms, value, doc = terms[keep], value[keep], doc[keep]
            if not len(doc):
                continue
            some, first = np.unique(doc, return_index=True)
            place = projected(terms, (value * weights[terms]).astype(np.float64), first)
            bounds = pa.array(np.r_[first, len(doc)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array(place, pa.int32()),
                                              pa.ListArray.from_arrays(bounds, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(value, pa.int32()))],
                                             names=["id", "row", "place", "terms", "impacts"])

    rows = staged(counts.mapInArrow(run, f"id {kind}, row long, place int, terms array<int>, impacts array<int>"), "vectors")
    bits = min(PLANES, max(0, math.ceil(math.log2(max(1, rows.count()) / cell_rows))))
    rows = rows.withColumn("cell", F.shiftright("place", PLANES - bits))
    # crowded cells, counted; a cell that is left as it is has no row here
    crowded = staged(rows.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts")).where(F.col("parts") > 2), "crowded")
    cut = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    return rows.join(crowded, "cell", "left").select("id", F.concat_ws(".", "cell", cut).alias("cell"), "terms", "impacts")


_CELL = "cell string, ids array<{kind}>, first array<int>, terms array<int>, impacts array<int>, list array<int>, begin array<int>, term array<int>, most array<int>"


def summaries(first: np.ndarray, terms: np.ndarray, values: np.ndarray, partners: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Blocks of a cell, one for each term that its documents hold: the term, where the summary
    begins, and the summaries end to end: terms and largest impacts."""
    vocabulary, column = np.unique(terms, return_inverse=True)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    dense = np.zeros((len(first) - 1, len(vocabulary)), dtype=np.int32)
    dense[doc, column] = values
    order = np.argsort(column, kind="stable")
    ends = np.cumsum(np.bincount(column, minlength=len(vocabulary)))
    begin, out_t, out_v = [0], [], []
    for t, a, b in zip(vocabulary.tolist(), ends - np.bincount(column, minlength=len(vocabulary)), ends):
        members = doc[order[a:b]]
        mine = np.intersect1d(partners[t], vocabulary, assume_unique=True)
        at = np.searchsorted(vocabulary, mine)
        most = dense[members][:, at].max(axis=0) if len(mine) * 4 > len(vocabulary) else dense[np.ix_(members, at)].max(axis=0)
        some = most > 0
        out_t.append(mine[some])
        out_v.append(most[some])
        begin.append(begin[-1] + int(some.sum()))
    return vocabulary, np.array(begin), np.concatenate(out_t), np.concatenate(out_v)


def index(vectors: DataFrame, queries: Queries) -> DataFrame:
    """One row for each cell: its documents and the summaries of its blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries.partners())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = np.r_[0, np.cumsum(group["terms"].map(len))]
        terms, values = (np.concatenate(group[c].to_numpy()).astype(np.int64) for c in ("terms", "impacts"))
        made = summaries(first, terms, values, shared.value)
        return pd.DataFrame({"cell": group["cell"].iloc[:1], "ids": [group["id"].tolist()], "first": [first], "terms": [terms], "impacts": [values],
                             **{n: [x] for n, x in zip(("list", "begin", "term", "most"), made)}})

    # ids as text: pandas has no null integers
    rows = vectors.withColumn("id", F.col("id").cast("string"))
    return rows.groupBy("cell").applyInPandas(run, _CELL.format(kind="string"))


def block_bounds(query: np.ndarray, weights: np.ndarray, lists: np.ndarray, begin: np.ndarray, term: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of a cell in the lists of a query's terms (by number), their bounds, the inner
    products of the query with their summaries, and what the list's own term contributes at most.
    ``weights``: 0 for terms of other queries."""
    at = np.searchsorted(lists, query)
    at = at[at < len(lists)]
    at = at[np.isin(lists[at], query)]
    at = np.unique(at)
    if not len(at):
        return at, at, at
    size = begin[at + 1] - begin[at]
    ends = np.cumsum(size)
    entry = np.arange(ends[-1]) + np.repeat(begin[at] - (ends - size), size)
    product = weights[term[entry]] * most[entry]
    own = term[entry] == np.repeat(lists[at], size)
    return at, np.add.reduceat(product, ends - size), product[own]


class Scorer:
    """Bounds and scores of the queries of a pass in one cell after the other."""

    def __init__(self, queries: Queries, weights: np.ndarray):
        self.queries, self.weights = queries, weights
        self.own = np.zeros(len(weights), dtype=np.int64)

    def of_query(self, q: int) -> np.ndarray:
        """The weights of the terms of one query, 0 elsewhere (valid until the next call)."""
        self.own[:] = 0
        terms = self.queries.terms[q]
        self.own[terms] = self.weights[terms]
        return self.own

    def bounds(self, cell: dict, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return block_bounds(self.queries.terms[q], self.of_query(q), cell["list"], cell["begin"], cell["term"], cell["most"])

    def best(self, cell: dict, q: int, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (by number in the cell) and scores of a query that can be among its best ``k``, and the
        number of documents that were scored."""
        at, bound, top = self.bounds(cell, q)
        terms, values, first, doc = cell["terms"], cell["impacts"], cell["first"], cell["doc"]
        order = np.argsort(top, kind="stable")
        free = order[np.cumsum(top[order]) < floor]            # documents of these lists only cannot reach the floor
        # 1: a document of the term's block may be one of the best, 2: it can't, 0: the block does not tell
        tells = np.zeros(len(self.weights), dtype=np.int8)
        tells[cell["list"][at]] = 1
        tells[cell["list"][at[free]]] = 0
        tells[cell["list"][at[bound < floor]]] = 2
        mark = tells[terms]
        stands, fails = np.zeros(len(first) - 1, dtype=bool), np.zeros(len(first) - 1, dtype=bool)
        stands[doc[mark == 1]] = True
        fails[doc[mark == 2]] = True
        wanted = np.flatnonzero(stands & ~fails)
        if not len(wanted):
            return wanted, wanted, 0
        size = first[wanted + 1] - first[wanted]
        ends = np.cumsum(size)
        entry = np.arange(ends[-1]) + np.repeat(first[wanted] - (ends - size), size)
        score = np.add.reduceat(self.own[terms[entry]] * values[entry], ends - size)
        some = (score > 0) & (score >= floor)
        wanted, score, scored = wanted[some], score[some], len(wanted)
        if len(score) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k]
            wanted, score = wanted[score >= edge], score[score >= edge]
        return wanted, score, scored


_PARTS = ("first", "terms", "impacts", "list", "begin", "term", "most")


def _cells(b: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """The rows of an index batch as arrays."""
    names = b.schema.names
    for i in range(b.num_rows):
        cell = {n: np.asarray(b.column(names.index(n))[i].values, dtype=np.int64) for n in _PARTS if n in names}
        if "first" in cell:
            cell["doc"] = np.repeat(np.arange(len(cell["first"]) - 1), np.diff(cell["first"]))
        yield i, cell


def cell_bounds(cells: DataFrame, queries: Queries, weights: np.ndarray) -> DataFrame:
    """(q, cell, bound, lead): the largest bound among a cell's blocks for each query that has one, and
    among those of the quarter of the query's terms that weigh most (0: none of them)."""
    shared = cells.sparkSession.sparkContext.broadcast((queries, weights))
    schema = pa.schema([("q", pa.int32()), ("cell", pa.string()), ("bound", pa.int64()), ("lead", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        scorer = Scorer(queries, weights)
        rare = [np.quantile(weights[t], 0.75) if len(t) else 0 for t in queries.terms]
        for b in slices(batches):
            for i, cell in _cells(b):
                found = []
                for q in range(len(queries.ids)):
                    at, bound, _ = scorer.bounds(cell, q)
                    if len(at):
                        found.append((q, int(bound.max()), int(bound[weights[cell["list"][at]] >= rare[q]].max(initial=0))))
                if found:
                    q, bound, lead = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([b.column(0)[i].as_py()] * len(q), pa.string()),
                                                      pa.array(bound, pa.int64()), pa.array(lead, pa.int64())], schema=schema)

    return cells.select("cell", "list", "begin", "term", "most").mapInArrow(run, "q int, cell string, bound long, lead long")


def scored(cells: DataFrame, wanted: DataFrame, queries: Queries, weights: np.ndarray, k: int = K) -> DataFrame:
    """(q, id, score) of the best documents of the cells that are wanted, rows (cell, q, floor)."""
    shared = cells.sparkSession.sparkContext.broadcast((queries, weights))
    visits = wanted.groupBy("cell").agg(F.collect_list(F.struct("q", "floor")).alias("visits"))     # each query once at most
    rows = cells.join(visits, "cell").select("ids", *_PARTS, F.col("visits.q").alias("q"), F.col("visits.floor").alias("floor"))
    schema = pa.schema([("q", pa.int32()), ("id", pa.string()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in slices(batches):
            for i, cell in _cells(b):
                ids, floors, out = (b.column(b.schema.names.index(n))[i].values for n in ("ids", "floor", "q"))
                found = [(q, *scorer.best(cell, q, floor, k)) for q, floor in zip(out.to_pylist(), floors.to_pylist())]
                size = [len(doc) for _, doc, _, _ in found]
                if sum(size):
                    doc, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], size), pa.int32()), ids.take(pa.array(doc, pa.int64())),
                                                      pa.array(score, pa.int64())], schema=schema)

    return rows.mapInArrow(run, "q int, id string, score long")


def _first(df: DataFrame, k: int, by: list) -> DataFrame:
    order = Window.partitionBy("q").orderBy(*by)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pass(docs: DataFrame, rows: list[tuple], item_type: T.DataType, key: str, text: str, k: int, cell_rows: int, seed_cells: int) -> DataFrame:
    queries = Queries.of(rows)
    counts = staged(counted(docs, queries, key, text), "term-counts")
    kind = counts.schema["id"].dataType
    stats = statistics(counts, len(queries.vocabulary))
    cells = staged(index(placed(counts, stats, cell_rows), queries), "index", INDEX_ROWS)
    bounds = staged(cell_bounds(cells, queries, stats.weights), "bounds")
    seeds = _first(bounds, seed_cells, [F.col("lead").desc(), F.col("bound").desc(), "cell"]).select("cell", "q", F.lit(0).cast("long").alias("floor"))
    floors = _first(scored(cells, seeds, queries, stats.weights, k), k, [F.col("score").desc()]).where(F.col("rank") == k).select("q", F.col("score").alias("floor"))
    wanted = bounds.join(staged(floors, "floors"), "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    found = scored(cells, staged(wanted.where(F.col("bound") >= F.col("floor")).select("cell", "q", "floor"), "visits"), queries, stats.weights, k)
    best = _first(found.withColumn("id", F.col("id").cast(kind)), k, [F.col("score").desc(), F.col("id").asc_nulls_first()])
    names = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", item_type)])
    ids = docs.sparkSession.createDataFrame([(q, i) for q, i in enumerate(queries.ids)], names)
    return best.join(F.broadcast(ids), "q").select("item", "rank", "id", "score")


def item_terms(items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item`` and its distinct ``terms``, of items that have any."""
    lower = F.translate(F.col(item_text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit(_PATTERN), F.lit(0))))
    return items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), term.alias("term")).groupBy("item").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           k: int = K, pass_items: int = PASS_ITEMS, cell_rows: int = CELL_ROWS, seed_cells: int = SEED_CELLS) -> DataFrame:
    """(``item_key``, ``rank``, ``key``, ``score``): the ``k`` documents of the highest scores above zero for each item."""
    prepare(docs.sparkSession)
    asked = staged(item_terms(items, item_key, item_text), "items")
    passes = max(1, -(-asked.count() // pass_items))
    found = None
    for p in range(passes):
        rows = [(r["item"], [t.encode() for t in r["terms"]]) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == p).orderBy("item").collect()]
        part = _pass(docs, rows, asked.schema["item"].dataType, key, text, k, cell_rows, seed_cells)
        found = part if found is None else found.union(part)
    return found.select(F.col("item").alias(item_key), "rank", F.col("id").alias(key), "score")

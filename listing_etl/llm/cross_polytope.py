"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors by fast pseudo-rotations (three rounds of random signs and a
Hadamard transform, of a power of two dimensions) and hashes a vector to the nearest signed
axis: the largest coordinate in size, and its sign. A query probes, in every table, the axes of
its largest coordinates (multiprobe). Rows meet queries in (table, axis) cells; a cell ranks
its queries against its rows by exact inner products of the original vectors, in blocks, and
hands on each query's best; the best over all cells are the result.

Equal vectors are gathered first: a vector with any number of copies is hashed once, as row and as
query, and stands for its smallest ids (as many as a query can need). Cells are cut into blocks of
about ``BLOCK_ROWS`` rows and ``QUERY_ROWS`` queries by hashes, counted beforehand, and each block of
rows meets each block of queries in one task, so that a crowded axis is spread and nothing is
dropped. Queries whose cells hold fewer rows than they can get (small tables, few distinct
vectors) are ranked against all distinct vectors, in blocks of queries and rows.

The number of probes is fitted to the table, unless it is given: up to ``SAMPLE`` distinct query
vectors are ranked exactly against all rows, and the smallest number is taken that finds the share
``TARGET`` of their nearest rows. In a larger table the nearest are nearer, so that fewer probes do
and the share of rows that are candidates falls; vectors of very different lengths, whose nearest
by inner product stand at wider angles, get more. All rows are indexed; rotations are drawn from a
fixed seed.

Edge cases: vectors that are null, zero or that hold null or non-finite components take no part,
as query or candidate; vectors of different dimensions have no inner product, so each dimension is
searched by itself; ties go to the smaller id; null ids take no part; repeated rows of one id and
vector count once, an id with several vectors is as near as the nearest of them; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from listing_etl.llm.common import prepare, slices, staged

TABLES, SEED = 10, 7
BLOCK_ROWS, QUERY_ROWS = 2_000, 2_000
#: Queries that fit the number of probes, and the share of their nearest rows that it finds.
SAMPLE, TARGET = 200, 0.95


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two columns), orthonormal."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotations(vectors: np.ndarray, tables: int = TABLES, seed: int = SEED) -> Iterator[np.ndarray]:
    """Unit vectors after each table's pseudo-rotation."""
    d = 1 << max(0, int(vectors.shape[1] - 1).bit_length())
    unit = np.zeros((len(vectors), d))
    unit[:, :vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for t in range(tables):
        signs = np.random.default_rng([seed, t]).choice([-1.0, 1.0], size=(3, d))
        x = unit
        for s in signs:
            x = hadamard(x * s)
        yield x


def axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """Signed axes (2 * axis, plus 1 for the negative side) of the ``probes`` largest coordinates."""
    probes = min(probes, rotated.shape[1])
    size = np.abs(rotated)
    top = np.argpartition(-size, probes - 1, axis=1)[:, :probes] if probes < rotated.shape[1] else np.argsort(-size, axis=1)
    return 2 * top + (np.take_along_axis(rotated, top, axis=1) < 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


def _cells(df: DataFrame, d: int, tables: int, probes: int, name: str) -> DataFrame:
    """(name, cell, vector) rows of (name, vector): one for each table and probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 19):
            x = _matrix(b.column(1), d)
            for t, r in enumerate(rotations(x, tables)):
                a = axes(r, probes)
                row = np.repeat(np.arange(len(x)), a.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(a.ravel() + (t << 20), pa.int64()), b.column(1).take(pa.array(row))],
                                                 names=[name, "cell", "vector"])

    return df.mapInArrow(run, f"{name} long, cell long, vector {df.schema['vector'].dataType.simpleString()}")


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed in one order wherever the rows stand."""
    return (q * x).sum(axis=1)


def _rank(k: int, d: int) -> Callable:
    def run(cell: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": pd.Series(dtype="int64"), "row": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(queries) or not len(rows):
            return none
        rows = rows.sort_values("row")
        x, ids = np.stack(rows["vector"].to_numpy()).astype(np.float64), rows["row"].to_numpy()
        out = []
        for at in range(0, len(queries), 1024):
            part = queries.iloc[at:at + 1024]
            q = np.stack(part["vector"].to_numpy()).astype(np.float64)
            s = q @ x.T
            keep = min(k, s.shape[1])
            edge = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
            # a little below the edge: the product of matrices sums in another order
            slack = 1e-14 * d * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            i, j = np.nonzero(s >= (edge - slack)[:, None])
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[i], "row": ids[j], "score": inner_products(q[i], x[j])}))
        return pd.concat(out)

    return run


def _best(df: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "row")
    return df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def _named(found: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the best ids of the ranked vectors, one more than asked for."""
    found = _best(staged(found.dropDuplicates(["query", "row"]), "found"), "query", k + 1)
    each = found.join(ids.select("row", "id"), "row").groupBy("query", "id").agg(F.max("score").alias("score"))
    return _best(each.withColumnRenamed("id", "row"), "query", k + 1).withColumnRenamed("row", "id")


def _exact(queries: np.ndarray, rows: DataFrame, k: int) -> DataFrame:
    """(query, row, score, vector): the best rows for a few queries, by number."""
    d = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in slices(batches, 1 << 20):
            x, row = _matrix(b.column(1), d), np.asarray(b.column(0))
            s = queries @ x.T
            if best is not None:
                s, row, x = np.concatenate([best[0], s], axis=1), np.concatenate([best[1], row]), np.concatenate([best[2], x])
            # the rows that are among the best of some query
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
            keep = np.unique(top)
            best = s[:, keep], row[keep], x[keep]
        if best is not None:
            s, row, x = best
            top = np.argsort(-s, axis=1)[:, :k]
            flat = top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(s)), top.shape[1])), pa.array(row[flat]), pa.array(np.take_along_axis(s, top, axis=1).ravel()),
                                              pa.array(list(x[flat])).cast(pa.list_(pa.float64()))], names=["query", "row", "score", "vector"])

    wide = rows.select("row", F.col("vector").cast("array<double>").alias("vector"))
    return wide.mapInArrow(run, "query long, row long, score double, vector array<double>")


def needed_probes(queries: np.ndarray, owner: np.ndarray, near: np.ndarray, tables: int, target: float) -> int:
    """The smallest number of probes with which the share ``target`` of the vectors ``near`` is found
    by the queries that they belong to (``owner``)."""
    place = np.full(len(near), np.iinfo(np.int64).max)
    for q, x in zip(rotations(queries, tables), rotations(near, tables)):
        rank = np.argsort(np.argsort(-np.abs(q), axis=1, kind="stable"), axis=1)[owner]
        axis = np.abs(x).argmax(axis=1)
        at = np.arange(len(near))
        same = (q[owner, axis] < 0) == (x[at, axis] < 0)
        place = np.where(same, np.minimum(place, rank[at, axis]), place)
    share = [(place < n).mean() for n in range(1, q.shape[1] + 1)]
    return next((n for n, s in enumerate(share, 1) if s >= target), q.shape[1])


def fitted_probes(queries: DataFrame, rows: DataFrame, k: int, tables: int, sample: int = SAMPLE, target: float = TARGET) -> int:
    some = queries.orderBy(F.xxhash64("query"), "query").limit(sample).collect()
    if not some:
        return 1
    q = np.array([r["vector"] for r in some], dtype=np.float64)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "row")
    best = _exact(q, rows, k + 1).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    near = [r for r in best.collect() if r["row"] != some[r["query"]]["query"]]      # at most sample * (k + 1)
    if not near:
        return 1
    return needed_probes(q, np.array([r["query"] for r in near]), np.array([r["vector"] for r in near]), tables, target)


def usable(vector: Column) -> Column:
    """The vector, or null if it can take no part."""
    v = vector
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    return F.when(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), v)


def search(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 20, key: str = "vec_id", vector: str = "embedding",
           tables: int = TABLES, probes: int | None = None, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(``query_id``, ``rank``, ``key``, ``score``): the ``k`` nearest rows found for each query row, by
    inner product, without itself. ``probes``: by table; fitted if it is not given."""
    prepare(rows.sparkSession)
    given = rows.select(F.col(key).cast("long").alias("id"), usable(F.col(vector)).alias("vector")).where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    given = staged(given.withColumn("h", F.xxhash64("vector")).withColumn("n", F.monotonically_increasing_id()), "vectors")
    found = rows.sparkSession.createDataFrame([], "query long, id long, score double")
    for d in sorted(r["d"] for r in given.select(F.size("vector").alias("d")).distinct().collect()):
        found = found.union(_search(given.where(F.size("vector") == d), d, is_query, k, tables, probes, block_rows, query_rows))
    best = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")


def _search(given: DataFrame, d: int, is_query, k: int, tables: int, probes: int | None, block_rows: int, query_rows: int) -> DataFrame:
    """(query, id, score) among vectors of one dimension."""
    given = given.dropDuplicates(["id", "h"])
    # the smallest ids of each distinct vector, in two steps so that no vector is one task's; the
    # smallest number names the vector
    parts = Window.partitionBy("h", "vector", F.pmod(F.col("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("h", "vector").orderBy("id")
    few = given.withColumn("nth", F.row_number().over(parts)).where(F.col("nth") <= k + 1)
    few = few.withColumn("nth", F.row_number().over(whole)).where(F.col("nth") <= k + 1)
    ids = staged(few.withColumn("row", F.min("n").over(Window.partitionBy("h", "vector"))).select("row", "id", "nth", "h", "vector"), "distinct")
    distinct = ids.where(F.col("nth") == 1).select("row", "vector", "h")
    # each distinct query vector is searched once, for all the ids that have it
    known = distinct.select("row", "h", F.col("vector").alias("_vector"))
    own = given.where(is_query(F.col("id"))).join(known, "h").where(F.col("vector") == F.col("_vector")).select(F.col("id").alias("query"), "row")
    own = staged(own, "asked")
    wanted = staged(own.select("row").distinct().join(distinct, "row").select(F.col("row").alias("query"), "vector"), "wanted")
    probes = probes or fitted_probes(wanted, distinct, k, tables)
    cells = staged(_cells(distinct.select("row", "vector"), d, tables, 1, "row"), "cells")
    asked = staged(_cells(wanted, d, tables, probes, "query"), "probes")
    # that is 2 * d * tables rows at most
    count = lambda df, n, name: df.groupBy("cell").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    sizes = F.broadcast(staged(count(cells, block_rows, "blocks").join(count(asked, query_rows, "query_blocks"), "cell"), "sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = asked.join(sizes, "cell").select("cell", every("blocks").alias("block"), deal("query", F.col("query_blocks")).alias("part"), "query", "vector")
    right = cells.join(sizes, "cell").select("cell", deal("row", F.col("blocks")).alias("block"), every("query_blocks").alias("part"), "row", "vector")
    meet = lambda left, right: left.groupBy("cell", "block", "part").cogroup(right.groupBy("cell", "block", "part")).applyInPandas(
        _rank(k + 1, d), "query long, row long, score double")
    # one vector more than asked for: the query's own may be among them
    named = _named(meet(left, right), ids, k)
    mine = lambda named: own.join(named.withColumnRenamed("query", "row"), "row").where(F.col("query") != F.col("id")).select("query", "row", "id", "score")
    got = staged(mine(named), "named")
    candidates = given.select("id").distinct().count() - 1
    short = own.select("query").distinct().join(got.groupBy("query").agg(F.countDistinct("id").alias("got")), "query", "left")
    short = short.where(F.coalesce("got", F.lit(0)) < min(k, candidates)).select("query")
    short = staged(own.join(short, "query").select("row").distinct(), "short")
    n = short.count()
    if n:
        most = [-(-n // query_rows), -(-distinct.count() // block_rows)]
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = wanted.join(short.withColumnRenamed("row", "query"), "query", "left_semi").select(
            F.lit(0).alias("cell"), all_of(most[1]).alias("block"), deal("query", F.lit(most[0])).alias("part"), "query", "vector")
        right = distinct.select(F.lit(0).alias("cell"), deal("row", F.lit(most[1])).alias("block"), all_of(most[0]).alias("part"), "row", "vector")
        more = staged(mine(_named(meet(left, right), ids, k)), "named")
        got = got.join(short, "row", "left_anti").select(*more.columns).union(more)
    return got.select("query", "id", "score")

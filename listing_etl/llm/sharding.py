"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group and go to one shard. Groups are gathered in a fixed
number of bundles by a hash of the text; a group above a bundle's fair share in any of the
three measures is an item of its own (there are at most three times as many of these as
bundles), and a group above a shard's capacity is cut into parts by a hash of the document
id, each part an item. Spark sums the vectors; the bounded list of items is placed one by one,
the heaviest first, each where the dot product of its vector with the residual capacity of the
shard is highest, among the shards that it overfills least.

A shard's slots are numbered without gaps by document id: rows are counted in sections of the
shard, and each section starts behind those before it, so no task sorts a whole shard.

Edge cases: null texts are one group of their own with no bytes and no tokens, empty texts
another; null ids get slots like others (first of their section); repeated rows get a slot
each; ties go to the smaller shard; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from listing_etl.llm.common import staged

OVERHEAD = 16
#: Bundles of small groups for each shard.
BUNDLES_PER_SHARD = 128
#: Rows of a section of a shard, about.
SECTION_ROWS = 50_000
MIN_SECTIONS = 16


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of nonnegative measures), the heaviest first."""
    total = vectors.sum(axis=0)
    share = vectors / np.where(total > 0, total, 1) * shards      # 1: a whole shard
    left = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        over = np.maximum(share[i] - left, 0).max(axis=1)
        fits = over <= over.min() + 1e-12
        score = np.where(fits, left @ share[i], -np.inf)
        out[i] = score.argmax()
        left[out[i]] -= share[i]
    return out


def _tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")).cast("long"), F.lit(0).cast("long"))


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """``key``, ``size`` (UTF-8 bytes and ``overhead``), ``text_crc32``, ``tokens``, ``shard`` and ``slot`` of every row."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    body = F.col(text)
    rows = staged(docs.select(
        F.col(key).alias("key"), (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + overhead).alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"), _tokens(body).alias("tokens"),
        F.xxhash64(body.isNull(), body).alias("of"), F.monotonically_increasing_id().alias("row")), "rows")
    bundles = shards * BUNDLES_PER_SHARD
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    measures = ("size", "tokens", "n")
    groups = staged(rows.groupBy("of").agg(*sums), "groups")
    whole = groups.agg(*(F.sum(m).cast("double").alias(m) for m in measures)).first()
    share = F.greatest(*(F.col(m) / (whole[m] or 1.0) for m in measures))
    # items: bundles of light groups, heavy groups, parts of groups that no shard can hold
    heavy = groups.where(share > 1 / bundles).select("of", F.greatest(F.lit(1), F.ceil(share * shards * 2)).cast("int").alias("parts"), share.alias("share"))
    heavy = heavy.select("of", F.when(F.col("share") * shards > 1, F.col("parts")).otherwise(1).alias("parts"))
    marked = rows.join(F.broadcast(heavy), "of", "left")          # at most 3 * bundles rows
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))).otherwise(0).cast("int")
    item = F.when(F.col("parts").isNull(), F.struct(F.pmod(F.col("of"), F.lit(bundles)).alias("of"), F.lit(-1).alias("part")))
    marked = marked.withColumn("item", item.otherwise(F.struct("of", part.alias("part")))).drop("of", "parts")
    items = marked.groupBy("item").agg(*sums).orderBy("item").collect()   # at most bundles + 3 * bundles + 6 * shards rows
    vectors = np.array([[r[m] for m in measures] for r in items], dtype=np.float64).reshape(len(items), 3)
    to = place(vectors, shards)
    kind = T.StructType([T.StructField("item", marked.schema["item"].dataType), T.StructField("shard", T.IntegerType())])
    where = docs.sparkSession.createDataFrame([(r["item"], int(s)) for r, s in zip(items, to)], kind)
    sections = max(MIN_SECTIONS, int((whole["n"] or 0) // (shards * SECTION_ROWS)))
    placed = marked.join(F.broadcast(where), "item").withColumn("section", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(sections)).cast("int"))
    placed = staged(placed.drop("item"), "placed")
    before = Window.partitionBy("shard").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "section").count().select("shard", "section", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "section").orderBy("row")
    numbered = placed.withColumn("nth", F.row_number().over(inner) - 1).join(F.broadcast(starts) if shards * sections <= 1_000_000 else starts, ["shard", "section"])
    return numbered.select(F.col("key").alias(key), "size", "text_crc32", "tokens", "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"))

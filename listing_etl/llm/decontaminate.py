"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts become lower-cased letter and digit words and sets of hashed five-word shingles
(64 bits). An item of fewer words is one shingle of all its words, and documents have the runs of
as many words for every such length that occurs among the items. Test items are partitioned by
the size of their set, each size class spanning a factor of two. The MinHash signature of
an item is the k smallest hashes of its set; k belongs to its class. If at least ``t`` of
an item's n shingles are in a document, fewer than k = n - ceil(t n) + 1 are missing, so
one of any k of them is in the document: with k for the largest n of the class no leaked
item is missed, while a document is asked for about a fifth of the shingles only. Unlike
whole-document signatures this does not weaken as documents get longer.

Documents stream past the signatures (which are broadcast only below a checked number of
rows; beyond it both sides shuffle on the hash), and the candidates are verified by the
exact number of the item's distinct shingles in the document.

Everything is built-in Spark expressions.

Edge cases: null and empty texts have no shingles and never match; an item that occurs
twice under two ids gives two rows, repeated rows of one id are one item; repeated document
rows of one id count as one document (all their texts together); null ids are ignored on
either side; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import staged

WORDS = 5
CONTAINMENT = 0.8
#: Signature rows (two longs each, 64 MB at most) and candidates up to which they are broadcast.
BROADCAST_ROWS = 2_000_000


def shingle_hashes(text: Column, words: int = WORDS, runs: tuple[int, ...] | None = None) -> Column:
    """Distinct 64-bit hashes of the word shingles of a text (null text: empty). Of an item
    (``runs`` is null) with fewer words: of all its words; of a document: also of its runs of the
    lengths ``runs``, each below ``words``."""
    w = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        none = F.array().cast("array<bigint>")
        each = F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words)))))
        if runs is None:
            return F.coalesce(each, F.when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))), none)

        def run(r: int) -> Column:
            joined = lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(r))))
            return F.when(n >= r, F.transform(F.sequence(F.lit(0), n - r), joined))

        return F.concat(*(F.coalesce(x, none) for x in [each, *map(run, runs)]))

    # the words are an element of an array here, so that they are computed once
    return F.array_distinct(F.flatten(F.transform(F.array(w), hashes)))


def _signature_size(n: Column, t: float) -> Column:
    """k of the class of a set of n: its largest member 2^(j+1) - 1 decides."""
    top = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1
    return (top - F.ceil(F.lit(t) * top - 1e-9) + 1).cast("int")


def short_lengths(items: DataFrame, key: str = "item_id", text: str = "text", words: int = WORDS) -> tuple[int, ...]:
    """The numbers of words below ``words`` that items have (at most ``words`` - 1 of them)."""
    n = F.size(F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), ""))
    found = items.where(F.col(key).isNotNull()).select(n.alias("n")).where(F.col("n").between(1, words - 1)).distinct()
    return tuple(sorted(r["n"] for r in found.collect()))


def item_sets(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item``, ``n`` and ``hashes`` (sorted) of every item with at least one shingle."""
    sets = (items.where(F.col(key).isNotNull())
            .select(F.col(key).alias("item"), F.explode(shingle_hashes(F.col(text))).alias("h"))
            .groupBy("item").agg(F.array_sort(F.collect_set("h")).alias("hashes")))
    return sets.select("item", F.size("hashes").alias("n"), "hashes")


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast below a checked number of rows; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= limit else df


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                    item_key: str = "item_id", item_text: str = "text",
                    threshold: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(``key``, ``item_key``, ``shared``, ``item_shingles``, ``containment``) for every document
    that contains at least ``threshold`` of an item's distinct shingles."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    runs = short_lengths(items, item_key, item_text)
    items = staged(item_sets(items, item_key, item_text), "items")
    size = F.least("n", _signature_size(F.col("n"), threshold))
    sketch = items.select("item", F.explode(F.slice("hashes", 1, size)).alias("h"))
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("body"))
    sketch = _small(sketch, broadcast_rows)
    # candidates: documents that hold a signature shingle
    seen = docs.select("doc", F.explode(shingle_hashes(F.col("body"), runs=runs)).alias("h"))
    pairs = staged(seen.join(sketch, "h").select("doc", "item").distinct(), "candidates")
    # verification: the item's shingles in those documents, counted exactly
    some = _small(pairs.select("doc").distinct(), broadcast_rows)
    again = docs.join(some, "doc", "left_semi").select("doc", F.explode(shingle_hashes(F.col("body"), runs=runs)).alias("h"))
    all_ = items.select("item", "n", F.explode("hashes").alias("h"))
    every = _small(all_, broadcast_rows)
    found = again.join(every, "h").groupBy("doc", "item").agg(F.countDistinct("h").alias("shared"), F.first("n").alias("n"))
    found = found.where(F.col("shared") >= F.lit(threshold) * F.col("n") - 1e-9).join(pairs, ["doc", "item"], "left_semi")
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), "shared",
                        F.col("n").cast("long").alias("item_shingles"), (F.col("shared") / F.col("n")).alias("containment"))

"""The latest stored price of each title (JN5, SRC5), kept per batch.

Every batch writes, besides its rows, one row for each of its titles: the latest by sequence
number. A later batch looks its titles up there, by a semi join, and does not read the stored
history: a title has one row for each batch at most, and ``compact`` folds the rows of many
batches into one each.

A row that comes late (its number is not above that of the title's latest row in some earlier
batch) may have its previous row inside of that batch. Only for such titles, and only in the
batches concerned (partitions), the history is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_etl.operators import relational as R
from listing_etl.sources.ledger import Ledger

TABLE, BASES = "latest_prices", "latest_prices_base"
ROW = "title string, price string, scrape_seq long"


def latest(rows: DataFrame) -> DataFrame:
    """One row (title, price, scrape_seq) for each title that names a product; partial sums, so
    that a hot title is one row of each map task."""
    top = rows.where(R.not_sentinel("title")).groupBy("title").agg(F.max(F.struct("scrape_seq", F.col("price").cast("string").alias("price"))).alias("t"))
    return top.select("title", "t.price", "t.scrape_seq")


def compact(ledger: Ledger, batches: dict[str, str] | None = None) -> str:
    """Fold the latest rows of all committed batches (or of the given attempts) into one table, ranges of
    titles in each file. Returns its name; ``before`` uses it for batches that may see all of them."""
    batches = ledger.committed() if batches is None else batches
    name = f"base-{len(ledger._names('bases')):08d}"
    rows = latest(ledger.read(TABLE, batches, ROW)).repartitionByRange("title").sortWithinPartitions("title")
    rows.write.mode("overwrite").parquet(f"{ledger.root}/{BASES}/{name}")
    ledger._put("bases", name, [f"{b} {a}" for b, a in sorted(batches.items())])
    return name


def _base(ledger: Ledger, seen: dict[str, str]) -> tuple[str | None, dict[str, str]]:
    """The newest base whose batches are all to be seen, and its batches."""
    for name in reversed(ledger._names("bases")):
        covered = dict(x.split(" ") for x in ledger._lines("bases", name) or [])
        if covered and all(seen.get(b) == a for b, a in covered.items()):
            return name, covered
    return None, {}


def before(ledger: Ledger, seen: dict[str, str], batch: DataFrame, history: str = "products") -> DataFrame:
    """The stored rows (title, price, scrape_seq) that a batch of rows (title, scrape_seq) needs to
    find its previous prices among the attempts ``seen``."""
    spark = ledger.spark
    name, covered = _base(ledger, seen)
    titles = batch.where(R.not_sentinel("title")).groupBy("title").agg(F.min("scrape_seq").alias("_first"))
    rows = ledger.read(TABLE, {b: a for b, a in seen.items() if b not in covered}, ROW).select("title", "price", "scrape_seq", "batch_id")
    if name is not None:
        base = spark.read.parquet(f"{ledger.root}/{BASES}/{name}")
        rows = rows.union(base.select("title", "price", "scrape_seq", F.lit(name).alias("batch_id")))
    known = rows.join(titles, "title")
    late = known.where(F.col("scrape_seq") >= F.col("_first")).select("title", "batch_id").distinct()
    where = [r["batch_id"] for r in late.select("batch_id").distinct().collect()]        # batches, not rows
    known = known.select("title", "price", "scrape_seq")
    if not where:
        return known
    ids = {b: a for b, a in seen.items() if b in where or (name in where and b in covered)}
    old = ledger.read(history, ids, ROW).select("title", F.col("price").cast("string").alias("price"), "scrape_seq")
    old = old.join(late.select("title").distinct(), "title", "left_semi")
    # rows that are found twice are equal; they do not change which one is the latest
    return known.union(old)

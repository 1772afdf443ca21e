"""The corpus pipeline: five stages from ``documents`` to a clean, encoded corpus.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, written as Parquet
and read again as the next one's ``docs``. Models are fitted on the labelled rows of the whole
``documents`` table; the stages work on all rows that their predecessor kept. Rows are told apart by
id and text: rows of one id with different texts are judged each by itself, and rows without an
id like all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_etl.llm import decontaminate, quality, queries, sentencepiece_codec, simhash, toxicity
from listing_etl.llm.common import prepare, staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return toxicity.keep_ordinary(docs, queries.toxicity_model(spark, sf_dir, docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id (rows without an id come last), once."""
    # orders rows of a group; rows that are equal in it are repeated rows
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _digest().alias("digest"))
    packed = docs.select(F.struct("*").alias("doc"), row.alias("row"), F.col("text").alias("body"))
    groups = simhash.near_duplicates(packed, "row", "body")
    firsts = staged(groups.where(F.col("row") == F.col("component_id")).select(_name(F.col("row.id"), F.col("row.digest")).alias("name")).distinct(), "firsts")
    named = packed.select("doc", _name(F.col("row.id"), F.col("row.digest")).alias("name"))
    return named.join(firsts, "name", "left_semi").dropDuplicates(["name"]).select("doc.*")


def _digest() -> Column:
    return F.sha1(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def _name(key: Column, digest: Column) -> Column:
    """Tells rows apart by id and text."""
    return F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("-")), digest)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    prepare(spark)
    named = docs.select(F.struct("*").alias("doc"), _name(F.col("doc_id"), _digest()).alias("name"), F.col("text").alias("body"))
    found = decontaminate.contained_items(named, table(spark, sf_dir, "benchmark"), "name", "body")
    leaked = staged(found.select("name").distinct(), "leaked")
    return named.join(leaked, "name", "left_anti").select("doc.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, checked by decoding them: (doc_id, source, lang, n_tokens, ids, lossless)."""
    model = queries.piece_model()
    narrow = docs.select("doc_id", "source", "lang", "text")
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(narrow, model, "text", "ids"), model, "ids", "decoded")
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_codec.MARK, " ")
    return both.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("simhash", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("sentencepiece", encode_pieces)]

#: SQL can express neither the models nor the merge order of the pieces; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    prepare(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs

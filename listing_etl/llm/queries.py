"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_etl.llm import (cross_polytope, decontaminate, lexical_search, merkle, oracles, quality, secret_scan, sentencepiece_codec, sharding, simhash, site_text, toxicity,
                             url_reputation, warc)
from listing_etl.llm.common import prepare, staged, table
from listing_etl.session import scratch_path

SHARDS = 40
SEGMENT_BYTES, FILE_RECORDS = 4 << 10, 10_000
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def piece_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def toxic_held_out(key: Column) -> Column:
    return fold(key, 3) == 1


def quality_held_out(key: Column) -> Column:
    return fold(key, 5) == 0


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    placed = sharding.shard(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: a page's url ends in the id of its document, whose label tells whether
    the page was good (good quality and not toxic)."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    labels = labels.groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    pages = table(spark, sf_dir, "pages").select("url", F.regexp_extract(url_reputation.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1).alias("id"))
    return pages.where(F.col("id") != "").select("url", F.col("id").cast("long").alias("doc_id")).join(labels, "doc_id").select("url", "bad")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    known = staged(url_reputation.reputations(page_outcomes(spark, sf_dir)), "reputations")
    return url_reputation.judge(table(spark, sf_dir, "pages"), known, RULES).withColumn("bound", F.round("bound", 6))


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), piece_model())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.KneserNey:
    """Fitted on the labelled rows of ``documents``, ready to score ``docs``."""
    return toxicity.fit(toxicity.labelled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxic_held_out), docs)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select("doc_id", toxic_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = scratch_path(spark, "archives")
    # small segments: the longer pages, with most of the bytes, are put together again from several
    warc.write_archives(table(spark, sf_dir, "pages"), path, segment_bytes=SEGMENT_BYTES, file_records=FILE_RECORDS)
    records = warc.reassemble(warc.read_records(spark, path))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*):[0-9]+>$", 1)
    own = F.when(F.col("status") == "ok", F.octet_length("payload").cast("long"))
    read = staged(records.select("id", "refers", own.alias("own"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "status"), "records")
    sizes = read.where(F.col("record_type") == "response").groupBy(F.col("id").alias("origin")).agg(F.max("own").alias("size"))
    joined = read.join(staged(sizes, "sizes"), read["refers"] == F.col("origin"), "left")
    return joined.select(F.nullif(page(F.col("id")), F.lit("")).cast("long").alias("page_id"), F.coalesce("own", "size").alias("payload_bytes"),
                         "payload_digest", "record_type", F.nullif(page(F.col("refers")), F.lit("")).cast("long").alias("refers_to"), "status")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Trees:
    return quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), quality_held_out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", quality_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = site_text.main_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even CRC-32 are checked without the line ends of their text."""
    def tampered(c: dict[str, Column]) -> list[Column]:
        cut = F.when(F.pmod(F.crc32(c["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0, F.replace(c["text"], F.lit("\n"), F.lit("")))
        return [F.coalesce(cut, c["text"]) if name == "text" else c[name] for name in c]

    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("rank", F.col("rank").cast("int"))


QUERIES = {f.__name__: f for f in (op1_shards, op2_url_reputation, op3_cross_polytope, op4_sentencepiece, op5_decontaminate,
                                   op6_simhash, op7_toxicity, op8_warc, op9_quality, op10_main_text, op11_secret_scan, op12_merkle, op13_lexical_search)}

ORACLES = {"op2_url_reputation": oracles.url_reputation(RULES), "op5_decontaminate": oracles.DECONTAMINATE,
           "op8_warc": oracles.WARC, "op10_main_text": oracles.MAIN_TEXT, "op12_merkle": oracles.merkle(), "op13_lexical_search": oracles.LEXICAL}

"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's test tables (or landed tables Spark derives from
them in ``testbed``) in full. Column names equal those of the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listing_etl.functions import scalars as S
from listing_etl.operators import history as H
from listing_etl.operators import relational as R
from listing_etl.plans import testbed as T
from listing_etl.sources import readers as RD


def asin_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY1, KEY2, KEY3."""
    r = T.part_requests(spark, sf_dir).withColumn("asin", S.asin("url"))
    return r.select("request_id", "url", "asin",
                    S.lookup_url("asin").alias("lookup_url"),
                    F.when(F.col("asin").isNull(), F.lit("INVALID_URL")).alias("code"))


def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL3 with its reject code."""
    t = T.price_texts(spark, sf_dir).withColumn("price", S.parse_money("price_text"))
    return t.select("id", "price_text", "price",
                    F.when(F.col("price").isNull(), F.lit("BAD_PRICE")).alias("code"))


def discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL5, SCL6 on every scrape: unit price and a used price from the line discount."""
    li = T.table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    unit = F.floor(cents / F.col("l_quantity").cast("bigint")).cast("bigint")
    used = F.floor(unit * (100 - F.round(F.col("l_discount") * 100).cast("bigint")) / 100).cast("bigint")
    x = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scrape_seq"),
                  (unit / 100.0).alias("price"), (used / 100.0).alias("used_price"))
    return x.withColumn("discount", S.discount("price", "used_price"))


def history_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS1-HIS10: decoded points of every landed history page."""
    d = H.decode_pages(T.history_pages(spark, sf_dir), ["internal_pid"])
    return H.points(d)


def history_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS7-HIS9 and page failures, counted per reject code."""
    d = H.decode_pages(T.history_pages(spark, sf_dir), ["internal_pid"])
    return H.rejects(d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def chart_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS11-HIS12."""
    pts = H.points(H.decode_pages(T.history_pages(spark, sf_dir), ["internal_pid"]))
    return H.chart_feed(pts)


def previous_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: each scrape sees the latest earlier scrape of the same title.

    Scrape order: (orderkey*8 + linenumber, partkey, suppkey, price); the line
    number alone does not make lineitem rows unique.
    """
    li = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                   "l_suppkey", "l_extendedprice")
    p = T.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    s = li.join(p, li.l_partkey == p.p_partkey).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scrape_seq"),
        "l_partkey", "l_suppkey",
        F.col("p_name").alias("title"), F.col("l_extendedprice").alias("price"))
    out = R.previous_value(s, "title", ["scrape_seq", "l_partkey", "l_suppkey", "price"], "price",
                           out="previous_price")
    return out.select("scrape_seq", "l_partkey", "l_suppkey", "title", "price", "previous_price")


def return_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1-AGG3 with the given label (labels.quality = 1 is POSITIVE)."""
    from listing_etl.operators import reviews as RV
    docs = T.table(spark, sf_dir, "documents").select("doc_id")
    lab = T.table(spark, sf_dir, "labels").select("doc_id", "quality")
    rv = docs.join(lab, "doc_id").select(
        T.review_record(F.col("doc_id")).alias("record_id"),
        F.when(F.col("quality") == 1, F.lit("POSITIVE")).otherwise(F.lit("NEGATIVE")).alias("label"))
    return RV.return_rate(rv, "record_id", "label")


QUERIES = {
    "asin_extract": asin_extract,
    "money_parse": money_parse,
    "discount": discount,
    "history_decode": history_decode,
    "history_rejects": history_rejects,
    "chart_feed": chart_feed,
    "previous_price": previous_price,
    "return_rate": return_rate,
}
FLAGSHIP = history_decode


# ------------------------------------------------------------------ page job

def page_fields_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAGE1-PAGE3, PAGE8, UDF3 on the ``pages`` table (generic preset)."""
    from listing_etl.operators import pages as P
    pg = T.table(spark, sf_dir, "pages")
    x = P.extract(pg, P.TEST_PAGE, ["page_id"])
    return x.select("page_id", *[S.ustrip(c).alias(c) for c in ("title", "h1", "ad", "first_p", "footer")],
                    "n_p", F.size("links").alias("n_links"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAGE5, PAGE6, EXP1: one row per ``a[href]`` in document order."""
    from listing_etl.operators import pages as P
    x = P.extract(T.table(spark, sf_dir, "pages"), P.TEST_PAGE, ["page_id"])
    e = R.explode_children(x, ["page_id"], "links", {"href": "href", "text": "text"})
    return e.select("page_id", "pos", "href", S.ustrip("text").alias("text"))


QUERIES.update({
    "page_fields_parsed": page_fields_parsed,
    "page_links": page_links,
})


# -------------------------------------------------------------- product flow

def stage_parsed(spark: SparkSession, sf_dir: str, *unseen: str) -> DataFrame:
    """Parse all product pages once, as a production batch does; the views take it as ``parsed``. ``unseen``:
    columns that no reader of it shows."""
    from listing_etl.sources import sinks as K
    return K.stage(spark, _parsed(spark, sf_dir).drop(*unseen), "parsed")


def _parsed(spark: SparkSession, sf_dir: str, *without: str, parsed: DataFrame | None = None) -> DataFrame:
    """Parsed pages, without optional columns that the view does not show."""
    from listing_etl.plans import products as PR
    if parsed is not None:
        return parsed.drop(*without)
    return PR.parse_products(T.product_pages(spark, sf_dir), keys=["request_id", "scrape_seq"], without=without)


def _but(*shown: str) -> list[str]:
    """The optional columns but those that a view shows."""
    from listing_etl.plans import products as PR
    return [c for c in PR.OPTIONAL if c not in shown]


def product_details(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """FLD1-FLD9, SCL1-SCL6, EXP4, SNK1 (V1 details row)."""
    from listing_etl.plans import products as PR
    return PR.details(_parsed(spark, sf_dir, *PR.NOT_DETAILS, parsed=parsed), ["request_id"])


def products_wide(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """FLD1-FLD9, SCL4 (V2 rule), SCL7, EXP4, SNK5 (V2 wide row)."""
    from listing_etl.plans import products as PR
    return PR.wide(_parsed(spark, sf_dir, "reviews", parsed=parsed), ["request_id"])


def product_images(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """FLD6, PAGE6, EXP1, SNK2."""
    from listing_etl.plans import products as PR
    return PR.images(_parsed(spark, sf_dir, *_but("title", "images"), parsed=parsed), ["request_id"])


def reviews_rows(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """FLD10, PAGE7, EXP2, SNK3."""
    from listing_etl.plans import products as PR
    return PR.reviews(_parsed(spark, sf_dir, *_but("title", "reviews"), parsed=parsed), ["request_id"])


def offers_rows(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """FLD11, EXP3, SNK4 (V1 offers)."""
    from listing_etl.plans import products as PR
    return PR.offers(_parsed(spark, sf_dir, *_but("title"), parsed=parsed), ["request_id"], "details")


def offers_wide(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """FLD12 (V2 offers: name, price text, condition, shipping)."""
    from listing_etl.plans import products as PR
    return PR.offers(_parsed(spark, sf_dir, *_but("title"), parsed=parsed), ["request_id"], "wide")


def product_rejects(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """REJ for the page stage: one row per (request, code)."""
    from listing_etl.plans import products as PR
    return PR.rejects(_parsed(spark, sf_dir, *PR.OPTIONAL, parsed=parsed))


def request_status(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """RPT2, JN3, SRC1, SRC2: requests by outcome (first fatal code, else ok), from requests and
    rejects; a request without a good page at its time counts as a failed page."""
    from listing_etl.plans import pipeline as PL
    from listing_etl.plans import products as PR
    from listing_etl.plans import report as RP
    from listing_etl.sources import sinks as K
    requests = _landed(spark, T.product_requests(spark, sf_dir), RD.requests)
    pages = T.product_pages(spark, sf_dir)
    if parsed is None:
        # pages are made once: parsed together with their names, and staged without their html
        keys = ["request_id", "scrape_seq", "url", "http_status", "page_hash"]
        named = pages.withColumn("page_hash", PL.page_hash())
        parsed = PR.parse_products(named, keys=keys, without=PR.OPTIONAL).select(*keys, "codes")
        parsed = pages = K.stage(spark, parsed, "status")
    else:
        pages = pages.withColumn("page_hash", PL.page_hash())
    found = PL.current_names(requests, T.landed(pages))
    lost = found.where(F.col("page_seq").isNull()).select("request_id", F.lit("page").alias("stage"), F.lit("PAGE_HTTP_FAILED").alias("code"),
                                                          F.lit(None).cast("string").alias("detail"))
    rejects = PR.rejects(parsed)
    return RP.request_status(requests, rejects.union(lost), "details")


def request_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS11: series length and history outcome of each product request, resolved or not."""
    from listing_etl.plans import prices as PX
    return PX.request_history(T.product_requests(spark, sf_dir), T.product_id_lookup(spark, sf_dir), T.history_pages(spark, sf_dir, clean=True))


def product_report(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """RPT1, SCL9, SCL10, AGG1-AGG3 with the rating scorer, JN5, HIS11: both branches of a request."""
    from listing_etl.plans import prices as PX
    from listing_etl.plans import products as PR
    from listing_etl.plans import report as RP
    # read for the prices seen before (several times), and for the report: pages are parsed once
    parsed = stage_parsed(spark, sf_dir, "offers_wide", "used_condition_wide") if parsed is None else parsed
    rows = PR.details(parsed, ["request_id", "scrape_seq"]).select("request_id", "scrape_seq", "title", "price")
    none = spark.createDataFrame([], "title string, price string, scrape_seq bigint")
    return RP.product_report(parsed, ["request_id"], previous=PX.previous_prices(rows, none, tie="request_id"), history=request_history(spark, sf_dir))


def product_details_strict(spark: SparkSession, sf_dir: str, parsed: DataFrame | None = None) -> DataFrame:
    """REJ, strict: details of the requests whose price history did not fail in any way."""
    from listing_etl.plans import products as PR
    return PR.without_failed_history(product_details(spark, sf_dir, parsed), request_history(spark, sf_dir))


def current_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: the page that was current for each request, over urls that are fetched many times."""
    from listing_etl.plans import pipeline as PL
    found = PL.current_pages(T.revisiting_requests(spark, sf_dir), T.revisited_pages(spark, sf_dir))
    return found.select("request_id", "url", "scrape_seq", "page_seq")


def parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6: every stored product with every stored offer of its title, one title hot."""
    return R.join_children(T.title_parents(spark, sf_dir), T.title_children(spark, sf_dir), "title", "product_title").drop("product_title")


#: Queries that can read a staged parse.
VIEWS = ("product_details", "products_wide", "product_images", "reviews_rows", "offers_rows", "offers_wide", "product_rejects", "request_status",
         "product_report", "product_details_strict")
QUERIES.update({
    "product_details": product_details,
    "products_wide": products_wide,
    "product_images": product_images,
    "reviews_rows": reviews_rows,
    "offers_rows": offers_rows,
    "offers_wide": offers_wide,
    "product_rejects": product_rejects,
    "request_status": request_status,
    "product_report": product_report,
    "product_details_strict": product_details_strict,
    "request_history": request_history,
    "current_page": current_page,
    "parent_children": parent_children,
})
FLAGSHIP = product_report


# ----------------------------------------------------------- V1 lookup chain

def _landed(spark: SparkSession, df: DataFrame, reader, **options) -> DataFrame:
    """``df`` landed as files in the shared folder and read by a source of the library."""
    from listing_etl.session import scratch_path
    path = scratch_path(spark, f"landed-{reader.__name__}")
    df.write.parquet(path)
    return reader(spark, path, **options)


def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY1-KEY5, JN1, SRC1, SRC3: request -> ASIN -> lookup response -> pid / code."""
    from listing_etl.plans import prices as PX
    return PX.resolve(_landed(spark, T.history_requests(spark, sf_dir), RD.requests),
                      _landed(spark, T.id_lookup(spark, sf_dir), RD.id_lookup))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1, JN2, SRC4, HIS1-HIS10 end to end: the ``price_history`` table."""
    from listing_etl.plans import prices as PX
    d = PX.price_history(_landed(spark, T.history_requests(spark, sf_dir), RD.requests),
                         _landed(spark, T.id_lookup(spark, sf_dir), RD.id_lookup),
                         _landed(spark, T.history_pages(spark, sf_dir), RD.history_pages))
    return H.points(d)


QUERIES.update({"lookup_join": lookup_join, "price_history": price_history})


# -------------------------------------------------- stored products, scalars

def product_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, SRC5: does an earlier row (stored or earlier in the batch) have this title?"""
    from listing_etl.plans import prices as PX
    batch = T.new_batch(spark, sf_dir)
    stored = _landed(spark, T.stored_products(spark, sf_dir), RD.stored_prices, titles=batch)
    r = PX.previous_prices(batch, stored)
    return r.select("request_id", "title", "exists")


def stored_previous_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, TOP1, WIN1, SCL8: the previous price each new scrape reports."""
    from listing_etl.plans import prices as PX
    batch = T.new_batch(spark, sf_dir)
    stored = _landed(spark, T.stored_products(spark, sf_dir), RD.stored_prices, titles=batch)
    r = PX.previous_prices(batch, stored)
    return r.select("request_id", "title", "previous_price", "code")


def latest_stored_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN5, SNK6: previous prices of a later batch from the latest price of each title that two
    committed batches have stored."""
    from listing_etl.plans import prices as PX
    from listing_etl.plans import state as ST
    from listing_etl.session import scratch_path
    from listing_etl.sources.ledger import Ledger
    ledger = Ledger(spark, scratch_path(spark, "stored"))
    stored = T.stored_products(spark, sf_dir)
    for name, rows in (("load-1", stored.where(F.col("scrape_seq") % 4 == 0)), ("load-2", stored.where(F.col("scrape_seq") % 4 != 0))):
        attempt, _ = ledger.begin(name)
        ledger.write(rows, "products", name, attempt)
        ledger.write(ST.latest(rows), ST.TABLE, name, attempt)
        ledger.commit(name, attempt)
    _, seen = ledger.begin("load-3")
    batch = T.new_batch(spark, sf_dir).withColumn("scrape_seq", F.col("scrape_seq") + 1_000_000_000)
    r = PX.previous_prices(batch, ST.before(ledger, seen, batch))
    return r.select("request_id", "title", "exists", "previous_price", "code")


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL1, SCL2 over whole review texts."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", S.with_default(S.normalize_text("text")).alias("text_norm"))


def condition_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL4, both variants."""
    c = T.condition_texts(spark, sf_dir)
    return c.select("id", "condition_text", S.used_condition("condition_text", "details").alias("used_condition"),
                    S.used_condition("condition_text", "wide").alias("used_condition_wide"))


QUERIES.update({
    "product_exists": product_exists,
    "stored_previous_price": stored_previous_price,
    "latest_stored_price": latest_stored_price,
    "text_normalize": text_normalize,
    "condition_split": condition_split,
})


# ----------------------------------------------------------- stream, scoring

def stream_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1, SET1: pages landed as several files, consumed some files for each core per micro-batch;
    the appended sink equals the batch ``product_details``."""
    from listing_etl import schemas as SC
    from listing_etl.session import scratch_path
    from listing_etl.streaming import intake as IN
    landing = scratch_path(spark, "landing")
    pages = T.product_pages(spark, sf_dir).select(*[f.name for f in SC.PAGES.fields])
    # landed as files of bounded size, as many as the data needs; zstd takes less room for markup
    pages.write.option("maxRecordsPerFile", 20_000).parquet(landing, compression="zstd")
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    # micro-batches that keep every core busy, bounded by files of bounded size
    q = IN.stream_details(spark, landing, out, ck, files_per_trigger=4 * max(2, spark.sparkContext.defaultParallelism))
    q.awaitTermination()
    return spark.read.parquet(out).drop("ingested_at")


def review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1: word odds fitted on labelled documents (every fifth held out) label every document."""
    from listing_etl.operators import reviews as RV
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = T.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    odds = RV.fit_word_odds(docs.join(lab.where(F.col("doc_id") % 5 != 0), "doc_id"))
    return RV.score_word_odds(docs, odds, "doc_id")


def review_return_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1 -> AGG1-AGG3: the return rate of each product page from the model's labels."""
    from listing_etl.operators import reviews as RV
    scored = review_score(spark, sf_dir).select(T.review_record(F.col("doc_id")).alias("record_id"), "label")
    return RV.return_rate(scored)


def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KEY4's JSON paths over event properties: the number under ``k``, null where there is none."""
    ev = T.table(spark, sf_dir, "events").select("event_id", "props")
    return ev.select("event_id", F.get_json_object("props", "$.k").alias("k_text"),
                     F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


QUERIES.update({"stream_intake": stream_intake, "review_score": review_score,
                "review_return_rate": review_return_rate, "json_path": json_path})


def history_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS10 regrouped, AGG4: per page, the ordered dates/prices lists (shown as text)."""
    pts = H.points(H.decode_pages(T.history_pages(spark, sf_dir), ["internal_pid"]))
    s = H.series(pts, ["internal_pid"])
    return s.select("internal_pid", F.size("prices").alias("n_points"),
                    F.array_join(F.transform("dates", lambda d: F.date_format(d, "yyyy-MM-dd HH:mm:ss")), "|")
                    .alias("dates_text"),
                    F.array_join(F.transform("prices", lambda p: F.format_string("%.2f", p)), "|")
                    .alias("prices_text"))


QUERIES.update({"history_series": history_series})

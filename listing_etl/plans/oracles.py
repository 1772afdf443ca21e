"""DuckDB SQL oracles, one per registered query (same column names).

They restate the test-table derivations of ``testbed`` and the expected outputs
directly in SQL over the raw tables, without the HTML/packed round trip, so a
match means the Spark decode recovered what was encoded.
"""

from __future__ import annotations

from listing_etl.functions.scalars import DEFAULT_SELLER, PY_WHITESPACE

def ustrip(e: str) -> str:
    """Python str.strip() in DuckDB."""
    chars = PY_WHITESPACE.replace("'", "''")
    return f"trim({e}, '{chars}')"


def rnd2(e: str) -> str:
    """Python round(x, 2): printf rounds the exact binary value, ties to even, too."""
    x = f"CAST({e} AS DOUBLE)"
    return f"(CASE WHEN isnan({x}) OR abs({x}) >= 1e15 THEN {x} ELSE CAST(printf('%.2f', {x}) AS DOUBLE) END)"


SHOP = "https://shop.example.com/"
LOOKUP = "https://lookup.example.com/api/productData?pid="

ASIN_EXTRACT = f"""
WITH r AS (
  SELECT p_partkey AS request_id,
    CASE WHEN p_partkey % 7 = 0 THEN '{SHOP}gp/product/' || k
         WHEN p_partkey % 11 = 0 THEN '{SHOP}' || replace(p_name, ' ', '-') || '/dp/' || k || 'XYZ/ref=sr_1'
         WHEN p_partkey % 13 = 0 THEN '{SHOP}' || replace(p_name, ' ', '-') || '/dp/' || lower(k)
         ELSE '{SHOP}' || replace(p_name, ' ', '-') || '/dp/' || k || '?psc=1' END AS url
  FROM (SELECT p_partkey, p_name, 'B' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS k FROM part)
), a AS (
  SELECT request_id, url, nullif(regexp_extract(url, '/dp/([A-Z0-9]{{10}})', 1), '') AS asin FROM r
)
SELECT request_id, url, asin, '{LOOKUP}' || asin AS lookup_url,
       CASE WHEN asin IS NULL THEN 'INVALID_URL' END AS code
FROM a
"""

MONEY_PARSE = f"""
WITH t AS (
  SELECT p_partkey AS id,
    CASE p_partkey % 6
      WHEN 0 THEN '₹' || format('{{:,.2f}}', p_retailprice)
      WHEN 1 THEN '  Rs. ' || format('{{:,.2f}}', p_retailprice) || ' only' || chr(10)
      WHEN 2 THEN 'NA'
      WHEN 3 THEN '$' || format('{{:,.2f}}', p_retailprice) || ' - $' || format('{{:,.2f}}', p_retailprice * 2)
      WHEN 4 THEN replace(replace(replace(format('{{:,.2f}}', p_retailprice), ',', '#'), '.', ','), '#', '.')
      ELSE format('{{:,.0f}}', p_retailprice) || '.' END AS price_text
  FROM part
), v AS (
  SELECT id, price_text,
    CASE WHEN {ustrip('price_text')} = 'NA' THEN 0.0
         ELSE TRY_CAST(regexp_replace({ustrip('price_text')}, '[^0-9.]', '', 'g') AS DOUBLE) END AS price
  FROM t
)
SELECT id, price_text, price, CASE WHEN price IS NULL THEN 'BAD_PRICE' END AS code FROM v
"""

_UNIT = "(round(l_extendedprice * 100)::BIGINT // l_quantity::BIGINT)"
_USED = f"(({_UNIT} * (100 - round(l_discount * 100)::BIGINT)) // 100)"
DISCOUNT = f"""
WITH x AS (
  SELECT l_orderkey * 8 + l_linenumber AS scrape_seq,
         {_UNIT} / 100.0 AS price, {_USED} / 100.0 AS used_price
  FROM lineitem
)
SELECT scrape_seq, price, used_price,
  CASE WHEN price > 0 AND used_price > 0 THEN {rnd2('(price - used_price) / price * 100.0')}
       ELSE 0.0 END AS discount
FROM x
"""

# History pages: user and month; page k = user_id + chunk.
_HIST_EVENTS = """
  SELECT printf('P%d-%d', user_id, (event_id // 1000000 * 1000 + (year(ts) - 2000) * 12 + month(ts))) AS internal_pid, user_id, (event_id // 1000000 * 1000 + (year(ts) - 2000) * 12 + month(ts)) AS chunk,
         event_id, ts, value,
         (row_number() OVER (PARTITION BY user_id, (event_id // 1000000 * 1000 + (year(ts) - 2000) * 12 + month(ts)) ORDER BY event_id) - 1)::INTEGER AS pos
  FROM events
"""
_PAGE_OK = "((user_id + chunk) % 13 <> 0 AND (user_id + chunk) % 11 <> 0 AND (user_id + chunk) % 7 <> 0)"

HISTORY_DECODE = f"""
WITH e AS ({_HIST_EVENTS})
SELECT internal_pid, pos, date_trunc('second', ts) AS ts, value AS price
FROM e
WHERE {_PAGE_OK} AND event_id % 10 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0
"""

HISTORY_REJECTS = f"""
WITH e AS ({_HIST_EVENTS}),
pages AS (SELECT DISTINCT internal_pid, user_id, chunk FROM e),
page_codes AS (
  SELECT CASE WHEN (user_id + chunk) % 13 = 0 THEN 'HISTORY_HTTP_FAILED'
              WHEN (user_id + chunk) % 11 = 0 THEN 'HISTORY_SCRIPT_MISSING'
              WHEN (user_id + chunk) % 7 = 0 THEN 'HISTORY_PAYLOAD_MISSING' END AS code
  FROM pages
),
pair_codes AS (
  SELECT CASE WHEN event_id % 17 = 0 THEN 'BAD_TIMESTAMP'
              WHEN event_id % 19 = 0 THEN 'BAD_HISTORY_PRICE' END AS code
  FROM e WHERE {_PAGE_OK} AND event_id % 10 <> 0
)
SELECT code, count(*) AS n
FROM (SELECT code FROM page_codes UNION ALL SELECT code FROM pair_codes)
WHERE code IS NOT NULL
GROUP BY code
"""

CHART_FEED = f"""
SELECT internal_pid, pos, ts, price, strftime(ts, '%Y-%m-%d') AS label, date_trunc('day', ts) AS tick
FROM ({HISTORY_DECODE})
"""

PREVIOUS_PRICE = """
SELECT l_orderkey * 8 + l_linenumber AS scrape_seq, l_partkey, l_suppkey, p_name AS title, l_extendedprice AS price,
       lag(l_extendedprice) OVER (PARTITION BY p_name
                                  ORDER BY l_orderkey * 8 + l_linenumber, l_partkey, l_suppkey, l_extendedprice)
         AS previous_price
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

RETURN_RATE = f"""
WITH g AS (
  SELECT CAST(d.doc_id // 3 AS VARCHAR) || '-1' AS record_id, count(*) AS n,
         count(*) FILTER (WHERE l.quality = 1) AS positive
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  GROUP BY 1
)
SELECT record_id, n, positive, {rnd2('(n - positive) / n * 100.0')} AS return_rate FROM g
"""


ORACLES = {
    "asin_extract": ASIN_EXTRACT,
    "money_parse": MONEY_PARSE,
    "discount": DISCOUNT,
    "history_decode": HISTORY_DECODE,
    "history_rejects": HISTORY_REJECTS,
    "chart_feed": CHART_FEED,
    "previous_price": PREVIOUS_PRICE,
    "return_rate": RETURN_RATE,
}


def unescape(e: str) -> str:
    """The four entities of the test pages; '&amp;' last so it is not decoded twice."""
    return (f"replace(replace(replace(replace({e}, '&quot;', '\"'), '&middot;', '·'), "
            f"'&copy;', '©'), '&amp;', '&')")


def tag_text(e: str) -> str:
    return ustrip(unescape(f"regexp_replace({e}, '(?s)<[^>]*>', '', 'g')"))


PAGE_FIELDS_PARSED = f"""
SELECT page_id,
  {tag_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
  {tag_text("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1,
  {tag_text("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)")} AS ad,
  {tag_text("regexp_extract(html, '(?s)<p>(.*?)(<p>|</p>|</article>)', 1)")} AS first_p,
  {tag_text("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")} AS footer,
  CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_p,
  CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS n_links
FROM pages
"""

PAGE_LINKS = f"""
WITH l AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1)) AS href,
         unnest(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2)) AS txt,
         unnest(range(len(regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1)))) AS pos
  FROM pages
)
SELECT page_id, CAST(pos AS INTEGER) AS pos, {unescape('href')} AS href, {tag_text('txt')} AS text FROM l
"""

ORACLES.update({
    "page_fields_parsed": PAGE_FIELDS_PARSED,
    "page_links": PAGE_LINKS,
})


# ------------------------------------------------------------- product flow
# Expected record per scrape (lineitem row), restated from the page rules.
_SCRAPES = """
s0 AS (
  SELECT printf('%d-%d-%d-%d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id,
         l_orderkey * 8 + l_linenumber AS scrape_seq, l_orderkey AS o, l_linenumber AS ln,
         l_partkey AS pk, l_suppkey AS sk, p_name, p_brand, p_type, s_name, l_quantity,
         l_linestatus, l_returnflag, l_shipdate,
         floor(round(l_extendedprice * 100)::BIGINT / l_quantity::BIGINT)::BIGINT AS unit,
         round(l_discount * 100)::BIGINT AS disc, round(l_tax * 100)::BIGINT AS tax
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL
  SELECT printf('%d-1-0-0', o), o * 8 + 1, o, 1, 0, 0, 'unlisted item', 'NONE', 'NONE', 'Unlisted', 1, 'F', 'N',
         DATE '2024-01-01', 100, 0, 0
  FROM (SELECT DISTINCT doc_id // 3 AS o FROM documents) WHERE o NOT IN (SELECT l_orderkey FROM lineitem)
),
s1 AS (
  SELECT *, row_number() OVER (PARTITION BY o ORDER BY ln, pk, sk, unit, floor(unit * (100 + tax) / 100)) = 1 AS is_first,
         CASE WHEN disc > 0 THEN floor(unit * (100 - disc) / 100)::BIGINT END AS used,
         floor(unit * (100 + tax) / 100)::BIGINT AS offer,
         (o * 7 + ln) % 50 = 0 AS failed, (o + ln) % 20 AS pv, ln <> 5 AS has_offer
  FROM s0
),
s2 AS (
  SELECT *, used IS NOT NULL AS has_used, (used IS NOT NULL AND ln = 7 AND o % 3 = 0) AS used_bad FROM s1
),
s AS (
  SELECT *,
    CASE WHEN pv = 1 THEN NULL
         WHEN pv = 0 THEN CASE WHEN has_used THEN (CASE WHEN used_bad THEN NULL ELSE used / 100.0 END)
                               WHEN has_offer THEN offer / 100.0 ELSE 0.0 END
         ELSE unit / 100.0 END AS price,
    CASE WHEN has_used THEN (CASE WHEN used_bad THEN NULL ELSE used / 100.0 END) ELSE 0.0 END AS used_price,
    CASE WHEN (o + 2 * ln) % 40 = 0 THEN 'NA' ELSE p_name END AS title,
    CASE WHEN ln = 6 THEN 'NA' ELSE CAST(CAST(l_quantity * 37 AS BIGINT) AS VARCHAR) || ' ratings' END AS reviews_count,
    CASE WHEN o % 9 IN (0, 1) THEN 'NA'
         WHEN l_linestatus = 'O' THEN 'Only ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' left in stock order soon.'
         ELSE 'In Stock' END AS availability,
    CASE WHEN ln = 2 THEN 'NA' ELSE p_type || ' ' || p_brand END AS description,
    CASE WHEN sk % 5 = 0 THEN '{DEFAULT_SELLER}' ELSE s_name END AS seller,
    CASE WHEN NOT has_used THEN 'NA'
         ELSE ['Like New', 'Very Good', 'Like', 'NA', 'Good', 'Acceptable', 'Good'][ln] END AS used_condition,
    CASE WHEN NOT has_used THEN 'NA'
         ELSE ['Like New', 'Very Good', 'Like', 'Used', 'Good', 'Acceptable', 'Good'][ln] END AS used_condition_wide,
    has_offer AND sk % 11 = 0 AS seller_bad
  FROM s2
),
d AS (
  SELECT *, CASE WHEN price > 0 AND used_price > 0
                 THEN {rnd2} ELSE 0.0 END AS discount,
         NOT failed AND price IS NOT NULL AND used_price IS NOT NULL AS ok_wide
  FROM s
),
p AS (SELECT *, ok_wide AND NOT seller_bad AS ok FROM d)
""".replace("{rnd2}", rnd2("(price - used_price) / price * 100.0")).replace("{DEFAULT_SELLER}", DEFAULT_SELLER)

_REVIEWS = f"""
rv AS (
  SELECT doc.doc_id // 3 AS o, doc.doc_id,
         (row_number() OVER (PARTITION BY doc.doc_id // 3 ORDER BY doc.doc_id) - 1)::INTEGER AS pos,
         'Review ' || doc.doc_id AS review_title,
         CASE WHEN lab.quality IS NULL THEN '3.0' ELSE CAST(lab.quality * 4 + 1 AS VARCHAR) || '.0' END
           || ' out of 5 stars' AS review_rating,
         {ustrip('doc.text')} AS review_text,
         CASE WHEN doc.doc_id % 11 = 0 THEN 'NA' ELSE doc.source END AS review_author,
         'Reviewed in ' || doc.lang AS review_date,
         coalesce(lab.quality, 0) = 1 AS positive
  FROM documents doc LEFT JOIN labels lab ON doc.doc_id = lab.doc_id
)
"""

PRODUCT_DETAILS = f"""
WITH {_SCRAPES}
SELECT request_id, title, price, reviews_count, availability, description, discount, used_price, used_condition
FROM p WHERE ok
"""

PRODUCTS_WIDE = f"""
WITH {_SCRAPES}
SELECT request_id, title, price, reviews_count, availability, description,
  '{{' || array_to_string(list_transform(list_filter(range(1, ln + 1), lambda i: i <> 2),
        lambda i: '"https://img.example.com/' || pk || '/' || i || '.jpg"'), ',') || '}}' AS images,
  seller, used_price, used_condition_wide AS used_condition, discount
FROM p WHERE ok_wide
"""

PRODUCT_IMAGES = f"""
WITH {_SCRAPES},
im AS (SELECT request_id, title, pk, unnest(list_filter(range(1, ln + 1), lambda i: i <> 2)) AS i FROM p WHERE ok)
SELECT request_id, title AS product_title,
       (row_number() OVER (PARTITION BY request_id ORDER BY i) - 1)::INTEGER AS pos,
       'https://img.example.com/' || pk || '/' || i || '.jpg' AS image_url
FROM im
"""

REVIEWS_ROWS = f"""
WITH {_SCRAPES}, {_REVIEWS}
SELECT p.request_id, p.title AS product_title, rv.pos, rv.review_title, rv.review_rating, rv.review_text,
       rv.review_author, rv.review_date
FROM p JOIN rv ON p.o = rv.o AND p.is_first
WHERE p.ok
"""

OFFERS_ROWS = f"""
WITH {_SCRAPES}
SELECT request_id, title AS product_title, 0 AS pos,
       CASE WHEN sk % 7 = 0 THEN 'NA' ELSE s_name END AS seller_name,
       CAST(offer // 100 AS DOUBLE) AS price
FROM p WHERE ok AND has_offer
"""

OFFERS_WIDE = f"""
WITH {_SCRAPES}
SELECT request_id, title AS product_title, 0 AS pos,
       CASE WHEN sk % 7 = 0 THEN 'Unknown' ELSE s_name END AS name,
       '₹' || printf('%.2f', offer / 100.0) AS price,
       CASE WHEN sk % 4 = 0 THEN 'NA' WHEN l_returnflag = 'R' THEN 'Used - Good' ELSE 'New' END AS condition,
       CASE WHEN sk % 3 = 0 THEN 'Free' ELSE 'Delivery by ' || strftime(l_shipdate, '%Y-%m-%d') || ' fast' END
         AS shipping
FROM p WHERE ok_wide AND has_offer
"""

PRODUCT_REJECTS = f"""
WITH {_SCRAPES}
SELECT request_id, 'page' AS stage, code, detail FROM (
  SELECT request_id, 'PAGE_HTTP_FAILED' AS code, NULL AS detail FROM p WHERE failed
  UNION ALL
  SELECT request_id, 'BAD_PRICE',
         CASE WHEN pv = 1 THEN '$' || format('{{:,.2f}}', unit / 100.0) || ' - $' || format('{{:,.2f}}', unit * 2 / 100.0)
              ELSE 'see options' END
  FROM p WHERE NOT failed AND price IS NULL
  UNION ALL
  SELECT request_id, 'BAD_USED_PRICE', 'see options' FROM p WHERE NOT failed AND used_price IS NULL
  UNION ALL
  SELECT request_id, 'BAD_SELLER_PRICE', '1' FROM p WHERE NOT failed AND seller_bad
  UNION ALL
  SELECT request_id, 'AVAILABILITY_NO_SPAN', NULL FROM p WHERE NOT failed AND o % 9 = 1
)
"""

REQUEST_STATUS = f"""
WITH {_SCRAPES}
SELECT status, count(*) AS n FROM (
  SELECT CASE WHEN failed OR scrape_seq % 61 = 0 THEN 'PAGE_HTTP_FAILED' WHEN price IS NULL THEN 'BAD_PRICE'
              WHEN used_price IS NULL THEN 'BAD_USED_PRICE' WHEN seller_bad THEN 'BAD_SELLER_PRICE'
              ELSE 'ok' END AS status
  FROM p)
GROUP BY status
"""

_REQUEST_HISTORY = f"""
he AS ({_HIST_EVENTS}),
hp AS (
  SELECT internal_pid, user_id, chunk, count(*) FILTER (WHERE event_id % 10 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0) AS good,
         count(*) FILTER (WHERE user_id % 2 = 0 AND event_id % 10 <> 0 AND (event_id % 17 = 0 OR event_id % 19 = 0)) AS bad,
         CASE WHEN (user_id + chunk) % 13 = 0 THEN 'HISTORY_HTTP_FAILED' WHEN (user_id + chunk) % 11 = 0 THEN 'HISTORY_SCRIPT_MISSING'
              WHEN (user_id + chunk) % 7 = 0 THEN 'HISTORY_PAYLOAD_MISSING' END AS page_code
  FROM he GROUP BY internal_pid, user_id, chunk
),
hl AS (SELECT p_partkey, max_by(internal_pid, chunk) AS internal_pid FROM part JOIN hp ON p_partkey % 200 = user_id GROUP BY p_partkey),
h AS (
  SELECT request_id, CASE WHEN pk % 23 <> 0 THEN hl.internal_pid END AS internal_pid,
         CASE WHEN hl.internal_pid IS NULL OR pk % 23 = 0 OR page_code IS NOT NULL THEN 0 ELSE good END AS series_length,
         CASE WHEN hl.internal_pid IS NULL THEN 'LOOKUP_HTTP_FAILED' WHEN pk % 23 = 0 THEN 'LOOKUP_KEY_MISSING' ELSE page_code END AS history_code,
         hl.internal_pid IS NULL OR pk % 23 = 0 OR page_code IS NOT NULL OR bad > 0 AS history_failed
  FROM s0 LEFT JOIN hl ON hl.p_partkey = pk LEFT JOIN hp USING (internal_pid)
)
"""

PRODUCT_REPORT = f"""
WITH {_SCRAPES}, {_REVIEWS}, {_REQUEST_HISTORY},
g AS (
  SELECT p.request_id, count(*) AS n, count(*) FILTER (WHERE rv.positive) AS positive,
         string_agg(concat_ws(' | ', review_title, review_rating, review_author, review_date, review_text), chr(10) ORDER BY pos) AS reviews_text
  FROM p JOIN rv ON p.o = rv.o AND p.is_first WHERE p.ok GROUP BY p.request_id
),
r AS (
  SELECT p.*, coalesce(g.n, 0) AS n, coalesce(g.positive, 0) AS positive,
         g.reviews_text, CASE WHEN coalesce(g.n, 0) > 0 THEN {rnd2('(g.n - g.positive) / g.n * 100.0')} ELSE 0.0 END AS return_rate
  FROM p LEFT JOIN g ON p.request_id = g.request_id WHERE p.ok
)
SELECT request_id, title, printf('%.2f', price) AS price_text, printf('%.2f', used_price) AS used_price_text,
       used_condition,
       CASE WHEN price > 0 AND used_price > 0 THEN CAST(discount AS VARCHAR) || '%' ELSE '0%' END AS discount_text,
       n AS n_reviews, positive AS n_positive, return_rate,
       printf('%.2f', return_rate) || '%' AS return_rate_text, return_rate / 100.0 AS progress,
       reviews_count, availability, description, seller, coalesce(reviews_text, '') AS reviews_text,
       CASE WHEN has_offer THEN concat_ws(' | ', CASE WHEN sk % 7 = 0 THEN 'NA' ELSE s_name END, printf('%.2f', CAST(offer // 100 AS DOUBLE)))
            ELSE '' END AS offers_text,
       CASE WHEN has_offer THEN 1 ELSE 0 END AS n_offers, CAST(ln - (CASE WHEN ln >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS n_images,
       title <> 'NA' AND nth > 1 AS seen_before, CASE WHEN title <> 'NA' THEN before END AS previous_price, NULL AS previous_code,
       series_length, history_code
FROM (SELECT *, row_number() OVER t AS nth, lag(price) OVER t AS before FROM r WINDOW t AS (PARTITION BY title ORDER BY scrape_seq, request_id)) JOIN h USING (request_id)
"""

PRODUCT_DETAILS_STRICT = f"""
WITH {_SCRAPES}, {_REQUEST_HISTORY}
SELECT request_id, title, price, reviews_count, availability, description, discount, used_price, used_condition
FROM p JOIN h USING (request_id) WHERE ok AND NOT history_failed
"""

REQUEST_HISTORY = f"WITH {_SCRAPES}, {_REQUEST_HISTORY} SELECT * FROM h"

CURRENT_PAGE = f"""
WITH q AS (SELECT *, l_orderkey * 8 + l_linenumber AS seq FROM lineitem),
pg AS (SELECT DISTINCT l_partkey, seq AS page_seq FROM q WHERE seq % 5 <> 0),
rq AS (
  SELECT printf('%d-%d-%d-%d', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS request_id, l_partkey,
         CASE WHEN seq % 97 <> 0 THEN '{SHOP}dp/B' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') END AS url,
         CASE WHEN seq % 31 = 0 THEN 0 ELSE seq + l_suppkey * 7 % 2000 END AS scrape_seq
  FROM q
)
SELECT request_id, url, scrape_seq, CASE WHEN url IS NOT NULL THEN page_seq END AS page_seq
FROM rq ASOF LEFT JOIN pg ON rq.l_partkey = pg.l_partkey AND rq.scrape_seq >= pg.page_seq
"""

PARENT_CHILDREN = """
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'hot item' ELSE concat_ws(' ', p_name, p_brand) END AS title FROM part),
o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT a.p_partkey, a.title, o.l_partkey, o.l_suppkey FROM t a JOIN t b ON a.title = b.title JOIN o ON o.l_partkey = b.p_partkey
"""

ORACLES.update({
    "product_details": PRODUCT_DETAILS,
    "products_wide": PRODUCTS_WIDE,
    "product_images": PRODUCT_IMAGES,
    "reviews_rows": REVIEWS_ROWS,
    "offers_rows": OFFERS_ROWS,
    "offers_wide": OFFERS_WIDE,
    "product_rejects": PRODUCT_REJECTS,
    "request_status": REQUEST_STATUS,
    "product_report": PRODUCT_REPORT,
})


# ------------------------------------------------------------ V1 lookup chain
HISTORY_PREFIX = "https://history.example.com/price-history-"
_SERIES = """
series AS (
  SELECT DISTINCT user_id, (event_id // 1000000 * 1000 + (year(ts) - 2000) * 12 + month(ts)) AS chunk FROM events
),
rq AS (
  SELECT printf('P%d-%d', user_id, chunk) AS request_id, user_id, chunk,
         'B' || lpad(CAST(chunk // 1000 * 10000000 + user_id * 1000 + chunk % 1000 AS VARCHAR), 9, '0') AS k,
         (user_id + chunk * 3) % 17 = 0 AS invalid, (user_id * 7 + chunk) AS lk
  FROM series
),
res AS (
  SELECT request_id, user_id, chunk,
    CASE WHEN invalid THEN '{SHOP}gp/product/' || k ELSE '{SHOP}item/dp/' || k || '?th=1' END AS url,
    CASE WHEN invalid THEN NULL ELSE k END AS asin,
    CASE WHEN invalid THEN 'INVALID_URL'
         WHEN lk % 41 = 0 THEN 'LOOKUP_HTTP_FAILED'
         WHEN lk % 19 = 0 THEN 'LOOKUP_HTTP_FAILED'
         WHEN lk % 23 = 0 THEN 'LOOKUP_KEY_MISSING'
         WHEN lk % 29 = 0 THEN 'LOOKUP_BAD_JSON'
         WHEN lk % 31 = 0 THEN 'LOOKUP_NULL'
         WHEN lk % 37 = 0 THEN 'LOOKUP_SHAPE' END AS code
  FROM rq
)
""".replace("{SHOP}", SHOP)

LOOKUP_JOIN = f"""
WITH {_SERIES}
SELECT request_id, url, asin, '{LOOKUP}' || asin AS lookup_url,
       CASE WHEN code IS NULL THEN request_id END AS internal_pid,
       CASE WHEN code IS NULL THEN '{HISTORY_PREFIX}' || request_id END AS history_url, code
FROM res
"""

PRICE_HISTORY = f"""
WITH {_SERIES}, e AS ({_HIST_EVENTS})
SELECT res.request_id, res.asin, e.internal_pid, e.pos, date_trunc('second', e.ts) AS ts, e.value AS price
FROM res JOIN e ON res.request_id = e.internal_pid
WHERE res.code IS NULL AND {_PAGE_OK.replace('user_id', 'e.user_id').replace('chunk', 'e.chunk')}
  AND e.event_id % 10 <> 0 AND e.event_id % 17 <> 0 AND e.event_id % 19 <> 0
"""

ORACLES.update({"lookup_join": LOOKUP_JOIN, "price_history": PRICE_HISTORY})


# ------------------------------------------------------------- stored products
_STORED = """
st AS (
  SELECT concat_ws(' ', p_name, p_brand) AS title, p_partkey AS seq,
         CASE WHEN p_partkey % 10 = 0 THEN 'abc' ELSE printf('%.2f', p_retailprice) END AS price
  FROM part WHERE p_partkey % 2 = 0
),
nb AS (
  SELECT p_partkey AS request_id, concat_ws(' ', p_name, p_brand) AS title, p_partkey AS seq,
         p_retailprice AS price
  FROM part WHERE p_partkey % 2 = 1
),
u AS (
  SELECT NULL AS request_id, title, seq, 0 AS new, price AS txt, NULL AS num FROM st
  UNION ALL SELECT request_id, title, seq, 1, NULL, price FROM nb
),
r AS (
  SELECT request_id, title, new, row_number() OVER w > 1 AS seen, lag(new) OVER w AS prev_new,
         TRY_CAST(trim(lag(txt) OVER w) AS DOUBLE) AS stored_num, lag(num) OVER w AS batch_num
  FROM u WINDOW w AS (PARTITION BY title ORDER BY seq, new)
),
pp AS (
  SELECT request_id, title, seen, CASE WHEN prev_new = 0 THEN stored_num ELSE batch_num END AS previous_price FROM r WHERE new = 1
)
"""

PRODUCT_EXISTS = f"""
WITH {_STORED}
SELECT request_id, title, seen AS "exists" FROM pp
"""

STORED_PREVIOUS_PRICE = f"""
WITH {_STORED}
SELECT request_id, title, previous_price,
       CASE WHEN seen AND previous_price IS NULL THEN 'PREVIOUS_PRICE_DATA_ERROR' END AS code
FROM pp
"""

TEXT_NORMALIZE = f"""
SELECT doc_id, coalesce(replace({ustrip('text')}, ',', ''), 'NA') AS text_norm FROM documents
"""

_COND = """
c AS (
  SELECT p_partkey AS id,
    CASE p_partkey % 4 WHEN 0 THEN 'Used - ' || p_name
                       WHEN 1 THEN 'Used - ' || replace(p_name, ' ', '-')
                       WHEN 2 THEN p_type
                       ELSE '  Used -' || p_brand || '  ' END AS condition_text
  FROM part
)
"""

CONDITION_SPLIT = f"""
WITH {_COND}, s AS (
  SELECT id, condition_text, {ustrip('condition_text')} AS t,
         {ustrip("string_split(" + ustrip('condition_text') + ", '-')[2]")} AS part1,
         len(string_split({ustrip('condition_text')}, '-')) AS n
  FROM c
)
SELECT id, condition_text,
  CASE WHEN t = 'NA' OR n < 2 THEN 'NA' ELSE part1 END AS used_condition,
  CASE WHEN t = 'NA' THEN 'NA' WHEN n < 2 THEN t ELSE part1 END AS used_condition_wide
FROM s
"""

ORACLES.update({
    "product_exists": PRODUCT_EXISTS,
    "stored_previous_price": STORED_PREVIOUS_PRICE,
    "text_normalize": TEXT_NORMALIZE,
    "condition_split": CONDITION_SPLIT,
})

ORACLES.update({"stream_intake": PRODUCT_DETAILS})

HISTORY_SERIES = f"""
SELECT internal_pid, CAST(count(*) AS INTEGER) AS n_points,
       string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S'), '|' ORDER BY pos) AS dates_text,
       string_agg(printf('%.2f', price), '|' ORDER BY pos) AS prices_text
FROM ({HISTORY_DECODE})
GROUP BY internal_pid
"""
ORACLES.update({"history_series": HISTORY_SERIES})

_LABELLED = """
w AS (
  SELECT doc_id, unnest(list_concat([''], list_distinct(list_filter(
    regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')))) AS word
  FROM documents
),
y AS (SELECT doc_id, quality AS y FROM labels WHERE quality IN (0, 1) AND doc_id % 5 <> 0 AND doc_id IN (SELECT doc_id FROM documents)),
t AS (SELECT count(*) FILTER (WHERE y = 1) AS t1, count(*) FILTER (WHERE y = 0) AS t0 FROM y),
o AS (
  SELECT word, CASE WHEN word = '' THEN ln((t1 + 1.0::DOUBLE) / (t0 + 1.0::DOUBLE))
                    ELSE ln((n1 + share) / (t1 + 1.0::DOUBLE)) - ln((n0 + 1.0::DOUBLE - share) / (t0 + 1.0::DOUBLE)) END AS odds
  FROM (SELECT word, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM w JOIN y USING (doc_id) GROUP BY word),
       (SELECT *, (t1 + 1.0::DOUBLE) / (t1 + t0 + 2.0::DOUBLE) AS share FROM t)
),
scored AS (
  SELECT doc_id, CASE WHEN sum(CAST(round(coalesce(odds, 0) * 1e6) AS BIGINT)) > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label
  FROM w LEFT JOIN o USING (word) GROUP BY doc_id
)
"""
REVIEW_SCORE = f"WITH {_LABELLED} SELECT doc_id, label FROM scored"
REVIEW_RETURN_RATE = f"""
WITH {_LABELLED}, g AS (
  SELECT CAST(doc_id // 3 AS VARCHAR) || '-1' AS record_id, count(*) AS n, count(*) FILTER (WHERE label = 'POSITIVE') AS positive
  FROM scored GROUP BY 1
)
SELECT record_id, n, positive, {rnd2('(n - positive) / n * 100.0')} AS return_rate FROM g
"""
JSON_PATH = """
SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
"""
ORACLES.update({"review_score": REVIEW_SCORE, "review_return_rate": REVIEW_RETURN_RATE, "json_path": JSON_PATH})
ORACLES.update({"product_details_strict": PRODUCT_DETAILS_STRICT, "request_history": REQUEST_HISTORY, "current_page": CURRENT_PAGE, "parent_children": PARENT_CHILDREN})

LATEST_STORED_PRICE = f"""
WITH {_STORED.replace("SELECT p_partkey AS request_id, concat_ws(' ', p_name, p_brand) AS title, p_partkey AS seq,",
                      "SELECT p_partkey AS request_id, concat_ws(' ', p_name, p_brand) AS title, p_partkey + 1000000000 AS seq,")}
SELECT request_id, title, seen AS "exists", previous_price, CASE WHEN seen AND previous_price IS NULL THEN 'PREVIOUS_PRICE_DATA_ERROR' END AS code FROM pp
"""
ORACLES.update({"latest_stored_price": LATEST_STORED_PRICE})

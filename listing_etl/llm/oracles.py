"""DuckDB SQL of the queries that SQL can express, over the raw tables.

Sharding, approximate search, pieces, fingerprints and the two trained models have none:
``tests/llm`` holds them against brute force, the library, or held-out labels.
"""

from __future__ import annotations

from listing_etl.llm.decontaminate import CONTAINMENT, WORDS
from listing_etl.llm.url_reputation import BLOCK_RATE, LONG_SUFFIXES, STRENGTH, Z


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _shingles(table: str, key: str) -> str:
    """(key, s) rows of the distinct word shingles of a table."""
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {key}, {_words('text')} AS w FROM {table} WHERE {key} IS NOT NULL)"""


DECONTAMINATE = f"""
WITH d AS ({_shingles('documents', 'doc_id')}),
b AS ({_shingles('benchmark', 'item_id')}),
short AS (SELECT DISTINCT len(w) AS r FROM (SELECT {_words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) BETWEEN 1 AND {WORDS - 1}),
every AS (
  SELECT doc_id, s FROM d
  UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - r + 2), lambda i: array_to_string(w[i:i + r - 1], ' '))) AS s
  FROM (SELECT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL), short WHERE len(w) >= r
),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles) AS containment
FROM b JOIN every USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= {CONTAINMENT} * any_value(item_shingles) - 1e-9
"""

_NIBBLE = "(strpos('0123456789abcdef', substr(h, {k}, 1)) - 1)"
_FIVE = " + ".join(f"{_NIBBLE.format(k=f'5 * i // 4 + {j}')} * {16 ** (3 - j)}" for j in (1, 2, 3))
#: Upper-case base32 of a hexadecimal SHA-1 in column h; the digits behind the end count as zero.
_BASE32 = ("array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
           f"1 + CAST((({_FIVE}) >> (7 - 5 * i % 4)) & 31 AS INTEGER), 1)), '')")

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) || '00' AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to, 'ok' AS status
FROM r
"""

#: The test pages mark their article and hold only p, b, br and h1 in it.
MAIN_TEXT = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages
),
b AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda t:
    trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
      '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda t: t <> '') AS l
  FROM a
)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, CAST(length(array_to_string(l, chr(10))) AS BIGINT) AS n_chars FROM b
"""


def url_reputation(rules) -> str:
    long_ = ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    low, high = STRENGTH

    def level(name: str, groups: str, above: str, on: str) -> str:
        """Posterior of a level under the prior means (column rate) of the one above."""
        share = ("(sum((bad - n * rate) ** 2) - sum(rate * (1 - rate) * n)) / sum(n * (n - 1.0) * rate * (1 - rate))")
        return f"""
{name}_p AS (SELECT g.*, pa / (pa + pb) AS rate FROM ({groups}) g JOIN (SELECT * FROM {above}) u ON {on}),
{name}_s AS (SELECT least(greatest(coalesce(CASE WHEN sum(n * (n - 1.0) * rate * (1 - rate)) > 0 AND {share} > 0 THEN 1 / ({share}) - 1 END, {high}), {low}), {high}) AS s FROM {name}_p),
{name} AS (SELECT {name}_p.*, s * rate + bad AS pa, s * (1 - rate) + n - bad AS pb FROM {name}_p, {name}_s)"""

    cases = sorted(rules, key=lambda r: (-len(r[0]), -len(r[1])))
    fit = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    pick = lambda value: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN '{value(h, p, v)}'" for h, p, v in cases) + " END"
    parts = """SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)"""
    bound = f"a / (a + b) - {Z} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))"
    return f"""
WITH p AS ({parts}),
names AS (
  SELECT host, CASE WHEN is_ip THEN array_to_string(l, '.') WHEN is_long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN is_ip THEN array_to_string(l, '.') WHEN is_long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
  FROM (SELECT host, l, regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}(:[0-9]+)?$') AS is_ip, len(l) >= 3 AND array_to_string(l[-2:], '.') IN ({long_}) AS is_long
        FROM (SELECT DISTINCT host, string_split(regexp_extract(host, '^([^:]*)', 1), '.') AS l FROM p))
),
outcome AS (
  SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
),
g AS (
  SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad) AS bad
  FROM p JOIN outcome ON TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.html)?/?$', 1) AS BIGINT) = doc_id JOIN names USING (host)
  GROUP BY host, domain, suffix
),
whole AS (SELECT coalesce(sum(bad), 0) + 0.5 AS pa, coalesce(sum(n) - sum(bad), 0) + 0.5 AS pb FROM g),
{level('suffixes', 'SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM g GROUP BY suffix', 'whole', 'true')},
{level('domains', 'SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM g GROUP BY domain, suffix', 'suffixes', 'g.suffix = u.suffix')},
{level('hosts', 'SELECT host, domain, n, bad FROM g', 'domains', 'g.domain = u.domain')},
post AS (
  SELECT 'host' AS lv, host AS nm, pa AS a, pb AS b FROM hosts UNION ALL SELECT 'domain', domain, pa, pb FROM domains
  UNION ALL SELECT 'suffix', suffix, pa, pb FROM suffixes UNION ALL SELECT 'all', '', pa, pb FROM whole WHERE pa + pb > 1
),
bounds AS (SELECT lv, nm, {bound} AS bound FROM post)
SELECT page_id, host, path, {pick(lambda h, p, v: h + p)} AS rule,
       coalesce({pick(lambda h, p, v: v)}, CASE WHEN coalesce(h.bound, d.bound, s.bound, w.bound) > {BLOCK_RATE} THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(h.bound, d.bound, s.bound, w.bound), 6) AS bound
FROM p JOIN names USING (host) LEFT JOIN bounds h ON h.lv = 'host' AND h.nm = host LEFT JOIN bounds d ON d.lv = 'domain' AND d.nm = domain
LEFT JOIN bounds s ON s.lv = 'suffix' AND s.nm = suffix LEFT JOIN bounds w ON w.lv = 'all'
"""


_TERMS = ("unnest(regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))")

LEXICAL = f"""
WITH w AS (SELECT r, doc_id, {_TERMS.format(text='text')} AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
d AS (SELECT r, doc_id, count(*) AS n FROM w GROUP BY r, doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, {_TERMS.format(text='text')} AS term FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT q.item_id, d.doc_id, d.r, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT)
          * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total))))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (r), s GROUP BY q.item_id, d.doc_id, d.r),
best AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM best WHERE rank <= 50
"""

#: Whether 2 divides the CRC-32 of the decimal id, bit by bit; null ids: no.
_CRC32_EVEN = """coalesce(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) & 1 = 1, false)"""


def merkle(levels: int = 12, upper: int = 6) -> str:
    """Levels unrolled: up to 3 ** ``levels`` rows of a source, 3 ** ``upper`` sources."""
    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"

    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END"
    leaf = f"sha256({' || '.join(field(c) for c in fields)})"
    found = f"sha256({' || '.join([*(field(c) for c in fields[:4]), field(f'({tampered})')])})"

    def tree(name: str, n: int) -> str:
        up = ", ".join(f"""
{name}{i + 1} AS (SELECT tree, p // 3 AS p, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h, (n + 2) // 3 AS n FROM {name}{i} GROUP BY tree, p // 3, n)""" for i in range(n))
        run = "string_agg(h, '') OVER (PARTITION BY tree, p // 3 ORDER BY p ROWS BETWEEN"
        around = ", ".join(f"""
s{name}{i} AS (SELECT tree, p, n, coalesce({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{i})""" for i in range(n))
        return f"{up}, {around}"

    steps = [("a", i, "f.tree", f"f.p // {3 ** i}") for i in range(levels)] + [("u", i, "''", f"f.rank // {3 ** i}") for i in range(upper)]
    path = ", ".join(f"""
f{k + 1} AS (SELECT f.* EXCLUDE (fold, proof), CASE WHEN s.n > 1 THEN sha256(s.l || f.fold || s.r) ELSE f.fold END AS fold, f.proof || s.l || s.r AS proof
  FROM f{k} f JOIN s{name}{i} s ON s.tree = {tree_} AND s.p = {place})""" for k, (name, i, tree_, place) in enumerate(steps))
    return f"""
WITH d AS (SELECT *, {_CRC32_EVEN} AS even FROM documents),
leaves AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {leaf} AS leaf, {found} AS found FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
a0 AS (SELECT tree, p, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM a), {tree('a', levels)},
u AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank FROM a{levels}),
u0 AS (SELECT '' AS tree, rank AS p, subroot AS h, count(*) OVER () AS n FROM u), {tree('u', upper)},
f0 AS (SELECT doc_id, leaf, tree, p, subroot, rank, found AS fold, '' AS proof FROM a JOIN u ON u.source = a.tree), {path}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM f{len(steps)}, u{upper}
"""

"""Column -> Column scalar rules (KEY*, SCL*).

Everything here is a built-in Spark expression, so it stays inside whole-stage
codegen and needs no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# The same set as a regex character class (Java and RE2 syntax).
WS_CLASS = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")

# Product key pattern and default URL prefixes (parameters).
ASIN_PATTERN = r"/dp/([A-Z0-9]{10})"
LOOKUP_PREFIX = "https://lookup.example.com/api/productData?pid="
HISTORY_PREFIX = "https://history.example.com/price-history-"

# Missing-value sentinels of the product record.
NA = "NA"
DEFAULT_SELLER = "Marketplace"
V2_DEFAULT_OFFER_NAME = "Unknown"
V2_DEFAULT_SHIPPING = "Free"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- text

def ustrip(x) -> Column:
    """Python ``str.strip()``: Unicode whitespace off both ends (``trim`` does spaces only)."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def normalize_text(x) -> Column:
    """SCL1: strip, then delete every comma."""
    return F.replace(ustrip(x), F.lit(","), F.lit(""))


def with_default(x, default: str = NA) -> Column:
    """SCL2: absent element (null) -> sentinel; empty text stays ''."""
    return F.coalesce(_c(x), F.lit(default))


# ------------------------------------------------------------------------ keys/urls

def asin(url) -> Column:
    """KEY1: first ``/dp/`` + 10 upper-case letters/digits; null when absent (KEY2)."""
    return F.nullif(F.regexp_extract(_c(url), ASIN_PATTERN, 1), F.lit(""))


def lookup_url(key, prefix: str = LOOKUP_PREFIX) -> Column:
    """KEY3."""
    return F.concat(F.lit(prefix), _c(key))


def history_url(pid, prefix: str = HISTORY_PREFIX) -> Column:
    """KEY5: null pid gives null (the row goes to rejects instead of fetching '...-None')."""
    return F.concat(F.lit(prefix), _c(pid))


def lookup_pid(body) -> Column:
    """KEY4: ``data.internalPid`` as text (numbers keep their JSON spelling)."""
    return F.get_json_object(_c(body), "$.data.internalPid")


def lookup_code(body, status=None, parsed=None) -> Column:
    """Reject code of one lookup response, null when the pid is usable.

    ``parsed``: a column with the body as a variant, if there is one.

    Order follows the reference's handlers: HTTP failure, undecodable body,
    wrong shape (indexing a non-object), missing key, JSON null.
    """
    b = _c(body)
    v = F.try_parse_json(b) if parsed is None else _c(parsed)
    top = F.schema_of_variant(v)
    d = F.variant_get(v, "$.data", "variant")
    p = F.variant_get(v, "$.data.internalPid", "variant")
    failed = b.isNull()
    if status is not None:
        failed = failed | (_c(status) >= 400)
    return (F.when(failed, F.lit("LOOKUP_HTTP_FAILED"))
            .when(v.isNull(), F.lit("LOOKUP_BAD_JSON"))
            .when(~top.startswith("OBJECT"), F.lit("LOOKUP_SHAPE"))
            .when(d.isNull(), F.lit("LOOKUP_KEY_MISSING"))
            .when(~F.schema_of_variant(d).startswith("OBJECT"), F.lit("LOOKUP_SHAPE"))
            .when(p.isNull(), F.lit("LOOKUP_KEY_MISSING"))
            .when(F.is_variant_null(p), F.lit("LOOKUP_NULL")))


# ---------------------------------------------------------------------------- money

def money_digits(x) -> Column:
    """Keep digits and dots only (ASCII digits; the reference's ``\\d`` is Unicode)."""
    return F.regexp_replace(_c(x), r"[^0-9.]", "")


def parse_money(x) -> Column:
    """SCL3: absent or 'NA' -> 0.0; otherwise digits-and-dots as a double, null when
    Python's ``float`` would raise (caller maps null to a reject code)."""
    t = ustrip(x)
    return (F.when(t.isNull() | (t == F.lit(NA)), F.lit(0.0))
            .otherwise(money_digits(t).try_cast("double")))


def used_condition(x, variant: str = "details") -> Column:
    """SCL4: text between the first and second '-', stripped.

    No hyphen: 'NA' in the details variant (V1), the text unchanged in the wide
    variant (V2). Absent element: 'NA' in both.
    """
    t = ustrip(x)
    part = ustrip(F.get(F.split(t, "-", -1), 1))
    fallback = F.lit(NA) if variant == "details" else t
    return (F.when(t.isNull() | (t == F.lit(NA)), F.lit(NA))
            .otherwise(F.coalesce(part, fallback)))


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitting constant


def py_round(x, ndigits: int = 2) -> Column:
    """Python's ``round(x, ndigits)``: half-even on the *exact* binary value.

    Spark's ``round``/``bround`` round the shortest decimal text of the double,
    which differs from Python on about 0.2% of doubles (2.675 -> 2.68, Python 2.67).
    Here ``x * 10**n`` is formed with its exact rounding error (Dekker product),
    so the tie test is exact. Plain double arithmetic: stays in codegen.
    """
    x = _c(x).cast("double")
    s = F.lit(float(10 ** ndigits))
    p = x * s
    c = x * F.lit(_SPLIT)
    hi = c - (c - x)
    lo = x - hi
    err = (hi * s - p) + lo * s          # x*s == p + err exactly
    f = F.floor(p).cast("double")
    d = ((p - f) - F.lit(0.5)) + err     # sign of (exact fraction - 1/2)
    even = F.pmod(f, F.lit(2.0)) == 0
    n = F.when(d > 0, f + 1).when(d < 0, f).when(even, f).otherwise(f + 1)
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(1e15)), x).otherwise(n / s)


def round2(x) -> Column:
    """SCL6: two decimals exactly as Python's ``round(x, 2)``."""
    return py_round(x, 2)


def discount(price, used) -> Column:
    """SCL5: percent off when both prices are positive, else 0."""
    p, u = _c(price), _c(used)
    return (F.when((p > 0) & (u > 0), round2((p - u) / p * F.lit(100.0)))
            .otherwise(F.lit(0.0)))


def array_literal(images) -> Column:
    """SCL7: ``{"a","b"}`` text, no escaping; ``{}`` when empty."""
    quoted = F.transform(_c(images), lambda s: F.concat(F.lit('"'), s, F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def reparse_price(x) -> Column:
    """SCL8: stored price as a number, null where it is not numeric."""
    return ustrip(_c(x).cast("string")).try_cast("double")


def fmt2(x) -> Column:
    """SCL9: ``'%.2f'`` text."""
    return F.format_string("%.2f", _c(x))


def percent_text(x) -> Column:
    """SCL9: value followed by '%'."""
    return F.concat(_c(x).cast("string"), F.lit("%"))


def progress_fraction(rate) -> Column:
    """SCL10."""
    return _c(rate) / F.lit(100.0)

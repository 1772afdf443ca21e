"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests finds.

Patterns give the base spans (``assign``, ``access``, ``hex``). Every other token of at least
``MIN_LENGTH`` characters of the base64 alphabets is a candidate (``random``). Its encoding is
inferred (the first of ``ENCODINGS`` that has all its characters; decimal numbers are no candidates), and three tests ask whether it
could be a uniform draw from that alphabet: chi-squared over cells of the alphabet (the length
decides how fine they are), runs above and below the middle of the alphabet, and the lag-1 serial
correlation of the symbol values. Fisher's method combines them: secrets have a combined p-value
anywhere in 0..1, ordinary text one near 0, the nearer the longer the token.

How near depends on the length, so the decision is calibrated by the corpus: all other ASCII
letters and digits of each text are cut into ordinary strings of the lengths of ``BANDS``, joined
in the styles in which long tokens are written, and go through the same battery. A candidate's
p-value against "ordinary text" is the share of ordinary strings of its length band that have its
encoding and look as random or more so, times the number of encodings (Bonferroni). The
Benjamini-Hochberg procedure over all candidates of the corpus keeps the false discovery rate at
``rate``. In both steps only counts by (band, encoding, bin of p) are needed: 1,920 at most,
summed by Spark. Candidates that overlap a base span are no discoveries of their own.

One pass over the texts finds spans, candidates and counts; what is staged holds no text.

Edge cases: null and empty texts have no spans; a candidate of a corpus without ordinary strings
of its length is not reported (nothing to compare with); repeated rows are scanned alike and count
each; whole texts are scanned, whatever their length; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import prepare, slices, staged

# The kinds of spans in their order, patterns and shortest lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

MIN_LENGTH = 16
#: Shortest lengths of the length bands; ordinary strings have exactly these lengths.
BANDS = (16, 20, 24, 32, 40, 48, 64, 96)
#: Bins of the combined p-value: four a decade.
BINS = 40
RATE = 0.05
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets as classes of symbols, the tightest first.
ENCODINGS = ((_DIGITS, "abcdef"), (_DIGITS, "ABCDEF"), ("234567", _UPPER), (_DIGITS, _LOWER), (_DIGITS, _UPPER),
             (_DIGITS, _UPPER, _LOWER), (_DIGITS, _UPPER, _LOWER, "+/"), (_DIGITS, _UPPER, _LOWER, "-_"))

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]{%d,}" % (ACCESS_MIN - 4))     # runs are maximal: the same as + and a test
_hex = re.compile(r"[0-9a-f]{%d,}" % HEX_MIN)
_token = re.compile(r"([A-Za-z0-9+/_-]{%d,})={0,2}" % MIN_LENGTH)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in code points, kinds by number."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, token without its padding) of the long tokens that overlap no base span."""
    out, i, last = [], 0, 0
    for m in _token.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            last = max(last, base[i][2])
            i += 1
        if last <= m.start():
            out.append((m.start(), m.end(), m[1].encode()))
    return out


# ------------------------------------------------------------------ the battery

def _value_table() -> np.ndarray:
    table = np.full((len(ENCODINGS), 256), -1, dtype=np.int16)
    for e, classes in enumerate(ENCODINGS):
        for v, c in enumerate("".join(classes)):
            table[e, ord(c)] = v
    return table


_VALUE = _value_table()
_SIZE = [len("".join(c)) for c in ENCODINGS]


def encodings(rows: np.ndarray) -> np.ndarray:
    """The first encoding that has all bytes of each row; -1 if none has, or if all are digits
    (decimal numbers name cards, phones and records; they are no encoded key)."""
    fits = np.stack([(_VALUE[e][rows] >= 0).all(axis=1) for e in range(len(ENCODINGS))], axis=1)
    number = ((rows >= 48) & (rows <= 57)).all(axis=1)
    return np.where(fits.any(axis=1) & ~number, fits.argmax(axis=1), -1)


def cells(encoding: int, n: int) -> np.ndarray:
    """Cell of each symbol value for strings of length ``n``: classes of symbols, cut into parts
    in which about four or more are expected; a class that expects fewer than two joins the one before."""
    out, k, used = [], _SIZE[encoding], 0
    for c in ENCODINGS[encoding]:
        expected = n * len(c) / k
        if expected < 2 and out:
            out += [used - 1] * len(c)
            continue
        parts = max(1, min(len(c), int(expected // 4)))
        for part in np.array_split(np.arange(len(c)), parts):
            out += [used] * len(part)
            used += 1
    return np.array(out)


def _normal_tails(z: np.ndarray) -> np.ndarray:
    """Two-sided tail of the normal distribution (error below 2e-7), not below 1e-6."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.clip(poly * np.exp(-x * x), 1e-6, 1)


def battery(rows: np.ndarray, encoding: int) -> np.ndarray:
    """p-values (columns: uniformity, runs, serial correlation) of strings of one length and
    encoding (a matrix of bytes) under a uniform draw from the alphabet."""
    # a few bytes a character: a token may be as long as its text
    v, k, n = _VALUE[encoding][rows], _SIZE[encoding], rows.shape[1]
    cell = cells(encoding, n).astype(np.uint8)
    at, df = cell[v], int(cell.max())
    chi = np.zeros(len(rows))
    for c in range(df + 1):
        expected = n * (cell == c).sum() / k
        chi += ((at == c).sum(axis=1) - expected) ** 2 / expected
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal; one tail
    df = max(1, df)
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    half = _normal_tails(z) / 2
    uniform = np.clip(np.where(z >= 0, half, 1 - half), 1e-6, 1)
    high = v >= k / 2
    n1 = high.sum(axis=1).astype(np.float64)
    n0 = n - n1
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    both = 2 * n0 * n1
    spread = np.sqrt(np.maximum(both * (both - n), 1e-9) / (n * n * (n - 1.0)))
    z = np.maximum(np.abs(runs - 1 - both / n) - 0.5, 0) / np.maximum(spread, 1e-6)
    run_p = np.where(both > 0, _normal_tails(z), 1.0)     # one side only: the first test tells
    dot = lambda a, b: np.einsum("ij,ij->i", a, b, dtype=np.int64)
    total = v.sum(axis=1, dtype=np.int64)
    mean = total / n
    power = dot(v, v) - n * mean * mean
    ends = 2 * total - v[:, 0] - v[:, -1]                  # of both factors of the lagged products
    r = (dot(v[:, 1:], v[:, :-1]) - mean * ends + (n - 1) * mean * mean) / np.maximum(power, 1e-9)
    serial = np.where(power > 1e-6, _normal_tails((r + 1 / n) * n * np.sqrt(n - 1.0) / (n - 2)), 1e-6)
    return np.stack([uniform, run_p, serial], axis=1)


def combined(p: np.ndarray) -> np.ndarray:
    """Fisher's combination of three p-values a row."""
    x = -np.log(p).sum(axis=1)
    return np.exp(-x) * (1 + x + x * x / 2)


def band_of(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def code(band: int, encoding: np.ndarray | int, p: np.ndarray) -> np.ndarray:
    """(band, encoding, bin of p) as one number."""
    bin_ = np.minimum(BINS - 1, np.floor(-4 * np.log10(np.maximum(p, 1e-300))).astype(np.int64))
    return (band * len(ENCODINGS) + encoding) * BINS + bin_


def codes_of(rows: np.ndarray) -> np.ndarray:
    """Codes of strings of one length (a matrix of bytes); -1: no encoding has all characters."""
    out = np.full(len(rows), -1, dtype=np.int64)
    found = encodings(rows)
    for e in np.unique(found[found >= 0]):
        mine = found == e
        out[mine] = code(band_of(rows.shape[1]), int(e), combined(battery(rows[mine], int(e))))
    return out


# ------------------------------------------------------------- ordinary strings

_TO_SPACE = bytes(c if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))
#: Ways in which long ordinary tokens are written.
_STYLES = (b"".join, b"-".join, b"/".join, lambda words: b"".join(words).upper())
_CYCLE = sum(BANDS)


def ordinary(text: str, piece: int = 1 << 20) -> Iterator[np.ndarray]:
    """The letters and digits of a text without its long tokens as matrices of strings; texts
    take turns in the style and in the length to begin with, by their checksum."""
    data = _token.sub(" ", text).encode()
    turn = zlib.crc32(data)
    stream = np.frombuffer(_STYLES[turn % len(_STYLES)](data.translate(_TO_SPACE).split()), dtype=np.uint8)
    first = turn // len(_STYLES) % len(BANDS)
    lengths = BANDS[first:] + BANDS[:first]
    for at in range(0, len(stream), piece // _CYCLE * _CYCLE):
        part = stream[at:at + piece // _CYCLE * _CYCLE]
        whole, rest = part[:len(part) // _CYCLE * _CYCLE].reshape(-1, _CYCLE), part[len(part) // _CYCLE * _CYCLE:]
        begin = 0
        for n in lengths:
            found = [whole[:, begin:begin + n]] if len(whole) else []
            if len(rest) >= begin + n:
                found.append(rest[None, begin:begin + n])
            if found:
                yield np.concatenate(found)
            begin += n


# ----------------------------------------------------------------------- Spark

_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key`` and ``spans`` (start, kind, end, and the code of a candidate);
    and rows without spans that count the ordinary strings: ``code`` and ``n``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        names, key_type = ["key", "spans", "code", "n"], None

        def batch(keys, spans, codes, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, pa.array(spans, pa.list_(_SPAN)), pa.array(codes, pa.int32()), pa.array(n, pa.int64())], names=names)

        for b in slices(batches):
            key_type = b.column(0).type
            spans: list[list] = []
            tokens: dict[int, list] = {}
            plain: dict[int, list] = {}
            for t in b.column(1).to_pylist():
                base = base_spans(t)
                spans.append([(*s, None) for s in base])
                for start, end, token in candidates(t, base):
                    tokens.setdefault(len(token), []).append((len(spans) - 1, start, end, token))
                for m in ordinary(t):
                    plain.setdefault(m.shape[1], []).append(m)
            for n, some in tokens.items():
                codes = codes_of(np.frombuffer(b"".join(x[3] for x in some), dtype=np.uint8).reshape(-1, n))
                for (i, start, end, _), c in zip(some, codes.tolist()):
                    if c >= 0:
                        spans[i].append((start, 3, end, c))
            for some in plain.values():
                values, n = np.unique(codes_of(np.concatenate(some)), return_counts=True)
                counts.update({v: c for v, c in zip(values.tolist(), n.tolist()) if v >= 0})
            yield batch(b.column(0), spans, [None] * len(spans), [None] * len(spans))
        if counts:
            yield batch(pa.nulls(len(counts), key_type), [None] * len(counts), list(counts), list(counts.values()))

    return rows.mapInArrow(run, f"key {kind}, spans array<struct<start:int,kind:int,end:int,code:int>>, code int, n long")


def discoveries(found: dict[int, int], plain: dict[int, int], rate: float = RATE) -> list[int]:
    """For each (band, encoding) the last bin whose candidates are reported; -1: none.
    ``found`` and ``plain``: numbers of candidates and of ordinary strings by code."""
    strata = len(BANDS) * len(ENCODINGS)
    of_band = [sum(n for c, n in plain.items() if c // (BINS * len(ENCODINGS)) == b) for b in range(len(BANDS))]
    p: dict[int, float] = {}
    for s in range(strata):
        as_random, all_ = 0, of_band[s // len(ENCODINGS)]
        for b in range(BINS):
            as_random += plain.get(s * BINS + b, 0)
            p[s * BINS + b] = min(1.0, len(ENCODINGS) * (1 + as_random) / (1 + all_))
    total, below, limit = sum(found.values()), 0, -1.0
    for c in sorted(found, key=lambda c: p[c]):
        below += found[c]
        # equal values stand and fall together: the last of them is tested with all of them counted
        if p[c] <= rate * below / total:
            limit = p[c]
    return [max((b for b in range(BINS) if p[s * BINS + b] <= limit), default=-1) for s in range(strata)]


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """``key`` and ``spans`` of every row, an array of (start, kind, end) in order: the base
    spans and the discoveries at the false discovery rate; kinds by number (``KINDS``)."""
    seen = staged(scan(docs, key, text), "secret-spans")
    rows = seen.where(F.col("spans").isNotNull())
    token = rows.select(F.explode("spans").alias("s")).where(F.col("s.code").isNotNull())
    # at most a few thousand counts, whatever the corpus
    found = {r["code"]: r["n"] for r in token.groupBy(F.col("s.code").alias("code")).agg(F.count("*").alias("n")).collect()}
    plain = {r["code"]: r["n"] for r in seen.where(F.col("spans").isNull()).groupBy("code").agg(F.sum("n").alias("n")).collect()}
    last = F.array(*(F.lit(b) for b in discoveries(found, plain, rate)))

    def kept(s: Column) -> Column:
        stratum = F.floor(s["code"] / BINS).cast("int")
        return s["code"].isNull() | (F.pmod(s["code"], F.lit(BINS)) <= F.get(last, stratum))

    spans = F.transform(F.array_sort(F.filter("spans", kept)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return rows.select(F.col("key").alias(key), spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """``key``, numbers of base spans by kind, the digest of the base spans, and all spans as text."""
    found = secrets(docs, key, text, rate)
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = as_text(F.filter("spans", lambda s: s["kind"] < KINDS.index("random")))
    return found.select(key, *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])),
                        F.sha2(base, 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))

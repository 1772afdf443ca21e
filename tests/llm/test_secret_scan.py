"""Secret scan: spans against a slow scanner, the tests against simulation, discoveries by hand."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_etl.llm import queries as Q
from listing_etl.llm import secret_scan as S
from listing_etl.llm.common import table

SF = "/root/testdata/sf0.01"
WORDS = "the of and engine table column shuffle partition cluster window merge scan filter Report Monday paper water".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def slow(text):
    """Spans by the patterns as they are given: leftmost matches, failing ones dropped."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(r"(" + word + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    """(id, text) rows of prose, some with keys, and the spans of keys that no pattern knows."""
    rng, rows, keys = random.Random(5), [], {}
    for i in range(400):
        t = prose(rng, 300)
        if i % 8 == 0:
            raw = rng.randbytes(rng.choice([24, 30, 48]))
            key = base64.b64encode(raw).decode() if i % 16 else base64.urlsafe_b64encode(raw).decode()
            at = len(t) + 4
            t += f" by {key} " + prose(rng, 20)
            keys[i] = (at, at + len(key))
        rows.append((i, t))
    return rows, keys


def test_query_base_spans_equal_the_slow_scanner(spark):
    got = {r["doc_id"]: r for r in Q.op11_secret_scan(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        want, r = slow(d["text"] or ""), got[d["doc_id"]]
        base = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
        some += len(want)
    assert some


def test_base_patterns():
    t = "ApI_KEY = 'abcdef' secret:short token=password=abcdef AKIA" + "A" * 15 + " AKIA" + "B2" * 8 + " " + "0a" * 12 + "G" + "0a" * 11
    assert S.base_spans(t) == slow(t) and [k for _, k, _ in S.base_spans(t)] == [0, 0, 1, 2]
    assert S.base_spans("\u017fecret=abcdefgh to\u212aen=abcdefgh") == []          # other letters that fold to s and k


def test_p_values_are_uniform_on_random_strings():
    rng = np.random.default_rng(1)
    for e, n in ((0, 40), (5, 32), (6, 64), (3, 24)):
        alphabet = np.frombuffer("".join(S.ENCODINGS[e]).encode(), dtype=np.uint8)
        p = S.battery(alphabet[rng.integers(0, len(alphabet), (4000, n))], e)
        for column in p.T:
            for level in (0.05, 0.2, 0.5):
                assert (column <= level).mean() <= level * 1.3 + 0.01    # never far too small (ties of the runs: conservative)
        assert abs((p[:, 0] <= 0.2).mean() - 0.2) < 0.06 and abs((p[:, 2] <= 0.2).mean() - 0.2) < 0.04


def test_tests_see_their_kind_of_structure():
    e = 5
    alphabet = "".join(S.ENCODINGS[e])
    row = lambda s: np.frombuffer(s.encode(), dtype=np.uint8)[None, :]
    uneven = S.battery(row("thepartitionoftheWindow1" * 2), e)[0]
    zigzag = S.battery(row("0z1y2x3w4v5u6t7s8r9qApBoCnDmElFk"), e)[0]
    rising = S.battery(row(alphabet[::2]), e)[0]
    assert uneven[0] < 0.001 and zigzag[1] < 0.001 and zigzag[2] < 0.01 and rising[2] < 0.001
    assert S.combined(np.array([[1.0, 1.0, 1.0]]))[0] == 1 and S.combined(np.array([[0.01, 0.5, 0.5]]))[0] > 0.01


def test_encoding_is_the_tightest_alphabet():
    rows = [b"0123456789abcdef", b"0123456789ABCDEF", b"ABCDEFGHJKLMNP23", b"0123456789abcxyz", b"0189ABCDEFGHIJKZ", b"aB3aB3aB3aB3aB3a", b"aB3+/B3aB3aB3aB3",
            b"aB3-_B3aB3aB3aB3", b"aB3-+B3aB3aB3aB3", b"4111111111111111"]
    assert S.encodings(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 16)).tolist() == [0, 1, 2, 3, 4, 5, 6, 7, -1, -1]


def test_discoveries_by_hand():
    n = len(S.ENCODINGS)
    key = lambda band, e, b: (band * n + e) * S.BINS + b
    plain = {key(2, 5, 0): 1, key(2, 5, 8): 798, key(2, 6, 30): 200}
    last = S.discoveries({key(2, 5, 0): 3, key(2, 5, 9): 100, key(3, 5, 0): 1}, plain, rate=0.8)
    # p of (2, 5, 0): 8 * 2 / 1000 = 0.016 <= 0.8 * 3 / 104; of (2, 5, 9): 1; band 3 has no ordinary strings
    assert last[2 * n + 5] >= 0 and last[3 * n + 5] == -1
    assert S.discoveries({key(2, 5, 0): 3, key(2, 5, 9): 100}, plain, rate=0.1) == [-1] * (len(S.BANDS) * n)
    assert S.discoveries({}, {}) == [-1] * (len(S.BANDS) * n)


def test_random_keys_are_found_and_words_are_not(spark, corpus):
    rows, keys = corpus
    tricky = [(1000, "international_conference_proceedings the-quick-brown-fox-jumps-over usr/local/lib/python/site/packages 4111111111111111 zzzzzzzzzzzzzzzzzzzzzzzzzz")]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S.secrets(spark.createDataFrame(rows + tricky, "doc_id long, text string"), rate=0.05).collect()}
    assert got[1000] == []
    found = {(i, a, b) for i, s in got.items() for a, k, b in s if k == 3}
    want = {(i, a, b) for i, (a, b) in keys.items()}
    assert len(found & want) >= 0.8 * len(want) and len(found - want) <= 0.1 * len(found)


def test_result_does_not_depend_on_partitions(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    one, many = ({(r["doc_id"], r["spans"]) for r in S.digests(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == many


def test_odd_rows(spark):
    schema = "doc_id long, text string, spans string, code int, n string, key string"
    rows = [(None, "password=abcdefg", "x", 1, "y", "k"), (1, None, "x", 1, "y", "k"), (2, "", None, None, None, None), (3, "é token: 'ab.cd=ef' é", "x", 1, "y", "k"),
            (3, "é token: 'ab.cd=ef' é", "x", 1, "y", "k"), (4, "word " * 200_000 + "secret=123456" + "é" * 10, None, 1, None, None)]
    got = S.digests(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    by = sorted((r["doc_id"] or 0, r["n_assign"], r["spans"]) for r in got.collect())
    assert by == [(0, 1, "assign:0:16"), (1, 0, ""), (2, 0, ""), (3, 1, "assign:2:18"), (3, 1, "assign:2:18"), (4, 1, "assign:1000000:1000013")]
    assert S.digests(spark.createDataFrame([], schema)).count() == 0
    assert S.secrets(spark.createDataFrame([("a", "x")], "id string, body string"), "id", "body").select(F.size("spans")).first()[0] == 0

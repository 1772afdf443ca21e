"""Golden rows for KEY/SCL rules (FIXTURES §4) and Python-equivalence properties."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listing_etl.functions import scalars as S


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_asin(spark):
    df = spark.createDataFrame([("https://a/x/dp/B0ABCDEFGHIJ?x",), ("https://a/gp/B0",), ("/dp/b0abcdefgh",)], "u string")
    got = [r[0] for r in df.select(S.asin("u")).collect()]
    assert got == ["B0ABCDEFGH", None, None]


def test_money(spark):
    vals = ["₹1,299.00", "1299.", "1.299,00", "NA", None, "$10.00 - $20.00", "", "free"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r[0] for r in df.select(S.parse_money("x")).collect()]
    assert got == [1299.0, 1299.0, 1.299, 0.0, 0.0, None, None, None]


def test_used_condition(spark):
    vals = ["Used - Like New", "Used - Like-New", "Used", None]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    v1 = [r[0] for r in df.select(S.used_condition("x", "details")).collect()]
    v2 = [r[0] for r in df.select(S.used_condition("x", "wide")).collect()]
    assert v1 == ["Like New", "Like", "NA", "NA"]
    assert v2 == ["Like New", "Like", "Used", "NA"]


def test_discount(spark):
    rows = [(100.0, 80.0), (999.0, 749.5), (100.0, 120.0), (0.0, 50.0), (100.0, 0.0), (32.0, 31.0)]
    df = spark.createDataFrame(rows, "p double, u double")
    got = [r[0] for r in df.select(S.discount("p", "u")).collect()]
    assert got == [20.0, 24.97, -20.0, 0.0, 0.0, 3.12]


def test_array_literal(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "x array<string>")
    assert [r[0] for r in df.select(S.array_literal("x")).collect()] == ['{"a","b"}', "{}"]


def test_round2_equals_python(spark):
    random.seed(7)
    vals = [random.uniform(-1e6, 1e6) for _ in range(20000)]
    vals += [k / 1000 for k in range(-5000, 5000)] + [2.675, 0.615, 3.125, 1.005, -2.675, 0.125]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r.i: r.r for r in df.select("i", S.round2("x").alias("r")).collect()}
    assert all(got[i] == round(v, 2) for i, v in enumerate(vals))


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \t\n\x0b\x0c\r\x1c\x85\xa0 　ab,c")), max_size=12))
def test_strip_and_normalize_equal_python(spark, s):
    df = spark.createDataFrame([(s,)], "x string")
    r = df.select(S.ustrip("x").alias("a"), S.normalize_text("x").alias("b")).first()
    assert r.a == s.strip()
    assert r.b == s.strip().replace(",", "")


def test_return_rate_goldens(spark):
    from listing_etl.operators.reviews import return_rate
    cases = [(3, 2), (8, 8), (32, 31), (7, 0)]
    rows = []
    for k, (n, pos) in enumerate(cases):
        rows += [(str(k), "POSITIVE" if i < pos else "NEGATIVE") for i in range(n)]
    df = spark.createDataFrame(rows, "record_id string, label string")
    got = {r.record_id: r.return_rate for r in return_rate(df).collect()}
    assert got == {"0": 33.33, "1": 0.0, "2": 3.12, "3": 100.0}


def test_lookup_codes(spark):
    bodies = [('{"data":{"internalPid":"77"}}', 200), ('{"data":{}}', 200), ("not json", 200),
              ('{"data":null}', 200), ('{"data":[1]}', 200), ('{"data":{"internalPid":null}}', 200),
              ('{"data":{"internalPid":"1"}}', 500), (None, None), ('{"x":1}', 200), ('[1,2]', 200)]
    df = spark.createDataFrame(bodies, "b string, s int")
    got = [(r.p, r.c) for r in df.select(S.lookup_pid("b").alias("p"), S.lookup_code("b", "s").alias("c")).collect()]
    assert [c for _, c in got] == [None, "LOOKUP_KEY_MISSING", "LOOKUP_BAD_JSON", "LOOKUP_SHAPE", "LOOKUP_SHAPE",
                                   "LOOKUP_NULL", "LOOKUP_HTTP_FAILED", "LOOKUP_HTTP_FAILED", "LOOKUP_KEY_MISSING",
                                   "LOOKUP_SHAPE"]
    assert got[0][0] == "77"

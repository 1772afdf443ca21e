"""Every registered query against its DuckDB oracle (sf0.001), plus rows-only checks."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(round(v, 9)))
    return (2, str(v))


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert cols == sorted(dcols)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in (x.asDict() for x in df.collect()))
    b = sorted(tuple(norm(r[c]) for c in cols) for r in (dict(zip(dcols, x)) for x in res.fetchall()))
    assert a == b


def test_every_query_has_an_oracle():
    from listing_etl.plans import catalog, oracles
    assert set(catalog.QUERIES) == set(oracles.ORACLES)


def test_held_out_reviews_are_scored_well(spark):
    out = {r.doc_id: r.label for r in E.queries()["review_score"](spark, "/root/testdata/sf0.01").collect()}
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("doc_id % 5 = 0").collect()
    assert sum((out[r.doc_id] == "POSITIVE") == (r.quality == 1) for r in lab) > 0.8 * len(lab)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0

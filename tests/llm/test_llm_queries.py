"""The queries on the small tables: contracts, and the pipeline against brute force."""

import base64
import hashlib
import re

import pytest

import corpus_pipeline as P
from listing_etl.llm import queries as Q
from listing_etl.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: [r.asDict() for r in table(spark, SF, t).collect()] for t in ("documents", "pages", "benchmark", "embeddings")}


def test_every_operator_has_a_query():
    import __spark_entry__ as E
    names = set(E.queries())
    assert names >= {*Q.QUERIES, "pipeline"} and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in Q.QUERIES) == list(range(1, 14))


def test_op1(spark, tables):
    got = [r.asDict() for r in Q.op1_shards(spark, SF).collect()]
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert len(got) == len(tables["documents"])


def test_op2(spark, tables):
    assert Q.op2_url_reputation(spark, SF).count() == len(tables["pages"])
    assert Q.page_outcomes(spark, SF).count() > 0


def test_op8(spark, tables):
    same = {}
    for p in tables["pages"]:
        same.setdefault(p["html"] or "", []).append(p["page_id"])
    got = {r["page_id"]: r for r in Q.op8_warc(spark, SF).collect()}
    for p in tables["pages"]:
        data, r = (p["html"] or "").encode(), got[p["page_id"]]
        last = max(same[p["html"] or ""])
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == p["page_id"] else ("revisit", last))


def test_op10_is_the_article(spark, tables):
    docs = {d["doc_id"]: d["text"] for d in tables["documents"]}
    got = {r["page_id"]: r for r in Q.op10_main_text(spark, SF).collect()}
    for p in tables["pages"]:
        t = docs[int(re.search(r"://[^/]*/\w+/(\d+)", p["url"])[1])]
        want = [x for x in (" ".join(line.split()) for line in t.split("\n")) if x]
        assert got[p["page_id"]]["text"].split("\n")[1:] == want         # behind the heading
        assert got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"])


def test_pipeline_equals_its_stages_on_what_came_before(spark, tables):
    import test_decontaminate as D
    docs = table(spark, SF, "documents")
    have = {d["doc_id"]: d["text"] for d in tables["documents"]}
    keep = []
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table(spark, SF, "documents").columns
        rows = docs.collect()
        keep.append({r["doc_id"] for r in rows})
        assert all(r["text"] == have[r["doc_id"]] for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert keep[0] >= keep[1] >= keep[2] >= keep[3]
    toxic = {r["doc_id"] for r in Q.op7_toxicity(spark, SF).collect() if r["predicted"]}
    bad = {r["doc_id"] for r in Q.op9_quality(spark, SF).collect() if not r["predicted"]}
    assert keep[0] == set(have) - toxic and keep[1] == keep[0] - bad
    import test_simhash as S
    ids = sorted(keep[1])
    by = S.slow_components([S.slow_fingerprint(have[i]) for i in ids])
    assert keep[2] == {ids[g] for g in set(by)}
    leaked = {i for i, *_ in D.brute([(i, have[i]) for i in keep[2]], [(b["item_id"], b["text"]) for b in tables["benchmark"]])}
    assert keep[3] == keep[2] - leaked
    last = {r["doc_id"]: r for r in P.run(spark, SF).collect()}
    assert set(last) == keep[3] and all(r["lossless"] and len(r["ids"]) == r["n_tokens"] for r in last.values())


def test_rows_without_an_id_and_of_one_id_are_judged_by_themselves(spark, tables):
    docs = table(spark, SF, "documents")
    leak = next(b["text"] for b in tables["benchmark"])
    rows = [(5, "one text of some words", "en", "s", 1), (5, "another thing altogether, longer than that", "en", "s", 1), (None, "no id but a text", "en", "s", 1),
            (None, "no id but a text", "de", "s", 2), (7, "no id but a text", "en", "s", 1), (None, "a " + leak + " b", "en", "s", 1), (8, "clean and short", "en", "s", 1)]
    odd = spark.createDataFrame(rows, docs.schema)
    kept = sorted((r["doc_id"] or 0, r["text"][:9]) for r in P.drop_near_duplicates(spark, odd, SF).collect())
    assert kept == sorted([(5, "one text "), (5, "another t"), (7, "no id but"), (0, ("a " + leak)[:9]), (8, "clean and")])
    left = P.drop_contaminated(spark, odd, SF)
    assert left.columns == docs.columns and left.count() == 6 and leak not in {r["text"] for r in left.collect()}


def test_stages_on_nulls_repeats_and_empty_tables(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "some words here", None, None, None), (900001, None, None, None, None), (900002, "", "en", "s", 0), (900002, "", "en", "s", 0)], docs.schema)
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        got = stage(spark, odd, SF).collect()
        assert {r["doc_id"] for r in got} <= {None, 900001, 900002}
    assert [r["doc_id"] for r in P.drop_near_duplicates(spark, odd, SF).collect() if r["doc_id"]] == [900001]

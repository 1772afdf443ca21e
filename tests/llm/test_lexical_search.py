"""Ranked search against scoring every document, and the bounds against the scores."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_etl.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def brute(docs, items, k=50):
    """(item, rank, id, score) by the formula, for each row of (id, text)."""
    have = [(i, terms(t)) for i, t in docs]
    have = [(i, w) for i, w in have if w]
    n_docs, total = len(have), sum(len(w) for _, w in have)
    df = {}
    for _, w in have:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, some in asked.items():
        found = []
        for i, w in have:
            m = 100 - 50 + (50 * len(w) * n_docs) // total
            score = 0
            for t in some & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, (i is not None, i or 0)))
        found.sort()
        out += [(item, r, i if some_ else None, -s) for r, (s, (some_, i)) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def made(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 1.5, 2) for r in docs], "doc_id long, text string, terms string, score double, q int")
    b = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, rank int")
    got = L.search(d, b, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    """Texts of a few topics with rare words, a hot group of copies, and items out of some texts."""
    rng = random.Random(3)
    common = [f"w{i}" for i in range(40)]
    topics = [[f"t{k}x{i}" for i in range(60)] for k in range(12)]
    docs = []
    for i in range(700):
        words = topics[i % 12]
        docs.append((i, " ".join(rng.choice(words if rng.random() < 0.6 else common) for _ in range(rng.choice([5, 20, 60])))))
    docs += [(1000 + i, docs[5][1]) for i in range(300)]
    items = [(i, " ".join(docs[i * 50][1].split()[:12])) for i in range(10)]
    return docs, items


def test_equals_scoring_every_document(spark, corpus):
    docs, items = corpus
    want = brute(docs, items)
    assert made(spark, docs, items, cell_rows=16) == want
    assert made(spark, docs, items, cell_rows=64, pass_items=4, seed_cells=1) == want


def test_blocks_are_skipped_and_hot_copies_are_cut(spark, corpus):
    docs, items = corpus
    rows = [(i, [t.encode() for t in sorted(set(terms(x)))]) for i, x in items]
    queries = L.Queries.of(rows)
    counts = L.staged(L.counted(spark.createDataFrame(docs, "doc_id long, text string"), queries, "doc_id", "text"), "counts")
    stats = L.statistics(counts, len(queries.vocabulary))
    cells = L.staged(L.index(L.placed(counts, stats, 16), queries), "cells")
    assert cells.agg(F.max(F.size("ids"))).first()[0] <= 64          # 300 copies are not one cell
    wanted = L.cell_bounds(cells, queries, stats.weights)
    want = brute(docs, items)
    floors = {i: min(s for item, _, _, s in want if item == i) for i, _ in items}
    visits = wanted.join(spark.createDataFrame([(q, floors[i]) for q, i in enumerate(queries.ids)], "q int, floor long"), "q").where("bound >= floor")
    assert visits.count() < 0.8 * wanted.count()
    # inside of the cells, too: documents that are scored with the floor and without
    scorer, with_floor, without = L.Scorer(queries, stats.weights), 0, 0
    for batch in cells.toArrow().to_batches():
        for _, cell in L._cells(batch.select(["cell", *L._PARTS])):
            for q, i in enumerate(queries.ids):
                with_floor += scorer.best(cell, q, floors[i], 50)[2]
                without += scorer.best(cell, q, 0, 50)[2]
    assert with_floor < 0.7 * without


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    first, parts, values = [0], [], []
    for _ in range(30):
        t = np.unique(rng.integers(0, 20, rng.integers(1, 9)))
        parts.append(t)
        values.append(rng.integers(1, 1000, len(t)))
        first.append(first[-1] + len(t))
    first, t, v = np.array(first), np.concatenate(parts), np.concatenate(values)
    query, weights = np.array([2, 3, 5, 11, 30]), np.zeros(40, dtype=np.int64)
    weights[query] = [5, 7, 1, 9, 4]
    partners = [query if i in query else np.array([i]) for i in range(40)]
    lists, begin, term, most = L.summaries(first, t, v, partners)
    at, bound, own = L.block_bounds(query, weights, lists, begin, term, most)
    assert lists[at].tolist() == sorted(set(query.tolist()) & set(t.tolist()))
    for x, b, o in zip(lists[at], bound, own):
        members = [i for i in range(30) if x in parts[i]]
        # the summary is the largest impact of each coordinate among the members of the list
        tops = {y: max((values[i][parts[i].tolist().index(y)] for i in members if y in parts[i]), default=0) for y in query.tolist()}
        assert b == sum(weights[y] * n for y, n in tops.items()) and o == weights[x] * tops[x]
        assert all(b >= sum(weights[y] * n for y, n in zip(parts[i].tolist(), values[i].tolist())) for i in members)


def test_terms_are_bytes_outside_of_the_ascii_marks():
    for t in ("ÀB c-d_e9\x00f\x7f g", "日本 語x", "ABC ÄÖ ſK", "", "\t\n"):
        assert [x.decode() for x in L.terms_of(t.encode())] == terms(t)


def test_similar_vectors_are_near():
    rng = np.random.default_rng(0)
    t = np.sort(rng.choice(1000, 30, replace=False))
    v = rng.integers(1, 9, 30).astype(float)
    far = np.sort(rng.choice(1000, 30, replace=False))
    a, b, c = L.projected(np.r_[t, t, far], np.r_[v, v * 2, v], np.array([0, 30, 60])).tolist()
    assert a == b and a != c


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, "--- !!"), (4, "Alpha alpha"), (4, "Alpha alpha"), (5, "beta " * 50_000 + "gamma"), (6, "delta"), (7, "ALPHA ß")]
    items = [(1, "alpha? BETA"), (1, "gamma"), (2, None), (3, ""), (4, "nothing like it"), (None, "alpha"), (5, "alpha"), (5, "alpha")]
    assert made(spark, docs, items) == brute(docs, items)
    assert made(spark, docs, items, k=2) == brute(docs, items, 2)
    assert made(spark, [], items) == [] and made(spark, docs, []) == []


def test_items_and_documents_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two three"), ("c", "four")], "name string, body string")
    items = spark.createDataFrame([("x", "two four")], "what string, body string")
    got = L.search(docs, items, "name", "body", "what", "body").collect()
    assert [(r["what"], r["rank"], r["name"]) for r in sorted(got, key=lambda r: r["rank"])][0][2] == "c"

import random
import re

import pytest
from pyspark.sql import functions as F

from listing_etl.llm import decontaminate as D


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, items, t=0.8):
    by = {}
    for i, x, *_ in docs:
        if i is not None:
            # a document has the runs of 1 to 4 words, too: items of fewer than five words are found in it
            by.setdefault(i, set()).update(*(shingles(x, k) for k in range(1, 6)))
    want = set()
    for j, y, *_ in items:
        s = shingles(y)
        for i, d in by.items():
            if j is not None and s and len(s & d) >= t * len(s) - 1e-9:
                want.add((i, j, len(s & d), len(s)))
    return want


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string, item int, h string")
    b = spark.createDataFrame(items, "item_id long, text string, n string, doc int")
    return {tuple(r)[:4] for r in D.contained_items(d, b, **more).collect()}


def test_planted_passages_equal_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    items = [(j, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 5, 6, 9, 15, 40, 60]))), "a", 0) for j in range(40)]
    items += [(40, None, "a", 0), (41, "", "a", 0), (None, items[5][1], "a", 0), (42, items[6][1], "a", 0), (6, items[6][1], "a", 0)]
    docs = []
    for i in range(150):
        w = [r.choice(words) for _ in range(r.choice([0, 4, 30, 300, 3000]))]
        if i % 2:
            part = items[r.randrange(40)][1].split()
            cut = r.choice([0, 0, 1, len(part) // 5, len(part) // 3])
            part = part[cut:]
            if r.random() < 0.3 and len(part) > 12:
                part[len(part) // 2] = "changed"
            at = r.randrange(len(w) + 1)
            w[at:at] = [p.upper() + "," for p in part]
        docs.append((i, " ".join(w), 1, "x"))
    docs += [(200, None, 1, "x"), (201, "", 1, "x"), (None, items[3][1], 1, "x"), (1, docs[1][1], 1, "x"), (202, items[0][1], 1, "x")]
    want = brute(docs, items)
    assert len(want) > 30
    assert run(spark, docs, items) == want
    assert run(spark, docs, items, broadcast_rows=0) == want            # the way beyond broadcasting
    assert run(spark, docs, items, threshold=0.5) == brute(docs, items, 0.5)


def test_items_of_few_words_are_found_inside_of_documents(spark):
    docs = [(1, "a long text with a Short, answer phrase in it", 1, "x"), (2, "short answer", 1, "x"), (3, "answer short phrase and others", 1, "x"), (4, "phrase", 1, "x")]
    items = [(1, "short answer phrase", "n", 0), (2, "phrase", "n", 0), (3, "short answer", "n", 0)]
    assert run(spark, docs, items) == {(1, 1, 1, 1), (1, 2, 1, 1), (3, 2, 1, 1), (4, 2, 1, 1), (1, 3, 1, 1), (2, 3, 1, 1)} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = [(1, "a b c d e f", 1, "x")], [(1, "a b c d e f", "n", 0)]
    assert run(spark, docs, items) == {(1, 1, 2, 2)}
    d = spark.createDataFrame(docs, "doc_id long, text string, item int, h string")
    b = spark.createDataFrame(items, "item_id long, text string, n string, doc int")
    assert D.contained_items(d.limit(0), b).count() == 0 and D.contained_items(d, b.limit(0)).count() == 0


def test_only_builtin_expressions(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = d.select(F.explode(D.shingle_hashes(F.col("text"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("t", [0.0, 1.5])
def test_thresholds_are_checked(spark, t):
    d = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        D.contained_items(d, d.withColumnRenamed("doc_id", "item_id"), threshold=t)

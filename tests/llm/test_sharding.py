import zlib
from collections import defaultdict

import numpy as np
import pytest

from listing_etl.llm import sharding as S


def rows_of(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, parts int")
    return [r.asDict() for r in S.shard(df, shards).collect()]


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    assert sorted((g["doc_id"], g["size"], g["text_crc32"]) for g in got if g["doc_id"] is not None) == want
    slots = defaultdict(list)
    for g in got:
        assert 0 <= g["shard"] < shards
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_measures_are_balanced_and_groups_stay_together(spark):
    r = np.random.default_rng(4)
    rows = [(i, "w " * int(r.lognormal(3, 1)) + str(i if i % 5 else i % 400), "x", 1) for i in range(6000)]
    got = rows_of(spark, rows, 8)
    check(rows, got, 8)
    for measure in (lambda g: g["size"], lambda g: g["tokens"], lambda g: 1):
        sums = np.zeros(8)
        for g in got:
            sums[g["shard"]] += measure(g)
        assert sums.max() <= 1.02 * sums.mean() and sums.min() >= 0.98 * sums.mean()
    where = defaultdict(set)
    texts = dict((i, t) for i, t, *_ in rows)
    for g in got:
        where[texts[g["doc_id"]]].add(g["shard"])
    assert all(len(w) == 1 for w in where.values())


def test_a_group_above_a_shard_is_cut(spark):
    rows = [(i, "the same text", "x", 1) for i in range(2000)] + [(2000 + i, f"text {i} of its own", "x", 1) for i in range(2000)]
    got = rows_of(spark, rows, 8)
    check(rows, got, 8)
    sizes = np.bincount([g["shard"] for g in got], minlength=8)
    assert sizes.max() <= 1.1 * sizes.mean()


def test_edge_cases(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "a" * 200_000, "x", 1), (None, "b", "x", 1), (None, "b", "x", 1), (4, "é", "x", 1), (4, "é", "x", 1)]
    got = rows_of(spark, rows, 3)
    check(rows, got, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, parts int")
    assert S.shard(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        S.shard(df, 0)


def plain_placement(vectors, shards):
    """The rule, item by item: the heaviest first; of the shards that overflow least, the one whose
    residual capacity has the highest dot product with the item, the first of equal ones."""
    total = [sum(v[k] for v in vectors) or 1 for k in range(len(vectors[0]))]
    share = [[x / t * shards for x, t in zip(v, total)] for v in vectors]
    left, out = [[1.0] * len(total) for _ in range(shards)], [None] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: -max(share[i])):
        over = [max(max(s - room, 0) for s, room in zip(share[i], left[j])) for j in range(shards)]
        able = [j for j in range(shards) if over[j] <= min(over) + 1e-12]
        dots = {j: sum(s * room for s, room in zip(share[i], left[j])) for j in able}
        best = max(dots.values())
        out[i] = min(j for j in able if dots[j] >= best - 1e-12)
        left[out[i]] = [room - s for s, room in zip(share[i], left[out[i]])]
    return out, left


def test_placement_equals_the_rule_item_by_item():
    r = np.random.default_rng(6)
    for shards, n in ((3, 40), (7, 200)):
        vectors = r.lognormal(0, 1.5, size=(n, 3))
        want, left = plain_placement(vectors.tolist(), shards)
        assert S.place(vectors, shards).tolist() == want
        assert min(map(min, left)) > -0.5


def test_rows_of_one_id_and_without_an_id_are_spread(spark):
    rows = [(None, f"text {i}", "x", 1) for i in range(1500)] + [(7, "same text", "x", 1)] * 1500
    got = rows_of(spark, rows, 4)
    check(rows, got, 4)
    sizes = np.bincount([g["shard"] for g in got], minlength=4)
    assert sizes.max() <= 1.15 * sizes.mean()


def test_placement_takes_the_highest_dot_product():
    items = np.array([[6, 1], [1, 6], [5, 1], [1, 5]], dtype=float)
    assert S.place(items, 2).tolist() == [0, 1, 1, 0] or S.place(items, 2).tolist() == [0, 0, 1, 1]
    sums = np.zeros((2, 2))
    np.add.at(sums, S.place(items, 2), items)
    assert sums.max() <= 7

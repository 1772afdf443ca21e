"""Merkle manifest against a tree built plainly in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from listing_etl.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, node string, place long"


def h(t):
    return hashlib.sha256(t.encode()).hexdigest()


def leaf(r, text):
    some = [r[0], r[3], r[2], r[4], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in some))


def tree_and_paths(leaves):
    """The top and, for each leaf, its siblings by level with the place in the run."""
    paths, level, where = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(where):
            run = level[p // 3 * 3:p // 3 * 3 + 3]
            paths[i].append((p % 3, run[:p % 3] + run[p % 3 + 1:]))
        where = [p // 3 for p in where]
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    subs = []
    for source in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        rs = sorted(by[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs.append((rs, *tree_and_paths([leaf(r, r[1]) for r in rs])))
    root, ups = tree_and_paths([s[1] for s in subs])
    out = []
    for (rs, sub, paths), up in zip(subs, ups):
        for r, path in zip(rs, paths):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for at, siblings in path + up:
                node = h("".join(siblings[:at] + [node] + siblings[at:]))
            out.append((r[0], leaf(r, r[1]), sub, root, h("".join(x for _, s in path + up for x in s)), node, node == root))
    return sorted(out, key=str)


def tampered(c):
    even = F.pmod(F.crc32(c["doc_id"].cast("string").cast("binary")), F.lit(2)) == 0
    return [F.coalesce(F.when(even, F.replace(c["text"], F.lit("\n"), F.lit(""))), c["text"]) if n == "text" else c[n] for n in c]


def made(spark, rows, **options):
    got = M.manifest(spark.createDataFrame([(*r, "x", None, 3) for r in rows], SCHEMA), tampered=tampered, **options)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and dict(got.dtypes)["doc_id"] == "bigint"
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(n, source, start=0):
    return [(start + i, f"text {i}\nline", "en", source, i) for i in range(n)]


@pytest.mark.parametrize("levels, partition_rows", [(1, 5), (2, 1 << 18)])
def test_many_tiers_hot_and_small_sources(spark, levels, partition_rows):
    rows = rows_of(50, "hot") + rows_of(1, "one", 100) + rows_of(3, "three", 200) + rows_of(4, "four", 300) + [r for i in range(9) for r in rows_of(2, f"s{i}", 400 + 10 * i)]
    got = made(spark, rows, levels=levels, partition_rows=partition_rows)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_nulls_ties_repeats_and_odd_sources(spark):
    rows = [(None, "a\nb", None, None, None), (None, None, "de", None, 3), (7, "", "", "", 0), (7, "", "", "", 0), (7, "other", "en", "", 5),
            (1 << 60, "ü\n ", "fr", "é", -1), (-5, "x" * 3_000_000 + "\n", "en", "z", 1), (8, None, None, "Z", None)]
    assert made(spark, rows, levels=1) == brute(rows)


def test_one_source_one_row_and_none(spark):
    for rows in ([(4, "a\n", "en", None, 1)], rows_of(10, "s")):
        assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []


def test_without_tampering_all_is_verified(spark):
    docs = spark.createDataFrame(rows_of(30, "a") + rows_of(5, None, 50), "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r) for r in M.manifest(docs, levels=1).select("verified").distinct().collect()} == {(True,)}
    other = M.manifest(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp")), fields=("id", "grp"), key="id", tree="grp")
    assert other.where("verified").count() == 35


def test_a_proof_fails_on_any_other_sibling():
    leaves = [h(str(i)) for i in range(10)]
    top, paths = tree_and_paths(leaves)
    for i in range(10):
        runs = [s for _, s in paths[i]]
        assert M.fold(leaves[i], i, runs) == top
        assert M.fold(leaves[i], i, [[h("x"), *runs[0][1:]], *runs[1:]]) != top if runs[0] else True
    assert M.reduction(leaves, M.levels_above(10))[-1] == [top] and [M.levels_above(n) for n in (0, 1, 2, 3, 4, 9, 10)] == [0, 0, 1, 1, 2, 2, 3]

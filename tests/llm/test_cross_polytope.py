import numpy as np
from pyspark.sql import functions as F

from listing_etl.llm import cross_polytope as C


def is_query(i):
    return F.pmod(i, F.lit(20)) == 0


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int, cell string, vector string")
    got = {}
    for r in C.search(df, is_query, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return got


def brute(ids, x, k=20):
    want = {}
    for q in [i for i in ids if i % 20 == 0]:
        s = {i: float((x[q].astype(float) * x[i].astype(float)).sum()) for i in ids if i != q}
        want[q] = sorted(s, key=lambda i: (-s[i], i))[:k], s
    return want


def test_hadamard_is_orthonormal():
    h = C.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    n = 1500
    x = r.normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, x[i].tolist(), 0, "c", "v") for i in range(n)]
    got, want = run(spark, rows, block_rows=100), brute(range(n), dict(enumerate(x)))
    hits = 0
    for q, (best, s) in want.items():
        assert [g[2] for g in got[q]] == list(range(1, 21))
        assert all(abs(s[i] - score) < 1e-12 for i, score, _ in got[q])
        assert [i for i, *_ in got[q]] == sorted((i for i, *_ in got[q]), key=lambda i: (-s[i], i))
        hits += len(set(best) & {i for i, *_ in got[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_copies_ties_and_unusable_vectors(spark):
    r = np.random.default_rng(1)
    x = {i: r.normal(size=5).astype(np.float32) for i in range(100)}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    for i in range(40, 100):
        x[i] = x[0]                     # copies of a query: ties by id
    rows = [(i, v.tolist(), 0, "c", "v") for i, v in x.items()]
    bad = [(200, None), (220, [0.0] * 5), (240, [float("nan")] * 5), (260, [float("inf"), 0.0, 0.0, 0.0, 1.0]), (280, [1.0, None, 0.0, 0.0, 0.0]), (300, [1.0, 2.0]), (None, [1.0] * 5)]
    rows += [(i, v, 0, "c", "v") for i, v in bad] + [rows[0], rows[41]]
    got = run(spark, rows, probes=8, tables=12, query_rows=2)
    want = brute(list(x), x)
    assert set(got) == set(want)              # a dimension with a single vector has nothing to find
    assert [i for i, *_ in got[0]] == list(range(40, 60))      # the smallest ids of its copies, itself left out
    assert [i for i, *_ in got[60]][:20] == [0, *range(40, 59)]
    for q in got:
        assert len(got[q]) == 20 and q not in [i for i, *_ in got[q]]


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0], 0, "c", "v"), (1, [0.5, 0.5], 0, "c", "v"), (2, [0.0, -3.0], 0, "c", "v")]
    assert [i for i, *_ in run(spark, rows)[0]] == [1, 2]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row int, cell string, vector string")
    assert C.search(df.limit(0), is_query).count() == 0


def test_small_tables_give_all_they_have(spark):
    r = np.random.default_rng(3)
    for n, block_rows in ((10, 4), (30, 2000)):
        x = r.normal(size=(n, 64)).astype(np.float32)
        got = run(spark, [(i, x[i].tolist(), 0, "c", "v") for i in range(n)], block_rows=block_rows)
        for q, (best, s) in brute(range(n), dict(enumerate(x))).items():
            # a query that was short has the exact rows, any other as many as were asked for
            assert len(got[q]) == min(20, n - 1) and all(abs(s[i] - score) < 1e-9 for i, score, _ in got[q])
            assert n > 21 or [i for i, *_ in got[q]] == best


def test_each_dimension_is_searched_by_itself(spark):
    r = np.random.default_rng(5)
    x = {i: r.normal(size=8 if i < 60 else 9).astype(np.float32) for i in range(100)}
    got = run(spark, [(i, v.tolist(), 0, "c", "v") for i, v in x.items()])
    for some in (range(60), range(60, 100)):
        have = {i: x[i] for i in some}
        for q in [i for i in some if i % 20 == 0]:
            s = sorted(((float((x[q].astype(float) * v.astype(float)).sum()), -i) for i, v in have.items() if i != q), reverse=True)
            assert len(got[q]) == 20 and {i for i, *_ in got[q]} <= set(some) and got[q][0][0] == -s[0][1]


def test_an_id_with_several_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 2.0]), (2, [3.0, 0.0]), (3, [-1.0, -1.0])]
    got = run(spark, [(i, v, 0, "c", "v") for i, v in rows])
    assert [(i, round(s, 6)) for i, s, _ in got[20]] == [(2, 3.0), (1, 1.0), (3, -1.0)]


def test_long_vectors_keep_their_ties(spark):
    rows = [(i, [1e8 * (i % 3 + 1), 1.0, 0.0], 0, "c", "v") for i in range(90)]
    got = run(spark, rows)
    assert [i for i, *_ in got[0]] == [i for i in range(90) if i % 3 == 2][:20]


def candidates_and_recall(x, k=20):
    """Share of the rows that share a probed cell with a query, and of the nearest that do, with the
    number of probes that the method would take."""
    n = len(x)
    q = x[:n:20].astype(float)
    s = q @ x.T.astype(float)
    s[np.arange(len(q)), np.arange(0, n, 20)] = -np.inf
    near = np.argsort(-s, axis=1)[:, :k]
    sample = np.arange(0, len(q), max(1, len(q) // 200))
    probes = C.needed_probes(q[sample], np.repeat(np.arange(len(sample)), k), x[near[sample].ravel()].astype(float), C.TABLES, C.TARGET)
    hit = np.zeros(s.shape, dtype=bool)
    for rq, rx in zip(C.rotations(q), C.rotations(x.astype(float))):
        cell = C.axes(rx, 1)[:, 0]
        for a in C.axes(rq, probes).T:
            hit |= a[:, None] == cell[None, :]
    return hit.mean(), np.take_along_axis(hit, near, axis=1).mean(), probes


def test_share_of_candidates_falls_and_recall_holds():
    r = np.random.default_rng(11)
    shares = []
    for n in (2000, 20_000):
        x = r.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        share, recall, _ = candidates_and_recall(x)
        shares.append(share)
        assert recall >= 0.92
    assert shares[1] < 0.8 * shares[0]
    for spread in (0.5, 1.0):              # vectors of unequal length
        x = r.normal(size=(2000, 64))
        x *= r.lognormal(0, spread, size=(2000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
        assert candidates_and_recall(x)[1] >= 0.92

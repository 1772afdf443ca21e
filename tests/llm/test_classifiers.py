import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from listing_etl.llm import quality as Q
from listing_etl.llm import queries, toxicity as T
from listing_etl.llm.common import table

SF = "/root/testdata/sf0.01"


def corpus(seed=0, n=900):
    r = random.Random(seed)
    words = ["".join(r.choice("aeiou") + r.choice("nrstlm") for _ in range(r.randint(1, 4))) for _ in range(800)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):      # a stem with endings, most of which training has not seen
                w[r.randrange(len(w))] = "zgrok" + "".join(r.choice("abdefg") for _ in range(3))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxic_stems_are_found_in_held_out_texts(spark):
    rows = corpus()
    train = spark.createDataFrame([r for r in rows if r[0] % 3], "id long, text string, toxic int")
    model = T.fit(train)
    test = [r for r in rows if r[0] % 3 == 0]
    s = model.score([t for _, t, _ in test])
    assert np.mean((s >= 0.7) == np.array([y for *_, y in test])) > 0.97
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in test] + [(None, None, 0.5, "x"), (-1, "", 0.5, "x"), (-2, "123 !", 0.5, "x"), (-3, "ab " * 200_000, 0.5, "x")],
                                 "doc_id long, text string, score double, id string")
    got = {r["doc_id"]: r["score"] for r in T.score(docs, model).collect()}
    assert [got[i] for i, *_ in test] == s.tolist()
    assert got[None] == got[-1] == got[-2] < 0.5 and 0 <= got[-3] <= 1
    kept = T.keep_ordinary(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x < 0.7}
    assert T.score(docs.limit(0), model).count() == 0 and T.keep_ordinary(docs.limit(0), model).count() == 0


def test_toxic_counts_equal_a_direct_count(spark):
    """N-grams of the highest order by class, against plain Python."""
    rows = corpus(n=60)
    got = T.model_cells(spark.createDataFrame(rows, "id long, text string, toxic int").select("text", "toxic")).where("kind = 0 and k = %d" % T.ORDER)
    want = {}
    for _, text, toxic in rows:
        for w in set(T.words_of(text.lower())):
            cells = T.spelled([w])[0][T.ORDER]
            for c in cells.tolist():
                want.setdefault(c, [0, 0])[toxic] += 1
    assert {r["cell"]: [r["a"], r["b"]] for r in got.collect()} == want


def plain_values(rows, grams):
    """Toxic less ordinary log-likelihood of n-grams by the formula, from plain counts of the texts."""
    n, d, s = T.ORDER, T.DISCOUNT, T.STRENGTH
    top = {}
    for _, text, toxic in rows:
        for w in set(T.words_of(text.lower())):
            padded = "\x02" * (n - 1) + w + "\x03"
            for i in range(len(padded) - n + 1):
                top.setdefault(padded[i:i + n], [0, 0])[toxic] += 1
    # shared counts: below the highest order, different characters in front
    shared = {n: {g: sum(c) for g, c in top.items()}}
    for k in range(n - 1, 0, -1):
        shared[k] = {}
        for g in {g[-k - 1:] for g in top}:
            shared[k][g[1:]] = shared[k].get(g[1:], 0) + 1

    def after(table, front):
        return [c for g, c in table.items() if g[:-1] == front and c > 0]

    def mixed(table, g, below, strength=0.0):
        found = after(table, g[:-1])
        total = sum(found) + strength
        return (max(table.get(g, 0) - d, 0) + (len(found) * d + strength) * below) / total if total else below

    out = {}
    for g in grams:
        p = 1 / 1024
        for k in range(1, n + 1):
            p = mixed(shared[k], g[-k:], p)
        toxic, ordinary = (mixed({x: c[j] for x, c in top.items()}, g, p, s) for j in (1, 0))
        out[g] = np.log(toxic) - np.log(ordinary)
    return out


def test_probabilities_of_all_orders_equal_the_formula(spark):
    rows = corpus(n=30)
    texts = [(i, t) for i, t, _ in rows[:6]] + [(99, "zgroka unseen xq é")]
    train = spark.createDataFrame(rows, "id long, text string, toxic int").select("text", "toxic")
    model = T.KneserNey(T.staged(T.nodes_of(T.model_cells(train)), "nodes"))
    grams = sorted({g for _, t in texts for w in T.split(t) for g in T.spelled([w])[0][T.ORDER]})
    got = {r["gram"]: r["value"] / 2 ** 32 for r in model.differences(spark.createDataFrame([(g,) for g in grams], "gram string")).collect()}
    want = plain_values(rows, grams)
    assert set(got) == set(want) and max(abs(got[g] - want[g]) for g in grams) < 1e-8


def test_scores_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = corpus(n=200)
    train = spark.createDataFrame([r for r in rows if r[0] % 2], "id long, text string, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (-1, "")], "doc_id long, text string")
    model = T.fit(train, docs)
    one = sorted((str(r["doc_id"]), r["score"]) for r in T.score(docs, model).collect())
    model.values.small = False
    assert sorted((str(r["doc_id"]), r["score"]) for r in T.score(docs, model).collect()) == one       # to the last bit
    assert model.values.shared is None


def plain_trees(x, y, trees, depth, bins):
    """Margins of boosted trees, grown by trying every cut of every feature for every node."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    margin = np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        groups = [np.arange(len(y))]
        for _ in range(depth):
            split = []
            for rows in groups:
                best = (1e-9, None)
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + Q.SHRINK)
                for j, c in enumerate(cuts):
                    for t in c:
                        low, high = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                        if min(len(low), len(high)) >= Q.LEAF_ROWS:
                            gain = score(low) + score(high) - score(rows)
                            if gain > best[0] + 1e-12:
                                best = (gain, (low, high))
                split += best[1] or (rows, rows[:0])
            groups = split
        for rows in groups:
            margin[rows] += -Q.RATE * g[rows].sum() / (h[rows].sum() + Q.SHRINK)
    return margin


def test_growing_equals_trying_every_cut():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 4)), 2)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.2)).astype(float)
    got = Q.grow(x, y, trees=4, depth=3, bins=12)
    assert np.allclose(got.margin(x), plain_trees(x, y, 4, 3, 12))


def test_toxicity_without_a_class_or_rows(spark):
    rows = corpus(n=40)
    kind = "id long, text string, toxic int"
    assert T.fit(spark.createDataFrame([(i, t, 0) for i, t, _ in rows], kind)).score(["x", None]).tolist() == [0.0, 0.0]
    assert T.fit(spark.createDataFrame([], kind)).score(["x"]).tolist() == [0.0]
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (3, 0, 1), (3, 1, 0), (4, 7, 7)], "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "doc_id long, text string")
    got = {(r["id"], r["toxic"]) for r in T.labelled(docs, labels, lambda k: k == 99).collect()}
    assert got == {(2, 1), (3, 1)}


@pytest.mark.parametrize("text", [None, "", "  ", "a", "A B\n\nc", "!!! ???", "x" * 100_000, "é " * 1000])
def test_statistics_of_any_text(text):
    x = Q.statistics(text)
    assert len(x) == len(Q.STATISTICS) and np.isfinite(x).all()


def test_trees_learn_and_traverse(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    m = Q.grow(x[:2000], y[:2000])
    assert np.mean((m.margin(x[2000:]) > 0) == y[2000:]) > 0.95

    def slow(row):
        s = m.base
        for t in range(len(m.feature)):
            node = 0
            while node < m.feature.shape[1]:
                node = 2 * node + 1 + int(row[m.feature[t, node]] > m.threshold[t, node])
            s += m.leaf[t, node - m.feature.shape[1]]
        return s

    assert np.allclose([slow(row) for row in x[:50]], m.margin(x[:50]))


def test_quality_without_a_class_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0.1), (2, None, "x", 0.1), (None, "c", "x", 0.1)], "doc_id long, text string, id string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    never = lambda k: F.lit(False)
    m = Q.fit(docs, none, never)
    assert {r["score"] for r in Q.score(docs, m).collect()} == {0.5}
    one = Q.fit(docs, spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int"), never)
    kept = Q.keep_good(docs, one)
    assert kept.columns == docs.columns and kept.count() == 3
    assert Q.score(docs.limit(0), m).count() == 0


def test_many_and_odd_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a b", *range(40)), (2, None, *range(40))], ["doc_id", "text", "a b-c", "row", *[f"c{i}" for i in range(38)]])
    trees = Q.grow(np.zeros((0, len(Q.STATISTICS))), np.zeros(0))
    for kept in (Q.keep_good(df, trees), T.keep_ordinary(df, T.KneserNey([], [], constant=0.0))):
        assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect()))


def held_out(got, labels, label):
    by = {r["doc_id"]: r[label] for r in labels.collect()}
    return [(by[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in by]


def test_queries_on_held_out_labels(spark):
    labels = table(spark, SF, "labels")
    tox = queries.op7_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in tox)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in tox)
    pairs = held_out(tox, labels, "toxic")
    assert sum(a == b for a, b in pairs) > 0.9 * len(pairs)
    assert sum(b for a, b in pairs if not a) <= 0.03 * sum(not a for a, b in pairs)      # clean ones stay
    good = queries.op9_quality(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in good)
    pairs = held_out(good, labels, "quality")
    assert sum(a == b for a, b in pairs) > 0.95 * len(pairs)


def test_counts_of_different_ngrams_never_merge(spark):
    """Far more n-grams than any fixed number of cells: each has its own count."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30)) for _ in range(12_000)]
    rows = [(i, " ".join(words[i * 100:i * 100 + 100]), i % 2) for i in range(120)]
    got = T.model_cells(spark.createDataFrame(rows, "id long, text string, toxic int").select("text", "toxic")).where("kind = 0 and k = %d" % T.ORDER)
    distinct = {("\2" * 5 + w + "\3")[i:i + 6] for w in words for i in range(31)}
    assert len(distinct) > 300_000 and got.count() == len(distinct)


def test_toxicity_beyond_broadcasting_scores_the_same(spark, monkeypatch):
    rows = corpus(n=120)
    model = T.fit(spark.createDataFrame(rows, "id long, text string, toxic int"))
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in rows] + [(None, None, "a"), (-1, "", "b"), (0, rows[0][1], "c")], "doc_id long, text string, id string")
    near = sorted((r["doc_id"] or -9, r["score"]) for r in T.score(docs, model).collect())
    monkeypatch.setattr(T, "BROADCAST_GRAMS", -1)
    far = sorted((r["doc_id"] or -9, r["score"]) for r in T.score(docs, model).collect())
    assert [i for i, _ in near] == [i for i, _ in far] and np.allclose([s for _, s in near], [s for _, s in far])
    assert T.keep_ordinary(docs, model).columns == docs.columns


def test_texts_of_insults_only_are_toxic(spark):
    model = T.fit(spark.createDataFrame(corpus(), "id long, text string, toxic int"))
    s = model.score(["zgrokabd", "zgrokabd zgrokabd zgrokabd", "zgrokfeg zgrokbad zgrokdef zgrokgag", "zgrokabd zgrokfeg " * 500, "", corpus()[1][1]])
    assert (s[:4] >= T.THRESHOLD).all() and (s[4:] < T.THRESHOLD).all()


def test_words_that_repeat_are_spelled_once(monkeypatch):
    """What a task holds already takes no room again: many documents of the same words give each
    n-gram in one row, with the right counts."""
    monkeypatch.setattr(T, "COUNT_BYTES", 1 << 14)
    words = [a + b + "x" for a in "abcdefgh" for b in "ijklmnop"]
    texts, toxic = [" ".join(words)] * 300 + [None, "ÉÀ ab"], [0, 0, 1] * 100 + [1, 0]
    batches = T.pa.table({"text": texts, "toxic": toxic}).to_batches(max_chunksize=50)
    got = [r for b in T._count(iter(batches)) for r in zip(*(c.to_pylist() for c in b.columns))]
    want = {}
    for text, y in zip(texts, toxic):
        for w in set(T.words_of((text or "").lower())):
            for g in T.spelled([w])[0][T.ORDER].tolist():
                want.setdefault(g, [0, 0])[y] += 1
    assert len(got) == len(want) and {g: [a, b] for g, a, b in got} == want
    seen = [g for b in T._distinct(iter(batches)) for g in b.column(0).to_pylist()]
    assert sorted(seen) == sorted(want)


def test_words_and_ngrams_in_one_step_equal_the_plain_ones(monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    texts = [None, "", "It's 3 O'CLOCK_now\tx\x02y\x03z\x1cw", "Straße ΟΔΟΣ ١٢ ª²½ İı\xa0 é", "𝔘𝔫𝔦 𐐀x 日本語テキスト", "a" * 40 + " é" * 9,
             "".join(map(chr, range(0x3000))), "".join(map(chr, range(0x10000, 0x12000)))]
    words = []
    for t in texts:
        assert T.split(t) == T.words_of((t or "").lower())
        words += T.split(t)
    want, of = T.spelled(words)
    got = [(g, i) for grams, word in T.grams_of(words) for g, i in zip(grams.to_pylist(), word.tolist())]
    assert got == list(zip(want[T.ORDER].tolist(), of))

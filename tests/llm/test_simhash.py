import random
import re

import numpy as np
import pytest
import xxhash

from listing_etl.llm import simhash as S


def slow_fingerprint(text, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """Root (smallest index) of each fingerprint by brute force."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", "   ", "One", "one  TWO", "a b c", "A b\tc d\x0be É Ü", "x " * 40000, " a b"])
def test_fingerprint(text):
    assert S.fingerprint(text) == slow_fingerprint(text)


def test_words_within_two_bits_share_a_key():
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 300)
    rows, index = S.segment_keys(words)
    keys = [set(index[rows == i].tolist()) for i in range(len(words))]
    assert {len(k) for k in keys} <= {1, 6}
    for width in (23, 18):
        w = words & ((1 << width) - 1)
        for i, j in [(i, j) for i in range(width) for j in range(width)][::7]:
            rows, index = S.segment_keys(np.array([w[0], w[0] ^ (1 << i) ^ (1 << j)]), width)
            assert set(index[rows == 0]) & set(index[rows == 1])


def test_links_and_components_equal_brute_force(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = list(base)
    for _ in range(400):      # chains of close fingerprints, some a step too far
        x = r.choice(fps)
        for b in r.sample(range(64), r.choice([1, 2, 2, 3])):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps) | {0, 1, 3, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {(x["a"], x["b"]) for x in S.links(df).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert found == want
    roots = {x["node"]: x["root"] for x in S.components(S.links(df)).collect()}
    by = slow_components(fps)
    groups = {}
    for i, g in enumerate(by):
        groups.setdefault(g, set()).add(signed[i])
    for g in groups.values():
        if len(g) > 1:
            assert {roots[x] for x in g} == {min(g)}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) for _ in range(60)]
    texts += [t.upper() for t in texts[:10]] + [None, "", "one", "ONE", "two words"] + [texts[0]] * 20
    long = [r.choice(vocabulary) for _ in range(3000)]
    texts += [" ".join(long), " ".join(long + ["tail"])]
    rows = [(100 + i, t, 0, "x") for i, t in enumerate(texts)] + [(100, texts[0], 0, "x"), (None, texts[0], 0, "x"), (None, "only here", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, root string")
    got = sorted(map(tuple, S.near_duplicates(df).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t, _, _ in rows]
    by = slow_components(fps)
    least = {}
    for (i, *_), g in zip(rows, by):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = [(i, f"{f:016x}", least.get(g)) for (i, *_), f, g in zip(rows, fps, by)]
    assert got == sorted(want, key=str)
    assert S.near_duplicates(df.limit(0)).count() == 0


def test_more_than_two_bits_are_refused(spark):
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp long"), 3)

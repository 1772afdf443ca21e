import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from listing_etl.llm import sentencepiece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", None, " ", "  hello   world ", "\tHi\n\nx▁y ▁", "a\x00b", "é́日本😀", "<s>x</s><unk>", "﻿a\r\nb", "x�y",
         "a" * 3000, "=======--------......" * 30, " " * 77 + "x", "hahahaha" * 99, "The end.", "The end."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library_on_odd_and_random_texts(library):
    r = random.Random(5)
    pieces = [library.id_to_piece(i) for i in range(3, library.get_piece_size())]
    letters = "abcdeilmnoprstu   ▁\n\t.,-=<>0123日本é😀"
    texts = CASES + ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(300)]
    texts += ["".join(r.choice(pieces).strip("▁") for _ in range(r.randint(1, 40))) for _ in range(300)]
    texts += ["".join(r.choice(["in", "on", "er", "th", "the"]) for _ in range(150)) for _ in range(50)]
    ids, bounds = C.codec(MODEL).encode(texts)
    back = C.codec(MODEL).decode(ids, bounds)
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want
        assert back[i] == library.decode(want)


def test_decode_of_any_ids_equals_the_library(library):
    r = random.Random(6)
    lists = [[r.randrange(3, 32000) for _ in range(r.randint(0, 30))] + [r.randrange(3, 259) for _ in range(r.randint(0, 6))] for _ in range(300)]
    bounds = np.r_[0, np.cumsum([len(x) for x in lists])]
    assert C.codec(MODEL).decode(np.array(sum(lists, []), dtype=np.int64), bounds) == [library.decode(x) for x in lists]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(C, "CACHE_BYTES", 300)
    monkeypatch.setattr(C, "ROUND_SYMBOLS", 10)
    c = C.PieceCodec(MODEL)
    for _ in range(2):
        for t in ("some words of a text", "and others that come later on"):
            assert c.encode([t])[0].tolist() == library.encode(t)


def test_digests_keep_every_row(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "a", "x"), (0, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, C.digests(df, MODEL).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert C.digests(df.limit(0), MODEL).count() == 0


def test_clashing_names_are_told(spark):
    df = spark.createDataFrame([(1, "a", [1])], "doc_id long, text string, ids array<int>")
    with pytest.raises(ValueError):
        C.encode(df, MODEL)
    got = C.encode(df, MODEL, ids="pieces").first()
    assert got["ids"] == [1] and len(got["pieces"]) == 1


def test_null_ids_stand_for_nothing(spark):
    df = spark.createDataFrame([(1, [28705, None, 264]), (2, None), (3, [])], "k long, ids array<int>")
    assert [r["decoded"] for r in C.decode(df, MODEL).orderBy("k").collect()][1:] == ["", ""]

import gzip
import random
from collections import Counter

import pytest

from listing_etl.llm import warc as W


def test_chunked_framing():
    for size in (0, 1, 5, 8192, 8193, 30000):
        data = bytes(random.Random(size).randrange(256) for _ in range(size))
        assert W.unchunked(W.chunked(data)) == data
    assert W.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"
    for broken in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        assert W.unchunked(broken) is None


def pages_of(spark):
    r = random.Random(3)
    big = "".join(r.choice("abcé😀\r\n <>") for _ in range(90_000))
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, "u3", "same"), (2, "u2", big), (4, "u4", ""), (6, "u6", None), (7, None, "WARC/1.1\r\nContent-Length: 9\r\n\r\nx"),
            (8, "u\r\n8", "y" * 40_000), (9, "u9", "same "), (5, "u5", "same"), (None, "u0", "same"), (None, "u0", "alone")]
    return spark.createDataFrame([(*x, "k", b"p") for x in rows], "page_id long, url string, html string, key string, payload binary"), rows, big


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    pages, rows, big = pages_of(spark)
    path = str(tmp_path / "a")
    W.write_archives(pages.repartition(3), path, segment_bytes=1000, file_records=40, compression=compression)
    raw = W.read_records(spark, path)
    assert raw.where("type = 'continuation'").count() > 100
    got = W.reassemble(raw).collect()
    assert {r["status"] for r in got} == {"ok"} and len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["id"].rpartition(":")[0], []).append(r)
    assert sorted(len(x) for x in by.values()) == sorted({k: n for k, n in Counter(i for i, *_ in rows).items()}.values())      # rows of one id stay apart
    for i, _, html in rows:
        if i is None:
            continue
        payload = (html or "").encode()
        last = max(k for k, _, h in rows if k is not None and (h or "") == (html or ""))
        for r in by[f"<urn:page:{i}"]:
            assert r["digest"] == W.payload_digest(payload)
            if i == last:
                assert r["type"] == "response" and bytes(r["payload"]) == payload and r["refers"] is None
            else:
                assert r["type"] == "revisit" and r["payload"] is None and r["refers"] in {x["id"] for x in by[f"<urn:page:{last}"]}
    assert sorted(bytes(r["payload"]) for r in got if r["id"].startswith("<urn:row")) == [b"alone", b"same"]


def test_damage_is_told(spark):
    pages, rows, big = pages_of(spark)
    records = W.page_records("2", 7, "u", big.encode(), None, 1000)
    kinds = "id string, type string, url string, digest string, refers string, origin string, segment int, total long, cut boolean, block binary"

    def status(parts):
        out = []
        for h, b in parts:
            seg, total = h.get("warc-segment-number"), h.get("warc-segment-total-length")
            out.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest"), None, h.get("warc-segment-origin-id"),
                        seg and int(seg), total and int(total), False, b))
        random.Random(1).shuffle(out)
        return [r["status"] for r in W.reassemble(spark.createDataFrame(out, kinds)).collect()]

    parsed = [next(W.parse_records(r + b"\r\n\r\n")) for r in records]
    assert status(parsed) == ["ok"] and status(parsed + parsed[3:5]) == ["ok"]
    assert status(parsed[:5] + parsed[6:]) == ["missing segment"]
    assert status(parsed[:-1]) == ["missing segment"] and status(parsed[1:]) == ["missing origin"]
    cut = [(h, b[:-1] if i == 2 else b) for i, (h, b) in enumerate(parsed)]
    assert status(cut) == ["wrong length"]
    swapped = [(h, b"x" + b[1:] if i == 2 else b) for i, (h, b) in enumerate(parsed)]
    assert status(swapped)[0] in ("wrong digest", "bad framing")


def test_gzip_members_and_noise(spark, tmp_path):
    a, b = W.page_records("1", 0, "u", b"one", None)[0] + b"\r\n\r\n", W.page_records("2", 1, "u", b"two", None)[0] + b"\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nno length\r\n\r\n" + a) + gzip.compress(b))
    got = W.reassemble(W.read_records(spark, str(tmp_path))).collect()
    assert sorted((r["id"], bytes(r["payload"]), r["status"]) for r in got) == [("<urn:page:1:0>", b"one", "ok"), ("<urn:page:2:1>", b"two", "ok")]


def test_long_pages_of_one_id_stay_apart(spark, tmp_path):
    """Equal rows and rows of one id with other texts, longer than a segment and not."""
    rows = [(1, "u", "a" * 150_000), (1, "u", "a" * 150_000), (3, "u", "b" * 150_000), (3, "v", "c" * 150_000), (4, "u", "d"), (4, "u", "d")]
    W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"))
    got = W.reassemble(W.read_records(spark, str(tmp_path / "a"))).collect()
    assert [r["status"] for r in got] == ["ok"] * 6
    assert sorted(bytes(r["payload"])[:1] for r in got) == [b"a", b"a", b"b", b"c", b"d", b"d"]


def test_streamed_records_equal_those_of_the_whole_file():
    r = random.Random(8)
    blocks = [b"", b"\r\n\r\n", b"x\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", bytes(r.randrange(256) for _ in range(5000)), b"0\r\n\r\n"]
    data = b"noise\r\n\r\n" + b"".join(W._header([("WARC-Type", "resource")], len(b)) + b + b"\r\n\r\n" for b in blocks * 2)
    for end in (len(data), len(data) - 4, len(data) - 6):
        pieces = data[:end].split(b"\r\n\r\n")
        pieces = pieces[:-1] if not pieces[-1] else pieces            # as the line reader gives them
        assert list(W.stream_records(pieces)) == list(W.parse_records(data[:end]))
    assert [b for _, b in W.parse_records(data)] == blocks * 2


def test_empty_table(spark, tmp_path):
    pages, *_ = pages_of(spark)
    W.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert W.reassemble(W.read_records(spark, str(tmp_path / "none"))).count() == 0

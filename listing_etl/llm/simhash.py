"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A text is lower-cased (A-Z), cut into words at ASCII white space, and each run of
``shingle`` words hashed with XXH64 (seed 42); a fingerprint bit is set if more than half
of the hashes have it. Equal fingerprints are gathered first, so copies cost one row.

The 64 bits form three segments (23, 23 and 18 bits). The Golay code (23, 12) is perfect:
each 23-bit word lies within three bits of exactly one codeword. The keys of a segment are
the indices of the codewords that it or a word one bit away decodes to (one or six of
them); two segments that differ in at most two bits have a word in the middle, one bit
from either, and so share a key. With at most two wrong bits in three segments one segment
is free of errors, and the next one has two at most: (segment, its value, a key of the
next segment) finds every pair, with about 30 to 35 bits of selectivity. Joined pairs are
verified by their exact distance; components come from minimum labels with pointer
jumping, each round written to the shared folder.

A fingerprint has at most 2,080 others within two bits, so no node of the graph is hot
however many copies a text has.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer
words than a shingle make one shingle; null ids take part but never name a component
(``component_id`` is null where no member has an id); repeated rows return repeated rows;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import prepare, slices, staged

SEED = 42
#: Start and width of the segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator polynomial of the code (fixed value).
GENERATOR = 0b110001110101


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    w = (text or "").encode("utf-8").lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        parts = [b" ".join(w)]
    else:
        parts = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
        # a long text in pieces: its hashes need not be held at once
    n = max(1, len(w) - shingle + 1)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    hashes = map(digest, parts)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        h = np.fromiter(hashes, dtype="<u8", count=min(1 << 14, n - at))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of every row."""
    prepare(df.sparkSession)
    narrow = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words as polynomials over GF(2), divided by the generator."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - 11), 0)
    return r


def _error_table() -> np.ndarray:
    """The pattern of at most three bits that belongs to each of the 2,048 remainders."""
    one = 1 << np.arange(23)
    two = (one[:, None] | one[None, :]).ravel()
    three = (two[:, None] | one[None, :]).ravel()
    all_ = np.unique(np.r_[0, one, two, three])
    table = np.zeros(1 << 11, dtype=np.int64)
    table[_remainder(all_)] = all_
    return table


def segment_keys(words: np.ndarray, width: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct codeword indices (12 bits) of segments of ``width`` bits."""
    near = words[:, None] ^ np.r_[0, 1 << np.arange(width)][None, :]
    index = (near ^ _error_table()[_remainder(near.ravel())].reshape(near.shape)) >> 11
    index.sort(axis=1)
    first = np.ones(index.shape, dtype=bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    return np.nonzero(first)[0], index[first]


def golay_keys(fps: DataFrame) -> DataFrame:
    """(``fp``, ``bucket``) rows of distinct fingerprints: 3 to 18 for each."""
    prepare(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1 << 17):
            fp = np.asarray(b.column(0)).view(np.uint64)
            seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
            for k in range(3):
                other = (k + 1) % 3
                row, index = segment_keys(seg[other], SEGMENTS[other][1])
                bucket = (k << 35) | (seg[k][row] << 12) | index
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)[row]), pa.array(bucket)], names=["fp", "bucket"])

    return fps.select("fp").mapInArrow(run, "fp long, bucket long")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints that differ in at most ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("segments and keys are laid out for at most two bits")
    keys = staged(golay_keys(fps), "golay-keys")
    a, b = keys.select("bucket", F.col("fp").alias("a")), keys.select("bucket", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return a.join(b, (a["bucket"] == b["bucket"]) & near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of every node that has a link."""
    both = staged(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))
                  .union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node"))
    labels = staged(labels, "labels")
    while True:
        seen = both.join(labels, both["dst"] == labels["node"]).select(F.col("src").alias("node"), "root")
        low = staged(seen.union(labels).groupBy("node").agg(F.min("root").alias("root")), "labels")
        up = low.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = staged(low.join(up, "root").select("node", F.col("top").alias("root")), "labels")
        old = labels.select("node", F.col("root").alias("before"))
        if new.join(old, "node").where(F.col("root") != F.col("before")).isEmpty():
            return new
        labels = new


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key that is
    reachable over links of at most ``max_bits`` bits, the own one included) of every row."""
    docs = staged(fingerprints(df, key, text, shingle), "fingerprints")
    nodes = staged(docs.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = components(links(nodes, max_bits))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = staged(rooted.join(lowest, "root").select(F.col("fp").alias("node"), "component_id"), "components")
    return docs.join(of_fp, docs["fp"] == of_fp["node"]).select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut into words before each run of the space mark (no piece of a model that
splits by white space has the mark behind another symbol, which is checked), each
distinct word is encoded once per worker, and the encoding of all new words of a batch
runs together on flat numpy arrays: one array of symbol ids and one of word numbers.
Every round takes the best pair rank of each word (a segmented minimum), merges its
occurrences from the left at once, and compacts the arrays, until no pair remains.

The order equals that of the library's queue (best score first, then leftmost). Where a
merge can make a pair that ranks before its own (seen by looking the new neighbours
up), only the leftmost occurrence is merged in that round.

Edge cases: null and empty texts have no ids; symbols outside the vocabulary become the
ids of their UTF-8 bytes; repeated rows are encoded alike; an empty table gives an empty
table; all input columns are kept, under any names (outputs are named by parameters;
a clash raises ``ValueError`` unless the column is to be replaced).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listing_etl.llm.common import append_columns, prepare, slices

MARK = "▁"
_NONE = np.iinfo(np.int32).max
_SHIFT = 22                       # symbol ids and code points behind them fit in 22 bits
_LONE = re.compile("[\udc80-\udcff]")
#: Bytes of the words that a Python worker keeps encoded within a task before it starts anew.
CACHE_BYTES = 32 << 20
#: Symbols that one round of merges works on at most (a longer word is taken alone).
ROUND_SYMBOLS = 500_000


class PieceCodec:
    """Encoder and decoder of one BPE model file with byte fallback."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and the space mark in front is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a model with the identity normalizer is needed")
        kind = pb.ModelProto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        pieces = [p.piece for p in model.pieces]
        self.size = len(pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses the border of two words")
        self.byte_id = np.zeros(256, dtype=np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
        # symbols: pieces by id, any other character by size + code point
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        by_score = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        rank = {i: by_score[model.pieces[i].score] for i in normal.values()}
        keys, made, ranks = [], [], []
        symbol = lambda s: int(self.of_char[ord(s)]) if len(s) == 1 else normal.get(s)
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    keys.append((a << _SHIFT) | b)
                    made.append(i)
                    ranks.append(rank[i])
        self._hash_table(np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int32), np.array(made, dtype=np.int32))
        # a rank is careful if a piece that ranks no later begins or ends with one of its pieces
        self.careful = np.zeros(len(by_score), dtype=bool)
        for q, i in normal.items():
            for k in range(1, len(q)):
                for p in (q[:k], q[k:]):
                    if p in normal and rank[normal[p]] >= rank[i]:
                        self.careful[rank[normal[p]]] = True
        self._decode_table(model, kind)
        self.forget()

    # -- encoding ---------------------------------------------------------

    def forget(self) -> None:
        """Drop the encoded words (at the end of a task: the worker goes on living)."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.flat: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def _hash_table(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """Open addressing over eight times as many places; ``probes``: the longest chain."""
        self.bits = int(8 * len(keys)).bit_length()
        slot = np.full(1 << self.bits, -1, dtype=np.int64)
        at, rest, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(rest):
            free = rest[slot[at[rest]] < 0]
            slot[at[free]] = free            # of several with one place the last one stays
            rest = rest[slot[at[rest]] != rest]
            at[rest] = (at[rest] + 1) & (len(slot) - 1)
            self.probes += 1
        used = slot >= 0
        self.keys = np.where(used, keys[slot], -1)
        self.ranks = np.where(used, ranks[slot], _NONE).astype(np.int32)
        self.made = np.where(used, made[slot], -1).astype(np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``_NONE``: no merge) and merged symbol of each pair."""
        want = (left.astype(np.int64) << _SHIFT) | right
        at = self._place(want)
        found = self.keys[at]
        rest = np.flatnonzero((found != want) & (found >= 0))
        for _ in range(self.probes):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            found[rest] = self.keys[at[rest]]
            rest = rest[(found[rest] != want[rest]) & (found[rest] >= 0)]
        hit = found == want
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.made[at], -1)

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All merge rounds; returns the final symbols with their word numbers, by word."""
        done_s, done_w = [], []
        rank = np.full(len(sym), _NONE, dtype=np.int32)
        made = np.full(len(sym), -1, dtype=np.int32)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._pairs(sym[:-1], sym[1:])
            last = np.flatnonzero(word[:-1] != word[1:])
            rank[last] = _NONE
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            ended = best == _NONE
            if ended.any():
                gone = np.repeat(ended, count)
                done_s.append(sym[gone])
                done_w.append(word[gone])
                keep = ~gone
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                count, best = count[~ended], best[~ended]
                if not len(sym):
                    break
                first = np.r_[0, np.cumsum(count)[:-1]]
            at = np.flatnonzero(rank == np.repeat(best, count))
            # of overlapping occurrences every second one merges, counted from the left of each run
            start = np.r_[True, at[1:] != at[:-1] + 1]
            run = np.flatnonzero(start)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            hot = self.careful[rank[at]]
            if hot.any():
                at = self._leftmost_only(sym, word, rank, made, at, hot)
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            moved = np.zeros(len(sym), dtype=bool)
            moved[at] = True
            sym, word, rank, made, moved = sym[keep], word[keep], rank[keep], made[keep], moved[keep]
            moved[:-1] |= moved[1:]
            new = np.flatnonzero(moved)
            rank[new] = _NONE
            new = new[new < len(sym) - 1]
            new = new[word[new] == word[new + 1]]
            rank[new], made[new] = self._pairs(sym[new], sym[new + 1])
        if not done_s:
            return sym, word
        sym, word = np.concatenate(done_s), np.concatenate(done_w)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _leftmost_only(self, sym, word, rank, made, at, hot) -> np.ndarray:
        """Drops all but the first merge of the words in which a merge makes a pair that
        does not rank behind it: the library would take that pair before the next one."""
        look = at[hot]
        here, mine, new = word[look], rank[look], made[look]
        bad = np.zeros(len(look), dtype=bool)
        ok = look > 0
        before = np.where(ok, look - 1, 0)
        ok &= word[before] == here
        bad |= ok & (self._pairs(sym[before], new)[0] <= mine)
        after = look + 2
        ok = after < len(sym)
        after = np.where(ok, after, 0)
        ok &= word[after] == here
        bad |= ok & (self._pairs(new, sym[after])[0] <= mine)
        # neighbours that merge in the same round
        if len(look) > 1:
            ok = (look[1:] == look[:-1] + 2) & (here[1:] == here[:-1])
            both = self._pairs(new[:-1], new[1:])[0] <= mine[1:]
            bad[1:] |= ok & both
        if not bad.any():
            return at
        only = np.unique(here[bad])
        mine = word[at]
        first = np.r_[True, mine[1:] != mine[:-1]]
        return at[first | ~np.isin(mine, only)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym, word = self._merge(self.of_char[points], np.repeat(np.arange(len(words), dtype=np.int32), size))
        wide = sym >= self.size
        if wide.any():  # characters that no piece holds: their UTF-8 bytes
            point = sym - self.size
            n = np.where(wide, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
            at = np.repeat(np.arange(len(sym)), n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            left = n[at] - 1 - nth                     # bytes that follow this one
            byte = (point[at] >> (6 * left)) & 0x3F | 0x80
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n[at]]
            byte = np.where(nth == 0, (point[at] >> (6 * left)) | lead, byte)
            sym = np.where(wide[at], self.byte_id[np.where(wide[at], byte, 0)], sym[at])
            word = word[at]
        return sym.astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, in rounds of bounded size."""
        part, total = [], 0
        for w in [*words, None]:
            if part and (w is None or total + len(w) > ROUND_SYMBOLS):
                ids, n = self._encode_words(part)
                base = len(self.known)
                self.known.update(zip(part, range(base, base + len(part))))
                self.flat.append(ids)
                self.lengths.append(n)
                self.held += ids.nbytes + n.nbytes + sum(map(sys.getsizeof, part)) + 120 * len(part)
                part, total = [], 0
            if w is not None:
                part.append(w)
                total += len(w)

    _split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat int32 ids of all texts, and the offsets at which each text begins."""
        if self.held > CACHE_BYTES:
            self.forget()
        words: list[str] = []
        per_text = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                t = t.replace(" ", MARK)
                w = self._split(MARK + t if self.prefix else t)
                words += w
                per_text[i] = len(w)
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        self._learn([w for w in dict.fromkeys(words) if w not in self.known])
        if len(self.flat) > 1:
            self.flat, self.lengths = [np.concatenate(self.flat)], [np.concatenate(self.lengths)]
        flat, n = self.flat[0], self.lengths[0]
        begin = np.cumsum(n) - n
        at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        size = n[at]
        ends = np.cumsum(size)
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[at] - (ends - size), size)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(per_text)]]
        return ids, bounds

    # -- decoding ---------------------------------------------------------

    def _decode_table(self, model, kind) -> None:
        """Bytes of each id; a byte piece stands for its byte, control pieces for nothing."""
        out = []
        for p in model.pieces:
            if p.type == kind.BYTE:
                out.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kind.CONTROL:
                out.append(b"")
            elif p.type == kind.UNKNOWN:
                out.append(model.trainer_spec.unk_surface.encode())
            else:
                out.append(p.piece.replace(MARK, " ").encode())
        self.piece_bytes = np.array(out, dtype=object)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of flat ids between consecutive bounds. Each byte that is no UTF-8 becomes
        U+FFFD; the space that encoding put in front is taken off."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        parts = self.piece_bytes[ids].tolist()
        texts = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            t = _LONE.sub("\ufffd", b"".join(parts[a:b]).decode("utf-8", "surrogateescape"))
            texts.append(t[1:] if self.prefix and t.startswith(" ") else t)
        return texts


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """The codec of a model file, made once per Python worker."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def _add(df: DataFrame, name: str, kind: str):
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the column {name} exists already; name another")
    return append_columns(df, f"`{name}` {kind}")


def encode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the piece ids of the whole column ``text`` in a column ``ids`` array<int>.
    ``model_file`` must exist on every executor (it is a parameter, never shipped)."""
    prepare(df.sparkSession)
    schema = _add(df, ids, "array<int>")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in slices(batches, 1 << 20):
            flat, bounds = c.encode(b.column(at).to_pylist())
            col = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, ids])
        c.forget()

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text that its column ``ids`` (array<int>; null: empty) stands for.
    Null ids inside an array stand for nothing."""
    prepare(df.sparkSession)
    schema = _add(df, text, "string")
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for b in slices(batches, 1 << 20):
            col = b.column(at)
            flat = col.flatten()
            size = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
            bounds = np.r_[0, np.cumsum(size)]
            if flat.null_count:
                real = np.asarray(flat.is_valid())
                bounds = np.r_[0, np.cumsum(real)][bounds]
                flat = flat.drop_null()
            texts = c.decode(np.asarray(flat, dtype=np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, and SHA-256 of the ids and of the decoded text of each row."""
    narrow = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids = encode(narrow, model_file, "text", "ids").select("key", "ids")
    both = decode(ids, model_file, "ids", "decoded")
    return both.select(
        F.col("key").alias(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

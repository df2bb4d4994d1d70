"""Byte-level BPE encoding and decoding in numpy.

Pretokens that the cache lacks are encoded together: those of near length share a matrix with
one row each; in each round every row merges its leftmost pair of least rank, which a hashed
table of pairs gives, and rows move together over the gap (and leave when nothing merges).  A
long pretoken is a matrix of one row, in which a round merges the places of the least pair from
left to right, up to one that makes a pair of smaller rank: the same merges in the same order.

Defined results: a null text counts as empty and gives no ids; a null doc_id is kept.
Repeated rows get equal results; an empty table gives no rows.  Only doc_id and the text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_bytes
from .packing import vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Pretokens over this many bytes are matrices of one row.
LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> merged id, by open addressing in arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.shift = np.uint64(64 - max(4, (4 * max(1, len(pairs))).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.last = np.int64(size - 1)
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        at = self._place(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of those that want one place, one gets it
            got = self.keys[at] == keys
            self.values[at[got]] = values[got]
            keys, values, at = keys[~got], values[~got], (at[~got] + 1) & self.last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where there is no such pair (or an id is negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        at = self._place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.last
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = 400_000):
        import regex

        self.ranks = ranks
        # tiktoken's white space is the Unicode property; Python's \s holds a few controls more
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.byte_id = np.full(256, -1, np.int32)
        for i in range(256):
            self.byte_id[i] = ranks.get(bytes([i]), -1)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
        self.table = PairTable(pairs)
        #: Of each token, the least rank of a pair that it is in.
        self.least = np.full(max(ranks.values()) + 1, NONE, np.int32)
        for (left, right), rank in pairs.items():
            self.least[left], self.least[right] = min(self.least[left], rank), min(self.least[right], rank)
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.cache: dict[str, bytes] = {}
        self.cached = cached

    def merge_row(self, piece: bytes) -> bytes:
        """Ids (little-endian, 32 bits) of one long piece."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.table.get(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:  # of places that follow one another, the first, third, ... merge
                each = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, each, 0))
                at = at[(each - first) % 2 == 0]
            if self.least[best] < best and len(at) > 1:
                before = np.where(np.diff(at, prepend=-9) == 2, best, ids[at - 1])
                before[at == 0] = -1
                after = np.append(ids, -1)[at + 2]
                merged = np.full(len(at), best)
                smaller = np.flatnonzero((self.table.get(before, merged) < best) | (self.table.get(merged, after) < best))
                at = at[: smaller[0] + 1 if len(smaller) else None]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            at = at - np.arange(len(at))
            for near in (at[at < len(rank)], at[at > 0] - 1):
                rank[near] = self.table.get(ids[near], ids[near + 1])
        return ids.astype("<i4").tobytes()

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces of 2 to `width` bytes, one matrix row each."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < length[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.table.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row = np.arange(n)  # of each matrix row, its piece
        out: list[bytes] = [b""] * n
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for r, own, m in zip(row[done].tolist(), ids[done], (ids[done] >= 0).sum(1).tolist()):
                    out[r] = own[:m].tobytes()
                going = ~done
                ids, rank, row, at, best = ids[going], rank[going], row[going], at[going], best[going]
            if not len(row):
                return out
            every = np.arange(len(row))
            ids[every, at] = best
            move = np.arange(ids.shape[1] - 1) > at[:, None]  # places after the merged one close the gap
            left = np.where(move, ids[:, 1:], ids[:, :-1])
            ids = np.concatenate([left, np.full((len(row), 1), -1, np.int32)], 1)
            rank = np.concatenate([np.where(move[:, : rank.shape[1] - 1], rank[:, 1:], rank[:, :-1]), np.full((len(row), 1), NONE, np.int32)], 1)
            right = np.where(at + 1 < ids.shape[1], ids[every, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            rank[every, np.minimum(at, rank.shape[1] - 1)] = self.table.get(best, right)
            inner = np.flatnonzero(at > 0)
            rank[inner, at[inner] - 1] = self.table.get(ids[inner, at[inner] - 1], best[inner])
            longest = int((ids >= 0).any(0).sum())
            if longest < ids.shape[1] and longest >= 2:
                ids, rank = np.ascontiguousarray(ids[:, :longest]), np.ascontiguousarray(rank[:, : longest - 1])

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self.merge_row(p)
            else:
                buckets.setdefault(4 * -(-len(p) // 4) if len(p) <= 32 else 1 << (len(p) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for low in range(0, len(members), step):
                some = members[low : low + step]
                for i, ids in zip(some, self.merge_rows([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        split = [self.pattern.findall(t) for t in texts]
        cache = self.cache
        missing = list({p for ps in split for p in set(ps).difference(cache)})
        if missing:
            new = dict(zip(missing, self.merge([p.encode() for p in missing])))
            if len(cache) < self.cached:
                cache.update(new)
            else:
                new.update((p, cache[p]) for ps in split for p in ps if p in cache)
                cache = new
        return [b"".join(map(cache.__getitem__, ps)) for ps in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(vocabulary: str, pattern: str) -> BytePairEncoder:
    """One for each worker process, vocabulary and pattern."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = BytePairEncoder(read_ranks(vocabulary_path(vocabulary)), pattern)
    return _ENCODERS[vocabulary, pattern]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, ids (array of ints) of every row."""
    return _through(docs, vocabulary, pattern, text, digests=False)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: its ids, and what they decode to."""
    return _through(docs, vocabulary, pattern, text, digests=True)


def _through(docs: DataFrame, vocabulary: str, pattern: str | None, text: str, digests: bool) -> DataFrame:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in slices(batches, 1, 2 << 20):
            found = own.encode([str(t, "utf-8", "replace") for t in batch.column(1).to_pylist()])
            if digests:
                yield pa.record_batch(
                    [batch.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in found], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.record_batch([batch.column(0), pa.array([np.frombuffer(x, "<i4") for x in found], pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, schema)


def decode(rows: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """doc_id and data (bytes) of rows with an array of ids; null ids give null."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, pattern)
        for batch in batches:
            data = [None if x is None else b"".join(own.token[i] for i in x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(of, "doc_id long, data binary")

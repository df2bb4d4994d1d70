"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes proposes cuts, which move to the next white space
(or character), so that equal passages get equal chunks wherever they stand.  From each chunk
on, and up to each chunk, the fewest neighbouring chunks that hold a passage of `min_words`
words are a window, and get a digest.  A window that an earlier document has whole (smaller doc_id), or that its own
document has whole before it, is a repeat, and its chunks are taken out.  So all that goes
stands in a passage of that length in one earlier place; chunks that are known from different
places stay.  Lengths are counted in characters, `WORD` to a word; those of scripts written
without spaces count as more.

Defined results: a null text stays null, an empty one empty.  Documents without doc_id are
last in order and are compared with no other document, so only their own repeats go.  Rows
that share a doc_id are one document: each keeps what is first in it.  Extra columns stay as
they are, whatever their names; of the three new columns, those that docs has already are left
out.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused
from .common import small_batches, text_bytes

GEAR = np.array([int.from_bytes(blake2b(bytes([i]), digest_size=2, person=b"gear").digest(), "little") for i in range(256)], np.uint16)
#: One in so many places is proposed as a cut.
EVERY = 30
LEAST, MOST = 8, 256
#: A cut moves at most so far to white space.
REACH = 24
#: Characters of a typical word and its space.
WORD = 6.4
#: Characters that a character counts for, by its first byte in UTF-8: ideographs and kana take
#: some two to a word, Hangul syllables some three with their space; later bytes count nothing.
UNITS = np.ones(256, np.int64)
UNITS[0x80:0xC0] = 0
UNITS[0xE3:0xEA] = UNITS[0xF0:0xF8] = 3
UNITS[0xEA:0xEE] = 2


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of data, ascending; the last is len(data)."""
    n = len(data)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    byte = np.frombuffer(data, np.uint8)
    gear = GEAR[byte]
    for step in (1, 2, 4, 8):  # the recursive hash (h << 1) + gear, 16 terms by doubling
        more = gear.copy()
        more[step:] += gear[:-step] << np.uint16(step)
        gear = more
    at = np.flatnonzero(gear < 65536 // EVERY) + 1
    at = at[at < n]
    if len(at):
        space = np.flatnonzero((byte == 32) | (byte == 10))
        ahead = np.append(space, 2 * n + REACH)[np.searchsorted(space, at)] + 1
        at = np.where(ahead - at <= REACH, ahead, at)
    while True:  # never inside a character
        at = at[at < n]
        inside = (byte[at] & 0xC0) == 0x80
        if not inside.any():
            break
        at = at + inside
    at = np.unique(at)
    # a cut needs room before it; this looks at its neighbours only, so chunks fall back in step
    at = at[np.diff(at, prepend=-LEAST) >= LEAST]
    ends = np.append(at, n)
    gap = np.diff(ends, prepend=0)
    if gap.max() > MOST:
        times = -(-gap // MOST)
        owner = np.repeat(np.arange(len(ends)), times)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        ends = np.minimum((ends - gap)[owner] + (within + 1) * MOST, ends[owner])
        while True:
            inside = (ends < n) & ((byte[np.minimum(ends, n - 1)] & 0xC0) == 0x80)
            if not inside.any():
                break
            ends = ends + inside
        ends = np.unique(ends)
    return ends


def windows(data: bytes, min_words: int) -> tuple[list[int], list[tuple[int, int]], list[bytes]]:
    """Ends of the chunks; the windows (first chunk, and the one after the last) in order; and
    their 16-byte digests.  In a run of chunks that is long enough, each chunk is in a window
    of the run: one that starts with it, or else one that ends where the run does."""
    ends = cuts(data)
    if not len(ends):
        return [], [], []
    n, least = len(ends), WORD * min_words
    held = np.append(0, np.cumsum(UNITS[np.frombuffer(data, np.uint8)])[ends - 1])
    last = np.searchsorted(held, held[:-1] + least)
    first = np.searchsorted(held, held[1:] - least, side="right") - 1
    ahead, back = np.flatnonzero(last <= n), np.flatnonzero(first >= 0)
    code = np.unique(np.concatenate([ahead * (n + 1) + last[ahead], first[back] * (n + 1) + back + 1]))
    found = list(zip((code // (n + 1)).tolist(), (code % (n + 1)).tolist()))
    at = ends.tolist()
    starts = [0, *at]
    return at, found, [blake2b(data[starts[i] : starts[j]], digest_size=16).digest() for i, j in found]


def _digests(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """id, d1, d2: each document's different windows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, count, found = batch.column(0), [], []
            for t in batch.column(1):
                own = dict.fromkeys(windows(t.as_py(), min_words)[2])
                count.append(len(own))
                found.extend(own)
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(count)), count))
            yield pa.record_batch([ids.take(owner), pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], ["id", "d1", "d2"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), text_bytes(text).alias("t")).mapInArrow(of, "id long, d1 long, d2 long")


def seen_earlier(docs: DataFrame, text: str = "text", min_words: int = 15) -> DataFrame:
    """id, seen: of each document, the (first halves of) digests that an earlier one has.

    A digest's documents are counted by partial sums before the shuffle; the join with the
    repeated digests is one that adaptive execution can split where a digest is hot.
    """
    every = _digests(docs.where(F.col("doc_id").isNotNull()), text, min_words)
    repeated = every.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = every.join(repeated, ["d1", "d2"]).where(F.col("id") > F.col("first"))
    return late.groupBy("id").agg(F.collect_set("d1").alias("seen"))


def remove(data: bytes, seen: set[int], min_words: int) -> tuple[bytes, list[tuple[int, int]], int, int]:
    """What is left of data, the spans (bytes) taken out, the number of chunks and of those
    taken out."""
    ends, found, digests = windows(data, min_words)
    own: dict[bytes, int] = {}
    runs: list[list[int]] = []  # of chunks
    for (i, j), digest in zip(found, digests):
        if int.from_bytes(digest[:8], "little", signed=True) in seen or own.setdefault(digest, j) <= i:
            if runs and i <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], j)
            else:
                runs.append([i, j])
    starts = [0, *ends]
    spans = [(starts[i], starts[j]) for i, j in runs]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), spans, len(ends), sum(j - i for i, j in runs)


def dedup(docs: DataFrame, text: str = "text", min_words: int = 15) -> DataFrame:
    """All columns and rows of docs, with repeats taken out of the text, and three more
    columns: cut_spans (start and end bytes in the old text), n_chunks, n_cut."""
    small_batches(docs.sparkSession)
    names = docs.columns
    key, seen, out = unused(docs, "key", "seen", "out")
    earlier = seen_earlier(docs, text, min_words).toDF(key, seen)
    both = docs.join(earlier, docs["doc_id"].cast("long") == earlier[key], "left")

    @F.pandas_udf("struct<text: string, cut_spans: array<struct<start: long, end: long>>, n_chunks: long, n_cut: long>")
    def of(texts, seens):
        import pandas as pd

        rows = []
        for t, s in zip(texts, seens):
            if t is None:
                rows.append((None, [], 0, 0))
                continue
            left, spans, n, gone = remove(bytes(t), set() if s is None else set(s.tolist()), min_words)
            rows.append((str(left, "utf-8", "replace"), [{"start": a, "end": b} for a, b in spans], n, gone))
        return pd.DataFrame(rows, columns=["text", "cut_spans", "n_chunks", "n_cut"])

    done = both.withColumn(out, of(F.col(text).cast("binary"), F.col(seen)))
    kept = [F.col(f"{out}.text").alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return done.select(*kept, *[F.col(f"{out}.{c}").alias(c) for c in ("cut_spans", "n_chunks", "n_cut") if c not in names])

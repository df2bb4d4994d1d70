"""Packing token streams into fixed-length sequences by first-fit decreasing.

Documents are cut into pieces of at most one sequence; seeded-random groups of documents are
packed independently.  In a group, pieces go longest first into the first bin with room, which
a tournament tree over the bins' free room finds in logarithmic time.

Defined results: a null or empty text is the end id alone (one piece).  A null doc_id is kept
as null.  Repeated rows are packed as often as they stand there, each in a group of its own
drawing, so that they do not meet in one.  An empty table gives no rows.  Only doc_id and the
text are read, so other columns cannot clash.  Which documents share a group depends on their
place in the table's partitions, and on nothing else.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches, text_bytes

#: A vocabulary file; the name of an installed public one, or a path.
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Lookup(dict):
    """A bounded cache and, in `extra`, what it has no room for."""

    extra: dict = {}

    def __missing__(self, key):
        return self.extra[key]


class WordTokenizer:
    """Token ids of whole texts, as the tokenizers library gives them without special tokens,
    by looking up the vocabulary's pieces in a cache.

    The vocabulary's normaliser and splitter never look across white space, so a text's ids
    are its words' ids in a row.  Words of plain Latin letters, digits and marks are lower-cased
    and cut as the splitter would; any other word goes to the library whole.  The cache stops
    growing at a bound and holds short pieces only.
    """

    #: Characters that the normaliser only lower-cases.
    PLAIN = "\x21-\x7eÀ-ÖØ-öø-ÿ"
    ALL_PLAIN = re.compile(f"[{PLAIN}\t-\r ]*")
    #: What makes a word one for the library: another character, or the start of a special token.
    ODD = re.compile(f"[^{PLAIN} ]|<\\|")
    PIECE = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z0-9ß-öø-ÿ\s]+")
    # str.split() also splits at these, the vocabulary's pattern does not
    NOT_SPACE = re.compile("[\x1c-\x1f]")
    #: Longer texts are taken in spans that end before white space.
    SPAN = 1 << 20
    SPANS = re.compile(r"[\s\S]{1,%d}\S*" % SPAN)
    #: Characters of the longest piece that is kept, and pieces that the library sees at a time.
    SHORT, AT_ONCE = 64, 4096

    def __init__(self, vocabulary: str, pieces: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(vocabulary))
        self.known = Lookup()
        self.most = pieces

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x)}I", *x.ids) for x in found]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of plain pieces: many in one text, each of which the splitter gives back."""
        out: list[bytes] = []
        for i in range(0, len(pieces), self.AT_ONCE):
            part = pieces[i : i + self.AT_ONCE]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            ids, of = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids)
            first = (np.flatnonzero(np.diff(of, prepend=-1)) * 4).tolist()
            if len(first) != len(part):
                raise ValueError("the vocabulary does not split as this tokenizer does")
            out += [ids[a:b] for a, b in zip(first, [*first[1:], len(ids)])]
        return out

    def _pieces(self, text: str, odd: set[str]) -> list[str]:
        """The pieces of a text in order; words for the library are pieces as well, and in `odd`."""
        if self.ALL_PLAIN.fullmatch(text) and "<|" not in text:
            return self.PIECE.findall(text.lower())
        text, out, at = " ".join(text.split()), [], 0
        while found := self.ODD.search(text, at):
            first = max(text.rfind(" ", at, found.start()) + 1, at)
            out += self.PIECE.findall(text[at:first].lower())
            at = text.find(" ", found.end())
            at = len(text) if at < 0 else at
            out.append(text[first:at])
            odd.add(out[-1])
        return out + self.PIECE.findall(text[at:].lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if any(len(t) > self.SPAN for t in texts):
            return [b"".join([self._encode([s])[0] for s in ([t] if self.NOT_SPACE.search(t) else self.SPANS.findall(t))]) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        odd: set[str] = set()
        split = [None if self.NOT_SPACE.search(t) else self._pieces(t, odd) for t in texts]
        known = self.known
        missing = set().union(*[ps for ps in split if ps]).difference(known)
        if missing:
            plain, other = list(missing - odd), list(missing & odd)
            new = dict(zip(plain + other, self._ids(plain) + self._library(other)))
            if len(known) < self.most:
                known.update({p: ids for p, ids in new.items() if len(p) <= self.SHORT})
            known.extra = new
        of = known.__getitem__
        return [self._library([t])[0] if ps is None else b"".join(map(of, ps)) for t, ps in zip(texts, split)]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(vocabulary: str) -> WordTokenizer:
    """One for each worker process and vocabulary."""
    if vocabulary not in _TOKENIZERS:
        _TOKENIZERS[vocabulary] = WordTokenizer(vocabulary)
    return _TOKENIZERS[vocabulary]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, room: int = 2048, end_id: int = 1, text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, place: every document's ids and the end id,
    cut into pieces of `room` ids and a rest.  place numbers the rows: partition and row in it."""
    end = int(end_id).to_bytes(4, "little")
    small_batches(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(vocabulary).encode
        place = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 1, 2 << 20):
            out: list[tuple] = []
            ids = encode([str(t, "utf-8", "replace") for t in batch.column(1).to_pylist()])
            for doc, got in zip(batch.column(0).to_pylist(), ids):
                got += end
                n = len(got) // 4
                for at in range(0, n, room):
                    part = got[4 * at : 4 * (at + room)]
                    out.append((doc, at, len(part) // 4, zlib.crc32(part), n, place))
                place += 1
            yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long")


class Tournament:
    """Bins in a row, all empty; each inner node holds the most free room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room, self.tree = room, [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put `size` into the first bin that has room: the bin, and what it held before."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        free, found = tree[at], at - self.leaves
        tree[at] = free - size
        while at > 1:
            at //= 2
            most = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == most:
                break
            tree[at] = most
        return found, self.room - free


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths come longest first and none exceeds `room`."""
    tree = Tournament(len(lengths), room)
    placed = [tree.place(n) for n in lengths]
    return [p[0] for p in placed], [p[1] for p in placed]


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, room: int = 2048, end_id: int = 1, group: int = 1 << 14, seed: int = 3, text: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset.  Documents of about `group` pieces in all are packed
    together; a seeded hash of a document's place draws its group."""
    parts = cut(pieces(docs, vocabulary, room, end_id, text))
    groups = max(1, -(-parts.count() // group))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "place", "start"], ascending=[False, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), room)
        return pdf[columns].assign(sequence_id=np.array(bins, np.int64) * groups + pdf["group"].to_numpy(), offset=np.array(offsets, np.int64)).astype({"doc_id": "Int64"})

    drawn = parts.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "place"), F.lit(groups)))
    return drawn.groupBy("group").applyInPandas(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

"""Nearest neighbours by additive quantisation.

Unit vectors are coded as sums of one full-dimensional code word from each of several
codebooks; a beam search picks the words, and the squared length of the sum is kept beside
the codes.  A query's table of inner products with all code words scores any code by look-ups;
the best of a query are then scored exactly, in double precision, on the original vectors.

Equal vectors are one candidate: of each different vector the few smallest ids are kept, as
many as an answer can hold, which loses nothing, and a vector that a third of all rows hold
costs no more than any other.  Codes and queries are dealt in blocks on a grid; no vector of
the corpus reaches the driver but for a bounded training sample.

Defined results: vectors that are null, empty, all zeros, or hold a null or non-finite
component take no part, nor do those of another dimension than most (a cosine with them is not
defined), nor rows whose id is null.  Fewer candidates than asked for are returned as far as they go.  Repeated rows (equal id
and vector) count once.  An empty table gives no rows.  Only the id and the vector are read,
so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in double precision; safe for very large and small numbers."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _kmeans(rows: np.ndarray, k: int, rounds: int, draw: np.random.Generator) -> np.ndarray:
    centres = rows[np.sort(draw.choice(len(rows), min(k, len(rows)), replace=False))].copy()
    if len(centres) < k:  # few rows: pad with small noise
        more = draw.standard_normal((k - len(centres), rows.shape[1])) * 0.01
        centres = np.concatenate([centres, more])
    for _ in range(rounds):
        near = (rows @ centres.T * 2 - np.einsum("ij,ij->i", centres, centres)).argmax(1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        full = count > 0
        centres[full] = sums[full] / count[full, None]
        if (~full).any():  # an empty centre takes a row that is far from its own
            far = np.argsort(-((rows - centres[near]) ** 2).sum(1), kind="stable")[: int((~full).sum())]
            centres[np.flatnonzero(~full)[: len(far)]] = rows[far]
    return centres


@dataclass
class Quantiser:
    """books: codebooks x words x dimensions."""

    books: np.ndarray
    beam: int

    @classmethod
    def fit(cls, rows: np.ndarray, books: int = 16, words: int = 256, rounds: int = 8, beam: int = 4, seed: int = 5) -> Quantiser:
        """Codebooks one after another, each over what the earlier ones leave."""
        draw = np.random.Generator(np.random.PCG64(seed))
        rest, out = rows.astype(np.float64), []
        for _ in range(books):
            book = _kmeans(rest, words, rounds, draw)
            near = (rest @ book.T * 2 - np.einsum("ij,ij->i", book, book)).argmax(1)
            rest = rest - book[near]
            out.append(book)
        return cls(np.array(out).astype(np.float32), beam)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and the squared lengths of the sums, by beam search: of each row the
        `beam` best sums so far go on, each with every word of the next book."""
        n, books, words = len(rows), *self.books.shape[:2]
        rows = rows.astype(np.float32)
        rest = rows[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            # |rest - word|^2 without the part that is equal for a row's own beam entry
            error = (rest**2).sum(2)[:, :, None] - 2 * rest @ book.T + (book**2).sum(1)
            flat = error.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            entry, word = best // words, best % words
            each = np.arange(n)[:, None]
            codes = np.concatenate([codes[each, entry], word[:, :, None].astype(np.uint8)], 2)
            rest = rest[each, entry] - book[word]
        best = (rest**2).sum(2).argmin(1)
        each = np.arange(n)
        total = rows - rest[each, best]
        return codes[each, best], (total**2).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x books x words: inner products."""
        return np.einsum("qd,mwd->qmw", queries.astype(np.float32), self.books)

    @staticmethod
    def scores(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """queries x codes: cosine of the query with the coded sum, by look-ups."""
        out = np.zeros((len(tables), len(codes)), np.float32)
        for m in range(codes.shape[1]):
            out += tables[:, m, :].take(codes[:, m], axis=1)
        return out / np.sqrt(np.maximum(norms, 1e-12))


def _vectors(rows: DataFrame, vec_col: str):
    """The vectors as they are (floats stay floats), but with no negative zeros, so that equal
    ones are equal as keys too."""
    kind = "float" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    return F.transform(F.col(vec_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))


def _hashes(vec):
    """Two hashes of a vector, by which equal ones meet: 128 bits instead of the vector itself."""
    return F.xxhash64(F.lit(1), vec).alias("h1"), F.xxhash64(F.lit(2), vec).alias("h2")


def candidates(rows: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """h1, h2, key (smallest id), ids (the k + 1 smallest), vec of each different vector that takes
    part.  The vector travels with its smallest ids only."""
    vec = _vectors(rows, vec_col)
    ok = F.col(id_col).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vec, lambda x: x != 0)
    valid = rows.where(ok).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), *_hashes(vec))
    # the row limit is applied before the shuffle too, so a vector that many rows hold sends few
    first = Window.partitionBy("h1", "h2").orderBy("id")
    few = valid.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1)
    out = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.first("vec").alias("vec"))
    return out.select("h1", "h2", F.element_at("ids", 1).alias("key"), "ids", "vec")


def _blocks(rows: DataFrame, size: int, total: int, seed: int) -> DataFrame:
    """A column `block`: about `size` rows each, by a seeded hash."""
    n = max(1, -(-total // size))
    return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n)).cast("int"))


def search(
    rows: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, shortlist: int = 512, sample: int = 8192, books: int = 16, words: int = 256, beam: int = 4, query_block: int = 512, code_block: int = 1 << 15
) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which is_query(id column) holds, the k
    nearest other rows by cosine.  sample: how many vectors the codebooks are fitted on."""
    spark = rows.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    found = candidates(rows, id_col, vec_col, k)
    usual = found.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None:
        return spark.createDataFrame([], empty)
    found = cut(found.where(F.size("vec") == usual["n"]))
    total = found.count()
    few = found.select("vec", "key").orderBy(F.xxhash64(F.lit(1), "key"), "key").limit(sample).select("vec").toArrow()
    model = Quantiser.fit(unit(np.array(few.column("vec").to_pylist(), np.float64).reshape(-1, usual["n"])), books, words, beam=beam)
    shared = spark.sparkContext.broadcast(model)  # books x words x dimensions numbers

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                vectors = np.array(part.column(1).to_pylist(), np.float64).reshape(-1, usual["n"])
                codes, norms = shared.value.encode(unit(vectors))
                yield pa.record_batch([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms.astype(np.float64)), part.column(2)], ["key", "code", "norm", "block"])

    coded = _blocks(found.select("key", "vec"), code_block, total, 2).mapInArrow(code, "key long, code binary, norm double, block int")
    packed = coded.groupBy("block").agg(F.collect_list(F.struct("key", "code", "norm")).alias("codes"))

    # every distinct vector that a query holds asks once
    vec = _vectors(rows, vec_col)
    more = rows.where(is_query(F.col(id_col))).select(F.col(id_col).cast("long").alias("query_id"), vec.alias("vec"), *_hashes(vec)).dropDuplicates(["query_id", "h1", "h2"])
    queries = cut(more.join(found.select("h1", "h2", "key"), ["h1", "h2"]).select("query_id", "key", "vec"))
    distinct = queries.select("key", "vec").dropDuplicates(["key"])
    n_queries = distinct.count()
    if not n_queries:
        return spark.createDataFrame([], empty)
    n_blocks = max(1, -(-n_queries // query_block))
    asking = _blocks(distinct, query_block, n_queries, 3).groupBy("block").agg(F.collect_list(F.struct("key", "vec")).alias("queries")).withColumnRenamed("block", "q")
    grid = packed.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    n_code = max(1, -(-total // code_block))
    gather = int(np.ceil(np.sqrt(n_code)))  # merged in two steps, so that none takes in all blocks

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for codes, asks, block in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                codes, asks = codes.values, asks.values
                keys = codes.field("key").to_numpy()
                code = np.frombuffer(b"".join(codes.field("code").to_pylist()), np.uint8).reshape(len(keys), -1)
                order = np.argsort(keys, kind="stable")
                keys, code, norm = keys[order], code[order], codes.field("norm").to_numpy()[order]
                vectors = unit(np.array(asks.field("vec").to_pylist(), np.float64).reshape(len(asks), -1))
                tables = shared.value.tables(vectors)
                asked, near, value = [], [], []
                for low in range(0, len(tables), 64):
                    own = Quantiser.scores(tables[low : low + 64], code, norm)
                    top = min(shortlist, len(keys))
                    best = np.argpartition(-own, top - 1, 1)[:, :top] if top < len(keys) else np.tile(np.arange(len(keys)), (len(own), 1))
                    for i, b in enumerate(best):
                        asked.append(asks.field("key")[low + i].as_py())
                        near.append(keys[b])
                        value.append(own[i, b])
                yield pa.record_batch([pa.array(asked, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float32())), pa.array([block % gather] * len(asked), pa.int32())], ["asked", "near", "value", "part"])

    scored = grid.join(asking, "q").select("codes", "queries", "block").mapInArrow(score, "asked long, near array<long>, value array<float>, part int")
    best_of = lambda lists: F.slice(F.array_sort(F.flatten(F.collect_list(lists))), 1, shortlist)
    own = scored.select("asked", "part", F.transform(F.arrays_zip("near", "value"), lambda x: F.struct((-x["value"]).alias("v"), x["near"].alias("key"))).alias("own"))
    merged = own.groupBy("asked", "part").agg(best_of("own").alias("own")).groupBy("asked").agg(best_of("own").alias("own"))
    short = merged.select("asked", F.explode("own").alias("s")).select("asked", F.col("s.key").alias("key"))

    # exact scores on the original vectors, and each vector's ids
    pairs = short.join(distinct.select(F.col("key").alias("asked"), F.col("vec").alias("q")), "asked").join(found, "key")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array(batch.column(i).to_pylist(), np.float64).reshape(batch.num_rows, -1) for i in (2, 3))
            cosine = np.clip(np.einsum("ij,ij->i", unit(a), unit(b)), -1.0, 1.0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cosine)], ["asked", "ids", "score"])

    sure = pairs.select("asked", "ids", "vec", "q").mapInArrow(exact, "asked long, ids array<long>, score double")
    flat = sure.select("asked", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    # one place more than asked for: a query is not its own neighbour
    top = flat.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    top = top.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best"))
    # queries that hold one vector share its answer, each without itself
    out = queries.select("query_id", F.col("key").alias("asked")).join(top, "asked")
    out = out.select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return out.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")

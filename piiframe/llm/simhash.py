"""SimHash near-duplicate classes by a hierarchical index over Gray-ordered fingerprints.

Fingerprints are filed so that near ones meet: under each of `radius + 1` blocks of their bits,
of which two within the radius share one whole (all links are found), or, where likeness of
the shingle sets is asked for, under bands of least hashes of the shingles (a pair that is just
alike enough is found with a stated probability, by as many files whatever the corpus's size).
A file that holds more than `most` is filed again under other bits, and one that has none left
is split into blocks, each pair of which is a file: no pair is lost and no file is large.
Within a file, fingerprints are sorted by Gray rank and a tree is built over them: a node
keeps the bits on which all its members agree (mask and pattern).  Pairs of nodes whose common
bits differ too often are dropped whole, pairs that are bound to link are joined whole, and
pairs that are joined already are left out.  Each file gives one link to its least member for
each other one, never all pairs; components grow from those by alternating star contraction.

Defined results: a null or empty text, or one of white space only, has fingerprint zero,
which links like any other.  A null doc_id gets the smallest doc_id of its component (null
if there is none).  Repeated rows each come back with equal values.  An empty table gives no
rows.  Columns beside doc_id and the text are not read, and those that keep_one returns may have
any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused
from .common import cut, small_batches, text_bytes

BITS = 64
SEED = 42
FANOUT = 8
#: Pairs of nodes that are looked at together.
FRONT = 1 << 17


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: bytes, size: int = 4) -> np.ndarray:
    """XXH64 of each run of `size` words (of the whole sequence if it is shorter)."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, of = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([of(joined, SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, n)
    end = np.cumsum(length + 1) - 1
    first, last = (end - length)[: n - size + 1].tolist(), end[size - 1 :].tolist()
    return np.fromiter((of(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half the hashes; signed, as Spark's long."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 64):  # byte counters of 255 rows, eight to a machine word
        bits = np.unpackbits(hashes[at : at + 255 * 64].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            ones += np.add.reduce(bits[low : low + 255].view(np.uint64), axis=0).view(np.uint8)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, size: int = 4) -> int:
    return majority(shingle_hashes(text, size))


def wide_code(hashes: np.ndarray, words: int) -> list[int]:
    """`words` fingerprints of 64 bits over different shingles, by hashes made from one."""
    out = []
    for i in range(words):
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(mixed ^ (mixed >> np.uint64(32))))
    return out


def least_hashes(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the multipliers in `odd`."""
    out = np.full(len(odd), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(out, np.multiply.outer(odd, hashes[at : at + 2048]).min(1), out=out)
    return out


def fingerprints(docs: DataFrame, text: str = "text", size: int = 4) -> DataFrame:
    """doc_id, fp of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(of, "doc_id long, fp long")


# --- the index ------------------------------------------------------------------------------


def blocks(bits: list[int], n: int) -> list[list[int]]:
    """Split a list of bit positions into n runs of nearly equal length."""
    return [list(map(int, x)) for x in np.array_split(np.array(bits, int), min(n, len(bits)))]


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each code (a row of 64-bit words, the first the highest) in Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    odd = np.cumsum(np.bitwise_count(code), axis=1) - np.bitwise_count(code)  # ones in the words above
    return rank ^ np.where(odd % 2 == 1, np.uint64(2**64 - 1), np.uint64(0))


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(1, dtype=np.int32)


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For item i count[i] times: i, and 0, 1, ... within it."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of classes, in place; a label is the smallest member of its class."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


class GrayIndex:
    """Hierarchical index over groups of codes (one or more words each); only codes of one
    group can link."""

    def __init__(self, group: np.ndarray, code: np.ndarray):
        code = code.reshape(len(group), -1)
        order = np.lexsort((*gray_rank(code).T[::-1], group))
        self.order, code, group = order, code[order], group[order]
        one = np.full(code.shape, 2**64 - 1, np.uint64)
        self.levels = [(group, one, code, np.arange(len(code)), np.ones(len(code), np.int64))]
        while len(group) > 1 and (group[1:] == group[:-1]).any():
            _, mask, pattern, _, _ = self.levels[-1]
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            first = np.flatnonzero(within % FANOUT == 0)
            every = np.bitwise_and.reduceat(pattern, first, axis=0)
            some = np.bitwise_or.reduceat(pattern, first, axis=0)
            shared = np.bitwise_and.reduceat(mask, first, axis=0) & ~(every ^ some)
            group = group[first]
            self.levels.append((group, shared, every & shared, first, np.diff(np.r_[first, len(within)])))

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of positions (in the given order) that link all that is within the radius."""
        base = self.levels[0]
        n, top = len(base[2]), len(self.levels) - 1
        label = np.arange(n)
        for step in range(1, 4):  # neighbours in Gray order often link
            near = np.flatnonzero((_ones(base[2][step:] ^ base[2][:-step]) <= radius) & (base[0][step:] == base[0][:-step]))
            _join(label, near, near + step)
        span = [(np.arange(n), np.arange(1, n + 1))]  # of each node, its codes
        for _, _, _, first, count in self.levels[1:]:
            low, high = span[-1]
            span.append((low[first], high[first + count - 1]))
        roots = np.arange(len(self.levels[top][0]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONT:
                stack.append((level, a[FRONT:], b[FRONT:]))
                a, b = a[:FRONT], b[:FRONT]
            _, mask, pattern, first, count = self.levels[level]
            both = mask[a] & mask[b]
            apart = _ones((pattern[a] ^ pattern[b]) & both)
            keep = apart <= radius
            a, b, both, apart = a[keep], b[keep], both[keep], apart[keep]
            low, high = span[level]
            bound = apart + _ones(~both) <= radius  # whatever the free bits are
            for x in (a[bound], b[bound]):
                owner, at = _spread(high[x] - low[x])
                _join(label, low[a[bound]][owner], low[x][owner] + at)
            rest = ~bound
            a, b = a[rest], b[rest]
            if not level or not len(a):
                continue
            least = np.minimum.reduceat(label, low)
            most = np.maximum.reduceat(label, low)
            open_ = ~((least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b]))
            a, b = a[open_], b[open_]
            owner, at = _spread(count[a] * count[b])
            x, y = first[a][owner] + at // count[b][owner], first[b][owner] + at % count[b][owner]
            keep = x < y if level == 1 else x <= y
            if keep.any():
                stack.append((level - 1, x[keep], y[keep]))
        child = np.flatnonzero(label != np.arange(n))
        return self.order[child], self.order[label[child]]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


class Blocks:
    """All links of one-word codes: files under the blocks of the bits not yet used."""

    columns = ["c_0"]
    #: A file that is too large is filed again so many times, under bits that it has not in common.
    deepest = 3

    def __init__(self, radius: int):
        self.radius = radius

    def masks(self, used: frozenset[int]) -> list[int]:
        free = [b for b in range(BITS) if b not in used]
        return [sum(1 << b for b in part) for part in blocks(free, self.radius + 1)]

    def keys(self, used: frozenset[int]) -> list:
        """One key for each block; files whose keys are equal by chance only share a tree."""
        return [F.xxhash64("parent", F.lit(i), F.col("c_0").bitwiseAND(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(self.masks(used))]

    def spent(self, used: frozenset[int], way: int) -> frozenset[int]:
        """Bits that a file of this block has in common, so that filing it again skips them."""
        mask = self.masks(used)[way]
        return used | {b for b in range(BITS) if mask >> b & 1}


class Bands:
    """Links of texts whose shingle sets are alike to `alike`: files under bands of `rows` least
    hashes, so many that a pair just alike enough shares none with chance `missed`.  The number
    depends on nothing else.  Words of a code, and their radius, are those of wide_code."""

    deepest = 1

    def __init__(self, alike: float, words: int, radius: int, rows: int = 6, missed: float = 0.003, seed: int = 23):
        self.radius, self.rows, self.words = radius, rows, words
        self.count = int(np.ceil(np.log(missed) / np.log(1 - alike**rows)))
        draw = np.random.Generator(np.random.PCG64(seed))
        self.odd = draw.integers(0, 2**64, self.count * rows, np.uint64) | np.uint64(1)
        self.columns = [f"c_{i}" for i in range(words)]
        self.bands = [f"b_{i}" for i in range(self.count)]

    def sign(self, hashes: np.ndarray) -> list[int]:
        """A hash of each band."""
        least = least_hashes(hashes, self.odd).reshape(self.count, self.rows)
        return [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least)]

    def keys(self, used: frozenset[int]) -> list:
        return [F.col(b) for b in self.bands]


def _link(radius: int, words: int, at_once: int = 1 << 16):
    """Rows (key, id, codes) come sorted by key; whole files are gathered up to a bound, then
    indexed.  Of each component within a file all members are linked to that of the least id."""

    def flush(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) > 1:
            label = np.arange(len(ids))
            _join(label, *GrayIndex(np.cumsum(np.r_[0, keys[1:] != keys[:-1]]), codes).forest(radius))
            least = np.full(len(ids), 2**63 - 1)
            np.minimum.at(least, label, ids)
            least = least[label]
            a = np.flatnonzero(ids != least)
            if len(a):
                yield pa.record_batch([pa.array(ids[a]), pa.array(least[a])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, at_once
        for batch in batches:
            own = [batch.column(i).to_numpy() for i in range(2 + words)]
            held.append((own[0], own[1], np.stack(own[2:], 1).view(np.uint64)))
            size += batch.num_rows
            if size >= enough:
                keys, ids, codes = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(keys, keys[-1]))
                yield from flush(keys[:whole], ids[:whole], codes[:whole])
                held, size = [(keys[whole:], ids[whole:], codes[whole:])], len(keys) - whole
                enough = max(at_once, 2 * size)  # a long file is joined few times
        if held:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return run


def forest(rows: DataFrame, filing: Blocks | Bands, most: int = 1 << 17) -> DataFrame:
    """Links (a, b) between ids that join all pairs which the filing brings together and which
    are within its radius.  rows: id, the filing's columns (the code's words) and, for bands,
    their keys; one row for each code.

    A file over `most` is filed again as long as the filing has other bits for it; then its rows
    are dealt to blocks of at most some `most` / 2, and each two blocks meet in a file.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    codes = filing.columns
    total = rows.count()

    def linked(files: DataFrame) -> DataFrame:
        return files.select("key", "id", *codes).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link(filing.radius, len(codes)), "a long, b long")

    out: list[DataFrame] = []
    todo = [(rows.withColumn("parent", F.lit(0).cast("long")), frozenset(), 1)]
    while todo:
        some, used, depth = todo.pop()
        ways = [F.struct(F.lit(i).alias("way"), k.alias("key")) for i, k in enumerate(filing.keys(used))]
        files = some.withColumn("file", F.explode(F.array(*ways))).select("id", *codes, "file.way", "file.key")
        # a large file makes its lot large: counts of few lots show that there is none, or where
        lots = max(64, 8 * total * len(ways) // most)
        lot = F.pmod("key", F.lit(lots))
        large = cut(files.groupBy(lot.alias("lot")).count().where(F.col("count") > most).select("lot"))
        hot = None
        if large.count():
            hot = cut(files.withColumn("lot", lot).join(large, "lot", "left_semi").groupBy("way", "key").count().where(F.col("count") > most))
        if hot is None or not hot.count():
            out.append(linked(files))
            continue
        out.append(linked(files.join(hot, ["way", "key"], "left_anti")))
        if depth >= filing.deepest:
            blocked = files.join(hot, ["way", "key"]).withColumn("last", F.ceil(F.col("count") * 2 / most) - 1)
            blocked = blocked.withColumn("own", F.pmod(F.xxhash64(F.lit(depth), "id"), F.col("last") + 1)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
            key = F.xxhash64("way", "key", F.least("own", "other"), F.greatest("own", "other"))
            out.append(linked(blocked.select("id", *codes, key.alias("key"))))
            continue
        for way in [r["way"] for r in hot.select("way").distinct().collect()]:  # one for each block of bits at most
            again = files.where(F.col("way") == way).join(hot, ["way", "key"], "left_semi")
            todo.append((cut(again.select("id", *codes, F.col("key").alias("parent"))), filing.spent(used, way), depth + 1))
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


# --- components -----------------------------------------------------------------------------


def stars(links: DataFrame) -> DataFrame:
    """node, root of every node in links (a, b) but the roots; a root is the least node that
    its members reach.  Alternating large-star and small-star steps, each written to the
    shared folder; only a count and a checksum a round reach the driver."""

    def lowest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("node").agg(F.min("root").alias("low"))

    edges = cut(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node != root").distinct())
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            return edges
        before = now
        ways = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        large = ways.join(lowest(ways), "node").where("root > node").select(F.col("root").alias("node"), F.least("node", "low").alias("root")).distinct()
        small = large.join(lowest(large), "node")
        small = small.select(F.col("root").alias("node"), F.col("low").alias("root")).unionByName(small.select("node", F.col("low").alias("root")))
        edges = cut(small.where("node != root").distinct())


def classes(docs: DataFrame, text: str = "text", size: int = 4, radius: int = 4, most: int = 1 << 17) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    fps = cut(fingerprints(docs, text, size))
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    links = forest(own.select(F.col("fp").alias("id"), F.col("fp").alias("c_0")), Blocks(radius), most)
    rooted = own.join(stars(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(whole, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- exact similarity -----------------------------------------------------------------------

#: Sets that are compared with one another in one group: rows, and shingles in all.
GROUP_ROWS, GROUP_SHINGLES = 1 << 10, 1 << 19
#: Rows of a component of several groups that each of its groups gets.
PIVOTS = 32
#: Places in the bitmap of rows whose shingles are needed.
PLACES = 1 << 23


def alike_forest(sets: list[np.ndarray], alike: float) -> tuple[list[int], list[int]]:
    """Pairs of positions that link all sets whose Jaccard similarity is `alike` or more.  A set
    is compared with all that are in no component yet, so that dense groups cost few steps."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(size)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    live, live_owner, left = shingle, owner, len(sets)
    mark, free = np.zeros(len(shingle), bool), np.ones(len(sets), bool)
    a: list[int] = []
    b: list[int] = []
    for first in range(len(sets)):
        stack = [first] if free[first] else []
        free[first] = False
        while stack:
            x = stack.pop()
            open_ = np.count_nonzero(free)
            if not open_:
                return a, b
            if 2 * open_ < left:
                keep = free[live_owner]
                live, live_owner, left = live[keep], live_owner[keep], open_
            own = shingle[end[x] - size[x] : end[x]]
            mark[own] = True
            common = np.bincount(live_owner[mark[live]], minlength=len(sets))
            mark[own] = False
            near = np.flatnonzero(free & (common >= alike * (size + size[x] - common) - 1e-9)).tolist()
            free[near] = False
            stack += near
            a += [x] * len(near)
            b += near
    return a, b


def _confirm(alike: float):
    """Rows (key, id, set) come sorted by key; links within each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, a, b = None, [], [], [], []

        def close() -> None:
            if len(ids) > 1:
                label = np.arange(len(ids))
                _join(label, *(np.array(x, int) for x in alike_forest(sets, alike)))
                own = np.array(ids, np.int64)
                least = np.full(len(ids), 2**63 - 1)
                np.minimum.at(least, label, own)
                least = least[label]
                a.extend(own[own != least].tolist())
                b.extend(least[own != least].tolist())

        for batch in batches:
            for k, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != key:
                    close()
                    key, ids, sets = k, [], []
                ids.append(i)
                sets.append(np.frombuffer(s.as_py(), np.uint64))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        close()
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _place(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(PLACES)) + 1


def _sets(docs: DataFrame, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """id, set of the rows of wanted (id, doc_id, text_hash): the different shingles' hashes.
    Only a bitmap of fixed size reaches the driver; it spares the shuffle of all other texts."""
    numbers = wanted.select(_place("doc_id", "text_hash").alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("n")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    bits = np.zeros((PLACES // 32768 + 1, 4096), np.uint8)
    for r in numbers.collect():
        bits[r["n"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits[1:].reshape(-1))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column(2).to_numpy() - 1
            at = np.flatnonzero(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            few = batch.take(pa.array(at))
            found = [np.unique(shingle_hashes(t.as_py(), size)).tobytes() for t in few.column(3)]
            yield pa.record_batch([few.column(0), few.column(1), pa.array(found, pa.binary())], ["_doc", "_hash", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"), text_bytes(text).alias("text"))
    some = rows.select("_doc", "_hash", _place("_doc", "_hash").alias("p"), "text").mapInArrow(of, "_doc long, _hash long, set binary")
    found = some.join(wanted, (some["_hash"] == wanted["text_hash"]) & some["_doc"].eqNullSafe(wanted["doc_id"]))
    return found.select("id", "set").dropDuplicates(["id"])


def alike_links(docs: DataFrame, text: str, size: int, own: DataFrame, found: DataFrame, alike: float) -> DataFrame:
    """Links (a, b) that join all pairs alike to `alike` within each component of found (node,
    root).  own: id, n (shingles), first.

    A small component is one group, all of whose pairs count.  A larger one is dealt to groups,
    which all get some rows of it as well; what is outside its largest part after that meets
    every row of the component.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "id")
    rows = own.join(both, "id")

    def groups(n, rows):
        return F.ceil(F.greatest(n / F.lit(GROUP_SHINGLES), rows / F.lit(GROUP_ROWS), F.lit(1.0))).cast("int")

    sums = rows.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    rows = cut(rows.join(sums.select("root", "m", groups(F.col("all"), F.col("m")).alias("dealt")), "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("dealt")).cast("int")))
    sets = cut(_sets(docs, text, size, rows.select("id", "first.doc_id", "first.text_hash")))

    def links(keyed: DataFrame) -> DataFrame:
        files = keyed.join(sets, "id").select("key", "id", "set")
        return files.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_confirm(alike), "a long, b long").where("a != b")

    every = F.sequence(F.lit(0), F.col("dealt") - 1)
    pivot = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("m")) < PIVOTS
    near = cut(links(rows.select("id", "root", F.explode(F.when(pivot, every).otherwise(F.array("own"))).alias("at")).select("id", F.xxhash64("root", "at").alias("key"))))
    large = rows.where("dealt > 1")
    if not large.limit(1).count():
        return near
    part = stars(near).select(F.col("node").alias("id"), F.col("root").alias("part"))
    large = large.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    most = large.groupBy("root", "part").count().groupBy("root").agg(F.max(F.struct("count", "part")).alias("p")).select("root", F.col("p.part").alias("_most"))
    large = cut(large.join(most, "root").withColumn("out", F.col("part") != F.col("_most")))
    sums = large.where("out").groupBy("root").agg(groups(F.sum("n"), F.count("*")).alias("outs"))
    large = large.join(sums, "root")
    outer = large.where("out").select("id", "root", F.pmod(F.xxhash64(F.lit(9), "id"), F.col("outs")).cast("int").alias("i"), F.explode(every).alias("j"))
    inner = large.select("id", "root", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("i"), F.col("own").alias("j"))
    return near.unionByName(links(outer.unionByName(inner).distinct().select("id", F.xxhash64("root", "i", "j").alias("key"))))


def wide_fingerprints(docs: DataFrame, text: str, size: int, filing: Bands) -> DataFrame:
    """doc_id, text_hash, id (a hash of the set of shingles), n (its size), the words of the code
    and the keys of the bands of every row."""
    names = ["doc_id", "text_hash", "id", "n", *filing.columns, *filing.bands]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), size)) for t in batch.column(2)]
            codes = np.array([wide_code(s, filing.words) for s in sets], np.int64).reshape(batch.num_rows, filing.words)
            bands = np.array([filing.sign(s) for s in sets], np.uint64).reshape(batch.num_rows, filing.count).view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            wide = np.ascontiguousarray(np.hstack([codes, bands]).T)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids), pa.array(list(map(len, sets)), pa.int64()), *map(pa.array, wide)], names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), text_bytes(text).alias("text"))
    return rows.mapInArrow(of, ", ".join(f"{n} long" for n in names))


def keep_one(docs: DataFrame, text: str = "text", size: int = 5, words: int = 2, radius: int = 40, alike: float = 0.8) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest
    doc_id stays (rows without one come last); of rows that repeat it, one.

    Two texts link if their sets of shingles are alike to `alike` (Jaccard).  Candidates come
    from fingerprints of 64 * words bits over the shingles, filed under bands: at 0.8 15 % of
    the bits differ on average, 19 of 128 with a deviation of 4; the radius allows for chance.
    Within each component of candidates the sets themselves decide.
    """
    filing = Bands(alike, words, radius)
    fps = cut(wide_fingerprints(docs, text, size, filing))
    rest = ["n", *filing.columns, *filing.bands]  # the same in all rows of one id
    own = cut(fps.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("first"), *[F.first(c).alias(c) for c in rest]))
    near = stars(forest(own.drop("first", "n"), filing))
    links = stars(alike_links(docs, text, size, own.select("id", "n", "first"), near, alike))
    rooted = own.select("id", "first").join(links.withColumnRenamed("node", "id"), "id", "left").select("first", F.coalesce("root", "id").alias("root"))
    best = rooted.groupBy("root").agg(F.min("first").alias("b"))
    repeats = fps.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    hashed, key, number = unused(docs, "hash", "key", "number")
    best = best.select(F.col("b.doc_id").alias(number), F.col("b.text_hash").alias(key))
    of = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = of.join(best, (of[hashed] == best[key]) & of["doc_id"].cast("long").eqNullSafe(best[number]), "left_semi")
    return (kept.dropDuplicates(["doc_id", hashed]) if repeats else kept).drop(hashed)

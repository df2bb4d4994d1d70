"""Proportional stratified interleaving into shards.

Within each source, rows are put into a seeded-random order and ranked; rank over the
source's count, less a seeded share of one step, is a row's fractional rank.  All rows in the
order of their fractional ranks are cut into runs of equal length, so that every shard has
each source's share of the rows.  The law is `rows`: shard counts differ by one at most.

No sort or window takes in more than a bucket of rows: a hash bucket within a source, then a
cell of the fractional rank; counts of buckets and cells, summed in two steps, give each its start.  Only ids, sizes,
checksums and the source travel, never the text.

Defined results: null and empty sources are two strata of their own; a null text has size 8
and a null checksum counts as that of the empty text; null doc_ids are kept.  Rows that are
alike in id, text size and checksum are interchangeable.  An empty table gives no rows.  Only
doc_id, source and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Rows that a bucket or cell holds on average, at most.
BUCKET_ROWS = 2_000


def _starts(counts: DataFrame, within: list[str], by: str, step: int = 1024) -> DataFrame:
    """For each row of counts (n), how many rows the smaller `by` of its group hold.  Sums of
    `step` neighbours are summed up first, so that no window takes in more of the counts than
    `step`, or one `step`-th of them."""
    part = counts.withColumn("part", F.expr(f"{by} div {step}"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = part.groupBy(*within, "part").agg(F.sum("n").alias("n"))
    parts = parts.withColumn("first", before(Window.partitionBy(*within).orderBy("part"))).drop("n")
    inner = part.withColumn("inner", before(Window.partitionBy(*within, "part").orderBy(by)))
    return inner.join(parts, [*within, "part"]).withColumn("start", F.col("first") + F.col("inner")).drop("part", "first", "inner")


def interleave(docs: DataFrame, shards: int = 24, seed: int = 17, source: str = "source", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col(source).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source).cast("string"))).alias("stratum"),
    )
    rows = cut(rows.withColumn("drawn", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    rows = rows.withColumn("bucket", F.pmod("drawn", F.lit(buckets)))

    # 1. rank within the source, and from it the fractional rank
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    whole = counts.groupBy("stratum").agg(F.sum("n").alias("whole"))
    starts = _starts(counts, ["stratum"], "bucket").join(whole, "stratum").drop("n")
    order = ["drawn", "doc_id", "text_crc32", "size"]
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order)))
    ranked = ranked.join(starts, ["stratum", "bucket"])
    step = F.pmod(F.xxhash64(F.lit(seed + 1), "stratum"), F.lit(1 << 20)).cast("double") / float(1 << 20)
    ranked = ranked.withColumn("at", (F.col("start") + F.col("r") - step) / F.col("whole"))
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("at") * buckets), F.lit(buckets - 1)).cast("long")).drop("start", "whole", "bucket", "r")

    # 2. place among all rows by fractional rank
    ranked = cut(ranked)
    cells = ranked.groupBy("cell").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    first = _starts(cells, ["all"], "cell").select("cell", "start")
    place = ranked.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("at", "stratum", *order)))
    place = place.join(first, "cell").withColumn("place", F.col("start") + F.col("r") - 1)

    # 3. runs of equal length: shard k holds the places from ceil(k * total / shards) on
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return place.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("place") - begin).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

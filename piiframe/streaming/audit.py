"""The audit trail: events as rows, drained in batches or streamed to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FIELDS = ("ts", "action", "token", "data_type", "agent", "tool")
SCHEMA = "id long, ts double, action string, token string, data_type string, agent string, tool string, extra_json string"
#: Rows that one flush takes, and seconds between two.
BATCH, PERIOD = 1000, 5.0


def events(df: DataFrame, id: Column, ts: Column, action: Column, token: Column, data_type: Column | None = None, agent: Column | None = None, tool: Column | None = None, extra: Column | None = None) -> DataFrame:
    """Audit rows of a DataFrame; the kind is opaque unless given, the rest empty.  extra is a
    map or struct, kept as JSON, and null where it is empty."""
    text = lambda c, default: F.coalesce(c, F.lit(default)) if c is not None else F.lit(default)
    extra_json = F.to_json(extra) if extra is not None else F.lit(None).cast("string")
    return df.select(
        id.cast("long").alias("id"),
        ts.cast("double").alias("ts"),
        action.alias("action"),
        token.alias("token"),
        text(data_type, "opaque").alias("data_type"),
        text(agent, "").alias("agent"),
        text(tool, "").alias("tool"),
        F.when(extra_json != "{}", extra_json).alias("extra_json"),
    )


def payloads(rows: DataFrame) -> DataFrame:
    """ts, id and the JSON that is sent: the fields, overridden and joined by the extra ones."""
    base = F.map_from_arrays(F.array(*[F.lit(c) for c in FIELDS]), F.array(*[F.col(c).cast("string") for c in FIELDS]))
    extra = F.coalesce(F.from_json("extra_json", "map<string, string>"), F.create_map().cast("map<string, string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(extra, k))
    return rows.select("ts", "id", F.to_json(F.map_concat(kept, extra)).alias("payload"))


def flush(log: DataFrame, batch: int = BATCH) -> DataFrame:
    """The oldest rows of the log, oldest first, as many as one flush takes."""
    return log.orderBy("ts", "id").limit(batch)


def without(log: DataFrame, flushed: DataFrame) -> DataFrame:
    """The log after a flush."""
    return log.join(flushed.select("ts", "id"), ["ts", "id"], "left_anti")


def drain(log: DataFrame, send: Callable[[list[str]], bool], batch: int = BATCH) -> DataFrame:
    """One flush: send a batch of payloads from the driver, and the log without them if that
    succeeded.  At least once: what could not be sent stays."""
    found = payloads(flush(log, batch)).orderBy("ts", "id").collect()  # `batch` rows at most
    if not found or not send([r["payload"] for r in found]):
        return log
    return without(log, log.sparkSession.createDataFrame([(r["ts"], r["id"]) for r in found], "ts double, id long"))


class AuditLog:
    """A trail in Parquet under one path, written an append at a time; `write` is an engine's sink.
    stream sends it on; without a path nothing is kept."""

    def __init__(self, path: str | None):
        self.path = path

    def write(self, rows: DataFrame) -> None:
        if self.path:
            rows.write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path)


#: What stands for a text that is no token, so that no original gets into the trail.
NO_TOKEN = "[no token]"


def numbered(call: str) -> Column:
    """Event numbers that differ within a call, and from those of other calls (of other names)."""
    return F.xxhash64(F.lit(call), F.monotonically_increasing_id())


def stream(spark: SparkSession, path: str, checkpoint: str, send: Callable[[list[str]], bool], period: float | None = PERIOD, batch: int = BATCH) -> StreamingQuery:
    """Stream audit files under a path to a sink; each partition sends its payloads in batches,
    and a batch that fails is retried with its files (at least once).  With no period, what is
    there is sent and the stream ends."""

    def partition(rows) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["payload"])
            if len(held) == batch:
                if not send(held):
                    raise RuntimeError("audit sink refused a batch")
                held = []
        if held and not send(held):
            raise RuntimeError("audit sink refused a batch")

    def each(rows: DataFrame, _: int) -> None:
        payloads(rows).foreachPartition(partition)

    source = spark.readStream.schema(SCHEMA).parquet(path)
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if period is None else writer.trigger(processingTime=f"{period} seconds")
    return writer.start()


def http_sink(url: str, api_key: str, timeout: float = 3.0) -> Callable[[list[str]], bool]:
    """A sender that posts a batch as one JSON list; any answer under 400 counts as received."""

    def send(batch: list[str]) -> bool:
        from urllib.error import URLError
        from urllib.request import Request, urlopen

        body = '{"events": [' + ", ".join(batch) + "]}"
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {api_key}"}
        try:
            with urlopen(Request(url, body.encode(), headers), timeout=timeout) as answer:
                return answer.status < 400
        except (URLError, OSError):
            return False

    return send


def rates(rows: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events of each action in each window of time."""
    at = F.timestamp_seconds(F.col("ts"))
    return rows.groupBy(F.window(at, width).alias("w"), "action").agg(F.count("*").alias("n_events"), F.countDistinct("token").alias("n_tokens")).select(F.unix_timestamp("w.start").alias("window_start"), "action", "n_events", "n_tokens")

"""The vault: tokens, encrypted originals and expiry.

Every kind of vault has the same four methods over DataFrames: put, find, retrieve, delete.  Two
kinds keep an append-only log, the others write to an outside key-value store.

A row of the log is a store or a tombstone of one token; `seq` orders them, and the greater hash
of the value orders rows of one `seq` (a store comes after a tombstone).  The state of a token is
its latest row, whatever that row says: the latest is chosen first and its expiry looked at
afterwards, so that a row that was overwritten never comes back.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TTL = 600
SCHEMA = "token string, ciphertext string, pt_hash string, expires_at double, seq long, deleted boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def latest(log: DataFrame, key: str) -> DataFrame:
    """The latest row for each value of `key` (token or pt_hash), by partial aggregation before the
    shuffle."""
    columns = [c for c in log.columns if c != key]
    order = F.struct("seq", "pt_hash" if key == "token" else "token")
    best = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def live(log: DataFrame, as_of: Column | float) -> DataFrame:
    """Tokens that are stored, not deleted and not expired at a time (epoch seconds)."""
    return latest(log, "token").where(~F.col("deleted") & (F.lit(as_of) <= F.col("expires_at")))


def reverse(log: DataFrame, as_of: Column | float, hashes: DataFrame | None = None) -> DataFrame:
    """pt_hash -> token, for hashes whose latest token is live (it may hold another value by now).
    With hashes (a column pt_hash), only for those: what the log has of others is left out before
    anything is aggregated."""
    some = log.where(~F.col("deleted"))
    if hashes is not None:
        some = some.join(hashes.select("pt_hash"), "pt_hash", "left_semi")
    stored = latest(some, "pt_hash").select("pt_hash", "token")
    if hashes is not None:
        log = log.join(stored.select("token"), "token", "left_semi")
    return stored.join(live(log, as_of).select("token"), "token", "left_semi").select("pt_hash", "token")


def store_rows(values: DataFrame, ttl: int | Column | None, now: Column | float) -> DataFrame:
    """Log rows of (token, ciphertext, pt_hash, seq); a null ttl means the default."""
    life = F.coalesce(F.lit(ttl) if not isinstance(ttl, Column) else ttl, F.lit(DEFAULT_TTL)).cast("double")
    return values.select("token", "ciphertext", "pt_hash", (F.lit(now).cast("double") + life).alias("expires_at"), F.col("seq").cast("long").alias("seq"), F.lit(False).alias("deleted"))


def tombstones(tokens: DataFrame, seq: int | Column) -> DataFrame:
    """Log rows that delete the tokens of a column `token`."""
    nothing = F.lit(None).cast("string")
    return tokens.select("token", nothing.alias("ciphertext"), nothing.alias("pt_hash"), F.lit(0.0).alias("expires_at"), F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("deleted"))


def compact(log: DataFrame, as_of: Column | float) -> DataFrame:
    """The log without rows that can no longer be read: only the latest, live ones."""
    return live(log, as_of).select(*COLUMNS)


def collisions(log: DataFrame) -> DataFrame:
    """Tokens that different values share, with how many."""
    return log.where(~F.col("deleted")).groupBy("token").agg(F.countDistinct("pt_hash").alias("n_values")).where("n_values > 1")


class Vault(Protocol):
    """What an engine needs of a vault.  Times are epoch seconds that the caller gives."""

    def put(self, rows: DataFrame, ttl: int | Column | None, as_of: float) -> None:
        """Store (token, ciphertext, pt_hash, seq)."""

    def find(self, hashes: DataFrame, as_of: float) -> DataFrame:
        """(pt_hash, token) of a frame with a column pt_hash, for those that have a live token."""

    def retrieve(self, tokens: DataFrame, as_of: float) -> DataFrame:
        """(token, ciphertext) of a frame with a column token, for those that are live."""

    def delete(self, tokens: DataFrame, seq: int) -> None:
        """Forget the tokens of a column token."""


class LogVault:
    """A vault over a log: subclasses say where its rows are kept."""

    def log(self) -> DataFrame:
        raise NotImplementedError

    def append(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def replace(self, make: Callable[[DataFrame], DataFrame]) -> None:
        raise NotImplementedError

    def put(self, rows: DataFrame, ttl: int | Column | None, as_of: float) -> None:
        self.append(store_rows(rows, ttl, as_of))

    def find(self, hashes: DataFrame, as_of: float) -> DataFrame:
        return reverse(self.log(), as_of, hashes)

    def retrieve(self, tokens: DataFrame, as_of: float) -> DataFrame:
        some = self.log().join(tokens.select("token"), "token", "left_semi")
        return live(some, as_of).select("token", "ciphertext")

    def delete(self, tokens: DataFrame, seq: int) -> None:
        self.append(tombstones(tokens, seq))

    def compact(self, as_of: float) -> None:
        """Leave out of the log what can no longer be read."""
        self.replace(lambda log: compact(log, as_of))


class MemoryVault(LogVault):
    """A log held as a DataFrame; for tests and single jobs.  Rows are pinned in the shared
    checkpoint folder, since encryption gives another text each time it runs."""

    def __init__(self, spark: SparkSession):
        self._rows = spark.createDataFrame([], SCHEMA)

    def log(self) -> DataFrame:
        return self._rows

    def append(self, rows: DataFrame) -> None:
        self._rows = self._rows.unionByName(pinned(rows.select(*COLUMNS)))

    def replace(self, make: Callable[[DataFrame], DataFrame]) -> None:
        self._rows = pinned(make(self._rows).select(*COLUMNS))


class ParquetVault(LogVault):
    """A log in Parquet under one path that all executors share.

    Every append is a folder of its own, which counts once its _SUCCESS mark is there.  A
    compaction writes one folder that says in its name which ones it stands for, and those count no
    longer; folders that others append meanwhile are not among them and stay.  A log names its
    folders one by one: two states of the log are then two relations, where one path would be one
    relation to Spark, whose listing it may reuse.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()), at

    def _folders(self) -> list[str]:
        """The whole folders that no compaction stands for, oldest name first."""
        fs, marks = self._fs(f"{self._path}/*/_SUCCESS")
        found = {m.getPath().getParent().getName(): m.getPath().getParent().toString() for m in fs.globStatus(marks) or []}
        fs, lists = self._fs(f"{self._path}/*/_REPLACES")
        gone: set[str] = set()
        for mark in fs.globStatus(lists) or []:
            if mark.getPath().getParent().getName() in found:  # one that was itself replaced counts too
                stream = fs.open(mark.getPath())
                try:
                    gone.update(bytes(stream.readAllBytes()).decode().split())
                finally:
                    stream.close()
        return [found[n] for n in sorted(set(found) - gone)]

    def _read(self, folders: list[str]) -> DataFrame:
        return self._spark.read.schema(SCHEMA).parquet(*folders) if folders else self._spark.createDataFrame([], SCHEMA)

    def log(self) -> DataFrame:
        return self._read(self._folders())

    def append(self, rows: DataFrame) -> None:
        rows.select(*COLUMNS).write.parquet(f"{self._path}/batch-{uuid.uuid4().hex}")

    def replace(self, make: Callable[[DataFrame], DataFrame]) -> None:
        folders = self._folders()
        name = f"{self._path}/base-{uuid.uuid4().hex}"
        rows = make(self._read(folders)).select(*COLUMNS)
        self._list(name, [f.rsplit("/", 1)[1] for f in folders])
        rows.write.mode("append").parquet(name)  # counts, and its list with it, once _SUCCESS is there

    def _list(self, name: str, folders: list[str]) -> None:
        fs, at = self._fs(f"{name}/_REPLACES")
        out = fs.create(at)
        try:
            out.write(bytearray("\n".join(folders).encode()))
        finally:
            out.close()


class KeyValueStore(Protocol):
    """A client of an outside store, made on each executor by a caller's function."""

    def put_many(self, rows: list[tuple[str, str, int, float]]) -> None:
        """(key, value, seconds to live, expiry in epoch seconds), the last of a key wins."""

    def get_many(self, keys: list[str]) -> list[str | None]: ...

    def delete_many(self, keys: list[str]) -> None: ...


class KeyValueVault:
    """A vault in an outside key-value store, written and read a batch of keys at a time.

    A token has one record: ciphertext, hash of the value and expiry as JSON; a hash has one, its
    token.  What is read as expired is removed with its other record, and so is a hash's record
    whose token is gone.
    """

    BATCH = 500

    def __init__(self, connect: Callable[[], KeyValueStore], prefix: str = "piiframe"):
        self._connect, self._prefix = connect, prefix

    def put(self, rows: DataFrame, ttl: int | Column | None, as_of: float) -> None:
        connect, prefix, size = self._connect, self._prefix, self.BATCH

        def write(found: Iterable) -> None:
            client, batch = connect(), []
            for r in found:
                life = max(1, int(r.expires_at - as_of))
                record = json.dumps({"ciphertext": r.ciphertext, "hash": r.pt_hash, "expires_at": r.expires_at})
                batch.append((f"{prefix}/token/{r.token}", record, life, r.expires_at))
                if r.pt_hash:
                    batch.append((f"{prefix}/hash/{r.pt_hash}", r.token, life, r.expires_at))
                if len(batch) >= size:
                    client.put_many(batch)
                    batch = []
            if batch:
                client.put_many(batch)

        # rows of one token are written in one task, in order
        store_rows(rows, ttl, as_of).repartition("token").sortWithinPartitions("token", "seq", "pt_hash").foreachPartition(write)

    def _read(self, rows: DataFrame, column: str, schema: str, answer: Callable) -> DataFrame:
        connect, size = self._connect, self.BATCH

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = connect()
            for batch in batches:
                asked = batch[column].dropna().tolist()
                for low in range(0, len(asked), size):
                    yield pd.DataFrame(answer(client, asked[low : low + size]), columns=[column, schema.split()[2]], dtype=object)

        return rows.select(column).distinct().mapInPandas(run, schema)

    @staticmethod
    def _records(client: KeyValueStore, prefix: str, tokens: list[str], as_of: float) -> dict[str, dict]:
        """The live records of tokens; expired ones are removed."""
        held = zip(tokens, client.get_many([f"{prefix}/token/{t}" for t in tokens]))
        found = {t: json.loads(r) for t, r in held if r}
        gone = [t for t, r in found.items() if as_of > r["expires_at"]]
        if gone:
            KeyValueVault._forget(client, prefix, {t: found.pop(t) for t in gone})
        return found

    @staticmethod
    def _forget(client: KeyValueStore, prefix: str, records: dict[str, dict]) -> None:
        """Remove tokens, and the records of their hashes where those still name them."""
        hashes = {r["hash"]: t for t, r in records.items() if r["hash"]}
        named = zip(hashes, client.get_many([f"{prefix}/hash/{h}" for h in hashes]))
        client.delete_many([f"{prefix}/token/{t}" for t in records] + [f"{prefix}/hash/{h}" for h, t in named if t == hashes[h]])

    def find(self, hashes: DataFrame, as_of: float) -> DataFrame:
        prefix, records = self._prefix, self._records

        def answer(client: KeyValueStore, asked: list[str]) -> list[tuple[str, str]]:
            named = {h: t for h, t in zip(asked, client.get_many([f"{prefix}/hash/{h}" for h in asked])) if t}
            alive = records(client, prefix, sorted(set(named.values())), as_of)
            stale = [h for h, t in named.items() if t not in alive]
            if stale:
                client.delete_many([f"{prefix}/hash/{h}" for h in stale])
            return [(h, t) for h, t in named.items() if t in alive]

        return self._read(hashes, "pt_hash", "pt_hash string, token string", answer)

    def retrieve(self, tokens: DataFrame, as_of: float) -> DataFrame:
        prefix, records = self._prefix, self._records

        def answer(client: KeyValueStore, asked: list[str]) -> list[tuple[str, str]]:
            return [(t, r["ciphertext"]) for t, r in records(client, prefix, asked, as_of).items()]

        return self._read(tokens, "token", "token string, ciphertext string", answer)

    def delete(self, tokens: DataFrame, seq: int) -> None:
        """seq has no meaning here: what is in the store goes."""
        connect, prefix, size, forget = self._connect, self._prefix, self.BATCH, self._forget

        def drop(found: Iterable) -> None:
            client, names = connect(), [r.token for r in found]
            for low in range(0, len(names), size):
                some = names[low : low + size]
                held = zip(some, client.get_many([f"{prefix}/token/{t}" for t in some]))
                forget(client, prefix, {t: json.loads(r) for t, r in held if r})

        tokens.select("token").where("token IS NOT NULL").distinct().foreachPartition(drop)

    def compact(self, as_of: float) -> None:
        """Stores of this kind drop what is expired by themselves."""


class RedisStore:
    """KeyValueStore over a client with pipeline/setex/mget/delete."""

    def __init__(self, client):
        self._client = client

    def put_many(self, rows):
        pipe = self._client.pipeline()
        for key, value, life, _ in rows:
            pipe.setex(key, life, value)
        pipe.execute()

    def get_many(self, keys):
        return [v.decode() if isinstance(v, bytes) else v for v in self._client.mget(keys)] if keys else []

    def delete_many(self, keys):
        if keys:
            self._client.delete(*keys)


class MemcachedStore:
    """KeyValueStore over a client with set_many/get_many/delete_many: one call for the rows of one
    time to live."""

    def __init__(self, client):
        self._client = client

    def put_many(self, rows):
        by_life: dict[int, dict[str, str]] = {}
        for key, value, life, _ in rows:
            for held in by_life.values():
                held.pop(key, None)
            by_life.setdefault(life, {})[key] = value
        for life, held in by_life.items():
            if held:
                # over 30 days the service takes the number for a date; such rows expire when read
                self._client.set_many(held, expire=life if life <= 2592000 else 0)

    def get_many(self, keys):
        found = self._client.get_many(keys) if keys else {}
        return [v.decode() if isinstance(v, bytes) else v for v in map(found.get, keys)]

    def delete_many(self, keys):
        if keys:
            self._client.delete_many(keys)


class DynamoStore:
    """KeyValueStore over a table with put_item/get_item/delete_item; the service deletes late,
    which does not matter, since expiry is checked when a record is read."""

    def __init__(self, table):
        self._table = table

    def put_many(self, rows):
        for key, value, _, expiry in rows:
            self._table.put_item(Item={"token": key, "record": value, "ttl": int(expiry)})

    def get_many(self, keys):
        items = [self._table.get_item(Key={"token": key}).get("Item") for key in keys]
        return [item["record"] if item else None for item in items]

    def delete_many(self, keys):
        for key in keys:
            self._table.delete_item(Key={"token": key})


def connect_redis(url: str = "redis://localhost:6379/0", **options) -> Callable[[], KeyValueStore]:
    def connect() -> KeyValueStore:
        import redis

        client = redis.Redis.from_url(url, **options)
        client.ping()  # a wrong address fails at once
        return RedisStore(client)

    return connect


def connect_memcached(host: str = "localhost", port: int = 11211, **options) -> Callable[[], KeyValueStore]:
    def connect() -> KeyValueStore:
        from pymemcache.client.base import Client

        return MemcachedStore(Client((host, port), **options))

    return connect


def connect_dynamodb(table: str = "piiframe-vault", region: str = "us-east-1") -> Callable[[], KeyValueStore]:
    def connect() -> KeyValueStore:
        import boto3

        return DynamoStore(boto3.resource("dynamodb", region_name=region).Table(table))

    return connect


def pinned(rows: DataFrame) -> DataFrame:
    """rows written to the shared checkpoint folder.  Where none is named, one of our own, if all
    runs on this machine (tests); on a cluster executors would not see it, so it is an error."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="piiframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return rows.checkpoint(eager=True)


def make_vault(kind: str, spark: SparkSession, **options) -> Vault:
    """memory, parquet (path), redis, memcached or dynamodb (connect: makes a KeyValueStore; else
    the options of connect_redis and its like)."""
    if kind == "memory":
        return MemoryVault(spark)
    if kind == "parquet":
        return ParquetVault(spark, options["path"])
    usual = {"redis": connect_redis, "memcached": connect_memcached, "dynamodb": connect_dynamodb}
    if kind in usual:
        prefix, connect = options.pop("prefix", "piiframe"), options.pop("connect", None)
        return KeyValueVault(connect or usual[kind](**options), prefix)
    raise ValueError(f"unknown vault type: {kind!r}")


def vault_from_env(spark: SparkSession) -> Vault:
    """The vault that the driver's environment names in PIIFRAME_VAULT (memory where unset), with
    PIIFRAME_VAULT_PATH, _REDIS_URL, _MEMCACHED_HOST, _MEMCACHED_PORT, _DYNAMODB_TABLE, _DYNAMODB_REGION."""
    env = lambda name: os.environ.get(f"PIIFRAME_{name}")
    kind = (env("VAULT") or "memory").lower()
    named = {"parquet": {"path": env("VAULT_PATH")}, "redis": {"url": env("REDIS_URL")}, "memcached": {"host": env("MEMCACHED_HOST"), "port": env("MEMCACHED_PORT") and int(env("MEMCACHED_PORT"))}, "dynamodb": {"table": env("DYNAMODB_TABLE"), "region": env("DYNAMODB_REGION")}}
    return make_vault(kind, spark, **{k: v for k, v in named.get(kind, {}).items() if v})

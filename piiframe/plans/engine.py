"""The engine: keys, vault, detector and audit trail behind one interface."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.crypto import Cipher
from ..functions.keys import EnvKeys, KeyProvider
from ..functions.names import unused
from ..operators import detect, restore
from ..operators.nested import has_text, leaves, replace_leaves, walk
from ..sources import vault as vaults
from ..streaming import audit


class Engine:
    """Everything belongs to one engine: its keys, its vault, its detector.  Times are epoch
    seconds that the caller gives, so that a plan gives the same rows whenever it runs.

    Of values that share a token the vault holds one.  With a `width` of text.WIDE hex digits no two
    addresses or opaque values do; the default is the compatible one."""

    def __init__(self, spark: SparkSession, keys: KeyProvider | None = None, vault: vaults.Vault | None = None, detector: detect.Detector | None = None, ttl: int = vaults.DEFAULT_TTL, audit_sink: Callable[[DataFrame], None] | None = None, width: int = text.NARROW):
        keys = keys or EnvKeys()
        self.spark, self.vault, self.detector, self.ttl, self.audit_sink = spark, vault or vaults.MemoryVault(spark), detector, ttl, audit_sink
        self._master, self._width, self.cipher = keys.master_key(), width, Cipher(keys.encryption_key())

    @classmethod
    def from_env(cls, spark: SparkSession, keys: KeyProvider | None = None) -> Engine:
        """An engine as the driver's environment describes it: PIIFRAME_VAULT and its options,
        PIIFRAME_VAULT_TTL, PIIFRAME_SCANNER (local, remote or none) with PIIFRAME_SCANNER_URL,
        PIIFRAME_AUDIT_PATH (no trail where unset) and PIIFRAME_TOKEN_WIDTH."""
        env = os.environ.get
        scanner = env("PIIFRAME_SCANNER", "none").lower()
        if scanner not in ("none", "local", "remote"):
            raise ValueError(f"unknown scanner type: {scanner!r}")
        found = {"local": detect.statistical, "remote": lambda: detect.remote(env("PIIFRAME_SCANNER_URL", "http://localhost:5001/analyze"), fail_open=True), "none": lambda: None}[scanner]()
        path = env("PIIFRAME_AUDIT_PATH")
        return cls(spark, keys, vaults.vault_from_env(spark), found, int(env("PIIFRAME_VAULT_TTL", vaults.DEFAULT_TTL)), audit.AuditLog(path).write if path else None, int(env("PIIFRAME_TOKEN_WIDTH", text.NARROW)))

    # --- tokens

    def token(self, c: Column) -> Column:
        """The token that a value gets when the vault has none for it; tokens stay."""
        return text.token_or_same(c, self._master, self._width)

    def new_values(self, df: DataFrame, column: str, as_of: float) -> DataFrame:
        """(value, pt_hash, token, known) of each different value that is no token: known ones
        keep the live token that the vault has for them."""
        raw = F.col(f"`{column}`")
        values = df.where(raw.isNotNull() & ~text.looks_like_token(raw)).select(text.strip(raw).alias("value")).distinct()
        values = values.withColumn("pt_hash", F.sha2("value", 256))
        held = self.vault.find(values.select("pt_hash"), as_of).withColumnRenamed("token", "held")
        both = values.join(held, "pt_hash", "left")
        return both.select("value", "pt_hash", F.coalesce("held", text.token(F.col("value"), self._master, self._width)).alias("token"), F.col("held").isNotNull().alias("known"))

    def encode(self, df: DataFrame, column: str, out: str, as_of: float, ttl: int | None = None, seq: int | None = None) -> DataFrame:
        """df with tokens for a column; values that the vault lacks are stored (a repeated
        value keeps its row and expiry).  A ttl of None is the engine's."""
        own = self._store(df, column, as_of, ttl, seq)
        raw = F.col(f"`{column}`")
        key, hashed, held = unused(df.withColumn(out, F.lit(0)), "key", "hashed", "held")
        work = df.withColumn(key, F.when(~text.looks_like_token(raw), text.plaintext_hash(raw)))
        work = work.join(own.select(F.col("pt_hash").alias(hashed), F.col("token").alias(held)), F.col(key) == F.col(hashed), "left")
        if self.audit_sink is not None:
            self._log(work.where(F.col(held).isNotNull()), "encode", held, as_of, kind=text.classify(raw))
        return work.withColumn(held, F.coalesce(held, raw)).drop(key, hashed).withColumn(out, F.col(held)).drop(held)

    def _store(self, df: DataFrame, column: str, as_of: float, ttl: int | None, seq: int | None) -> DataFrame:
        """Store what the vault lacks: (pt_hash, token) of all values of a column that are no tokens."""
        own = vaults.pinned(self.new_values(df, column, as_of))
        start = int(as_of * 1000) << 20 if seq is None else seq
        rows = own.where(~F.col("known")).select("token", self.cipher.encrypt(F.col("value")).alias("ciphertext"), "pt_hash", F.lit(start).alias("seq"))
        self.vault.put(rows, self.ttl if ttl is None else ttl, as_of)
        return own.select("pt_hash", "token")

    def decode(self, df: DataFrame, column: str, out: str, as_of: float, mode: str = "lenient") -> DataFrame:
        plain, action = unused(df.withColumn(out, F.lit(0)), "plain", "action")
        found = restore.looked_up(df, column, self._retrieve(as_of), self.cipher, plain, action)
        self._log(found.where(F.col(action).isNotNull()), F.col(action), column, as_of, extra=F.when(F.col(action) == "error", F.create_map(F.lit("error"), F.lit("decryption_failed"))))
        return restore.decoded(found, column, plain, action, out, mode)

    def delete(self, df: DataFrame, column: str, seq: int) -> None:
        """Forget the tokens of a column."""
        self.vault.delete(df.select(F.col(f"`{column}`").alias("token")).where("token IS NOT NULL").distinct(), seq)

    def compact(self, as_of: float) -> None:
        self.vault.compact(as_of)

    def _retrieve(self, as_of: float) -> restore.Retrieve:
        return lambda tokens: self.vault.retrieve(tokens, as_of)

    # --- texts and nested columns

    def entities(self, df: DataFrame, column: str, out: str, options: detect.Options = detect.Options()) -> DataFrame:
        return detect.scan(df, column, self._master, options, self.detector, entities_out=out, width=self._width)

    def tokenize_text(self, df: DataFrame, column: str, out: str, options: detect.Options = detect.Options(), entities: str | None = None) -> DataFrame:
        return detect.scan(df, column, self._master, options, self.detector, text_out=out, entities_out=entities, width=self._width)

    def persist(self, df: DataFrame, entities: str, as_of: float, ttl: int | None = None, seq: int | None = None) -> None:
        """Store the values of an entity column in the vault: a job of its own, once per value."""
        self._store(df.select(F.explode(F.col(f"`{entities}`")["value"]).alias("value")), "value", as_of, ttl, seq)

    def detokenize_text(self, df: DataFrame, column: str, out: str, as_of: float) -> DataFrame:
        return restore.detokenize_text(df, column, self._retrieve(as_of), self.cipher, out)

    def deep_encode(self, df: DataFrame, columns: list[str], options: detect.Options = detect.Options()) -> DataFrame:
        """Strings in (nested) columns: whole tokens stay, other texts are scanned, by the
        detector too if there is one."""
        kinds = {c: df.schema[c].dataType for c in columns if has_text(df.schema[c].dataType)}

        def replaced(c: Column, spans: Column) -> Column:
            kept = detect._kept(detect.resolve(spans), options, self._master, self._width)
            return F.when(text.looks_like_token(c), c).otherwise(detect._splice(c, kept, lambda s: s["masked"]))

        if options.first and kinds:
            df = replace_leaves(df, kinds, lambda x: replaced(x, detect.candidates(x, options)))
        if options.second and self.detector is not None and kinds:
            second = unused(df, "second")[0]
            texts = F.concat(*[leaves(F.col(f"`{c}`"), kind) for c, kind in kinds.items()])
            df = detect.second_spans(df, texts, second, options, self.detector)
            for c, kind in kinds.items():
                df = df.withColumn(c, walk(F.col(f"`{c}`"), kind, lambda x: F.when(x.isNotNull(), replaced(x, F.coalesce(F.element_at(second, x), F.array().cast(detect.SPANS))))))
            df = df.drop(second)
        return df

    def deep_decode(self, df: DataFrame, columns: list[str], as_of: float) -> DataFrame:
        columns = [c for c in columns if has_text(df.schema[c].dataType)]
        return restore.deep_decode(df, columns, self._retrieve(as_of), self.cipher) if columns else df

    # --- audit

    def _log(self, df: DataFrame, action: Column | str, token: str, as_of: float, kind: Column | None = None, extra: Column | None = None) -> None:
        """Events of the rows of df, one each: the token as it came in or as it was made, and what is
        no token not at all."""
        if self.audit_sink is None:
            return
        action = F.lit(action) if isinstance(action, str) else action
        shown = F.when(text.looks_like_token(F.col(f"`{token}`")), F.col(f"`{token}`")).otherwise(audit.NO_TOKEN)
        self.audit_sink(audit.events(df, audit.numbered(uuid.uuid4().hex), F.lit(as_of), action, shown, kind, extra=extra))

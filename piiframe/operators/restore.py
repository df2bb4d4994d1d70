"""Looking tokens up in the vault: whole values, tokens inside texts, and nested columns.

`retrieve` gives, for a frame with a column token, the (token, ciphertext) that the vault has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import Cipher
from ..functions.names import every, unused
from ..functions.text import TOKEN_PATTERN, replace_tokens
from .nested import leaves, walk

Retrieve = Callable[[DataFrame], DataFrame]

#: Rows without any token are spread over so many keys, since they have no key of their own.
SPREAD = 4096


def looked_up(df: DataFrame, token: str, retrieve: Retrieve, cipher: Cipher, plain: str, action: str) -> DataFrame:
    """df with two more columns: the plaintext of a token column, null where there is none, and
    what came of it: decode, expired (the vault has nothing), error (another key) or null."""
    asked = df.select(F.col(token).alias("token")).where("token IS NOT NULL").distinct()
    key, held = unused(df, "token", "ciphertext")
    both = df.join(retrieve(asked).select(F.col("token").alias(key), F.col("ciphertext").alias(held)), F.col(f"`{token}`") == F.col(key), "left")
    value = cipher.try_decrypt(F.col(held))
    came = F.when(F.col(f"`{token}`").isNull(), None).when(F.col(held).isNull(), "expired").when(F.col(plain).isNull(), "error").otherwise("decode")
    return both.withColumn(plain, value).withColumn(action, came).drop(key, held)


def decoded(found: DataFrame, token: str, plain: str, action: str, out: str, mode: str = "lenient") -> DataFrame:
    """What looked_up gave, with the answer as `out`.  lenient: what cannot be restored stays as it
    is; strict: it stops the job; null: it is null.  A null token gives null."""
    t, value = F.col(f"`{token}`"), F.col(plain)
    if mode == "strict":
        missing = F.when(F.col(action) == "expired", F.raise_error(F.concat(F.lit("Token not found or expired: "), t)))
        value = F.coalesce(value, missing.when(F.col(action) == "error", F.raise_error(F.lit("Failed to decrypt token payload"))))
    elif mode == "lenient":
        value = F.coalesce(value, t)
    else:
        if mode != "null":
            raise ValueError(f"unknown mode: {mode!r}")
    return found.withColumn(plain, value).drop(action).withColumn(out, F.col(plain)).drop(plain)


def decode(df: DataFrame, token: str, retrieve: Retrieve, cipher: Cipher, out: str, mode: str = "lenient") -> DataFrame:
    """df with the plaintext of a token column."""
    plain, action = unused(df.withColumn(out, F.lit(0)), "plain", "action")
    return decoded(looked_up(df, token, retrieve, cipher, plain, action), token, plain, action, out, mode)


def _tokens(texts: Column) -> Column:
    """The different tokens in an array of texts, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))))))


def with_plaintexts(df: DataFrame, texts: Column, retrieve: Retrieve, cipher: Cipher, out: str) -> DataFrame:
    """df with a map from each token in its texts to the plaintext, where there is one.

    A map depends on the row's set of tokens alone, so it is made once for each different set.
    """
    tokens, of, key = unused(df.withColumn(out, F.lit(0)), "tokens", "of", "key")
    work = df.withColumn(tokens, F.coalesce(_tokens(texts), F.array().cast("array<string>")))
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*[F.to_json(F.struct(texts.alias("t")))]), F.lit(SPREAD)).cast("string"))
    work = work.withColumn(of, F.when(F.size(tokens) > 0, F.sha2(F.array_join(tokens, "\n"), 256)).otherwise(spread))
    sets = work.where(F.size(tokens) > 0).select(F.col(of).alias("of"), F.col(tokens).alias("tokens")).dropDuplicates(["of"])
    asked = sets.select("of", F.explode("tokens").alias("token"))
    held = retrieve(asked.select("token").distinct()).select("token", cipher.try_decrypt(F.col("ciphertext")).alias("plain")).where("plain IS NOT NULL")
    maps = asked.join(held, "token").groupBy("of").agg(F.map_from_entries(F.collect_list(F.struct("token", "plain"))).alias(out))
    return work.join(maps.withColumnRenamed("of", key), F.col(of) == F.col(key), "left").drop(of, tokens, key)


def _restored(text: Column, plain: Column) -> Column:
    return F.when(plain.isNull(), text).otherwise(replace_tokens(text, lambda t: F.coalesce(F.element_at(plain, t), t)))


def detokenize_text(df: DataFrame, text: str, retrieve: Retrieve, cipher: Cipher, out: str) -> DataFrame:
    """df with every known token inside a text replaced by its plaintext; others stay."""
    plain, made = unused(df.withColumn(out, F.lit(0)), "plain", "made")
    work = with_plaintexts(df, F.array(F.col(f"`{text}`")), retrieve, cipher, plain)
    return work.withColumn(made, _restored(F.col(f"`{text}`"), F.col(plain))).drop(plain).withColumn(out, F.col(made)).drop(made)


def deep_decode(df: DataFrame, columns: list[str], retrieve: Retrieve, cipher: Cipher) -> DataFrame:
    """df with the tokens in all strings of (nested) columns replaced."""
    plain = unused(df, "plain")[0]
    kinds = {c: df.schema[c].dataType for c in columns}
    texts = F.concat(*[leaves(F.col(f"`{c}`"), k) for c, k in kinds.items()])
    texts = F.filter(texts, lambda t: t.isNotNull())
    work = with_plaintexts(df, texts, retrieve, cipher, plain)
    walked = [walk(c, kinds[n], lambda t: _restored(t, F.col(plain))).alias(n) if n in kinds else c for n, c in zip(df.columns, every(work))]
    return work.select(*walked)

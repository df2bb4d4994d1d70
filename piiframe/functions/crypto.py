"""Authenticated encryption of values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import aes_key


class Cipher:
    """AES-256-GCM with a random nonce for each value; ciphertexts are base64 text.

    Encryption is random, so write its result once before using it twice; and never encrypt
    literals, which the optimiser would fold into the plan.
    """

    def __init__(self, secret: str):
        self._key = F.unhex(F.lit(aes_key(secret)))

    def encrypt(self, c: Column) -> Column:
        return F.base64(F.aes_encrypt(F.encode(c, "UTF-8"), self._key, F.lit("GCM")))

    def decrypt(self, c: Column) -> Column:
        """An error where the text was not encrypted under this key."""
        return F.decode(F.aes_decrypt(F.unbase64(c), self._key, F.lit("GCM")), "UTF-8")

    def try_decrypt(self, c: Column) -> Column:
        """Null instead of an error."""
        return F.decode(F.try_aes_decrypt(F.unbase64(c), self._key, F.lit("GCM")), "UTF-8")

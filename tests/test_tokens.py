"""Tokens, guards, hashes and encryption."""

import hashlib
import hmac
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piiframe.functions import text
from piiframe.functions.crypto import Cipher
from piiframe.functions.keys import CallbackKeys, EnvKeys, StaticKeys, aes_key, from_passphrase, hmac_pads, unconfigured

SHAPES = {
    "email": r"tkn-[0-9a-f]{8}@email\.com",
    "phone": r"\+1-555-\d{7}",
    "ssn": r"000-00-\d{4}",
    "card": r"4000-0000-0000-\d{4}",
    "routing": r"000000\d{3}",
    "opaque": r"\[TKN-[0-9a-f]{8}\]",
}
VALUES = [
    ("user@company.io", "email"), ("+1-212-555-1234", "phone"), ("555-1234", "phone"), ("(212) 555 1234", "phone"), ("123-45-6789", "ssn"), ("4111-1111-1111-1111", "card"),
    ("4111111111111111", "card"), ("122000661", "routing"), ("just some random string", "opaque"), ("", "opaque"), ("  someone@email.com　", "email"), ("123456789\n", "routing"),
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def expected(value, master):
    """The token by Python's own hmac."""
    v = value.strip()
    h = hmac.new(master.encode(), v.encode(), hashlib.sha256).hexdigest()
    d = "".join(str(int(c, 16) % 10) for c in h)
    kind = dict((x.strip(), k) for x, k in VALUES)[v]
    return {"email": f"tkn-{h[:8]}@email.com", "phone": f"+1-555-{d[:7]}", "ssn": f"000-00-{d[:4]}", "card": f"4000-0000-0000-{d[:4]}", "routing": f"000000{d[:3]}", "opaque": f"[TKN-{h[:8]}]"}[kind]


@pytest.mark.parametrize("master", ["key", "k" * 64, "k" * 100, "schlüssel"])
def test_tokens(spark, master):
    values = [v for v, _ in VALUES]
    assert column(spark, values, text.classify) == [k for _, k in VALUES]
    got = column(spark, values, lambda c: text.token(c, master))
    assert got == [expected(v, master) for v in values]
    for token, (_, kind) in zip(got, VALUES):
        assert re.fullmatch(SHAPES[kind], token)
    assert all(column(spark, got, text.looks_like_token))
    assert column(spark, got, lambda c: text.token_or_same(c, master)) == got


def test_null_and_distinct_forms(spark):
    got = column(spark, [None, "555-123-4567", "(555) 123-4567", " 555-123-4567"], lambda c: text.token(c, "k"))
    assert got[0] is None and got[1] != got[2] and got[1] == got[3]
    assert column(spark, ["a@b.co"], lambda c: text.token(c, "k")) != column(spark, ["a@b.co"], lambda c: text.token(c, "other"))


def test_guard(spark):
    yes = ["tkn-abcd1234@email.com", "tkn- any thing @email.com", "+1-555-1234567", "+1-555-abcdefg", " 000-00-1234\t", "4000-0000-0000-1234", "000000123", "[TKN-abcd1234]", "[TKN-]"]
    no = ["real@company.com", "hello world", "+1-555-123-4567", "000-00-12a4", "000-00-12345", "4000-0000-0000-12345", "0000001234", "00000012x", "TKN-abcd", ""]
    assert column(spark, yes + no, text.looks_like_token) == [True] * len(yes) + [False] * len(no)


SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


@given(st.lists(st.text(alphabet=st.sampled_from(SPACES + "ab​᠎"), max_size=8), min_size=1, max_size=30))
@settings(max_examples=10, deadline=None)
def test_strip_is_pythons(spark, values):
    assert column(spark, values, text.strip) == [v.strip() for v in values]


def test_hash_and_luhn(spark):
    assert column(spark, [" a ", "a"], text.plaintext_hash) == [hashlib.sha256(b"a").hexdigest()] * 2
    assert column(spark, ["4111-1111-1111-1111", "4111 1111 1111 1112", "79927398713"], text.luhn) == [True, False, True]


def test_digits_pad(spark):
    assert column(spark, ["af", "0123456789abcdef"], lambda c: text.digits(c, 4)) == ["0500", "0123"]
    assert column(spark, ["0123456789abcdef"], lambda c: text.digits(c, 4, 10)) == ["0123"]


def test_cipher(spark):
    own, other = Cipher(from_passphrase("secret")), Cipher(from_passphrase("another"))
    values = ["x", "", "déjà \U0001f600", None, "long " * 500]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    held = df.withColumn("c", own.encrypt(F.col("v")))
    rows = held.select("i", "v", "c").collect()
    again = held.select("i", "c").collect()
    assert {r.c for r in rows if r.v} & {r.c for r in again} <= {None}  # another text each time
    stored = spark.createDataFrame([(r.i, r.v, r.c) for r in rows], "i int, v string, c string")
    back = stored.select("v", own.decrypt(F.col("c")).alias("p"), other.try_decrypt(F.col("c")).alias("q")).collect()
    assert all(r.p == r.v and r.q is None for r in back)
    with pytest.raises(Exception):
        stored.where("v = 'x'").select(other.decrypt(F.col("c"))).collect()


def test_keys(monkeypatch):
    assert StaticKeys("e", "m").master_key() == "m" and StaticKeys("e").master_key() == "e"
    monkeypatch.delenv("PIIFRAME_ENCRYPTION_KEY", raising=False)
    monkeypatch.delenv("PIIFRAME_MASTER_KEY", raising=False)
    with pytest.raises(KeyError):
        EnvKeys().encryption_key()
    monkeypatch.setenv("PIIFRAME_ENCRYPTION_KEY", "e")
    assert EnvKeys().master_key() == "e"
    monkeypatch.setenv("PIIFRAME_MASTER_KEY", "m")
    assert EnvKeys().master_key() == "m" and EnvKeys().encryption_key() == "e"
    assert CallbackKeys({"encryption": "e", "master": None}.get).master_key() == "e"
    with pytest.raises(KeyError):
        CallbackKeys({}.get).encryption_key()
    with pytest.raises(NotImplementedError):
        unconfigured("a key service").encryption_key()
    import base64

    raw = bytes(range(32))
    assert aes_key(base64.urlsafe_b64encode(raw).decode()) == raw.hex()
    assert all(len(p) == 128 for p in hmac_pads("x" * 200))

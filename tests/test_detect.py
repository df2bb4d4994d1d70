"""Detection in texts, nested columns and user functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piiframe.functions import text
from piiframe.functions.keys import StaticKeys, from_passphrase
from piiframe.operators import detect, nested
from piiframe.operators.tools import secure_udf
from piiframe.plans.engine import Engine

KEY = "key"


def run(spark, texts, options=detect.Options(), detector=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = detect.scan(df, "t", KEY, options, detector, text_out="out", entities_out="entities").orderBy("i").collect()
    return [(r.out, [(e.type, e.value, e.confidence) for e in r.entities]) for r in out]


def luhn(value):
    d = [int(c) for c in value if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def checker(t, threshold=0.7):
    """Spans kept by the rule, with Python's own expressions."""
    found = []
    for pri, (kind, pattern) in enumerate(detect.PATTERNS.items()):
        for m in re.finditer(pattern, t):
            sure = 0.99 if kind == "CREDIT_CARD" and luhn(m[0]) else 0.95
            found.append((m.start(), m.start() - m.end(), pri, m.end(), kind, m[0], sure))
    kept, last = [], -1
    for start, _, _, end, kind, value, sure in sorted(found):
        if start >= last:
            kept.append((kind, value, sure))
            last = end
    return kept[::-1]


EDGES = [
    "at 555-123-4567 now", "Card 4111111111111111", "Card 4111-1111-1111-1111", "acct 123456789", "9123-45-67890", "1700000000", "mail bob@example.com. Bye", "a@b.c_d@e.f",
    "route 000000123", "x [TKN-12345678] y", "+1 (212) 555-1234", "2024-01-15 10:00", "", "\U0001f600 a@b.co \U0001f600 555-123-4567 a@b.co", "5551234 5551234 5551234", "@@a@b.c@",
]


def test_edges(spark):
    for t, (_, found) in zip(EDGES, run(spark, EDGES)):
        # values that look like tokens are left out of what is listed
        assert found == [c for c in checker(t) if not re.fullmatch(r"\+1-555-\d{7}", c[1].strip())]
    out = [o for o, _ in run(spark, EDGES)]
    assert out[0].startswith("at+1-555-") and out[0].endswith(" now")
    assert out[1].endswith("111111") and out[2].startswith("Card 4000-0000-0000-")
    assert re.fullmatch(r"acct \+1-555-\d{7}89", out[3]) and re.fullmatch(r"9000-00-\d{4}0", out[4])
    assert out[6].endswith("@email.com Bye") and out[11] == EDGES[11] and out[12] == ""


@given(st.lists(st.lists(st.sampled_from("a b.c @ x@y.zz 555 123 4567 4111 1111 - ( ) + 1 000 00 12 _ . \n é".split(" ") + [" "]), max_size=25).map("".join), min_size=5, max_size=40))
@settings(max_examples=12, deadline=None)
def test_spans_against_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", detect.resolve(detect.candidates(F.col("t"))).alias("s")).orderBy("i").collect()
    for t, r in zip(texts, rows):
        assert [(s.type, s.value, s.confidence) for s in r.s][::-1] == checker(t)
        assert all(t[s.start : s.end] == s.value for s in r.s)


def test_options(spark):
    t = ["card 4111-1111-1111-1111 ssn 123-45-6789 mail a@b.co"]
    kinds = lambda **o: [e[0] for e in run(spark, t, detect.Options(**o))[0][1]]
    assert kinds() == ["EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD"]
    assert kinds(threshold=0.97) == ["CREDIT_CARD"] and kinds(threshold=1.0) == []
    assert kinds(threshold=1.0, aggressive=True) == ["EMAIL_ADDRESS", "US_SSN", "CREDIT_CARD"]
    assert kinds(threshold=1.0, context="the CREDIT CARD, ssn, email") == ["CREDIT_CARD"]
    assert kinds(pipeline=("checksum",)) == kinds(pipeline=("regex",)) == kinds(pipeline=()) != kinds(pipeline=("nlp",)) == []


def test_threshold_comes_after_overlap(spark):
    # the card is under the threshold and still hides the phone number inside it
    assert run(spark, ["x4111-1111-1111-1112"], detect.Options(threshold=0.96)) == [("x4111-1111-1111-1112", [])]


def test_strict_spans(spark):
    got = run(spark, ["Card 4111111111111111", "x [TKN-12345678] y", "tkn-12345678@email.com 555-123-4567"], detect.Options(strict_spans=True))
    assert [e[0] for e in got[0][1]] == ["CREDIT_CARD"] and got[1] == ("x [TKN-12345678] y", [])
    assert [e[0] for e in got[2][1]] == ["PHONE_NUMBER"]


def test_null(spark):
    assert run(spark, [None, "a@b.co"])[0] == (None, [])


def names(texts):
    return [[{"start": m.start(), "end": m.end(), "entity_type": "PERSON", "score": 0.6} for m in re.finditer("[A-Z]+", t)] for t in texts]


def test_second_tier(spark):
    own = detect.Detector(names)
    assert run(spark, ["see ADA at a@b.co"], detector=own)[0][1] == [("EMAIL_ADDRESS", "a@b.co", 0.95)]
    out, found = run(spark, ["see ADA at a@b.co"], detect.Options(aggressive=True), own)[0]
    assert found == [("EMAIL_ADDRESS", "a@b.co", 1.0), ("PERSON", "ADA", 0.8)] and "ADA" not in out
    twice = detect.Detector(lambda ts: [[{"start": 0, "end": 5, "entity_type": "A"}, {"start": 3, "end": 8, "entity_type": "B"}] for _ in ts])
    out, found = run(spark, ["abcdefgh"], detector=twice)[0]
    assert [f[1] for f in found] == ["abcde"] and out.endswith("]fgh")

    def broken(texts):
        raise OSError("no service")

    assert run(spark, ["x ADA"], detector=detect.Detector(broken, fail_open=True)) == [("x ADA", [])]
    with pytest.raises(Exception):
        run(spark, ["x ADA"], detector=detect.Detector(broken))


def test_gate_has_every_match():
    for t in EDGES:
        assert not checker(t) or re.search(detect.GATE, t)


# --- nested columns

ROW = "struct<user: struct<contact: struct<email: string>, age: int>, cc: array<string>, extra: map<string, string>, deep: array<struct<m: map<string, array<string>>>>>"


def payload(spark):
    data = [(1, (("bob@example.com",), 7), ["a@b.co", "tkn-abcd1234@email.com", None], {"a@b.co": "Contact support@example.com for help."}, [({"k": ["555-1234"]},)]), (2, None, None, None, None)]
    return spark.createDataFrame(data, f"i int, {ROW[7:-1]}")


def test_deep_encode_and_decode(spark):
    own = Engine(spark, StaticKeys(from_passphrase("enc"), KEY))
    df = payload(spark)
    columns = ["user", "cc", "extra", "deep"]
    done = own.deep_encode(df, columns)
    assert done.schema.simpleString() == df.schema.simpleString()
    r = done.orderBy("i").collect()
    assert re.fullmatch(r"tkn-\w{8}@email\.com", r[0].user.contact.email) and r[0].user.age == 7
    assert r[0].cc[1] == "tkn-abcd1234@email.com" and r[0].cc[2] is None and list(r[0].extra) == ["a@b.co"]
    assert re.fullmatch(r"Contact tkn-\w{8}@email\.com for help\.", r[0].extra["a@b.co"]) and r[0].deep[0].m["k"][0].startswith("+1-555-")
    assert r[1].user is None and r[1].cc is None and r[1].extra is None and r[1].deep is None
    values = spark.createDataFrame([("bob@example.com",), ("a@b.co",), ("support@example.com",), ("555-1234",)], "v string")
    own.encode(values, "v", "t", 1000.0)
    back = own.deep_decode(done, columns, 1001.0).orderBy("i").collect()
    assert [b.asDict(True) for b in back] == [x.asDict(True) for x in df.orderBy("i").collect()]


def test_deep_encode_with_a_detector(spark):
    own = Engine(spark, StaticKeys(from_passphrase("enc"), KEY), detector=detect.Detector(names))
    df = spark.createDataFrame([(["see ADA, a@b.co", None, "tkn-abcd1234@email.com", ""], {"k": "BOB"})], "l array<string>, m map<string, string>")
    r = own.deep_encode(df, ["l", "m"], detect.Options(aggressive=True)).first()
    assert re.fullmatch(r"see \[TKN-\w{8}\], tkn-\w{8}@email\.com", r.l[0]) and list(r.l[1:]) == [None, "tkn-abcd1234@email.com", ""]
    assert re.fullmatch(r"\[TKN-\w{8}\]", r.m["k"])
    assert own.deep_encode(df, ["l"]).first().l[0].startswith("see ADA")  # 0.6 is under the threshold


def test_leaves(spark):
    df = payload(spark)
    got = df.select(*[nested.leaves(F.col(c), df.schema[c].dataType).alias(c) for c in ("user", "cc", "extra", "deep")]).orderBy(F.size("user").desc()).collect()
    assert got[0].user == ["bob@example.com"] and got[0].extra == ["Contact support@example.com for help."] and got[0].deep == ["555-1234"]
    assert got[1].user == [] and not nested.has_text(df.schema["i"].dataType)


def test_secure_functions(spark):
    own = Engine(spark, StaticKeys(from_passphrase("enc"), KEY))
    df = spark.createDataFrame([("bob@example.com",)], "v string")
    safe = own.encode(df, "v", "t", 1000.0).select("t")

    @secure_udf(returns="struct<says: string, n: int>", name="greet", description="greets")
    def fn(mail):
        import pandas as pd

        return pd.DataFrame({"says": "hello " + mail, "n": mail.str.len().astype("int32")})

    assert (fn.name, fn.description) == ("greet", "greets")
    r = fn(own, safe, ["t"], "out", 1001.0).first()
    assert re.fullmatch(r"hello tkn-\w{8}@email\.com", r.out.says) and r.out.n == len("bob@example.com")

    @secure_udf
    def plain(mail):
        """Doc."""
        return mail.str.upper()

    assert plain.name == "plain" and plain.description == "Doc."
    assert re.fullmatch(r"tkn-\w{8}@email\.com", plain(own, safe, ["t"], "out", 1001.0).first().out)


def test_text_functions_in_a_plan_have_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = detect.scan(docs, "text", KEY, entities_out="e", text_out="o")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert text.token(F.col("x"), KEY) is not None

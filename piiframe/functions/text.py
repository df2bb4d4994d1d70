"""Token generation, token guards and hashes as built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import hmac_pads
from .names import let

# The white space that stripping removes.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"

# What a whole value is, first match first.
CLASSES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": r"^\+?1?[\s\-.]?\(?[0-9]{3}\)?[\s\-.]?[0-9]{3}[\s\-.]?[0-9]{4}$|^[0-9]{3}[\s\-.]?[0-9]{4}$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "card": r"^([0-9]{4}[ \-]?){3}[0-9]{4}$",
    "routing": r"^[0-9]{9}$",
}

# Token shapes inside a text.
TOKEN_PATTERN = r"tkn-[a-f0-9]{8,64}@email\.com|\+1-555-[0-9]{7}|000-00-[0-9]{4}|4000-0000-0000-[0-9]{4}|000000[0-9]{3}|\[TKN-[a-f0-9]{8,64}\]"


#: Hex digits in the tokens of addresses and opaque values: of the compatible default, which two of
#: some 10^5 values may share, and of tokens that no two values share.  Patterns take 8 to 64.
NARROW, WIDE = 8, 32


def strip(c: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(c, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def classify(c: Column) -> Column:
    """email, phone, ssn, card, routing or opaque, of the stripped value."""
    return let(strip(c), _class)


def _class(v: Column) -> Column:
    out = None
    for name, pattern in CLASSES.items():
        # `$` would also match before a line end; no class holds one at its end once stripped
        test = v.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("opaque")


def digest(c: Column, master: str) -> Column:
    """HMAC-SHA256 of the stripped value under the master key, 64 hex digits."""
    return _hmac(strip(c), master)


def _hmac(v: Column, master: str) -> Column:
    inner, outer = hmac_pads(master)
    pads = [F.unhex(F.lit(x)) for x in (inner, outer)]
    return F.sha2(F.concat(pads[1], F.unhex(F.sha2(F.concat(pads[0], F.encode(v, "UTF-8")), 256))), 256)


def digits(hexed: Column, n: int, offset: int = 0) -> Column:
    """n decimal digits from hex digits (each modulo 10); padded with zeros where it is short."""
    return F.rpad(F.substring(F.translate(hexed, "abcdef", "012345"), 1 + offset, n), n, "0")


def token(c: Column, master: str, width: int = NARROW) -> Column:
    """The format-preserving token of a value; null stays null.  Formats of addresses and opaque
    values have room for `width` hex digits, the others have none to choose."""
    if not 8 <= width <= 64:
        raise ValueError(f"a token has 8 to 64 hex digits, not {width}")
    parts = lambda v: let(F.struct(_hmac(v, master).alias("h"), _class(v).alias("kind")), lambda p: _shaped(p, width))
    return F.when(c.isNotNull(), let(strip(c), parts))


def _shaped(parts: Column, width: int) -> Column:
    h, kind = parts["h"], parts["kind"]
    return (
        F.when(kind == "email", F.concat(F.lit("tkn-"), F.substring(h, 1, width), F.lit("@email.com")))
        .when(kind == "phone", F.concat(F.lit("+1-555-"), digits(h, 7)))
        .when(kind == "ssn", F.concat(F.lit("000-00-"), digits(h, 4)))
        .when(kind == "card", F.concat(F.lit("4000-0000-0000-"), digits(h, 4)))
        .when(kind == "routing", F.concat(F.lit("000000"), digits(h, 3)))
        .otherwise(F.concat(F.lit("[TKN-"), F.substring(h, 1, width), F.lit("]")))
    )


def looks_like_token(c: Column) -> Column:
    """Whether the stripped value has a token's shape (ends and lengths; digits where said)."""
    return let(strip(c), _token_shape)


def _token_shape(v: Column) -> Column:
    numeric = lambda prefix, n: v.startswith(prefix) & (F.length(v) == n) & F.substring(v, len(prefix) + 1, n).rlike("^[0-9]+$")
    return (
        (v.startswith("tkn-") & v.endswith("@email.com"))
        | (v.startswith("+1-555-") & (F.length(v) == 14))
        | numeric("000-00-", 11)
        | numeric("4000-0000-0000-", 19)
        | numeric("000000", 9)
        | (v.startswith("[TKN-") & v.endswith("]"))
    )


def token_or_same(c: Column, master: str, width: int = NARROW) -> Column:
    """A value that is a token already stays as it is."""
    return F.when(looks_like_token(c), c).otherwise(token(c, master, width))


def short(c: Column) -> Column:
    """The narrow token of a wide one, for show: it may stand for several values and is not what the
    vault has.  What is no wide token stays."""
    return F.regexp_replace(c, r"\A(?:(tkn-[a-f0-9]{8})[a-f0-9]{1,56}(@email\.com)|(\[TKN-[a-f0-9]{8})[a-f0-9]{1,56}(\]))\z", "$1$2$3$4")


def plaintext_hash(c: Column) -> Column:
    """SHA-256 of the stripped value, hex; finds a value again in the vault."""
    return F.sha2(strip(c), 256)


def luhn(c: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    return F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", ""))


def replace_tokens(text: Column, value_of: Callable[[Column], Column]) -> Column:
    """The text with each token m in it replaced by value_of(m)."""
    gaps, found = F.split(text, TOKEN_PATTERN, -1), F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    pieces = F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(value_of(F.get(found, i)), F.lit(""))))
    return F.array_join(pieces, "")

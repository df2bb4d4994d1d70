"""DuckDB SQL with the same results as the operators; an independent check of them."""

from __future__ import annotations

from ..functions.keys import hmac_pads

# White space, patterns and token shapes, as DuckDB's expressions spell them.
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEP = r"[ \t\n\x0b\f\r\-.]"
PATTERNS = [
    ("EMAIL_ADDRESS", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    ("PHONE_NUMBER", rf"\+?1?{SEP}?\(?[0-9]{{3}}\)?{SEP}?[0-9]{{3}}{SEP}?[0-9]{{4}}|[0-9]{{3}}{SEP}?[0-9]{{4}}"),
    ("US_SSN", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    ("CREDIT_CARD", r"(?:[0-9]{4}[ \-]?){3}[0-9]{4}"),
]
TOKENS = r"tkn-[a-f0-9]{8,64}@email\.com|\+1-555-[0-9]{7}|000-00-[0-9]{4}|4000-0000-0000-[0-9]{4}|000000[0-9]{3}|\[TKN-[a-f0-9]{8,64}\]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def digest(x: str, master: str) -> str:
    inner, outer = hmac_pads(master)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({strip(x)}))))"


def kind(x: str) -> str:
    v = strip(x)
    return (
        f"CASE WHEN regexp_full_match({v}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 'email'"
        f" WHEN regexp_full_match({v}, '\\+?1?[\\s\\-.]?\\(?[0-9]{{3}}\\)?[\\s\\-.]?[0-9]{{3}}[\\s\\-.]?[0-9]{{4}}|[0-9]{{3}}[\\s\\-.]?[0-9]{{4}}') THEN 'phone'"
        f" WHEN regexp_full_match({v}, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') THEN 'ssn'"
        f" WHEN regexp_full_match({v}, '([0-9]{{4}}[ \\-]?){{3}}[0-9]{{4}}') THEN 'card'"
        f" WHEN regexp_full_match({v}, '[0-9]{{9}}') THEN 'routing' ELSE 'opaque' END"
    )


def token(x: str, master: str) -> str:
    h = digest(x, master)
    n = lambda k: f"substr(translate({h}, 'abcdef', '012345'), 1, {k})"
    return (
        f"CASE {kind(x)} WHEN 'email' THEN 'tkn-' || substr({h}, 1, 8) || '@email.com' WHEN 'phone' THEN '+1-555-' || {n(7)}"
        f" WHEN 'ssn' THEN '000-00-' || {n(4)} WHEN 'card' THEN '4000-0000-0000-' || {n(4)} WHEN 'routing' THEN '000000' || {n(3)}"
        f" ELSE '[TKN-' || substr({h}, 1, 8) || ']' END"
    )


def is_token(x: str) -> str:
    v = strip(x)
    return (
        f"(({v} LIKE 'tkn-%' AND {v} LIKE '%@email.com') OR ({v} LIKE '+1-555-%' AND length({v}) = 14)"
        f" OR regexp_full_match({v}, '000-00-[0-9]{{4}}') OR regexp_full_match({v}, '4000-0000-0000-[0-9]{{4}}')"
        f" OR regexp_full_match({v}, '000000[0-9]{{3}}') OR ({v} LIKE '[TKN-%' AND {v} LIKE '%]'))"
    )


def candidates(source: str, boosted: tuple[str, ...] = (), aggressive: bool = False) -> str:
    """CTEs up to `cand`: id, t, pri, type, value, s, e, conf.  source gives id and t."""
    each = " UNION ALL ".join(f"SELECT id, t, {i} AS pri, '{name}' AS type, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM src" for i, (name, p) in enumerate(PATTERNS))
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    # Luhn over the digits from the right
    luhn = f"list_sum([CASE WHEN j % 2 = 0 THEN substr(reverse({digits}), (j + 1)::INT, 1)::INT ELSE (substr(reverse({digits}), (j + 1)::INT, 1)::INT * 2) // 10 + (substr(reverse({digits}), (j + 1)::INT, 1)::INT * 2) % 10 END FOR j IN range(length({digits}))]) % 10 = 0"
    base = "1.0" if aggressive else "CASE WHEN type IN (" + ", ".join(f"'{b}'" for b in (*boosted, "-")) + ") THEN 1.0 ELSE 0.95 END"
    return f"""src AS ({source}),
m AS ({each}),
c AS (SELECT id, t, pri, type, ms[i] AS value, (list_sum([length(x) FOR x IN ps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i-1]]), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
cand AS (SELECT id, t, pri, type, value, s, s + length(value) AS e,
      greatest({base}, CASE WHEN type = 'CREDIT_CARD' AND {luhn} THEN 0.99 ELSE 0.0 END)::DOUBLE AS conf FROM c)"""


def strict() -> str:
    """CTEs after `cand`, up to `apart`: candidates that meet no token and no longer candidate (of
    equally long ones, none that comes before)."""
    return f"""tm AS (SELECT id, regexp_extract_all(t, '{TOKENS}') AS ms, regexp_split_to_array(t, '{TOKENS}') AS ps FROM src),
tk AS (SELECT id, (list_sum([length(x) FOR x IN ps[1:i]]) + coalesce(list_sum([length(x) FOR x IN ms[1:i-1]]), 0))::BIGINT AS s, length(ms[i]) AS n
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM tm WHERE len(ms) > 0)),
free AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.id = c.id AND c.s < tk.s + tk.n AND tk.s < c.e)),
apart AS (SELECT * FROM free a WHERE NOT EXISTS (SELECT 1 FROM free b WHERE b.id = a.id AND a.s < b.e AND b.s < a.e
      AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND (b.s < a.s OR (b.s = a.s AND b.pri < a.pri))))))"""


def spans(source: str, master: str, threshold: float = 0.7, boosted: tuple[str, ...] = (), aggressive: bool = False, apart: bool = False) -> str:
    """CTEs up to `kept`: id, t, type, value, s, e, conf, masked, n (ascending within a text)."""
    return f"""{candidates(source, boosted, aggressive)}{", " + strict() if apart else ""},
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, s - e, pri) AS rn FROM {"apart" if apart else "cand"}),
g AS (SELECT id, rn, e AS last, TRUE AS keep FROM o WHERE rn = 1
      UNION ALL SELECT o.id, o.rn, CASE WHEN o.s >= g.last THEN o.e ELSE g.last END, o.s >= g.last FROM g JOIN o ON o.id = g.id AND o.rn = g.rn + 1),
kept AS (SELECT o.id, t, type, value, s, e, conf, {token('value', master)} AS masked, row_number() OVER (PARTITION BY o.id ORDER BY s) AS n
      FROM o JOIN g ON g.id = o.id AND g.rn = o.rn WHERE g.keep AND conf >= {threshold} AND NOT {is_token('value')})"""


def rewritten(name: str = "outs") -> str:
    """A CTE after `kept` and `src`: id and out, the text with spans replaced."""
    return f"""pieces AS (SELECT id, n, substr(t, (coalesce(lag(e) OVER w, 0) + 1)::BIGINT, (s - coalesce(lag(e) OVER w, 0))::BIGINT) || masked AS piece, e FROM kept WINDOW w AS (PARTITION BY id ORDER BY n)),
joined AS (SELECT id, string_agg(piece, '' ORDER BY n) AS head, max(e) AS e FROM pieces GROUP BY id),
{name} AS (SELECT src.id, CASE WHEN joined.id IS NULL THEN src.t ELSE head || substr(src.t, (joined.e + 1)::BIGINT) END AS out FROM src LEFT JOIN joined ON joined.id = src.id)"""


def restored(texts: str, vault: str, name: str = "back") -> str:
    """CTEs: id and out, the texts (id, t) with tokens that the vault (token, plain) has replaced."""
    return f"""rt AS ({texts}),
rv AS ({vault}),
rp AS (SELECT id, regexp_split_to_array(t, '{TOKENS}') AS ps, regexp_extract_all(t, '{TOKENS}') AS ms FROM rt),
ru AS (SELECT id, i, ps[i] AS gap, ms[i] AS tok FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM rp)),
{name} AS (SELECT id, string_agg(gap || coalesce(plain, tok, ''), '' ORDER BY i) AS out FROM ru LEFT JOIN rv ON rv.token = ru.tok GROUP BY id)"""

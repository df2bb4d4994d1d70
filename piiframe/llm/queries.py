"""The registered queries of this subpackage: thin uses of its operators on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, licenses, media, packing, sharding, simhash, subdedup, warc
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = subdedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "cut_spans", "n_chunks", "n_cut")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.columns(table(spark, sf_dir, "documents"), keep=False).drop("media")


def op4_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, "vec_id", "embedding", k=5)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), shards=24)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(table(spark, sf_dir, "documents"), size=4, radius=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary=packing.VOCABULARY, room=2048, end_id=1)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), per_lang=400, rows=4096)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.from_pages(table(spark, sf_dir, "pages")))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can work out as well: payloads and stored files."""
    return op3_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_license_scan,
        op3_media_columns,
        op4_ann_search,
        op5_sharding,
        op6_simhash_dedup,
        op7_packing,
        op8_bpe_codec,
        op9_language_id,
        op10_warc_derivatives,
        media_payloads,
    )
}

# Written from the contract, not from the operator: words as a list, phrases by position, and
# each template as a regular expression over the words between single spaces.
_LICENSE_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), p AS (
  SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS line,
    [i FOR i IN range(len(w)) IF w[i+1] = 'gnu' AND w[i+2] = 'general' AND w[i+3] = 'public' AND w[i+4] = 'license'] AS gpl,
    [i FOR i IN range(len(w)) IF w[i+1] = 'apache' AND w[i+2] = 'license'] AS apache,
    [i FOR i IN range(len(w)) IF w[i+1] = 'cc' AND w[i+2] = 'by'] AS ccby,
    [i FOR i IN range(len(w)) IF w[i+1] = 'mit' AND w[i+2] = 'license'] AS mit
  FROM w
), l AS (
  SELECT *, list_concat(list_concat(gpl, apache), list_concat(ccby, mit)) AS places,
    list_concat(list_concat(CASE WHEN len(apache) > 0 THEN ['apache'] ELSE [] END, CASE WHEN len(ccby) > 0 THEN ['cc-by'] ELSE [] END),
                list_concat(CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END, CASE WHEN len(mit) > 0 THEN ['mit'] ELSE [] END)) AS base,
    [t FOR t IN [{templates}] IF t IS NOT NULL] AS found
  FROM p
)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(base, ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base, found))), ',') AS labels,
  CASE WHEN len(found) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""


def _license_sql() -> str:
    """The templates' patterns: an optional region is an optional group, a replaceable one any
    words up to its bound."""

    def pattern(markup: str) -> str:
        out, at = " ", 0
        for m in [*licenses._MARK.finditer(markup), None]:
            plain = markup[at : m.start() if m else None]
            out += "".join(x.decode() + " " for x in licenses.words(plain.encode()))
            if m is None:
                return out
            at = m.end()
            out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or f"(?:[^ ]+ ){{0,{m[2].rpartition('max=')[2]}}}"

    each = [f"CASE WHEN regexp_matches(line, '{pattern(markup)}') THEN '{label}' END" for label, markups in licenses.TEMPLATES.items() for markup in markups]
    return _LICENSE_SQL.replace("{templates}", ", ".join(each))


# A WAV file is 44 bytes of header (one channel, 8000 samples a second, 8 bits each) and the payload.
_MEDIA_SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, greatest(64, ((octet_length(b) + 63) // 64) * 64) AS m, b FROM b),
w AS (SELECT *, b || unhex(repeat('00', (m - n)::INT)) AS payload FROM p),
le AS (SELECT *, [printf('%08x', (m + 36)::BIGINT), printf('%08x', m::BIGINT)] AS h FROM w),
f AS (SELECT *, [substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) FOR x IN h] AS l FROM le)
SELECT doc_id, n::BIGINT AS n_bytes, m::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, (m + 44)::BIGINT AS media_bytes,
  sha256(unhex('52494646' || l[1] || '57415645666d74201000000001000100401f0000401f00000100080064617461' || l[2]) || payload) AS media_sha256
FROM f
"""

ORACLE: dict[str, str] = {"op2_license_scan": _license_sql(), "media_payloads": _MEDIA_SQL}

"""Detection of sensitive values in text, and their replacement by tokens.

The first tier is built from expressions alone: matches of four patterns, their places, the
leftmost-then-longest choice among overlapping ones, and the rewritten text.  A caller's
detector can follow as a second tier on the rewritten text.  Detection never writes; what it
finds is kept by the vault in a job of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import unused
from ..functions.text import NARROW, TOKEN_PATTERN, looks_like_token, luhn, token

# First-tier patterns in their order of precedence.  The class before a phone
# number may be a separator that is replaced with it.
PATTERNS = {
    "EMAIL_ADDRESS": r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+",
    "PHONE_NUMBER": r"\+?1?[ \t\n\x0b\f\r\-.]?\(?[0-9]{3}\)?[ \t\n\x0b\f\r\-.]?[0-9]{3}[ \t\n\x0b\f\r\-.]?[0-9]{4}|[0-9]{3}[ \t\n\x0b\f\r\-.]?[0-9]{4}",
    "US_SSN": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "CREDIT_CARD": r"(?:[0-9]{4}[ \-]?){3}[0-9]{4}",
}

# Phrases whose presence in a context raises confidence.
CONTEXT_KEYWORDS = ["account number", "ssn", "phone", "credit card", "iban", "bank", "email", "pii", "personal info"]

# A text without any of these has no match of any pattern.
GATE = r"@|[0-9]{3}[ \t\n\x0b\f\r\-.]?[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}"

# The e-mail pattern tried only where a run of its characters starts or the last match ended:
# the same matches, without a scan of the rest of the run from each of its characters.
_FIND = {**PATTERNS, "EMAIL_ADDRESS": r"(?:\G|(?<![a-zA-Z0-9_.+-]))[a-zA-Z0-9_.+-]++@[a-zA-Z0-9-]++\.[a-zA-Z0-9-.]+"}

ENTITY = "struct<type: string, value: string, method: string, confidence: double, masked_value: string>"
TIERS = ("regex", "checksum", "nlp")

# What a statistical detector is asked for, and the models that are tried in order.
ENTITY_TYPES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD", "US_BANK_NUMBER", "CRYPTO", "IBAN_CODE", "IP_ADDRESS", "PERSON")
MODELS = ("en_core_web_lg", "en_core_web_md", "en_core_web_sm")


@dataclass(frozen=True)
class Options:
    """pipeline: any of regex, checksum (each turns the first tier on) and nlp; empty means all.
    strict_spans: drop matches inside a token, and prefer the longest of overlapping matches."""

    pipeline: Sequence[str] = TIERS
    threshold: float = 0.7
    context: str | None = None
    aggressive: bool = False
    strict_spans: bool = False

    @property
    def first(self) -> bool:
        return bool({"regex", "checksum"} & set(self.pipeline or TIERS))

    @property
    def second(self) -> bool:
        return "nlp" in (self.pipeline or TIERS)

    def boosted(self, kind: str) -> bool:
        low = (self.context or "").lower()
        return self.aggressive or kind.lower().replace("_", " ") in {k for k in CONTEXT_KEYWORDS if k in low}


@dataclass(frozen=True)
class Detector:
    """A second-tier detector: find(list of texts) gives for each text a list of mappings with
    start, end, entity_type and perhaps score.  fail_open: a text on which it fails has no finds,
    instead of stopping the job.  entity_types: others are left out (none named: all count)."""

    find: Callable[[list[str]], list[list[dict]]]
    method: str = "nlp"
    default_score: float = 0.7
    fail_open: bool = False
    boost: float = field(default=0.2)
    entity_types: Sequence[str] = ()


def remote(url: str, language: str = "en", timeout: float = 10.0, fail_open: bool = False) -> Detector:
    """A detector behind an HTTP service: one request for each text, a JSON list of spans back.
    The connection is kept for a batch of texts."""

    def find(texts: list[str]) -> list[list[dict]]:
        import http.client
        import json
        from urllib.parse import urlsplit

        at = urlsplit(url)
        kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
        link = kind(at.netloc, timeout=timeout)
        place = (at.path or "/") + (f"?{at.query}" if at.query else "")
        out = []
        try:
            for text in texts:
                if not text:
                    out.append([])
                    continue
                link.request("POST", place, json.dumps({"text": text, "language": language}), {"Content-Type": "application/json"})
                answer = link.getresponse()
                body = answer.read()
                if answer.status >= 400:
                    raise OSError(f"detector answered {answer.status}")
                out.append(json.loads(body))
        finally:
            link.close()
        return out

    return Detector(find, method="nlp-remote", fail_open=fail_open)


def statistical(models: Sequence[str] = MODELS, entity_types: Sequence[str] = ENTITY_TYPES, language: str = "en", fail_open: bool = False) -> Detector:
    """A detector by an analyser with a language model, loaded once in each worker: the first of
    the models that is installed there.  Both libraries are the caller's to install."""
    loaded: list = []

    def find(texts: list[str]) -> list[list[dict]]:
        if not loaded:
            import spacy.util
            from presidio_analyzer import AnalyzerEngine
            from presidio_analyzer.nlp_engine import NlpEngineProvider

            name = next((m for m in models if spacy.util.is_package(m)), None)
            if name is None:
                raise ImportError(f"install one of the language models {', '.join(models)}")
            engine = NlpEngineProvider(nlp_configuration={"nlp_engine_name": "spacy", "models": [{"lang_code": language, "model_name": name}]}).create_engine()
            loaded.append(AnalyzerEngine(nlp_engine=engine, supported_languages=[language]))
        asked = list(entity_types) or None
        return [[{"start": r.start, "end": r.end, "entity_type": r.entity_type, "score": r.score} for r in loaded[0].analyze(text=t, entities=asked, language=language)] if t else [] for t in texts]

    return Detector(find, fail_open=fail_open, entity_types=tuple(entity_types))


def resolve_boost(context: Column) -> Column:
    """The keywords that a context column holds."""
    return F.filter(F.array(*[F.lit(k) for k in CONTEXT_KEYWORDS]), lambda k: F.contains(F.lower(context), k))


def _found(text: Column, kind: str) -> Column:
    """All matches of a pattern, with start (from 0)."""
    matches = F.regexp_extract_all(text, F.lit(f"({_FIND[kind]})"), F.lit(1))
    first = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<start: int, value: string>>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        # the first place of the same characters at or after the last match is the match's own
        at = F.call_function("locate", m, text, acc["cursor"])
        return F.struct((at + F.length(m)).alias("cursor"), F.array_append(acc["out"], F.struct((at - 1).alias("start"), m.alias("value"))).alias("out"))

    return F.aggregate(matches, first, add, lambda acc: acc["out"])


def candidates(text: Column, options: Options = Options()) -> Column:
    """All matches: array of (start, end, pri, type, value, confidence), pattern by pattern."""
    def full(kind: str, pri: int) -> Callable[[Column], Column]:
        base = F.lit(1.0 if options.boosted(kind) else 0.95)
        sure = (lambda m: F.greatest(base, F.when(luhn(m["value"]), 0.99).otherwise(0.0))) if kind == "CREDIT_CARD" else (lambda m: base)
        return lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), F.lit(pri).alias("pri"), F.lit(kind).alias("type"), m["value"].alias("value"), sure(m).alias("confidence"))

    lists = [F.transform(_found(text, kind), full(kind, pri)) for pri, kind in enumerate(PATTERNS)]
    lists[0] = F.when(F.contains(text, F.lit("@")), lists[0]).otherwise(F.array().cast(SPANS))
    return F.when(text.rlike(GATE), F.concat(*lists)).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start: int, end: int, pri: int, type: string, value: string, confidence: double>>"


def _inside_tokens(text: Column) -> Column:
    """Places of tokens in a text: array of (start, end)."""
    matches = F.regexp_extract_all(text, F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    first = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<start: int, end: int>>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, acc["cursor"])
        return F.struct((at + F.length(m)).alias("cursor"), F.array_append(acc["out"], F.struct((at - 1).alias("start"), (at - 1 + F.length(m)).alias("end"))).alias("out"))

    return F.aggregate(matches, first, add, lambda acc: acc["out"])


def resolve(spans: Column) -> Column:
    """Leftmost first, the longest of those, then in pattern order; none overlaps the last kept."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("back"), s["pri"].alias("pri"), s.alias("span"))))
    first = F.struct(F.lit(-1).alias("last"), F.array().cast(SPANS).alias("kept"))
    add = lambda acc, k: F.when(k["start"] >= acc["last"], F.struct(k["span"]["end"].alias("last"), F.array_append(acc["kept"], k["span"]).alias("kept"))).otherwise(acc)
    return F.aggregate(keyed, first, add, lambda acc: acc["kept"])


def resolve_longest(spans: Column) -> Column:
    """A span goes where a longer one (or an equal one before it) overlaps it; then as resolve."""
    longer = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (F.struct(b["start"] - b["end"], b["start"], b["pri"]) < F.struct(a["start"] - a["end"], a["start"], a["pri"]))
    return resolve(F.filter(spans, lambda a: ~F.exists(spans, lambda b: longer(a, b))))


def _splice(text: Column, spans: Column, value: Callable[[Column], Column]) -> Column:
    """The text with spans (ascending, disjoint) replaced."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    add = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), value(s)).alias("out"))
    return F.aggregate(spans, first, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _entities(spans: Column, method: str) -> Column:
    """Last place first, as the entity list has them."""
    return F.reverse(F.transform(spans, lambda s: F.struct(s["type"].alias("type"), s["value"].alias("value"), F.lit(method).alias("method"), s["confidence"].alias("confidence"), s["masked"].alias("masked_value"))))


def _kept(spans: Column, options: Options, master: str, width: int = NARROW) -> Column:
    """Spans over the threshold that are no tokens, with their tokens."""
    sure = F.filter(spans, lambda s: (s["confidence"] >= options.threshold) & ~looks_like_token(s["value"]))
    return F.transform(sure, lambda s: s.withField("masked", token(s["value"], master, width)))


def _judged(texts: list[str], options: Options, detector: Detector) -> list[list[dict]]:
    """A detector's finds as span rows, with raised confidence where it is due."""

    def judge(some: list[str]) -> list[list[dict]]:
        rows = []
        for t, spans in zip(some, detector.find(some), strict=True):
            row = []
            for s in spans:
                score, kind = float(s.get("score", detector.default_score)), s["entity_type"]
                if detector.entity_types and kind not in detector.entity_types:
                    continue
                sure = min(1.0, score + detector.boost) if options.boosted(kind) else score
                row.append({"start": s["start"], "end": s["end"], "pri": 0, "type": kind, "value": t[s["start"] : s["end"]], "confidence": sure})
            rows.append(row)
        return rows

    def alone(text: str) -> list[dict]:
        try:
            return judge([text])[0]
        except Exception:
            return []

    try:
        return judge(texts)
    except Exception:
        if not detector.fail_open:
            raise
    return [alone(t) for t in texts]  # one text's failure leaves no other unscanned


def _second_tier(df: DataFrame, text: str, out: str, options: Options, detector: Detector, master: str, width: int = NARROW) -> DataFrame:
    """Columns `out` (spans with tokens) found by a detector in df[text]."""

    @F.pandas_udf(SPANS)
    def find(texts):
        import pandas as pd

        return pd.Series(_judged([t or "" for t in texts], options, detector))

    with_spans = df.withColumn(out, find(F.col(text))).withColumn(out, resolve(F.col(out)))
    return with_spans.withColumn(out, _kept(F.col(out), options, master, width))


def second_spans(df: DataFrame, texts: Column, out: str, options: Options, detector: Detector) -> DataFrame:
    """A map from each text of an array column to the detector's spans in it, for nested columns,
    whose lambdas cannot call Python themselves."""

    @F.pandas_udf(f"map<string, {SPANS}>")
    def find(lists):
        import pandas as pd

        each = [list(dict.fromkeys(t for t in (ts if ts is not None else []) if t)) for ts in lists]
        found = iter(_judged([t for ts in each for t in ts], options, detector))
        return pd.Series([{t: next(found) for t in ts} for ts in each])

    return df.withColumn(out, find(texts))


def scan(df: DataFrame, text: str, master: str, options: Options = Options(), detector: Detector | None = None, text_out: str | None = None, entities_out: str | None = None, width: int = NARROW) -> DataFrame:
    """df with the rewritten text and/or the entity list.  A null text gives null and no
    entities.  Without a detector the second tier finds nothing.  `width` is that of tokens."""
    source = F.col(text)
    nothing = F.array().cast(f"array<{ENTITY}>")
    own, every, tokens, kept, second = unused(df, "pii_text", "pii_all", "pii_tokens", "pii_kept", "pii_second")
    work = df.withColumn(own, F.coalesce(source.cast("string"), F.lit("")))
    entities: list[Column] = []
    if options.first:
        work = work.withColumn(every, candidates(F.col(own), options))
        if options.strict_spans:
            work = work.withColumn(tokens, _inside_tokens(F.col(own)))
            work = work.withColumn(every, F.filter(every, lambda s: ~F.exists(tokens, lambda t: (s["start"] < t["end"]) & (t["start"] < s["end"]))))
            work = work.withColumn(kept, resolve_longest(F.col(every)))
        else:
            work = work.withColumn(kept, resolve(F.col(every)))
        work = work.withColumn(kept, _kept(F.col(kept), options, master, width))
        work = work.withColumn(own, F.when(F.size(kept) > 0, _splice(F.col(own), F.col(kept), lambda s: s["masked"])).otherwise(F.col(own)))
        entities.append(_entities(F.col(kept), "regex"))
    if options.second and detector is not None:
        work = _second_tier(work, own, second, options, detector, master, width)
        work = work.withColumn(own, _splice(F.col(own), F.col(second), lambda s: s["masked"]))
        entities.append(_entities(F.col(second), detector.method))
    if entities_out:
        work = work.withColumn(entities_out, F.when(source.isNull(), nothing).otherwise(F.concat(*entities)) if entities else nothing)
    if text_out:
        work = work.withColumn(text_out, F.when(source.isNull(), None).otherwise(F.col(own)))
    return work.drop(own, every, tokens, kept, second)

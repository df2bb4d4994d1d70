"""WARC derivatives: metadata and plain-text conversion records of response records.

A response record gives a metadata record (title, declared language, links, sizes) and a
conversion record (the visible text).  Both name the response in WARC-Refers-To, keep its target
address, date and other headers that concern the source (its payload digest as
WARC-Source-Payload-Digest), and have digests of their own block; identifiers are derived from
the content, so that a second run gives the same records.  HTTP bodies are read through their
transfer and content encodings, and as text by the charset of the header, a byte order mark, a
meta element, or else UTF-8 (Windows-1252 where that does not fit).

Defined results: a null address or page counts as empty; an empty page gives a response of no
content, a metadata record and an empty conversion.  A record that is no response gives nothing.
Repeated rows get equal records.  A null page_id is kept.  A row's records count up to the first
broken one (no version line, no length, or no record id to refer to).  Of a body whose encoding
breaks off, what came before counts; one in an encoding that is not known here has no text.  An
empty table gives no rows.  Only page_id, url and html are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

VERSION = b"WARC/1.1"
#: Headers of the source that its derivatives keep.
SOURCE_HEADERS = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type")
#: Header names as they are written; they are read in any case.
NAMES = {n.lower(): n for n in (*SOURCE_HEADERS, "WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Concurrent-To", "WARC-Truncated", "Content-Type", "Content-Length")}

#: Bytes that are inflated at a time, so that many members in a row cost no copies of the rest.
AT_ONCE = 1 << 16

Record = tuple[dict[str, str], bytes]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def write(record: Record) -> bytes:
    headers, block = record
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode() for k, v in headers.items()), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def unzipped(data: bytes) -> bytes:
    """The gzip members of data one after another; of a broken one, what came before."""
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            part = data[at : at + AT_ONCE]
            try:
                out.append(member.decompress(part))
            except zlib.error:
                return b"".join(out)
            at += len(part) - len(member.unused_data)
        while data[at : at + 1] == b"\0":
            at += 1
    return b"".join(out)


def read(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or with gzip members."""
    data = unzipped(data) if data[:2] == b"\x1f\x8b" else data
    at, end = 0, len(data)

    def line() -> bytes:
        nonlocal at
        start, at = at, (data.find(b"\n", at) + 1) or end
        return data[start:at]

    while at < end:
        first = line()
        if not first.strip():
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        last = None
        while at < end and (own := line()).strip():
            if own[:1] in b" \t" and last:  # a folded header
                headers[last] += " " + own.decode("utf-8", "replace").strip()
                continue
            name, _, value = own.decode("utf-8", "replace").partition(":")
            last = NAMES.get(name.strip().lower(), name.strip())
            headers[last] = value.strip()
        length = headers.get("Content-Length", "")
        if not length.isdecimal():
            raise ValueError("a WARC record without a length")
        yield headers, data[at : at + int(length)]
        at += int(length)


def readable(data: bytes) -> Iterator[Record]:
    """Records of data up to the first broken one."""
    try:
        yield from read(data)
    except ValueError:
        return


def response(url: str, page: bytes, date: str) -> Record:
    """A response record as a crawler would have written it for the page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(page) + page
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": identifier("response", url, digest(block)),
        "WARC-Target-URI": url,
        "WARC-Date": date,
        "WARC-Payload-Digest": digest(page),
        "WARC-Block-Digest": digest(block),
        "WARC-Identified-Payload-Type": "text/html",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    return headers, block


_PART = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>script|style|noscript|template)\b[^>]*>(?:.*?</(?P=raw)\s*>|.*)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>[^>]*)>?|<[!?/][^>]*>?|(?P<text>[^<]+)|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th title tr ul".split())
_HEAD = frozenset("base html link meta noscript script style template title".split())
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")


def visible(page: str) -> tuple[str, dict[str, list[str]]]:
    """Plain text of a page, one line per block, and fields: title, language, charset, links."""
    out: list[str] = []
    fields: dict[str, list[str]] = {"title": [], "language": [], "charset": [], "outlink": []}
    in_title = in_head = False
    for m in _PART.finditer(page):
        text, tag = m["text"], m["tag"]
        if text is not None:
            if in_title:
                fields["title"].append(text)
            elif not in_head:
                out.append(text)
        elif tag:
            tag, closes = tag.lower(), bool(m["close"])
            if tag == "title":
                in_title = not closes
            elif tag == "head":
                in_head = not closes
            elif tag not in _HEAD:  # what cannot stand in a title or head ends both
                in_title = in_head = False
            if tag in _BLOCK:
                out.append("\n")
            if not closes and tag in ("a", "html", "meta"):
                own = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m["rest"])}
                for key, name in (("href", "outlink"), ("lang", "language"), ("charset", "charset")):
                    if own.get(key):
                        fields[name].append(_clean(entities.unescape(own[key])))
    plain = entities.unescape("".join(out)).replace("\r", "\n")
    plain = _LINES.sub("\n", _SPACE.sub(" ", plain)).strip()
    fields["title"] = [_clean(_SPACE.sub(" ", entities.unescape("".join(fields["title"]))))] if fields["title"] else []
    return plain, fields


def http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the body of an HTTP response; without a status line all
    is body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    end = re.search(rb"\r?\n\r?\n", block)
    head = block[: end.start()] if end else block
    fields: dict[str, str] = {}
    last = None
    for own in head.decode("latin-1").splitlines()[1:]:
        if own[:1] in " \t" and last:
            fields[last] += " " + own.strip()
            continue
        name, _, value = own.partition(":")
        last = name.strip().lower()
        fields[last] = f"{fields[last]}, {value.strip()}" if last in fields else value.strip()
    return fields, block[end.end() :] if end else b""


def unchunked(body: bytes) -> bytes:
    """A body without its transfer encoding by chunks; a body that has none comes back as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return b"".join(out) if out else body
        if not int(size, 16):
            return b"".join(out)
        at = end + 1 + int(size, 16)
        out.append(body[end + 1 : at])
        at += 2 if body[at : at + 1] == b"\r" else 1


def payload(block: bytes) -> bytes:
    """The payload of a response: its HTTP body without the transfer encoding."""
    fields, body = http(block)
    return unchunked(body) if "chunked" in fields.get("transfer-encoding", "").lower() else body


def _inflated(data: bytes, kinds: tuple[int, ...]) -> bytes:
    """data inflated by the first kind of wrapper that fits, as far as it goes."""
    for kind in kinds:
        step, out = zlib.decompressobj(kind), []
        try:
            for at in range(0, len(data), AT_ONCE):
                out.append(step.decompress(data[at : at + AT_ONCE]))
        except zlib.error:
            if not out or not any(out):
                continue
        return b"".join(out)
    return b""


def content(block: bytes) -> bytes | None:
    """The payload without its content encodings; None where one is not known here."""
    data = payload(block)
    coded = [x.strip().lower() for x in http(block)[0].get("content-encoding", "").split(",")]
    for kind in reversed([x for x in coded if x and x != "identity"]):
        if kind in ("gzip", "x-gzip"):
            data = (unzipped(data) or _inflated(data, (31,))) if data[:2] == b"\x1f\x8b" else data
        elif kind == "deflate":
            data = _inflated(data, (15, -15))
        else:
            return None
    return data


_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_META = re.compile(rb"<meta\b[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
# Labels that browsers read as another charset.
_READ_AS = {"iso8859-1": "cp1252", "ascii": "cp1252", "iso8859-9": "cp1254", "gb2312": "gb18030", "gbk": "gb18030", "euc_kr": "cp949", "shift_jis": "cp932", "tis-620": "cp874"}


def as_text(page: bytes, content_type: str = "") -> str:
    for mark, name in _MARKS:
        if page.startswith(mark):
            return page[len(mark) :].decode(name, "replace")
    found = _CHARSET.search(content_type)
    label = found[1] if found else (m[1].decode("ascii", "replace") if (m := _META.search(page[:4096])) else "")
    if not found and label.lower().startswith("utf-16"):
        label = "utf-8"  # a meta element that could be read is in no such charset
    try:
        name = codecs.lookup(label).name if label else ""
        if name:
            return page.decode(_READ_AS.get(name, name), "replace")
    except (LookupError, ValueError):
        pass
    try:
        return page.decode("utf-8")
    except UnicodeDecodeError as e:
        # a page that was cut off within a character is UTF-8 still
        return page.decode("utf-8", "replace") if e.start >= len(page) - 3 or label else page.decode("cp1252", "replace")


def derive(source: Record) -> list[Record]:
    """The metadata and conversion records of a response record."""
    headers, block = source
    fields, body = http(block)
    page = content(block)
    plain, found = visible(as_text(page or b"", fields.get("content-type", "")))
    kept = {k: headers[k] for k in SOURCE_HEADERS if k in headers}
    raw = payload(block)
    kept["WARC-Source-Payload-Digest"] = headers.get("WARC-Payload-Digest") or digest(raw)
    about = [*[f"{k}: {v}" for k, vs in found.items() for v in vs], f"payload-bytes: {len(raw)}", f"text-bytes: {len(plain.encode())}"]
    if page is None:
        about.append(f"undecoded: {_clean(fields['content-encoding'])}")
    made = [("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in about).encode()), ("conversion", "text/plain; charset=utf-8", plain.encode())]
    out = []
    for kind, content_type, data in made:
        own = {
            "WARC-Type": kind,
            "WARC-Record-ID": identifier(kind, headers["WARC-Record-ID"], digest(data)),
            "WARC-Refers-To": headers["WARC-Record-ID"],
            **kept,
            "WARC-Block-Digest": digest(data),
            "Content-Type": content_type,
            "Content-Length": str(len(data)),
        }
        if kind == "conversion":  # the digest of the payload that it holds itself
            own["WARC-Payload-Digest"] = digest(data)
            own["WARC-Identified-Payload-Type"] = "text/plain"
        out.append((own, data))
    return out


def from_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, record: each page as the bytes of a response record."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            made = [write(response(u, p, date)) for u, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(page), F.lit("")).cast("binary").alias("html"))
    return rows.mapInArrow(of, "page_id long, record binary")


COLUMNS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, payload_digest string, source_digest string, block_digest string, record binary"


def derivatives(records: DataFrame, source: str = "record") -> DataFrame:
    """Two rows for each response in the records (page_id and bytes of one record or more),
    with the parsed headers beside the record's own bytes, ready to be written one after another."""
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in COLUMNS.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in readable(data or b""):
                    if found[0].get("WARC-Type") != "response":
                        continue
                    if "WARC-Record-ID" not in found[0]:
                        break
                    for h, block in derive(found):
                        get = h.get
                        rows.append((key, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], get("WARC-Target-URI"), get("WARC-Date"), h["Content-Type"], len(block), get("WARC-Payload-Digest"), h["WARC-Source-Payload-Digest"], h["WARC-Block-Digest"], write((h, block))))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names)

    small_batches(records.sparkSession)
    return records.select(F.col("page_id").cast("long").alias("page_id"), F.col(source).alias("record")).mapInArrow(of, COLUMNS)


def write_files(derived: DataFrame, path: str, files: int) -> None:
    """Write the records as gzip members (one per record, as readers of WARC expect) into
    `files` Parquet rows of name and bytes under path, by a hash of the record's identifier."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip.compress(r, mtime=0) for r in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(members, pa.binary())], ["record_id", "member"])

    rows = derived.select("record_id", "record").mapInArrow(of, "record_id string, member binary")
    rows.withColumn("file", F.pmod(F.xxhash64("record_id"), F.lit(files))).repartition("file").sortWithinPartitions("file", "record_id").write.partitionBy("file").parquet(path)

"""Operator 10: WARC derivatives: from response records, linked metadata records and plain-text conversion records.

A record is a row: type, id, refers-to, target URI, date, content type, block, digests. Derived records name the response's id in
WARC-Refers-To, keep its source headers, and carry digests of their own blocks. Record ids are name-based, so a rerun of a lost
task writes the same ids. Records can be written as, and read from, WARC/1.1 bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "`{key}` {kind}, seq int, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, source_headers string, block binary"
DATE = "1970-01-01T00:00:00Z"

_DROP = re.compile(r"<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<(?:script|style)\b[^>]*>.*\Z", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|blockquote|pre|title|head|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^<>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + chr(10) + chr(10).join(parts))}>"


def plain_text(page: str) -> str:
    """Text of a page: scripts, styles and comments go, block tags end lines, entities are read, white space is joined."""
    t = _DROP.sub(" ", page)
    t = _TAG.sub("", _BREAK.sub("\n", t))
    t = html.unescape(t)
    return "\n".join(x for x in (_BLANK.sub(" ", line).strip() for line in t.split("\n")) if x)


def http_parts(block: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (lower-case names, repeated ones joined) and body of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return "", {}, block
    first, *rest = head.decode("latin-1").split("\r\n")
    headers: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            k = name.strip().lower()
            headers[k] = f"{headers[k]}, {value.strip()}" if k in headers else value.strip()
    return first, headers, body


def decoded(headers: dict[str, str], body: bytes) -> str:
    """The body as text: its stated transfer and content coding, then its charset (UTF-8 where none is known)."""
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, rest = [], body
        while rest:
            size, mark, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not n or not mark:
                break
            out.append(rest[:n])
            rest = rest[n + 2 :]
        body = b"".join(out)
    if "gzip" in headers.get("content-encoding", "").lower():
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            pass
    m = _CHARSET.search(headers.get("content-type", "").encode() + b" " + body[:2048])
    try:
        return body.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Response records (SCHEMA) of fetched pages: a null url is empty, a null page an empty body."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, u, h in pdf.itertuples(index=False):
                u, body = u or "", (h or "").encode("utf-8", "replace")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                rows.append((k, 0, "response", record_id("response", str(k), u, digest(body)), None, u, DATE, "application/http; msgtype=response", len(block), digest(block), digest(body), None, block))
            yield pd.DataFrame(rows, columns=_columns(key))

    return pages.select(key, url, page).mapInPandas(run, SCHEMA.format(key=key, kind=kind))


def _columns(key: str) -> list[str]:
    return [key, "seq", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "source_headers", "block"]


def derivatives(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Metadata and conversion records of response records, with what they refer to; other record types give none.

    Both keep the response's id in refers_to and its HTTP headers in source_headers (JSON); the metadata record also states the
    payload's digest, title, language and links. Empty pages give empty conversions. Repeated responses give repeated records with
    equal ids.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, rid, uri, date, payload, block in pdf.itertuples(index=False):
                status, headers, body = http_parts(bytes(block or b""))
                page = decoded(headers, body)
                source = json.dumps({"status": status, **headers}, ensure_ascii=False, sort_keys=True)
                text = plain_text(page).encode("utf-8", "replace")
                title, lang = _TITLE.search(page), _LANG.search(page)
                links = [html.unescape(a or b or c) for a, b, c in _LINK.findall(page)]
                conversion = record_id("conversion", rid, digest(text))
                fields = [("payload-digest", payload or digest(body)), ("conversion-record", conversion), ("title", plain_text(title[1]).replace("\n", " ") if title else ""), ("lang", lang[1].lower() if lang else ""), ("text-bytes", str(len(text))), ("n-outlinks", str(len(links))), *[("outlink", x.replace("\r", " ").replace("\n", " ")) for x in links]]
                meta = "".join(f"{n}: {v}\r\n" for n, v in fields).encode("utf-8", "replace")
                rows.append((k, 1, "metadata", record_id("metadata", rid, digest(meta)), rid, uri, date, "application/warc-fields", len(meta), digest(meta), None, source, meta))
                rows.append((k, 2, "conversion", conversion, rid, uri, date, "text/plain; charset=utf-8", len(text), digest(text), payload or digest(body), source, text))
            yield pd.DataFrame(rows, columns=_columns(key))

    wanted = records.filter(F.col("warc_type") == "response").select(key, "record_id", "target_uri", "warc_date", "payload_digest", "block")
    return wanted.mapInPandas(run, SCHEMA.format(key=key, kind=kind))


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files (plain or gzipped) at a path: file, place and the fields of from_bytes(). A file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(name, i, *(r[f] for f in _FIELDS)) for name, data in pdf.itertuples(index=False) for i, r in enumerate(from_bytes(bytes(data)))]
            yield pd.DataFrame(rows, columns=["file", "place", *_FIELDS])

    kinds = ", ".join(f"{f} {'long' if f == 'content_length' else 'binary' if f == 'block' else 'string'}" for f in _FIELDS)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, place int, {kinds}")


_FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length", "block_digest", "payload_digest", "source_headers", "block")


def to_bytes(row) -> bytes:
    """A record in WARC/1.1 form."""
    named = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["warc_date"]), ("Content-Type", row["content_type"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Source-Headers", row["source_headers"])]
    block = bytes(row["block"])
    head = "".join(f"{n}: {v}\r\n" for n, v in named if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def from_bytes(data: bytes) -> Iterator[dict]:
    """Records of WARC bytes (each member gzipped or not), in order; ends at the first that is cut short."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError):
            return
    at = 0
    while True:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        h = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
        size = int(h["content-length"]) if h.get("content-length", "").isdigit() else 0
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        yield {"warc_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "content_type": h.get("content-type"), "content_length": size, "block_digest": h.get("warc-block-digest"), "payload_digest": h.get("warc-payload-digest"), "source_headers": h.get("warc-source-headers"), "block": block}
        at = end + 4 + size + 4

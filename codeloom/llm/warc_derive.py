"""WARC derivatives: from each response record a metadata and a conversion record that refer to it.

Records follow the public WARC 1.1 format, a gzip member each. ``read_warc`` reads the records of .warc and .warc.gz files
(a file is one row of Spark's binary reader, so 2 GB at most); ``responses`` writes a response record for each row of a
table of pages. ``derivatives`` takes response records apart: WARC header, HTTP header, payload (chunked and compressed
transfers undone, the character set taken from the header, the page or else UTF-8), and builds

* ``metadata`` (application/warc-fields): every named field of the source's WARC header and of its HTTP header, its
  digests as stated and as found, its length, whether it was cut off, title and number of links;
* ``conversion`` (text/plain): the visible text of an HTML or plain-text payload. Other payloads have no conversion.

Both carry WARC-Refers-To, WARC-Refers-To-Target-URI and -Date, the source's WARC-Target-URI, WARC-Date and
WARC-Warcinfo-ID, and their own digests. Record ids are name-based (UUID 5) on the source's id and the type, so that a
task that runs again gives the same ones; a source without an id gets one from its target and payload.

Nulls: a null page has an empty payload, which gives an empty conversion; a null url gives records without a target
URI. Records of other types, and what is no record, give nothing. Repeated rows give repeated records with equal ids.
Extra columns are left alone. An empty table gives no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, text_batches

#: Pages carry no date of their own; a column named date is used where there is one.
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:derivative")
#: Compression of members: they are written once and read once.
LEVEL = 1
_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|title)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*(?:>|$)", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*(?:>|$)")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|$)", re.S | re.I)
_LINK = re.compile(r"<a\s[^>]*\bhref\b", re.I)
_CHARSET = re.compile(rb"<meta\s[^>]*charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record_id(kind: str, source: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"


def one_line(text: str) -> str:
    """A header value must not break its line."""
    return " ".join(text.split())


@dataclass
class Record:
    """headers: named fields in order; block: what they describe; cut: the block is shorter than its stated length."""

    headers: list[tuple[str, str]]
    block: bytes
    cut: bool = False

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), default)


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The record as it stands in a WARC file."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The record as a gzip member of its own, without a time of writing."""
    return gzip.compress(serialize(headers, block), LEVEL, mtime=0)


def named_fields(raw: bytes) -> list[tuple[str, str]]:
    """Fields of a header; lines that begin with white space go on with the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def head_and_rest(raw: bytes) -> tuple[bytes, bytes]:
    """What stands before and behind the first empty line."""
    m = re.search(rb"\r?\n\r?\n", raw)
    return (raw[: m.start()], raw[m.end() :]) if m else (raw, b"")


def records_of(raw: bytes) -> Iterator[Record]:
    """The records of an uncompressed stretch of a WARC file; what isn't one is passed over."""
    at = raw.find(b"WARC/")
    while at >= 0:
        head, rest = head_and_rest(raw[at:])
        behind = len(raw) - len(rest)
        headers = named_fields(head.partition(b"\n")[2])
        length = next((v for k, v in headers if k.lower() == "content-length"), "")
        if length.isdigit():
            end = behind + int(length)
        else:
            nxt = raw.find(b"\r\n\r\nWARC/", behind)
            end = nxt if nxt >= 0 else len(raw)
        yield Record(headers, raw[behind:end], end > len(raw))
        at = raw.find(b"WARC/", min(end, len(raw)))


def inflated(raw: bytes) -> Iterator[bytes]:
    """The contents of the gzip members that follow one another; plain contents as they are. A broken member gives what
    can be read of it, and the next one is looked for."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    at = 0
    while 0 <= at < len(raw):
        open_ = zlib.decompressobj(31)
        out = b""
        try:
            out = open_.decompress(raw[at:])
            used = len(raw) - at - len(open_.unused_data) if open_.eof else len(raw) - at
            at += used
        except zlib.error:
            at = raw.find(b"\x1f\x8b\x08", at + 3)
        yield out


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked transfer; from the first broken chunk on, nothing."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"0", 16)
        except ValueError:
            break
        if size <= 0:
            break
        out.append(body[end + 1 : end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at : at + 2] == b"\r\n" else 1 if body[at : at + 1] == b"\n" else 0
    return b"".join(out)


def http_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, header fields, payload) of a response's block; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    head, body = head_and_rest(block)
    first, _, rest = head.partition(b"\n")
    fields = named_fields(rest)
    value = {k.lower(): v.lower() for k, v in fields}
    if "chunked" in value.get("transfer-encoding", ""):
        body = unchunked(body)
    coding = value.get("content-encoding", "")
    if coding in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                continue
    return first.decode("utf-8", "replace").strip(), fields, body


def decoded(payload: bytes, content_type: str) -> str:
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type, re.I)
    stated = _CHARSET.search(payload[:4096])
    for name in (named and named[1], stated and stated[1].decode()):
        try:
            return payload.decode(name, "replace") if name else payload.decode()
        except (LookupError, UnicodeDecodeError):
            continue
    return payload.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """The visible text, one line a block."""
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def response(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, block) of a response record of a page."""
    payload = (page or "").encode()
    block = (HTTP % len(payload)).encode() + payload
    own = digest(payload)
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", f"{page_id} {url} {own}")), ("WARC-Date", date)]
    headers += [] if url is None else [("WARC-Target-URI", one_line(url))]
    return [*headers, ("WARC-Payload-Digest", own), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block


def derive(source: Record) -> list[dict]:
    """The metadata and the conversion record of a response: {warc_type, headers, block, source}."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return []
    status, fields, payload = http_response(source.block)
    content_type = next((v for k, v in fields if k.lower() == "content-type"), "text/html" if not fields else "")
    found = digest(payload)
    target, date = source.get("WARC-Target-URI"), source.get("WARC-Date", DATE)
    refers = source.get("WARC-Record-ID") or record_id("response", f"{target} {found}")
    textual = re.match(r"\s*(text/html|application/xhtml\+xml|text/plain)", content_type, re.I)
    text = decoded(payload, content_type) if textual else ""
    page = text if textual and "plain" not in textual[1].lower() else ""
    title = _TITLE.search(page)
    lines = [(f"source-{k.lower()}", v) for k, v in source.headers] + [("http-status", status)] * bool(status) + [(f"http-{k.lower()}", v) for k, v in fields]
    lines += [("payload-digest", found), ("payload-digest-agrees", str(source.get("WARC-Payload-Digest") in (None, found)).lower()), ("block-digest", digest(source.block)), ("payload-length", str(len(payload))), ("cut-off", str(source.cut or source.get("WARC-Truncated") is not None).lower())]
    lines += [("title", one_line(html.unescape(title[1])) if title else ""), ("outlinks", str(len(_LINK.findall(page))))]
    metadata = "".join(f"{one_line(k)}: {one_line(v)}\r\n" for k, v in lines).encode()
    blocks = [("metadata", "application/warc-fields", metadata)]
    if textual:
        blocks.append(("conversion", "text/plain; charset=utf-8", (plain_text(page) if page else "\n".join(text.splitlines()) if "plain" in textual[1].lower() else "").encode()))
    out = []
    for kind, media, data in blocks:
        headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(kind, refers)), ("WARC-Date", date)]
        headers += [] if target is None else [("WARC-Target-URI", target), ("WARC-Refers-To-Target-URI", target)]
        headers += [("WARC-Refers-To", refers), ("WARC-Refers-To-Date", date)]
        headers += [("WARC-Warcinfo-ID", info)] if (info := source.get("WARC-Warcinfo-ID")) else []
        headers += [("Content-Type", media), ("Content-Length", str(len(data))), ("WARC-Block-Digest", digest(data))]
        headers += [("WARC-Payload-Digest", digest(data))] if kind == "conversion" else []
        out.append({"warc_type": kind, "record_id": headers[1][1], "refers_to": refers, "source_payload_digest": source.get("WARC-Payload-Digest") or found, "block_digest": digest(data), "content_length": len(data), "headers": headers, "block": data})
    return out


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, url, member): a response record of each row of pages, as a gzip member."""
    date = "cast(date as string)" if "date" in pages.columns else f"'{DATE}'"
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([member(*response(*r)) for r in rows], pa.binary())], schema=schema)

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html", f"coalesce({date}, '{DATE}') as date").mapInArrow(run, "page_id long, url string, member binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, member) of the records of the .warc and .warc.gz files at path, each as a member of its own."""
    schema = pa.schema([("file", pa.string()), ("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for stretch in inflated(content):
                    rows = [member(r.headers, r.block) for r in records_of(stretch)]
                    for i in range(0, len(rows), 500):
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows[i : i + 500])), pa.array(rows[i : i + 500], pa.binary())], schema=schema)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content").mapInArrow(run, "file string, member binary")


SCHEMA = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("source_payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("header", pa.string()), ("block", pa.string())])


def derivatives(members: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The derived records of (member, and the columns of keep): their header lines and blocks, with keep's columns."""
    kept = members.select(*keep, F.col("member"))
    heads = kept.schema.fields[:-1]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in heads), *(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(b.column(len(heads)).to_pylist()):
                for stretch in inflated(raw or b""):
                    for r in (x for source in records_of(stretch) for x in derive(source)):
                        at.append(i)
                        rows.append(r)
            columns = {f.name: [r[f.name] for r in rows] for f in SCHEMA if f.name not in ("header", "block")}
            columns |= {"header": ["\r\n".join(f"{k}: {v}" for k, v in r["headers"]) for r in rows], "block": [r["block"].decode() for r in rows]}
            first = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(heads))]
            yield pa.RecordBatch.from_arrays([*first, *(pa.array(columns[f.name], f.type) for f in SCHEMA)], names=[*(f.name for f in heads), *SCHEMA.names])

    return kept.mapInArrow(run, ddl)


def warc_file(derived: list[dict]) -> bytes:
    """The contents of a .warc.gz file of derived records (header, block)."""
    return b"".join(member([tuple(line.split(": ", 1)) for line in r["header"].split("\r\n")], r["block"].encode()) for r in derived)


def of_pages(pages: DataFrame) -> DataFrame:
    """Pages as response records, written into the shared folder and read back, and what derives from them."""
    text_batches(pages.sparkSession)
    written = Scratch(pages.sparkSession).keep(responses(pages), "responses")
    return derivatives(written, ("page_id", "url"))

"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Records are WARC/1.1 bytes in a binary column, one record a row, so Spark splits and shuffles them
like any table; written one after the other (gzipped each or not) they are a WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tracelake.llm import kit
from tracelake.plans.ship import map_arrow

VERSION = "WARC/1.1"
#: Elements whose text is no text of the page, and those that end a line (fixed values of HTML).
HIDDEN = frozenset(("script", "style", "noscript", "template", "title"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
))
#: A comment's start, a declaration, or a tag with its name and the rest; never tried behind the last ">", so it can't fail late.
_MARKUP = re.compile(r"<(?:(!--)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)")
_CLOSED = {name: re.compile(rf"</{name}\b[^>]*+>", re.I) for name in HIDDEN}
_LANGUAGE = re.compile(r"\blang\s*+=\s*+[\"']?([\w-]+)", re.I)
_HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+))", re.I)
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{8,}+);?")
_BLANKS = re.compile(r"[^\S\n]++")
_LINES = re.compile(r" ?\n[ \n]*+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case, continued lines joined) and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    size = int(headers.get("content-length", len(rest)))
    if len(rest) < size:
        raise ValueError("cut WARC record")
    return headers, rest[:size]


def unescape(text: str) -> str:
    """Text with its entities resolved; numbers too long for a character are replacement characters."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text))


class Page(NamedTuple):
    text: str
    title: str
    language: str
    links: list[str]


def read_page(page: str) -> Page:
    """Text, title, language and links of an HTML page, by one scan from left to right.

    The text has one line for each block, blanks joined and entities resolved, and nothing of comments,
    the head and hidden elements. An element or comment that isn't closed reaches to the end; "<"
    without ">" is text. Every character is looked at a bounded number of times, whatever the page.
    """
    end = page.rfind(">") + 1
    out: list[str] = []
    title = language = None
    links: list[str] = []
    at, head = 0, False
    while m := _MARKUP.search(page, at, end):
        if not head:
            out.append(page[at : m.start()].replace("\n", " ").replace("\r", " "))
        at = m.end()
        name = m[3]
        if name is None:
            if m[1]:
                close = page.find("-->", at)
                at = close + 3 if close >= 0 else len(page)
            out.append(" ")
            continue
        name, closes = name.lower(), bool(m[2])
        if name in HIDDEN and not closes:
            close = _CLOSED[name].search(page, at, end)
            if name == "title" and title is None and close:
                title = page[at : close.start()]
            at = close.end() if close else len(page)
            out.append(" ")
        elif name == "head":
            head = not closes
        elif name == "body":
            head = False
        elif name == "a" and not closes:
            if h := _HREF.search(m[4]):
                links.append(unescape(h[1] or h[2] or h[3] or ""))
        elif name == "html" and language is None and not closes and (found := _LANGUAGE.search(m[4])):
            language = found[1]
        if name in BLOCKS and not head:
            out.append("\n")
    if not head:
        out.append(page[at:].replace("\n", " ").replace("\r", " "))
    text = _LINES.sub("\n", _BLANKS.sub(" ", unescape("".join(out)))).strip()
    return Page(text, one_line(unescape(title or "")), language or "", links)


def response(page_id: object, url: str | None, page: str | None, date: str) -> bytes:
    """A response record for a page that is kept as text."""
    body = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
    return build([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, digest(body))), ("WARC-Date", date), ("WARC-Target-URI", url or ""),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)),
    ], block)


def derive(record: bytes) -> list[tuple[str, bytes]]:
    """The metadata and conversion records of one response."""
    head, block = parse(record)
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.decode("iso-8859-1").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    kind = fields.get("content-type", "application/octet-stream")
    charset = re.search(r"charset=[\"']?([\w-]+)", kind)
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    read = read_page(page)
    source, uri, date = head["warc-record-id"], head.get("warc-target-uri", ""), head.get("warc-date", "")
    known = head.get("warc-payload-digest") or digest(payload)
    match = known.startswith("sha1:") and known == digest(payload)
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    about = [
        ("sourceStatus", status), ("sourceContentType", kind), ("sourceContentLength", str(len(payload))), ("sourceDigest", known),
        ("sourceDigestChecked", str(match).lower()), ("title", read.title), ("language", read.language),
        *(("outlink", one_line(x)) for x in read.links),
    ]
    facts = "".join(f"{k}: {v}\r\n" for k, v in about).encode("utf-8", "replace")
    text = read.text.encode("utf-8", "replace")
    return [
        ("metadata", build([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", source)), *linked, ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", digest(facts))], facts)),
        ("conversion", build([
            ("WARC-Type", "conversion"), ("WARC-Record-ID", record_id("conversion", source)), *linked, ("Content-Type", "text/plain; charset=utf-8"),
            ("WARC-Source-Payload-Digest", known), ("WARC-Payload-Digest", digest(text)), ("WARC-Block-Digest", digest(text)),
        ], text)),
    ]


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record) with a response record for every row of pages (page_id, url, html).

    A null url or html counts as empty; a null page_id is kept, and stands in the record's id as None.
    Rows equal in id, url and html get equal records, others never share a record id. Other columns are
    not looked at; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in kit.byte_slices(batch.column("html")):
                part = batch.slice(i, j - i)
                ids = part.column("page_id").to_pylist()
                out = [response(k, u, h, date) for k, u, h in zip(ids, part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["page_id", "record"])

    return map_arrow(pages.selectExpr("cast(page_id as bigint) page_id", "url", "html"), run, "page_id long, record binary")


def derivatives(records: DataFrame) -> DataFrame:
    """One row for each metadata and conversion record of the response records in (page_id, record).

    Columns: page_id, record_type, record_id, refers_to, target_uri, source_digest, payload_digest,
    content_length, record. Rows of other record types and null records give none; repeated rows repeat.
    A damaged record is an error. An empty table gives an empty result.
    """
    names = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "source_digest", "payload_digest", "content_length", "record"]
    types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in kit.byte_slices(batch.column("record")):
                rows = []
                part = batch.slice(i, j - i)
                for page, record in zip(part.column("page_id").to_pylist(), part.column("record").to_pylist(), strict=True):
                    if record is None or (head := parse(record)[0]).get("warc-type") != "response":
                        continue
                    source = head.get("warc-payload-digest", "")
                    for kind, made in derive(record):
                        h, block = parse(made)
                        rows.append((page, kind, h["warc-record-id"], h["warc-refers-to"], h["warc-target-uri"], source, h.get("warc-payload-digest", h["warc-block-digest"]), len(block), made))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)

    return map_arrow(records.select("page_id", "record"), run, "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_digest string, payload_digest string, content_length long, record binary")

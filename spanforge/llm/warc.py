"""Operator 9: WARC derivatives - metadata and conversion records made from responses.

Every page is a response record: HTTP head, HTML, digests and a record id derived from its content and place. From it come a
metadata record (title, language, outgoing links, source headers) and a conversion record (plain text). Both name the
response in WARC-Refers-To, repeat its target URI and date, and carry digests of their own blocks; the three stand in one
warcinfo-free file in that order. Each page is worked on alone: a narrow map without a shuffle.

A crawl's date and status are no columns of ``pages``, so every response has DATE and status 200.

Edge cases: a null url or html is empty; HTML that never closes its tags is read to its end, in linear time; repeated rows give repeated
records with equal ids, a null page_id is an id like others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.common import slices, table

DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the published name space for URLs
_OPEN = re.compile(r"<!--|<(script|style|noscript|template|nav)\b[^>]*>", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "nav")}
_BREAK = re.compile(r"<(?:/?(?:p|div|article|section|li|ul|ol|table|tr|h[1-6]|header|footer|main|blockquote|pre|title|head|body|html)\b[^>]*|br\b[^>]*)>", re.I)
_CELL = re.compile(r"</t[dh]\s*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_TITLE_OPEN, _TITLE_CLOSE = re.compile(r"<title[^>]*>", re.I), re.compile(r"</title>", re.I)
_LANG = re.compile(r"<html.*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I | re.S)
_LINK = re.compile(r"<a\b.*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)
_BLANKS = re.compile(r"[^\S\n]+")

SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, block_digest string, payload_digest string, content_length long, record binary"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str | int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, '|'.join(map(str, parts)))}>"


def _tags_end(html: str) -> int:
    """Where the last tag can end: from before it, a search for a tag's end always finds one, so no search runs to the end in vain."""
    return html.rfind(">") + 1


def without_hidden(html: str) -> str:
    """The page without comments, scripts and the like, each a blank; one that never closes goes to the end."""
    out, at, end = [], 0, _tags_end(html)
    while m := _OPEN.search(html, at, end):
        out += [html[at : m.start()], " "]
        if m[1]:
            close = _CLOSE[m[1].lower()].search(html, m.end())
            at = close.end() if close else len(html)
        else:
            close = html.find("-->", m.end())
            at = close + 3 if close >= 0 else len(html)
    late = html.find("<!--", at)
    return "".join([*out, html[at:], ""] if late < 0 else [*out, html[at:late], " "])


def title_of(html: str) -> tuple[int, int, int, int] | None:
    """(start, text start, text end, end) of the first title."""
    if m := _TITLE_OPEN.search(html, 0, _tags_end(html)):
        if close := _TITLE_CLOSE.search(html, m.end()):
            return m.start(), m.end(), close.start(), close.end()
    return None


def without_titles(html: str) -> str:
    out, at, end = [], 0, _tags_end(html)
    while (m := _TITLE_OPEN.search(html, at, end)) and (close := _TITLE_CLOSE.search(html, m.end())):
        out += [html[at : m.start()], "\n"]
        at = close.end()
    return "".join([*out, html[at:]])


def _replaced(pattern: re.Pattern, by: str, html: str) -> str:
    """Replaces tags up to the last tag's end."""
    end = _tags_end(html)
    return pattern.sub(by, html[:end]) + html[end:]


def plain_text(html: str) -> str:
    """The text of a page, a line for each block."""
    body = without_titles(without_hidden(html))
    for pattern, by in ((_BREAK, "\n"), (_CELL, " "), (_TAG, "")):
        body = _replaced(pattern, by, body)
    lines = (_BLANKS.sub(" ", line).strip() for line in unescape(body).split("\n"))
    return "\n".join(line for line in lines if line)


def write_record(fields: list[tuple[str, str | int]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[: int(fields["Content-Length"])]


def _uri(url: str) -> str:
    """A URI without line ends or blanks, so that it can't break a header."""
    return "".join(url.split())


def records(page_id: int, url: str, html: str) -> list[tuple]:
    """The response of a page and the two records that derive from it."""
    uri, payload = _uri(url), html.encode()
    source = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]
    http = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in source) + "\r\n").encode() + payload
    response = record_id("response", page_id, uri, digest(payload))
    made = []

    def add(kind: str, own: str, refers: str | None, content_type: str, block: bytes, body: bytes):
        block_digest, payload_digest = digest(block), digest(body)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
        if refers:
            fields.append(("WARC-Refers-To", refers))
        fields += [("Content-Type", content_type), ("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload_digest), ("Content-Length", len(block))]
        made.append((page_id, kind, own, refers, uri, content_type, block_digest, payload_digest, len(block), write_record(fields, block)))

    add("response", response, None, "application/http; msgtype=response", http, payload)
    title, tags = title_of(html), [m[0] for m in _TAG.finditer(html, 0, _tags_end(html))]
    lang = next((m for t in tags if t[:5].lower() == "<html" and (m := _LANG.match(t))), None)
    about = [("title", " ".join(unescape(html[title[1] : title[2]]).split()) if title else ""), ("language", lang[1].lower() if lang else "")]
    about += [(f"http-{k.lower()}", v) for k, v in source] + [("source-payload-digest", digest(payload))]
    about += [("outlink", _uri(unescape(next(filter(None, m.groups()), "")))) for t in tags if t[:2].lower() == "<a" and (m := _LINK.match(t))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in about).encode()
    add("metadata", record_id("metadata", response), response, "application/warc-fields", meta, meta)
    text = plain_text(html).encode()
    add("conversion", record_id("conversion", response), response, "text/plain; charset=utf-8", text, text)
    return made


def build_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response, metadata and conversion records of every page, each with its bytes."""
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")
    )
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]

    def work(batches):
        for batch in slices(batches, 100):
            rows = [r for page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True) for r in records(*page)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return plain.mapInArrow(work, SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all pages."""
    return build_derivatives(table(spark, sf_dir, "pages"))

"""WARC derivatives: metadata and plain-text conversion records of response records.

A landed page stands for a response record (HTTP head and body). From each response come a metadata record (JSON: HTTP
headers, title, links) and a conversion record (the page's plain text). Both carry WARC-Refers-To with the
response's record id, its target URI, date and payload digest. Status, headers, date and record id of the responses
are taken from columns where the table has them; otherwise they are made up from the page (200 OK, text/html, one
date, an id by name), so that a rerun gives the same. The response records themselves come out on request.

Pages are read in one scan from left to right that never goes back, so its time is in proportion to the page whatever
its markup: what is opened and never closed (a comment, a tag, a quoted value, a script) reaches to the page's end.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
#: Elements whose content is not markup, by what ends them; all but the title are hidden.
CLOSERS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "noscript", "template", "title", "textarea", "iframe")}
HUGE_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s samp small span strong sub sup time u var".split())
BLANK = re.compile(r"[ \t\r\f\v ]+")
LINES = re.compile(r" ?\n[ \n]*")
COLUMNS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_digest string, block_digest string, content_length long, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, page: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}|{page}')}>"


def record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC/1.0 record: named fields, a blank line, the block, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.0\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def unescape(text: str) -> str:
    return entities.unescape(HUGE_NUMBER.sub("\ufffd", text))


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """A tag's attributes from `at` on, the first of each name, and the place after the tag; the page's end if it never closes."""
    found: dict[str, str] = {}
    while m := ATTRIBUTE.match(page, at):
        at, value = m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return {}, len(page)
                value, at = page[at + 1 : end], end + 1
            else:
                value = UNQUOTED.match(page, at)[0]
                at += len(value)
        found.setdefault(m[1].lower(), value)
    end = page.find(">", at)
    return (found, end + 1) if end >= 0 else ({}, len(page))


def scan(page: str) -> tuple[str | None, list[str], str]:
    """(title, links, visible text): tags of blocks end a line, inline tags leave nothing, entities are resolved."""
    title, links, text, at = None, [], [], 0
    while at < len(page):
        open_ = page.find("<", at)
        open_ = len(page) if open_ < 0 else open_
        text.append(page[at:open_].replace("\n", " "))
        at = open_ + 1
        mark = page[at : at + 1]
        if page.startswith("!--", at):
            # <!--> and <!---> are whole comments
            end = page.find("-->", at + 1)
            at = end + 3 if end >= 0 else len(page)
        elif mark in ("!", "?") and mark or mark == "/" and not NAME.match(page, at + 1):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        elif m := NAME.match(page, at + (mark == "/")):
            name = m[0].lower()
            found, at = attributes(page, m.end())
            text.append("" if name in INLINE else "\n")
            if mark == "/" or at == len(page) and page[-1] != ">":
                continue
            if name == "a" and "href" in found:
                links.append(unescape(found["href"]))
            if closer := CLOSERS.get(name):
                end = closer.search(page, at)
                inside, at = page[at : end.start() if end else len(page)], end.start() if end else len(page)
                if name == "title" and title is None:
                    title = unescape(inside).strip()
                elif name == "textarea":
                    text.append(inside.replace("\n", " "))
        elif open_ < len(page):
            text.append("<")
    return title, links, LINES.sub("\n", BLANK.sub(" ", unescape("".join(text)))).strip()


def one_line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text).strip()


def http_head(body: bytes, status: str | None = None, headers: object = None) -> tuple[str, list[tuple[str, str]]]:
    """Status line and headers: as given (a map's pairs, or lines `name: value`), or made up."""
    if isinstance(headers, str):
        headers = [(k.strip(), v.strip()) for k, mark, v in (x.partition(":") for x in headers.splitlines()) if mark]
    made = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return one_line(status) if status else "HTTP/1.1 200 OK", made if headers is None else [(one_line(str(k)), one_line(str(v or ""))) for k, v in headers]


def response(page_id: int, url: str, page: bytes, date: str, status: str | None = None, headers: object = None, own_id: str | None = None) -> dict:
    status, headers = http_head(page, status, headers)
    block = (status + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + page
    key = own_id or f"{page_id}|{url}|{hashlib.sha1(page).hexdigest()}"
    fields = {
        "WARC-Type": "response",
        "WARC-Record-ID": one_line(own_id) if own_id else record_id("response", key),
        "WARC-Target-URI": url,
        "WARC-Date": date,
        "WARC-Payload-Digest": digest(page),
        "WARC-Block-Digest": digest(block),
        "Content-Type": "application/http; msgtype=response",
    }
    return {"key": key, "fields": fields, "block": block, "status": status, "headers": headers, "page": page}


def derive(source: dict) -> list[tuple[str, dict[str, str], bytes]]:
    """The metadata and conversion records of a response: (type, fields, block)."""
    title, links, text = scan(source["page"].decode(errors="replace"))
    names = [k for k, _ in source["headers"]]
    found = {
        "Envelope": {
            "WARC-Header-Metadata": source["fields"],
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": source["status"],
                    # a header that is there more than once has a list
                    "Headers": {k: v if names.count(k) == 1 else [x for name, x in source["headers"] if name == k] for k, v in source["headers"]},
                    "HTML-Metadata": {"Title": title, "Links": [{"path": "A@/href", "url": x} for x in links]},
                }
            },
        }
    }
    out = []
    for kind, content_type, block in (
        ("metadata", "application/json", json.dumps(found, ensure_ascii=False, sort_keys=True).encode(errors="replace")),
        ("conversion", "text/plain", text.encode(errors="replace")),
    ):
        fields = {
            "WARC-Type": kind,
            "WARC-Record-ID": record_id(kind, source["key"]),
            "WARC-Refers-To": source["fields"]["WARC-Record-ID"],
            "WARC-Target-URI": source["fields"]["WARC-Target-URI"],
            "WARC-Date": source["fields"]["WARC-Date"],
            "WARC-Source-Payload-Digest": source["fields"]["WARC-Payload-Digest"],
            "WARC-Block-Digest": digest(block),
            "Content-Type": content_type,
        }
        out.append((kind, fields, block))
    return out


def derivatives(
    pages: DataFrame,
    date: str = "1970-01-01T00:00:00Z",
    keep_records: bool = True,
    status: str | None = None,
    headers: str | None = None,
    dates: str | None = None,
    record_ids: str | None = None,
    responses: bool = False,
) -> DataFrame:
    """Two rows a page, metadata and conversion, with `responses` the response before them; `record` is the whole WARC record (null if not kept).

    status, headers (strings of lines, or maps), dates and record_ids name columns of the pages that hold what the
    responses had; without them, and where they are null, `date` and made-up ones stand in. Null html counts as an empty
    page, a null url as ''. Line ends in a url are taken out, those in a header become blanks, so that no header is forged. Rows that repeat a
    page give records with the same ids; other columns are ignored; an empty table gives no rows.
    """
    given = {"status": status, "headers": headers, "dates": dates, "record_ids": record_ids}
    taken = [F.lit(None).cast("string").alias(k) if name is None else F.col(name).alias(k) for k, name in given.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for page_id, url, page, status, headers, when, own_id in zip(*(batch.column(k).to_pylist() for k in (0, 1)), utf8(batch.column(2)), *(batch.column(k).to_pylist() for k in range(3, 7))):
                source = response(page_id, re.sub(r"[\r\n]", "", url or ""), page, one_line(when or date), status, headers, own_id)
                own = [("response", source["fields"] | {"WARC-Refers-To": None, "WARC-Source-Payload-Digest": source["fields"]["WARC-Payload-Digest"]}, source["block"])] if responses else []
                for kind, f, block in [*own, *derive(source)]:
                    whole = record(source["fields"] if kind == "response" else f, block) if keep_records else None
                    rows.append((page_id, kind, f["WARC-Record-ID"], f["WARC-Refers-To"], f["WARC-Target-URI"], f["WARC-Date"], f["Content-Type"], f["WARC-Source-Payload-Digest"], f["WARC-Block-Digest"], len(block), whole))
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    return pages.select("page_id", "url", "html", *taken).mapInArrow(run, COLUMNS)

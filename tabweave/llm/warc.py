"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

A conversion record holds the text of the response's payload, a metadata record its fields (title, language, links,
source headers). Both name the response in WARC-Refers-To, keep its target URI and date, and carry digests of the
source payload and of their own block. Record ids are name-based UUIDs of the response's id and the record's type, so
a task that runs again makes the same records.

response_derivatives() works on the records of read_warc(): the response's id, date, HTTP headers and digests are its
own. derivatives() works on pages that were kept without their record, and only there these values are made up.

Defined results: a null or empty payload gives records with empty text; a null URL stays out of the headers; markup
that is never closed reaches to the end of the payload; payloads of any length are read whole; rows that repeat id, URL
and payload give repeated records, rows that differ in any of them have record ids of their own; there are no ties; an
empty table gives no rows; other columns of the input are ignored, and an id may have any type.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabweave.llm.shared import bounded_batches

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Elements whose content is no text (a head has no text but theirs, and its end tag is optional), and elements that break a line (fixed values).
SILENT = frozenset({"script", "style", "noscript", "template", "svg", "iframe", "object", "title"})
BREAKS = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
TAG = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
#: The rest of a tag: a quoted value may hold the character that ends a tag.
TAG_END = re.compile(r"""(?>[^>=]+|=\s*+(?>"[^"]*+"|'[^']*+')?+)*+>""")
ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


@dataclass
class Page:
    text: str = ""
    title: str = ""
    lang: str = ""
    links: list[str] = field(default_factory=list)


def read_html(source: str) -> Page:
    """Text, title, language and links of a page, in one pass over its tags."""
    page, out, at, n = Page(), [], 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            out.append(source[at:])
            break
        out.append(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        closing = source.startswith("/", lt + 1)
        name = TAG.match(source, lt + 1 + closing)
        if not name and not source.startswith(("!", "?"), lt + 1):
            out.append("<")
            at = lt + 1
            continue
        gt = source.find(">", lt)
        if name and gt >= 0 and source.find("=", lt, gt) >= 0:
            whole = TAG_END.match(source, name.end())
            gt = whole.end() - 1 if whole else gt
        end = n if gt < 0 else gt + 1
        at = end
        if not name:
            continue
        tag = name.group().lower()
        if tag in BREAKS:
            out.append("\n")
        if closing:
            continue
        inside = source[name.end() : end]
        if tag in ("a", "html"):
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(inside)}
            if tag == "a" and attributes.get("href"):
                page.links.append(html.unescape(attributes["href"]))
            elif tag == "html" and attributes.get("lang"):
                page.lang = attributes["lang"]
        if tag in SILENT and not inside.endswith("/>"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, end)
            stop = close.start() if close else n
            part = source[end:stop]
            if tag == "title" and not page.title:
                page.title = " ".join(html.unescape(part).split())
            at = close.end() if close else n
    lines = (" ".join(x.split()) for x in html.unescape("".join(out)).split("\n"))
    page.text = "\n".join(x for x in lines if x)
    return page


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(headers, block) of each record of an uncompressed WARC file."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {k.strip(): v.strip() for k, colon, v in (line.partition(":") for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]) if colon}
        size = int(next((v for k, v in headers.items() if k.lower() == "content-length"), 0))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def records_of(content: bytes):
    """(headers, block) of each record of a WARC file, gzipped by record, gzipped as a whole, or plain."""
    if not content.startswith(b"\x1f\x8b"):
        yield from parse_records(content)
        return
    held, rest = b"", memoryview(content)
    while len(rest):
        one = zlib.decompressobj(31)
        try:
            held += one.decompress(rest)
        except zlib.error:
            break  # what follows is no gzip; the records so far stand
        rest = memoryview(one.unused_data)
        if rest[:2] != b"\x1f\x8b" or held.endswith(b"\r\n\r\n"):
            yield from parse_records(held)
            held = b""
    yield from parse_records(held)


def response_of(key, url: str | None, payload: str, date: str) -> tuple[list[tuple[str, str]], str, str]:
    """(source HTTP headers, record id, payload digest) of a page kept without its WARC record."""
    raw = payload.encode("utf-8", "surrogatepass")
    http = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(raw)))]
    mark = digest(raw)
    return http, f"<urn:uuid:{uuid.uuid5(SPACE, f'response|{key}|{url}|{date}|{mark}')}>", mark


def parse_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers in their order, body) of an HTTP response; a block of another kind is all body."""
    if not block.startswith(b"HTTP/"):
        return [], block
    gap = re.search(rb"\r?\n\r?\n", block)
    head, body = (block[: gap.start()], block[gap.end() :]) if gap else (block, b"")
    lines = re.split(r"\r?\n(?![ \t])", head.decode("latin-1"))[1:]
    headers = [(k.strip(), " ".join(v.split())) for k, colon, v in (line.partition(":") for line in lines) if colon]
    if any(k.lower() == "transfer-encoding" and "chunked" in v.lower() for k, v in headers):
        body = unchunked(body)
    return headers, body


def unchunked(body: bytes) -> bytes:
    """The body without its chunk marks; a body that was stored without them stays as it is."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r?\n").match(body, at):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size
        if not size:
            break
        at += 2 if body.startswith(b"\r\n", at) else body.startswith(b"\n", at)
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes:
    """The body without gzip or deflate, as far as it can be read; one that was stored without it stays as it is."""
    if coding in ("", "identity"):
        return body
    if coding not in ("gzip", "x-gzip", "deflate"):
        return b""
    for bits in (47, -15) if coding == "deflate" else (47,):
        out, rest = [], body
        try:
            while rest:
                one = zlib.decompressobj(bits)
                out.append(one.decompress(rest))
                rest = one.unused_data
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return body


def page_of(http: list[tuple[str, str]], body: bytes) -> Page:
    """The page in a response's body. Types other than HTML and plain text, and unknown codings, have no text."""
    last = {k.lower(): v for k, v in http}
    kind, _, rest = last.get("content-type", "").partition(";")
    kind = kind.strip().lower()
    if kind and "html" not in kind and not kind.startswith("text/"):
        return Page()
    body = inflated(body, last.get("content-encoding", "").strip().lower())
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", rest, re.IGNORECASE)
    meta = re.search(rb"<meta[^>]*charset\s*=\s*[\"']?([\w.:-]+)", body[:4096], re.IGNORECASE)
    charset = "utf-8-sig" if body.startswith(b"\xef\xbb\xbf") else named[1] if named else meta[1].decode("latin-1") if meta else "utf-8"
    try:
        text = body.decode(charset, "replace")
    except (LookupError, ValueError):
        text = body.decode("utf-8", "replace")
    return read_html(text) if not kind or "html" in kind else Page(text=text)


def derive_response(headers: dict[str, str], block: bytes) -> list[dict]:
    """The records of a response record: its own id, date, HTTP headers and digests; a digest it lacks is computed."""
    own = {k.lower(): v for k, v in headers.items()}
    http, body = parse_http(block)
    url, date, mark = own.get("warc-target-uri"), own.get("warc-date", ""), own.get("warc-payload-digest") or digest(body)
    return derive(url, page_of(http, body), date, own["warc-record-id"], mark, http, own.get("warc-block-digest") or digest(block))


def derive(url: str | None, page: Page, date: str, response_id: str, payload_digest: str, http: list[tuple[str, str]], block_digest: str | None = None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    fields = [("source-record-id", response_id), ("source-payload-digest", payload_digest), *([("source-block-digest", block_digest)] if block_digest else []), *((f"source-header-{k.lower()}", v) for k, v in http), ("title", page.title), ("language", page.lang), ("text-length", str(len(page.text))), *(("outlink", x) for x in page.links)]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)), "conversion": ("text/plain; charset=utf-8", page.text)}
    ids = {t: f"<urn:uuid:{uuid.uuid5(SPACE, f'{t}|{response_id}')}>" for t in blocks}
    out = []
    for kind, (mime, text) in blocks.items():
        block = text.encode("utf-8", "surrogatepass")
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), *([("WARC-Target-URI", url)] if url else []), ("WARC-Refers-To", response_id)]
        headers += [("WARC-Refers-To-Target-URI", url)] if url else []
        headers += [("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Block-Digest", digest(block)), ("WARC-Linked-Record-ID", ids["conversion" if kind == "metadata" else "metadata"]), ("Content-Type", mime), ("Content-Length", str(len(block)))]
        out.append({"record_type": kind, "record_id": ids[kind], "refers_to": response_id, "linked_id": dict(headers)["WARC-Linked-Record-ID"], "target_uri": url, "source_digest": payload_digest, "block_digest": digest(block), "content_length": len(block), "block": text, "record": record_bytes(headers, block)})
    return out


COLUMNS = "record_type string, record_id string, refers_to string, linked_id string, target_uri string, source_digest string, block_digest string, content_length bigint, block string"


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", whole: bool = False) -> DataFrame:
    """Two rows per page (metadata, conversion); with whole=True also the record's bytes. One pass, no shuffle."""
    kind = pages.schema[id_col].dataType.simpleString()
    bounded_batches(pages.sparkSession)
    fields = [*((c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in COLUMNS.split(", ")), *[("record", pa.binary())] * whole]

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            arrow = pa.schema([(id_col, batch.schema.field(id_col).type), *fields])
            for key, url, text in zip(*(batch.column(c).to_pylist() for c in (id_col, url_col, html_col))):
                http, response_id, mark = response_of(key, url, text or "", date)
                for r in derive(url, read_html(text or ""), date, response_id, mark, http):
                    rows.append(r | {id_col: key})
                    size += len(r["block"])
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}" + ", record binary" * whole)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, gzipped or not: path, headers (map), block. Files are read whole, one at a time in a task."""
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            for path_, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for headers, block in records_of(content):
                    yield pa.RecordBatch.from_pydict({"path": [path_], "headers": pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), "block": pa.array([block], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, headers map<string,string>, block binary")


def response_derivatives(records: DataFrame, whole: bool = False) -> DataFrame:
    """Two rows (metadata, conversion) per response among the records of read_warc(); other records have none, nor has
    a response without the id that the format demands, as nothing could refer to it."""
    arrow = pa.schema([("path", pa.string()), *((c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in COLUMNS.split(", "))] + [("record", pa.binary())] * whole)

    def run(batches):
        for batch in batches:
            for path, headers, block in zip(*(batch.column(c).to_pylist() for c in ("path", "headers", "block"))):
                own = {k.lower(): v for k, v in headers}
                if own.get("warc-type", "").lower() == "response" and own.get("warc-record-id"):
                    rows = derive_response(dict(headers), block)
                    yield pa.RecordBatch.from_pylist([r | {"path": path} for r in rows], schema=arrow)

    return records.select("path", "headers", "block").mapInArrow(run, f"path string, {COLUMNS}" + ", record binary" * whole)

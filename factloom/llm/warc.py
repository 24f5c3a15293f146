"""WARC derivatives: metadata and plain-text conversion records of responses.

Follows the public WARC 1.1 format.  A derivative names its response in
``WARC-Refers-To``, and carries the response's URI, date and payload digest.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fresh

CRLF = b"\r\n"

#: Elements whose content isn't text, those of them that hold no tags, and elements that end a line.
HIDDEN = ("script", "style", "noscript", "template", "head", "svg", "iframe", "object", "textarea", "select")
RAW = ("script", "style", "textarea")
#: Start tags that a head may hold; any other ends it.
HEAD = ("base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title")
BLOCKS = (
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td",
    "th", "title", "tr", "ul",
)

_name = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)") for tag in (*HIDDEN, "title", "noframes")}
_blank = re.compile(r"[^\S\n]+")
_lines = re.compile(r"\s*\n\s*")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that is the same whenever the record is the same."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def plain_text(page: str) -> tuple[str, str]:
    """Title and text of an HTML page; one pass, linear in its length.

    Comments, declarations and hidden elements go; block elements end lines;
    entities are decoded; blanks are folded.  An open head ends at the first
    text or start tag that no head holds.  An unclosed script, style or textarea
    hides the rest of the page, any other unclosed hidden element its tag only;
    an unclosed tag is text.
    """
    out: list[str] = []
    title, at, n, folded = "", 0, len(page), None
    unclosed: set[str] = set()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            out.append(page[at:])
            break
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        named = _name.match(page, start)
        if not named and not page.startswith(("<!", "<?"), start):
            out.append("<")
            at = start + 1
            continue
        end = page.find(">", start)
        if end < 0:
            out.append(page[start:])
            break
        at = end + 1
        tag = named[1].lower() if named else ""
        if tag == "body" and page[start + 1] != "/":
            continue
        if tag in HIDDEN and page[start + 1] != "/" and page[end - 1] != "/":
            folded = page.lower() if folded is None else folded
            if len(folded) != n:  # lower case may change the length of other letters
                folded = re.sub("[A-Z]", lambda m: m[0].lower(), page)
            if tag == "head":
                to = _head_end(page, folded, at, unclosed)
                title = title or _title(page, folded, at, to)
                at = to
            else:
                close = -1 if tag in unclosed else _close(folded, tag, at)
                gone = -1 if close < 0 else page.find(">", close)
                if gone >= 0:
                    at = gone + 1
                elif tag in RAW:
                    at = n
                else:
                    unclosed.add(tag)
            out.append("\n")
        elif tag in BLOCKS:
            out.append("\n")
    text = _lines.sub("\n", _blank.sub(" ", html.unescape("".join(out)))).strip()
    return title, text


def _close(folded: str, tag: str, at: int) -> int:
    """Place of the end tag of this very name, or -1."""
    found = _ends[tag].search(folded, at)
    return found.start() if found else -1


def _head_end(page: str, folded: str, at: int, unclosed: set[str]) -> int:
    """Where the head that is open at ``at`` ends, behind its end tag if it has one."""
    n = len(page)
    while at < n:
        start = page.find("<", at)
        if page[at : n if start < 0 else start].strip():
            return at
        if start < 0:
            return n
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        named = _name.match(page, start)
        end = page.find(">", start)
        if end < 0 or not named and not page.startswith(("<!", "<?"), start):
            return start
        tag = named[1].lower() if named else ""
        if page[start + 1] == "/":
            if tag == "head":
                return end + 1
            if tag in ("body", "html"):
                return start
        elif tag and tag not in HEAD:
            return start
        at = end + 1
        if tag in ("title", "noframes", "noscript", "script", "style", "template") and page[start + 1] != "/" and page[end - 1] != "/":
            close = -1 if tag in unclosed else _close(folded, tag, at)
            gone = -1 if close < 0 else page.find(">", close)
            if gone >= 0:
                at = gone + 1
            elif tag in RAW:
                return n
            else:
                unclosed.add(tag)
    return n


def _title(page: str, folded: str, at: int, to: int) -> str:
    start = folded.find("<title", at, to)
    if start < 0:
        return ""
    start = page.find(">", start, to) + 1 if start >= 0 else 0
    end = folded.find("</title", start, to)
    return _blank.sub(" ", html.unescape(page[start:end]).replace("\n", " ")).strip() if start and end >= 0 else ""


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, found, payload = block.partition(CRLF + CRLF)
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def entity(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer coding: chunks are put together, broken ones as far as they go."""
    if not any(k.lower() == "transfer-encoding" and "chunked" in v.lower() for k, v in headers):
        return payload
    out, at = [], 0
    while (end := payload.find(CRLF, at)) >= 0:
        size = payload[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            break
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    # Not chunked after all, or cut short: what is left is kept.
    return b"".join([*out, payload[at:]])


def plain_payload(headers: list[tuple[str, str]], payload: bytes) -> bytes | None:
    """The entity without its content codings; None if one is unknown or broken."""
    codings = [c.strip().lower() for k, v in headers if k.lower() == "content-encoding" for c in v.split(",")]
    for coding in reversed([c for c in codings if c and c != "identity"]):
        if coding not in ("gzip", "x-gzip", "deflate"):
            return None
        out = b""
        for bits in (47,) if coding != "deflate" else (47, -15):  # deflate is met with and without its wrapper
            try:
                out = _inflated(payload, bits)
                break
            except zlib.error:
                continue
        else:
            return None
        payload = out
    return payload


def _inflated(data: bytes, bits: int) -> bytes:
    """All members of the stream; one that is cut short gives what it holds."""
    out = []
    while data:
        stream = zlib.decompressobj(bits)
        out.append(stream.decompress(data))
        out.append(stream.flush())
        data = stream.unused_data.lstrip(b"\0")
        if data and not data.startswith(b"\x1f\x8b"):
            break
    return b"".join(out)


def charset(headers: list[tuple[str, str]]) -> str:
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    named = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.IGNORECASE)
    return named[1] if named else "utf-8"


def decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    try:
        return payload.decode(charset(headers), errors="replace")
    except LookupError:
        return payload.decode("utf-8", errors="replace")


def serialize(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, closed by two line ends."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + lines.encode() + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record in ``data``."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(CRLF + CRLF, at)
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode().split("\r\n")[1:])}
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, data[start:at]
        at += 4


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def derive(record: str, uri: str, date: str, block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, headers, payload = http_parts(block)
    payload = entity(headers, payload)
    plain = plain_payload(headers, payload)
    title, text = plain_text(decoded(plain or b"", headers))
    digest = sha1(payload)
    facts = [("http-status", status), *((f"http-{k.lower()}", v) for k, v in headers), ("charset", charset(headers)), ("title", title), ("text-characters", str(len(text))), ("payload-bytes", str(len(payload)))]
    if plain is None:
        facts.append(("undecoded", "content-encoding"))
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {one_line(v)}\r\n" for k, v in facts).encode()),
        "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", errors="replace")),
    }
    out = []
    for kind, (content, own) in blocks.items():
        own_id, own_digest = record_id(record, kind), sha1(own)
        lines = [
            ("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Refers-To", record),
            ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Source-Payload-Digest", digest),
            ("WARC-Block-Digest", own_digest), ("Content-Type", content), ("Content-Length", str(len(own))),
        ]
        lines = [(k, one_line(v)) for k, v in lines]
        out.append(
            {"warc_type": kind, "record_id": own_id, "refers_to": record, "target_uri": uri, "warc_date": date, "source_payload_digest": digest,
             "block_digest": own_digest, "content_length": len(own), "block": own, "record": serialize(lines, own)}
        )
    return out


#: Records of an output batch, and bytes of records beyond which it is closed.
BATCH, BATCH_BYTES = 128, 32 << 20
#: Columns of a derivative; the input's key comes first.
DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, source_payload_digest string, block_digest string, content_length long, block binary, record binary"


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records, ``metadata`` and ``conversion``, for each row of ``responses``.

    ``responses``: ``key`` (of any type), ``record_id, target_uri, warc_date,
    block`` (the HTTP response).  Digests are of the entity: chunks are put
    together, a content coding stays.  Text is that of the decoded entity; an
    unknown or broken coding gives an empty conversion and a line
    ``undecoded`` in the metadata.  Null URI and date become empty; a null
    block is an empty one; a null record id is derived from URI, date and
    payload digest.  Repeated rows give repeated records with the same ids; an
    empty table gives no rows; other columns play no part.  Rows are worked on
    one by one, whole, without a shuffle; memory is bounded by the largest page
    and a batch of ``BATCH`` records.
    """
    kind = responses.schema[key].dataType.simpleString()
    (own_key,) = fresh([n for n, _ in _FIELDS], "own_key")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, held = [], [], 0
            for i, row in enumerate(_rows(batch)):
                block, uri, date = row["block"] or b"", row["target_uri"] or "", row["warc_date"] or ""
                if row["record_id"]:
                    own = row["record_id"]
                else:
                    _, headers, payload = http_parts(block)
                    own = record_id(uri, date, sha1(entity(headers, payload)))
                made = derive(own, uri, date, block)
                rows += made
                at += [i] * len(made)
                held += sum(len(x["record"]) for x in made)
                if len(rows) >= BATCH or held > BATCH_BYTES:
                    yield _batch(batch.column(own_key), at, rows, own_key)
                    rows, at, held = [], [], 0
            if rows:
                yield _batch(batch.column(own_key), at, rows, own_key)

    chosen = responses.select(F.col(key).alias(own_key), "record_id", "target_uri", "warc_date", F.col("block").cast("binary").alias("block"))
    out = chosen.mapInArrow(build, f"{own_key} {kind}, {DERIVED}")
    return out.select(F.col(own_key).alias(key), *[n for n, _ in _FIELDS])


_FIELDS = [tuple(x.split()) for x in DERIVED.split(", ")]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows' fields but the key, one row at a time."""
    columns = {c: batch.column(c) for c in ("record_id", "target_uri", "warc_date", "block")}
    for i in range(batch.num_rows):
        yield {c: v[i].as_py() for c, v in columns.items()}


def _batch(keys: pa.Array, at: list[int], rows: list[dict], name: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array([r[n] for r in rows], kinds[t]) for n, t in _FIELDS)], [name, *(n for n, _ in _FIELDS)])


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages (``page_id, url, html``).

    The table holds no capture, so the status line, the content type and the
    date (a parameter) are supplied; the record id is left to ``derivatives``.
    """
    head: Column = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    return pages.select(
        "page_id", F.lit(None).cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.concat(head, F.coalesce("html", F.lit(""))).cast("binary").alias("block"),
    )

"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

Both derivatives refer to the response by its record id (WARC-Refers-To), keep its target URI and date, and carry digests of
their own block; the metadata record lists the response's HTTP headers and digests, and names the conversion record.

Bodies are read as their headers say: chunks are joined, gzip and deflate are inflated.  HTML becomes its visible text, other text
stays as it is; what isn't text, or is coded in another way, has a metadata record alone, which says why.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.base import map_arrow

CRLF = b"\r\n"
#: Comments, scripts and styles (to the page's end if they aren't closed), tags, and other markup.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.I | re.S)
#: Elements that aren't shown, if they are closed.
_HIDDEN = frozenset(("svg", "noscript", "template"))
#: What a head can hold; as its end tag is optional, anything else ends it.
_IN_HEAD = frozenset(("meta", "link", "base", "basefont", "bgsound", "noscript", "template", "html", "head"))
_BREAK = frozenset(("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul").split())
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    """A digest as WARC headers have it: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that depends on nothing but parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode()).digest()[:16], version=5)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length is added."""
    head = CRLF.join(f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1" + CRLF + head + CRLF * 2 + block + CRLF * 2


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:  # a folded line continues the one before
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        elif b":" in line:
            k, _, v = line.partition(b":")
            out.append((k.decode("utf-8", "replace").strip(), v.decode("utf-8", "replace").strip()))
    return out


def get(headers: list[tuple[str, str]], name: str) -> str | None:
    """The first value of a header; names don't tell upper from lower case."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def parse(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of every record in data, plain or in gzip members; ValueError where data is no WARC."""
    if data[:2] == GZIP:
        yield from (r for member in _members(data) for r in parse(member))
        return
    at = 0
    while at < len(data):
        end = data.find(CRLF * 2, at)
        lines = data[at : max(end, at)].split(CRLF)
        if end < 0 or not lines[0].startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = _fields(lines[1:])
        n = int(get(headers, "Content-Length") or -1)
        block = data[end + 4 : end + 4 + n]
        if n < 0 or len(block) < n:
            raise ValueError("a record without its length, or cut short")
        yield headers, block
        at = end + 4 + n
        while data[at : at + 2] == CRLF:
            at += 2


GZIP = b"\x1f\x8b"


def _member(data: bytes, at: int, wbits: int) -> tuple[bytes, int, bool]:
    """What the deflated stream at a place gives, as far as it goes, where it ends, and whether it is whole."""
    out, stream = [], zlib.decompressobj(wbits=wbits)
    while at < len(data):
        piece = data[at : at + (1 << 16)]
        at += len(piece)
        try:
            out.append(stream.decompress(piece))
        except zlib.error:
            break
        if stream.eof:
            return b"".join(out), at - len(stream.unused_data), True
    return b"".join(out), at, False


def _members(data: bytes) -> Iterator[bytes]:
    """The gzip members of data, inflated; ValueError where one is broken or cut short."""
    at = 0
    while at < len(data):
        member, at, whole = _member(data, at, 31)
        if not whole:
            raise ValueError("a gzip member that is broken or cut short")
        yield member


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, _, payload = block.partition(CRLF * 2)
    lines = head.split(CRLF)
    return lines[0].decode("utf-8", "replace"), _fields(lines[1:]), payload


def _joined_chunks(payload: bytes) -> bytes:
    """The body of chunked payload, as far as it goes; payload itself where it isn't chunked, as archives also keep joined bodies."""
    out, at = [], 0
    while m := _CHUNK.match(payload, at):
        n = int(m[1], 16)
        out.append(payload[m.end() : m.end() + n])
        at = m.end() + n
        if not n or at >= len(payload):
            return b"".join(out)
        at += 2 * (payload[at : at + 2] == CRLF)
    return b"".join(out) if out else payload


def _inflated(data: bytes, wbits: int) -> bytes:
    """What data inflates to, as far as it goes; gzip (31) may have several members."""
    out, at, whole = [], 0, True
    while whole and (not at or wbits == 31 and data[at : at + 2] == GZIP):
        member, at, whole = _member(data, at, wbits)
        out.append(member)
    return b"".join(out)


def _tokens(fields: list[tuple[str, str]], name: str) -> list[str]:
    return [t.strip().lower() for k, v in fields if k.lower() == name for t in v.split(",") if t.strip()]


def body(fields: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """An HTTP response's body without its transfer and content codings, and the coding that can't be undone, if there is one.

    Codings that the bytes don't have, as where an archive undid them and kept the header, are passed over.
    """
    codings = [*_tokens(fields, "content-encoding"), *_tokens(fields, "transfer-encoding")]
    for coding in reversed(codings):
        if coding == "chunked":
            payload = _joined_chunks(payload)
        elif coding in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31) if payload[:2] == GZIP else payload
        elif coding == "deflate":
            zlib_head = len(payload) > 1 and payload[0] & 15 == 8 and (payload[0] << 8 | payload[1]) % 31 == 0
            payload = _inflated(payload, 15 if zlib_head else -15) or payload
        elif coding != "identity":
            return payload, coding
    return payload, None


def _text_of(fields: list[tuple[str, str]], payload: bytes) -> tuple[str | None, str]:
    """The text of a response's payload, or None and the reason why it has none."""
    data, coding = body(fields, payload)
    if coding:
        return None, f"content coding {coding}"
    stated = get(fields, "Content-Type") or ""
    kind = stated.split(";")[0].strip().lower()
    if not kind:  # unstated: markup, text without zero bytes, or neither
        kind = "text/html" if data.lstrip()[:1] in (b"<", b"") else "application/octet-stream" if b"\0" in data else "text/plain"
    page = kind in _PAGES
    if not page and not kind.startswith("text/"):
        return None, f"content type {kind}"
    mark = next((c for m, c in _MARKS if data.startswith(m)), None)
    named = re.search(r"charset=[\"']?([\w.:-]+)", stated, re.I) or (_META.search(data[:1024].decode("latin-1")) if page else None)
    try:
        text = data.decode(mark or (named[1] if named else "utf-8"), "replace")
    except (LookupError, UnicodeError):  # an unknown name, or one of no character set
        text = data.decode("utf-8", "replace")
    return (plain_text(text) if page else text), ""


_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")
_PAGES = frozenset(("text/html", "application/xhtml+xml"))
_META = re.compile(r"<meta\b[^>]*?charset\s*=\s*[\"']?([\w.:-]+)", re.I)
#: Byte order marks and their character sets (fixed values).
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def plain_text(page: str) -> str:
    """A page's visible text: its title, then a line for each block element; white space run together, entities resolved.

    One pass over the markup.  Hidden elements lose their content when their end tag comes; without one they lose their tags alone.
    """
    out: list[str] = []
    title: str | None = None
    head, hidden, at = False, [], 0  # hidden: names of open hidden elements, and where their content begins in out
    in_title, last_title, open_ = -1, max((m.start() for m in _CLOSED_TITLE.finditer(page)), default=-1), dict.fromkeys(_HIDDEN, 0)
    for m in _MARKUP.finditer(page):
        text = page[at : m.start()]
        at = m.end()
        if text:
            if head and in_title < 0 and not text.isspace():
                head = False
            if not head or in_title >= 0:
                out.append(text)
        name = m["name"]
        if name is None:
            if not head:
                out.append(" ")
            continue
        name, end = name.lower(), bool(m["end"])
        if name == "title" and not hidden:
            if end and in_title >= 0:
                if title is None:
                    title = "".join(out[in_title:])
                del out[in_title:]
                in_title = -1
            elif not end and in_title < 0 and at <= last_title:
                in_title = len(out)
            continue
        if name == "head":
            head = not end
            continue
        if head and name not in _IN_HEAD:
            head = False
        if name in _BREAK:
            out.append("\n")
        elif name in _HIDDEN:
            if end:
                while open_[name]:
                    inner, begin = hidden.pop()
                    open_[inner] -= 1
                    if inner == name:
                        del out[begin:]
                        out.append(" ")
                        break
            elif name == "svg" and m["rest"].endswith("/"):
                out.append(" ")
            else:
                hidden.append((name, len(out)))
                open_[name] += 1
    if at < len(page):
        out.append(page[at:])
    text = ("" if title is None else title + "\n") + "".join(out)
    return _LINES.sub("\n", _SPACE.sub(" ", html.unescape(text))).strip(" \n")


_CLOSED_TITLE = re.compile(r"</title\s*>", re.I)


def response(url: str | None, page: str | None, *, key: object, date: str) -> bytes:
    """The response record of a page that was fetched from url."""
    payload = (page or "").encode("utf-8", "surrogatepass")
    block = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]) + CRLF * 2 + payload
    target = re.sub(r"[\r\n]", "", url or "")
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", key, url, page)), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload))],
        block,
    )


def derivatives(headers: list[tuple[str, str]], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The metadata and the conversion record of a response, without Content-Length; none for another record.

    A response without text has no conversion record.  A payload digest that fits neither the payload nor its joined chunks is
    reported in the metadata record (payload-digest-valid: false).
    """
    if get(headers, "WARC-Type") != "response":
        return []
    status, fields, payload = http_parts(block)
    source, target, date = (get(headers, k) or "" for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date"))
    found, reason = _text_of(fields, payload)
    text = None if found is None else found.encode("utf-8", "surrogatepass")
    own, other = record_id("conversion", source), record_id("metadata", source)
    stated = get(headers, "WARC-Payload-Digest")
    valid = stated is None or stated == digest(payload) or "chunked" in _tokens(fields, "transfer-encoding") and stated == digest(_joined_chunks(payload))
    lines = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in fields)]
    lines += [(f"source-{k.lower()}", v) for k in ("WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type") if (v := get(headers, k))]
    lines += [("payload-digest-valid", str(valid).lower())]
    lines += [("conversion-none", reason)] if text is None else [("conversion-record", own), ("conversion-digest", digest(text))]
    meta = b"".join(f"{k}: {v}".encode() + CRLF for k, v in lines)
    made = []
    for kind, rid, what, data in (("metadata", other, "application/warc-fields", meta), ("conversion", own, "text/plain; charset=utf-8", text)):
        if data is not None:
            made.append(([("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Refers-To", source), ("Content-Type", what), ("WARC-Block-Digest", digest(data))], data))
    return made


ROWS = "page_id long,warc_type string,record_id string,refers_to string,target_uri string,warc_date string,content_type string,content_length long,block_digest string,block string,record_sha256 string"


def derive(responses: DataFrame, *, id_col: str = "page_id", warc_col: str = "warc") -> DataFrame:
    """Two rows for each response record in a column of WARC bytes (plain, or gzip members): one ``metadata``, one ``conversion``.

    A response without text, or of a content coding other than gzip and deflate, has the first alone.

    Other records, null bytes and broken records give no rows; what stands before a broken record is kept.  Equal rows give equal
    record ids.  record_sha256 is of the whole derived record as it is written.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out: list[tuple] = []
        for i, data in zip(batch.column("id").to_pylist(), batch.column("warc").to_pylist(), strict=True):
            try:
                for source in parse(data or b""):
                    for headers, block in derivatives(*source):
                        whole = record(headers, block)
                        out.append((i, *(get(headers, k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")), len(block), get(headers, "WARC-Block-Digest"), block.decode("utf-8", "replace"), hashlib.sha256(whole).hexdigest()))
            except ValueError:
                continue
        names = [x.split()[0] for x in ROWS.split(",")]
        return dict(zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True))

    return map_arrow(responses.select(F.col(id_col).cast("long").alias("id"), F.col(warc_col).alias("warc")), rows, ROWS)


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and warc: each page as a response record.  A null page is an empty payload, a null url an empty URI."""
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def rows(batch: pa.RecordBatch) -> dict:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html")]
        return {"page_id": columns[0], "warc": [response(u, h, key=i, date=date) for i, u, h in zip(*columns, strict=True)]}

    return map_arrow(source, rows, "page_id long,warc binary")

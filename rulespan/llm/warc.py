"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

Records are bytes as in the WARC 1.1 format: ``read_records`` and ``write_record`` are each other's
inverse. ``derive`` turns every response record into a metadata record (the source's headers, digest
and outgoing links) and a conversion record (its plain text), both of which refer to the response.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm.common import unescaped

_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:rulespan:warc")
_DROP = re.compile(r"<!--.*?(?:-->|$)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_ANCHOR, _HREF = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>]+)")
_TITLE, _TITLE_END = re.compile(r"<title\b", re.I), re.compile(r"</title", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)

DERIVED = ("record_type string, record_id string, refers_to string, target_uri string, date string, payload_digest string, block_digest string, "
           "source_headers array<struct<name: string, value: string>>, content_length long, record binary")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's customary digest


def record_id(*parts: object) -> str:
    """The same identifier for the same parts, whenever and wherever it is made."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(map(str, parts)))}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record of these headers, in their order; the length is added."""
    # a header is one line: line ends in values become spaces
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in headers if k.lower() != "content-length"]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def opened(data: bytes, *, strict: bool = True) -> bytes:
    """The data of all gzip members, or the data itself. Not ``strict``: what comes before a broken place."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            out.append(member.decompress(data))
            if not member.eof:
                raise zlib.error("a member is cut off")
        except zlib.error as problem:
            if strict:
                raise ValueError(str(problem)) from problem
            break
        data = member.unused_data
    return b"".join(out)


def _next_record(stream: io.BytesIO) -> tuple[list[tuple[str, str]], bytes] | None:
    while line := stream.readline():
        if line.strip():
            break
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record starts with {line[:40]!r}")
    headers: list[tuple[str, str]] = []
    while (line := stream.readline()).strip():
        if line.startswith(b"WARC/"):
            raise ValueError("a record's headers don't end")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {text.strip()}"
        else:
            name, _, value = text.partition(":")
            headers.append((name.strip(), value.strip()))
    length = next((v for k, v in headers if k.lower() == "content-length"), "")
    if not length.isdecimal() or len(length) > 18:
        raise ValueError("a record has no length")
    block = stream.read(int(length))
    if len(block) < int(length):
        raise ValueError("a record is cut off")
    at = stream.tell()
    if stream.read(1).strip():
        raise ValueError("a record goes on after its length")
    stream.seek(at)
    return headers, block


def read_records(data: bytes, *, strict: bool = True) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record; gzip members are opened. Where a record is broken, ``strict`` raises
    ValueError, else reading goes on with the next line that starts a record."""
    data = opened(data, strict=strict)
    stream = io.BytesIO(data)
    while True:
        start = stream.tell()
        try:
            record = _next_record(stream)
        except ValueError:
            if strict:
                raise
            if (at := data.find(b"\nWARC/", start + 4)) < 0:  # blank lines may come before the broken one
                return
            stream.seek(at + 1)
            continue
        if record is None:
            return
        yield record


def http_message(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and decoded payload of a response block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
    get = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in get.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            try:
                n = int(payload[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not n:
                break
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 4 + n
        payload = b"".join(out) or payload
    if get.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompressobj(zlib.MAX_WBITS | 32).decompress(payload)
        except zlib.error:
            pass  # what can't be opened stays as it is
    return lines[0], headers, payload


def decoded(payload: bytes, content_type: str) -> str:
    """The payload's text, by the charset that its header or its first 1024 bytes name, else UTF-8."""
    named = _CHARSET.search(content_type) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _without(tags: re.Pattern, by: str, page: str) -> str:
    # after the last ">" nothing can be a tag; without that, each "<" there would be looked at to the page's end
    end = page.rfind(">") + 1
    return tags.sub(by, page[:end]) + page[end:]


def plain_text(page: str) -> str:
    """All visible text: a line for each block, inline tags removed, character references decoded."""
    text = _without(_TAG, "", _without(_BREAK, "\n", _DROP.sub(" ", page)))
    return "\n".join(x for line in unescaped(text).split("\n") if (x := " ".join(line.split())))


def title_of(page: str) -> str | None:
    """The first title's text, still with its markup."""
    if (m := _TITLE.search(page)) and (start := page.find(">", m.end())) >= 0 and (stop := _TITLE_END.search(page, start + 1)):
        return page[start + 1 : stop.start()]
    return None


def outlinks(page: str) -> Iterator[str]:
    """What anchors link to, as written, in page order. Looks ahead once for all anchors, so in linear time."""
    at, close, href = 0, -1, None
    while anchor := _ANCHOR.search(page, at):
        at = anchor.end()
        if close < at and (close := page.find(">", at)) < 0:
            close = len(page)
        if (href is None or href.start() < at) and (href := _HREF.search(page, at)) is None:
            return
        if href.start() < close and (value := _VALUE.match(page, href.end())):
            yield value[1] or value[2] or value[3] or ""
            at = value.end()


def responses(pages: DataFrame, key: str, *, url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``key`` and ``record binary``: a response record for each page; null pages have an empty payload, null URLs an empty one."""
    source = pages.select(F.col(key).alias("__key"), F.col(url).cast("string").alias("__url"), F.col(html).cast("string").alias("__html"))
    kind = source.schema["__key"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out = []
                for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (h or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                    out.append(write_record([
                        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", k, u)), ("WARC-Date", date), ("WARC-Target-URI", u or ""),
                        ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "record"])

    return source.mapInArrow(build, f"`{key}` {kind}, record binary")


def derived_records(headers: list[tuple[str, str]], block: bytes) -> Iterator[dict]:
    """The metadata and the conversion record of one response record."""
    get = {k.lower(): v for k, v in headers}
    source, target, date = get.get("warc-record-id", ""), get.get("warc-target-uri", ""), get.get("warc-date", "")
    status, http, payload = http_message(block)
    raw = block.partition(b"\r\n\r\n")[2] if status else block
    source_digest = get.get("warc-payload-digest") or digest(raw)
    kind = next((v for k, v in http if k.lower() == "content-type"), "")
    page = decoded(payload, kind)
    title = title_of(page)
    links = list(dict.fromkeys(" ".join(unescaped(x).split()) for x in outlinks(_DROP.sub(" ", page))))
    fields = [("sourceStatus", status), *((f"sourceHeader-{k}", v) for k, v in http), ("sourcePayloadDigest", source_digest)]
    if title is not None:
        fields.append(("title", " ".join(unescaped(title).split())))
    fields += [("outlink", x) for x in links]
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date)]
    linked += [(k, v) for k, v in headers if k.lower() in ("warc-warcinfo-id", "warc-ip-address", "warc-identified-payload-type")]
    for record_type, content_type, body in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode()),
        ("conversion", "text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    ):
        own, block_digest = record_id(record_type, source, source_digest), digest(body)
        record = write_record([("WARC-Type", record_type), ("WARC-Record-ID", own), *linked, ("WARC-Payload-Digest", source_digest if record_type == "metadata" else block_digest),
                               ("WARC-Block-Digest", block_digest), ("Content-Type", content_type)], body)
        yield {"record_type": record_type, "record_id": own, "refers_to": source, "target_uri": target, "date": date, "payload_digest": source_digest, "block_digest": block_digest,
               "source_headers": [{"name": k, "value": v} for k, v in http], "content_length": len(body), "record": record}


def derive(records: DataFrame, keys: list[str], *, record: str = "record") -> DataFrame:
    """``keys``, then the columns of ``DERIVED``: two rows for each response among the WARC data in ``record``.

    ``payload_digest`` is the source's, in both rows. Records of other types give nothing, nor do
    null or empty data; a cell may hold any number of records, gzipped or not; a broken record is left out, and
    reading goes on with the next. Repeated rows each count; other columns are ignored.
    """
    source = records.select(*(F.col(k) for k in keys), F.col(record).alias("__record"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    header = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"content_length": pa.int64(), "record": pa.binary(), "source_headers": header}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                rows, found = [], []
                for i, data in enumerate(batch.column(len(keys)).to_pylist()):
                    for headers, block in read_records(data or b"", strict=False):
                        if any(k.lower() == "warc-type" and v == "response" for k, v in headers):
                            for x in derived_records(headers, block):
                                rows.append(i)
                                found.append(x)
                if rows:
                    names = list(found[0])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(len(keys))), *(pa.array([x[n] for x in found], kinds.get(n, pa.string())) for n in names)], names=[*keys, *names])

    return source.mapInArrow(run, types + DERIVED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` as ``path string, record binary``, one row each, for ``derive``; each must be under 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("content").alias("record"))

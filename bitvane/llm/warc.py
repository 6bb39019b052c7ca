"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A record is a row: its type, id, the id it refers to, target URI, date, content type, block and the
named headers in order. For each response, derive() gives a metadata record (a JSON block with the
source's WARC and HTTP headers, status, digests, title and links) and a conversion record (the
page's text, UTF-8). Both carry WARC-Refers-To the response, WARC-Refers-To-Target-URI and -Date,
its target URI, the digests of their own block, and the source's payload digest; the metadata also
names the conversion that was made. A response's id is a UUID of its page's id, URL, date and payload
digest, a derivative's of its source's id and its kind: so a rerun after the loss of an executor
makes the same records, and another crawl of a page makes others.

The work is a map over records: no shuffle, and one record in memory at a time beside its batch.
Files are decompressed a gzip member, and parsed a record, at a time.

Defined results: a null or empty page gives a response with an empty payload, and derivatives with
an empty text; a null URL gives records without target URI; control characters in a URL are percent-encoded,
and a header that holds a line's end is refused with ValueError; records of other types, and responses
that aren't HTTP, give no conversion but do give metadata; rows that repeat in all of id, URL and
page give records that repeat, ids too; a very long page is one record, held whole by one task. No
rows, no records. Malformed records raise ValueError when parsed. Extra columns of the pages, of whatever
name, play no part.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import map_frames, or_none, table
from .html_text import plain_text

VERSION = "WARC/1.1"
_SPACE = uuid.UUID("5d3c4d5e-3b0a-5c57-9f2e-8a1f0c6b7d42")
_HEADER_COLUMN = "array<struct<name string, value string>>"
RECORD = f"page_id bigint, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, headers {_HEADER_COLUMN}, block binary"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
#: Records and bytes that are handed on at once.
BATCH_RECORDS, BATCH_BYTES = 1000, 32 << 20
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(block: bytes) -> str:
    """As WARC digest headers write it: the algorithm and base32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(map(str, parts)))}>"


def record(kind: str, rid: str, block: bytes, content_type: str, uri: str | None, date: str | None, **more: str | None) -> dict:
    """A record with its headers in order; more names further headers, _ for -."""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", rid)]
    headers += [(k, v) for k, v in (("WARC-Date", date), ("WARC-Target-URI", uri)) if v is not None]
    headers += [(k.replace("_", "-"), v) for k, v in more.items() if v is not None]
    headers += [("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return {
        "warc_type": kind, "record_id": rid, "refers_to": more.get("WARC_Refers_To"), "target_uri": uri, "warc_date": date,
        "content_type": content_type, "headers": [{"name": k, "value": v} for k, v in headers], "block": block,
    }


def http_response(body: bytes) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes] | None:
    """(status line, headers, payload), or None for what isn't an HTTP message."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found:
        head, found, payload = block.partition(b"\n\n")
    lines = head.decode("iso-8859-1").splitlines()
    if not lines or not lines[0].startswith("HTTP/"):
        return None
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in " \t" and headers:  # a folded line belongs to the one before
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            headers.append((name.strip(), value.strip()))
    return lines[0], headers, payload


def _decoded(payload: bytes, headers: list[tuple[str, str]]) -> str:
    named = [v for k, v in headers if k.lower() == "content-type"]
    found = _CHARSET.search(named[0]) if named else None
    try:
        return payload.decode(found[1] if found else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def response_of(page_id: int | None, url: str | None, html: str | None, date: str) -> dict:
    """The response record of a fetched page."""
    payload = (html or "").encode("utf-8", "replace")
    uri = None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    of = digest(payload)
    rid = record_id("response", "" if page_id is None else page_id, "null" if uri is None else f"uri {uri}", date, of)
    return record("response", rid, http_response(payload), "application/http; msgtype=response", uri, date, WARC_Payload_Digest=of)


def derivatives(source: dict) -> list[dict]:
    """The metadata record of a source record, and before it the conversion of a response."""
    given = {h["name"].lower(): h["value"] for h in source["headers"]}
    block, sid, uri, date = bytes(source["block"]), source["record_id"], source["target_uri"], source["warc_date"]
    message = split_http(block) if source["warc_type"] == "response" else None
    links = {"WARC_Refers_To": sid, "WARC_Refers_To_Target_URI": uri, "WARC_Refers_To_Date": date}
    out, envelope = [], {"warc": {h["name"]: h["value"] for h in source["headers"]}, "block_digest": digest(block), "block_digest_holds": given.get("warc-block-digest", digest(block)) == digest(block)}
    payload_digest = given.get("warc-payload-digest")
    if message is not None:
        status, headers, payload = message
        payload_digest = payload_digest or digest(payload)
        page = _decoded(payload, headers)
        title = _TITLE.search(page)
        text = plain_text(page).encode("utf-8")
        converted = record("conversion", record_id("conversion", sid), text, "text/plain; charset=UTF-8", uri, date, **links, WARC_Payload_Digest=payload_digest)
        out.append(converted)
        envelope["http"] = {"status": status, "headers": [list(h) for h in headers], "payload_length": len(payload), "payload_digest": digest(payload)}
        envelope["html"] = {"title": " ".join(title[1].split()) if title else None, "links": [a or b or c for a, b, c in _LINK.findall(page)]}
        envelope["conversion"] = {"record_id": converted["record_id"], "block_digest": digest(text), "length": len(text)}
    body = json.dumps(envelope, ensure_ascii=False, separators=(",", ":")).encode("utf-8")
    out.append(record("metadata", record_id("metadata", sid), body, "application/json", uri, date, **links, WARC_Payload_Digest=payload_digest))
    return out


def responses(pages: DataFrame, date: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of pages that were fetched at the date (ISO 8601)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [response_of(p, u, h, date) for p, u, h in zip(or_none(batch["page_id"]), batch["url"].tolist(), batch["html"].tolist())]
            yield _frame(batch["page_id"], rows, range(len(rows)))

    known = pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return map_frames(known, run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """The derivatives of records, with the columns of records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, of = [], []
            for i, source in enumerate(batch.drop(columns="page_id").to_dict("records")):
                made = derivatives({k: None if isinstance(v, float) and v != v else v for k, v in source.items()})
                rows += made
                of += [i] * len(made)
            yield _frame(batch["page_id"], rows, of)

    return map_frames(records, run, RECORD)


def _frame(ids: pd.Series, rows: list[dict], of) -> pd.DataFrame:
    names = [part.split()[0] for part in ("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "headers", "block")]
    out = pd.DataFrame(rows, columns=names[1:])
    known = or_none(ids)
    out.insert(0, "page_id", pd.array([known[i] for i in of], dtype="Int64"))
    return out


def to_bytes(headers: list[dict], block: bytes, compress: bool = False) -> bytes:
    """A record as it stands in a file; compressed, as a gzip member of its own."""
    for h in headers:
        if any(c in part for part in (h["name"], h["value"]) for c in "\r\n") or not h["name"] or ":" in h["name"]:
            raise ValueError(f"a header that isn't one line: {h['name']!r}")
    head = "".join(f"{h['name']}: {h['value']}\r\n" for h in headers)
    raw = f"{VERSION}\r\n{head}\r\n".encode() + bytes(block) + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def _inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file, plain or of gzip members, some at a time."""
    view = memoryview(raw)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), step):
            yield bytes(view[at : at + step])
        return
    at = 0
    while at < len(view):
        member, given = zlib.decompressobj(31), view[at : at + step]
        at += len(given)
        while not member.eof:
            out = member.decompress(given, step)
            if out:
                yield out
            given = member.unconsumed_tail
            if not member.eof and not given and not out:
                given = view[at : at + step]
                at += len(given)
                if not given:
                    raise ValueError("the last gzip member is cut off")
        at -= len(member.unused_data)


def parse(raw: bytes) -> Iterator[dict]:
    """The records of a file's bytes, plain or of gzip members; one is held at a time."""
    chunks, held, passed = _inflated(raw), bytearray(), 0

    def more() -> bool:
        found = next(chunks, None)
        if found is not None:
            held.extend(found)
        return found is not None

    while held or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                break
        lines = held[:end].decode("utf-8").split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {passed}")
        headers: list[dict] = []
        for line in lines[1:]:
            if line[:1] in (" ", "\t") and headers:  # a folded line belongs to the one before
                headers[-1]["value"] += " " + line.strip()
                continue
            name, colon, value = line.partition(":")
            if not colon:
                raise ValueError(f"no header in the record at byte {passed}: {line[:80]!r}")
            headers.append({"name": name.strip(), "value": value.strip()})
        of = {h["name"].lower(): h["value"] for h in headers}
        told = of.get("content-length", "")
        last = end + 8 + int(told) if told.isascii() and told.isdigit() else -1
        while 0 <= last and len(held) < last - 4 and more():
            pass
        if last < 0 or len(held) < last - 4:
            raise ValueError(f"the record at byte {passed} is cut off")
        block = bytes(held[end + 4 : last - 4])
        yield {
            "warc_type": of.get("warc-type"), "record_id": of.get("warc-record-id"), "refers_to": of.get("warc-refers-to"), "target_uri": of.get("warc-target-uri"),
            "warc_date": of.get("warc-date"), "content_type": of.get("content-type"), "headers": headers, "block": block,
        }
        while len(held) < last and more():
            pass
        del held[:last]
        passed += last


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, each below 2 GB as it is stored; page_id is null.

    A task holds a file as stored, and of what is decompressed one batch of records.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows, size = [], 0
                for found in parse(bytes(raw)):
                    rows.append(found)
                    size += len(found["block"])
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield _frame(pd.Series([None], dtype="object"), rows, [0] * len(rows))
                        rows, size = [], 0
                yield _frame(pd.Series([None], dtype="object"), rows, [0] * len(rows))

    return map_frames(files, run, RECORD)


def file_bytes(records: DataFrame, compress: bool = True, out: str = "bytes") -> DataFrame:
    """records with each one's bytes as in a file; concatenate them to write files."""

    @F.pandas_udf("binary")
    def made(headers: pd.Series, block: pd.Series) -> pd.Series:
        return pd.Series([to_bytes(list(h), b, compress) for h, b in zip(headers, block)], dtype=object)

    return records.withColumn(out, made("headers", "block"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a derived record: page_id, its type and ids, digests, length, and the whole block and headers' digest."""
    made = derive(responses(table(spark, sf_dir, "pages"), "2026-01-01T00:00:00Z"))
    value = lambda name: F.element_at(F.filter("headers", lambda h: h["name"] == name), 1)["value"]
    return made.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type",
        value("WARC-Block-Digest").alias("block_digest"), value("WARC-Payload-Digest").alias("payload_digest"),
        F.length("block").cast("bigint").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"), F.when(F.col("warc_type") == "conversion", F.decode("block", "utf-8")).alias("text"),
    )


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL: dict[str, str] = {}

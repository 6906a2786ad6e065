"""WARC derivatives: from each response a linked metadata record and a plain-text conversion record.

Both name the response in WARC-Refers-To (with its target URI and date), and carry the response's own content type, digests
and HTTP headers, so that a derivative can be checked against its source without it. Headers are lists of names and values, so
repeated ones all stay, in their order. Each row makes its own derivatives; nothing is grouped or shuffled. Identifiers are made
from what a record is about, so a repeated run gives the same ones.

Defined results: a null or empty page is a response with an empty payload; its conversion record is empty. A null URL is
an empty target. Rows with equal ids give records with equal ids. Responses without the HTTP separator are all header.
Transfer and content codings (chunked, gzip, deflate, zstd) are undone for the text, as far as the payload goes if it is cut; a payload
that isn't what its header says is taken as it is. Of a cut WARC file the last record keeps what there is of its
block and gets a WARC-Truncated header; a cut header is no record. Extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices
from .htmltext import page_lines

VERSION = "WARC/1.1"
NO_DATE = "1970-01-01T00:00:00Z"
_SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers array<struct<name:string,value:string>>, block binary"


def _urn(*of: Column) -> Column:
    """A name-based identifier: a UUID of version 8 from a SHA-256."""
    h = F.sha2(F.concat_ws("\x1f", *of).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _digest(of: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(of, 256))


def _headers(of: dict[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in of.items()))


def header(headers: Column, name: str) -> Column:
    """The value of the first header of a name, whatever its case; empty without one."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.when(F.size(found) > 0, found[0]["value"]), F.lit(""))


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", date: str = NO_DATE) -> DataFrame:
    """Pages as response records, a row each, beside the page's key."""
    payload = F.coalesce(F.col(page).cast("string"), F.lit("")).cast("binary")
    target = F.coalesce(F.col(url).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.concat(head, payload)
    return pages.select(
        F.col(key).alias("page_id"),
        F.lit("response").alias("warc_type"),
        _urn(F.lit("response"), F.coalesce(F.col(key).cast("string"), F.lit("")), target).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"),
        target.alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        _headers({"WARC-Payload-Digest": _digest(payload), "WARC-Block-Digest": _digest(block)}).alias("headers"),
        block.alias("block"),
    )


_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=", re.I)
_CHARSET = re.compile(r"charset=[\"']?([A-Za-z0-9_-]+)", re.I)


def _inflated(data: bytes, bits: int) -> bytes | None:
    """All members of compressed data, as far as they go; None where it doesn't begin as such data does."""
    out = []
    while data:
        one = zlib.decompressobj(bits)
        try:
            out.append(one.decompress(data))
        except zlib.error:
            return b"".join(out) if out else None
        data = one.unused_data
    return b"".join(out)


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else data
        if not n:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else data


def _plain(payload: bytes, headers: list[tuple[str, str]]) -> bytes:
    """The payload without its transfer and content codings, the last one first."""
    for name in ("transfer-encoding", "content-encoding"):
        codings = [c.strip().lower() for k, v in headers if k.lower() == name for c in v.split(",")]
        for coding in reversed(codings):
            if coding == "chunked":
                payload = _unchunked(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = payload if (x := _inflated(payload, 31)) is None else x
            elif coding == "deflate":
                for bits in (15, -15):
                    if (x := _inflated(payload, bits)) is not None:
                        payload = x
                        break
            elif coding == "zstd":
                try:
                    payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
                except zstandard.ZstdError:
                    pass
    return payload


def _pairs(lines: list[str]) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines) if k.strip()]


def _read(block: bytes) -> tuple[list[tuple[str, str]], str, str, str, str, int]:
    """Of an HTTP response: its headers, status, text lines, title, language, number of links."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *rest = head.decode("latin-1").split("\r\n")
    headers = _pairs(rest)
    payload = _plain(payload, headers)
    named = next(filter(None, (_CHARSET.search(v) for k, v in headers if k.lower() == "content-type")), None)
    try:
        page = payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    title, lang = _TITLE.search(page), _LANG.search(page)
    text = "\n".join(x.text for x in page_lines(page))
    return headers, status, text, " ".join(html.unescape(title[1]).split()) if title else "", lang[1].lower() if lang else "", len(_HREF.findall(page))


def derivatives(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response; other records give none. A key column `page_id`, if any, is kept."""
    if "page_id" not in source.columns:
        source = source.withColumn("page_id", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            out = list(zip(*(_read(b or b"") for b in batch.column(2).to_pylist()), strict=True)) or [[]] * 6
            types = (_HEADERS, pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            heads = [[{"name": k, "value": v} for k, v in x] for x in out[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip([heads, *out[1:]], types, strict=True))], names=["page_id", "s", "http", "status", "text", "title", "lang", "links"])

    kept = F.struct("record_id", "target_uri", "date", "headers")
    rows = source.where("warc_type = 'response'").select(F.col("page_id").cast("long"), kept.alias("s"), "block")
    kind = rows.schema["s"].dataType.simpleString()
    read = rows.mapInArrow(run, f"page_id long, s {kind}, http array<struct<name:string,value:string>>, status string, text string, title string, lang string, links long")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n"))
    # By name, repeated ones in their order.
    placed = F.array_sort(F.transform("http", lambda e, k: F.struct(F.lower(e["name"]).alias("name"), k.alias("k"), e["value"].alias("value"))))
    http = F.array_join(F.transform(placed, lambda e: F.concat(F.lit("http-"), e["name"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    fields = F.concat(line("http-status", F.col("status")), http, line("title", F.col("title")), line("language", F.col("lang")), line("outlinks", F.col("links").cast("string")))
    made = F.array(
        F.struct(F.lit("metadata").alias("t"), F.lit("application/warc-fields").alias("c"), fields.cast("binary").alias("b")),
        F.struct(F.lit("conversion").alias("t"), F.lit("text/plain; charset=utf-8").alias("c"), F.col("text").cast("binary").alias("b")),
    )
    each = read.select("page_id", "s", "http", F.explode(made).alias("m"))
    own = {
        "WARC-Refers-To-Target-URI": F.col("s.target_uri"),
        "WARC-Refers-To-Date": F.col("s.date"),
        "WARC-Block-Digest": _digest(F.col("m.b")),
        "X-Source-Payload-Digest": header(F.col("s.headers"), "WARC-Payload-Digest"),
        "X-Source-Block-Digest": header(F.col("s.headers"), "WARC-Block-Digest"),
        "X-Source-Content-Type": header(F.col("http"), "Content-Type"),
    }
    return each.select(
        "page_id",
        F.col("m.t").alias("warc_type"),
        _urn(F.col("m.t"), F.col("s.record_id")).alias("record_id"),
        F.col("s.record_id").alias("refers_to"),
        F.col("s.target_uri").alias("target_uri"),
        F.col("s.date").alias("date"),
        F.col("m.c").alias("content_type"),
        _headers(own).alias("headers"),
        F.col("m.b").alias("block"),
    )


def derivative_rows(records: DataFrame) -> DataFrame:
    """The records as plain columns."""
    return records.select(
        "page_id",
        "warc_type",
        "record_id",
        "refers_to",
        "target_uri",
        "date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        header(F.col("headers"), "WARC-Block-Digest").alias("block_digest"),
        header(F.col("headers"), "X-Source-Payload-Digest").alias("source_payload_digest"),
        header(F.col("headers"), "X-Source-Block-Digest").alias("source_block_digest"),
        header(F.col("headers"), "X-Source-Content-Type").alias("source_content_type"),
        F.col("block").cast("string").alias("content"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files, one a partition, each begun by nothing but its records; written by Spark's text writer with CRLF ends."""
    line = lambda name, value: F.when(value.isNull() | (value == ""), "").otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")))
    more = F.array_join(F.transform("headers", lambda e: F.when(e["value"] == "", "").otherwise(F.concat(e["name"], F.lit(": "), F.regexp_replace(e["value"], r"[\r\n]+", " "), F.lit("\r\n")))), "")
    block = F.coalesce("block", F.lit("").cast("binary"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")), F.coalesce(more, F.lit("")), line("Content-Type", F.col("content_type")), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    whole = F.concat(head.cast("binary"), block, F.lit("\r\n").cast("binary"))
    records.select(whole.cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)


#: Fields of a record that have a column of their own.
_FIELDS = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type"}


def _members(data: bytes) -> Iterator[bytes]:
    """A plain file as it is; a compressed one member by member, as far as each goes."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        try:
            yield one.decompress(data)
        except zlib.error:
            return
        data = one.unused_data


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", at)) >= 0:
        row = dict.fromkeys(_FIELDS.values()) | {"target_uri": "", "headers": []}
        size = "0"
        for name, value in _pairs(data[at:end].decode("utf-8", "replace").split("\r\n")[1:]):
            if name.lower() == "content-length":
                size = value
            elif (field := _FIELDS.get(name.lower())) and not row[field]:
                row[field] = value
            else:
                row["headers"].append({"name": name, "value": value})
        n = int(size) if size.isdecimal() else 0
        row["block"] = data[end + 4 : end + 4 + n]
        if len(row["block"]) < n:
            row["headers"].append({"name": "WARC-Truncated", "value": "length"})
        yield row
        at = end + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, plain or compressed by gzip (each under 2 GB): the columns that write_warc() takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for part in _members(content.as_py()):
                    for row in _records(part):
                        rows.append(row)
                        size += len(row["block"])
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _SCHEMA)


_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_ARROW = pa.schema([*((n, pa.string()) for n in "warc_type record_id refers_to target_uri date content_type".split()), ("headers", _HEADERS), ("block", pa.binary())])

_H = "sha256({})"
_UUID = "'<urn:uuid:'||substr({h},1,8)||'-'||substr({h},9,4)||'-8'||substr({h},14,3)||'-a'||substr({h},18,3)||'-'||substr({h},21,12)||'>'"
_BLOCK_TAGS = "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|legend|li|main|menu|nav|ol|optgroup|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
_DECODED = "replace(replace(replace(replace(replace({x},'&quot;','\"'),'&lt;','<'),'&gt;','>'),'&copy;','©'),'&middot;','·')"
#: DuckDB SQL for the rows of op10; it decodes the character references that the driver's pages have.
ORACLE = rf"""
WITH p AS (SELECT page_id, coalesce(url,'') AS u, coalesce(html,'') AS h FROM pages),
b AS (SELECT *, 'HTTP/1.1 200 OK'||chr(13)||chr(10)||'Content-Type: text/html; charset=utf-8'||chr(13)||chr(10)||'Content-Length: '||strlen(h)||chr(13)||chr(10)||chr(13)||chr(10)||h AS blk,
 sha256('response'||chr(31)||page_id||chr(31)||u) AS rh,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(h,'\s+',' ','g'),'(?i)<head>.*?</head>','','g'),'(?i)<(script|style)[^>]*>.*?</(script|style)>','','g'),'<!(--.*?--|[a-zA-Z][^>]*)>','','g') AS t0,
 trim(regexp_extract(regexp_replace(h,'\s+',' ','g'),'(?i)<title[^>]*>(.*?)</title',1)) AS ti, lower(regexp_extract(h,'(?i)<html lang="([A-Za-z0-9-]+)',1)) AS lg, len(regexp_extract_all(h,'(?i)<a href=')) AS nl FROM p),
x AS (SELECT *, {_UUID.format(h="rh")} AS rid,
 list_filter(list_transform(string_split(regexp_replace(regexp_replace(t0,'(?i)</?({_BLOCK_TAGS})(\s[^>]*)?/?>',chr(10),'g'),'</?[a-zA-Z][^>]*>','','g'),chr(10)), lambda z: trim(regexp_replace({_DECODED.format(x="z")},'&amp;?','&','g'))), lambda z: z<>'') AS ls FROM b),
r AS (SELECT page_id, u, rid, h, blk, 'metadata' AS wt, 'application/warc-fields' AS ct, 'http-status: HTTP/1.1 200 OK'||chr(13)||chr(10)||'http-content-length: '||strlen(h)||chr(13)||chr(10)||'http-content-type: text/html; charset=utf-8'||chr(13)||chr(10)
  ||'title: '||regexp_replace({_DECODED.format(x="ti")},'&amp;?','&','g')||chr(13)||chr(10)||'language: '||lg||chr(13)||chr(10)||'outlinks: '||nl||chr(13)||chr(10) AS c FROM x
 UNION ALL SELECT page_id, u, rid, h, blk, 'conversion', 'text/plain; charset=utf-8', array_to_string(ls, chr(10)) FROM x),
i AS (SELECT *, sha256(wt||chr(31)||rid) AS ih FROM r)
SELECT page_id, wt AS warc_type, {_UUID.format(h="ih")} AS record_id, rid AS refers_to, u AS target_uri, '{NO_DATE}' AS date, ct AS content_type, CAST(strlen(c) AS BIGINT) AS content_length,
 'sha256:'||sha256(c) AS block_digest, 'sha256:'||sha256(h) AS source_payload_digest, 'sha256:'||sha256(blk) AS source_block_digest, 'text/html; charset=utf-8' AS source_content_type, c AS content FROM i
"""

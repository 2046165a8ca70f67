"""WARC records, and the resolution of not-modified revisits.

A revisit with profile server-not-modified holds only headers. It is resolved by an as-of join: among the captures of the same
canonical URL, the latest earlier full response (status 200) is its original if the validators agree: the entity tags when
the revisit has one, else the dates of last modification when it has one; with neither it stands for the latest response unchecked.
The result has the original's headers, in which those that a 304 answer may renew are taken from the revisit.

Files may be plain or gzip, in one or many members. Dates are ISO 8601 and become microseconds since 1970. The identifier of a record that was written
here gives its number back; any other is hashed to 63 bits. Repeated header lines are joined by ", ". A file is read by one task, in memory. A revisit of another profile than server-not-modified isn't of kind 'revisit'
but 'revisit:' and the profile's last part, as the rules here don't apply to it.

Records are (record_id long, kind 'response' or 'revisit', url, ts long, status int, headers map of lower-case names, payload binary).
Order is by ts, then record_id, then kind (responses first), digest and headers; rows that agree in all of
these are alike, so their order has no effect. Null or empty URLs equal nothing. A null payload is empty. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netglean.llm.asof import latest_before

#: Headers that a 304 answer may renew (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only say where a visitor came from.
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid)"
PROFILE = "server-not-modified"
_GZIP, _FEED = b"\x1f\x8b\x08", 1 << 16
#: A record's first line, and its greatest length.
_LINE = 16
_RECORD = re.compile(rb"WARC/[0-9]{1,2}\.[0-9]{1,4}\r\n")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def canonical_url(url: Column) -> Column:
    """Host and path: scheme, user, default port, fragment, www., tracking parameters and a final slash go; the host is lower-cased, parameters sorted."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(u, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)"))
    out = F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))
    return F.when(out != "", out)


def _tag(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row for each revisit: record_id, canonical, ts, original_id, verdict (resolved, unchecked, changed or missing), headers merged, digest (SHA-256) and n_bytes of the original's payload."""
    df = records.select(
        F.col("record_id").cast("long").alias("record_id"), "kind", canonical_url(F.col("url")).alias("canonical"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"), "headers",
        F.sha2(F.coalesce(F.col("payload").cast("binary"), F.lit(b"")), 256).alias("digest"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("n_bytes"),
    ).where("kind IN ('response', 'revisit')")
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("canonical").isNotNull()
    value = F.when(full, F.struct("record_id", F.to_json("headers").alias("headers"), "digest", "n_bytes"))
    # rows that share no URL with others needn't meet in one group of nulls
    df = df.withColumn("key", F.coalesce(F.col("canonical"), F.concat(F.lit("\u0000"), F.col("record_id").cast("string"))))
    order = [F.col("ts").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("kind"), F.col("digest"), F.to_json("headers")]
    df = latest_before(df, ["key"], order, value, "original").where("kind = 'revisit'")
    theirs = F.from_json("original.headers", "map<string,string>")
    df = df.withColumn("theirs", F.when(F.col("original").isNotNull(), F.coalesce(theirs, F.create_map().cast("map<string,string>")))).withColumn("own", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    get = lambda m, k: F.element_at(F.col(m), F.lit(k))
    agree = F.when(get("own", "etag").isNotNull(), _tag(get("own", "etag")).eqNullSafe(_tag(get("theirs", "etag")))).when(get("own", "last-modified").isNotNull(), get("own", "last-modified").eqNullSafe(get("theirs", "last-modified")))
    df = df.withColumn("verdict", F.when(F.col("original").isNull(), "missing").when(agree.isNull(), "unchecked").when(agree, "resolved").otherwise("changed"))
    ok = F.col("verdict").isin("resolved", "unchecked")
    renewed = F.map_filter("own", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("theirs", lambda k, v: ~F.array_contains(F.map_keys(renewed), k)), renewed)
    return df.select("record_id", "canonical", "ts", F.when(ok, F.col("original.record_id")).alias("original_id"), "verdict", F.when(ok, merged).alias("headers"), F.when(ok, F.col("original.digest")).alias("digest"), F.when(ok, F.col("original.n_bytes")).alias("n_bytes"))


def captures(pages: DataFrame) -> DataFrame:
    """Records made of (page_id, url, html): a response and a later revisit for each page; some revisits carry another entity tag, some only a date, and some neither."""
    day = (F.col("page_id") % 28 + 1).cast("string")
    etag = F.concat(F.lit('"'), F.substring(F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), 1, 16), F.lit('"'))
    date = F.concat(F.lpad(day, 2, "0"), F.lit(" Jan 2024 00:00:00 GMT"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", etag.alias("etag"), date.alias("date"))
    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", (F.col("page_id") * 2).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), F.col("etag"), F.lit("last-modified"), F.col("date"), F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.col("html").cast("binary").alias("payload"),
    )
    kind = F.pmod(F.floor(F.col("page_id") / 3), F.lit(4))
    headers = F.when(kind == 0, F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.col("etag")), F.lit("date"), F.col("date"), F.lit("content-type"), F.lit("x/y"))).when(kind == 1, F.create_map(F.lit("etag"), F.lit('"other"'))).when(kind == 2, F.create_map(F.lit("last-modified"), F.col("date"), F.lit("cache-control"), F.lit("no-store"))).otherwise(F.create_map(F.lit("server"), F.lit("none")))
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") * 2 + 1).alias("ts"), F.lit(304).alias("status"), headers.alias("headers"), F.lit(None).cast("binary").alias("payload"))
    return full.union(again)


def to_bytes(kind: str, url: str, ts: str, status: int, headers: dict[str, str], payload: bytes | None, record_id: str) -> bytes:
    """A WARC/1.1 record whose block is an HTTP answer."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "Status")
    http = f"HTTP/1.1 {status} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + (payload or b"")
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:record:{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", ts), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        named.insert(4, ("WARC-Profile", f"http://netpreserve.org/warc/1.1/revisit/{PROFILE}"))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n").encode() + block + b"\r\n\r\n"


def iso(ts: int | None) -> str:
    """Microseconds since 1970 as a WARC date, which has none if they are unknown or in no year from 1 to 9999."""
    try:
        return "" if ts is None else (_EPOCH + timedelta(microseconds=ts)).replace(tzinfo=None).isoformat(timespec="microseconds") + "Z"
    except OverflowError:
        return ""


def microseconds(date: str) -> int | None:
    """A WARC date as microseconds since 1970; of fractions six digits count, and months and days may be missing."""
    try:
        d = datetime.fromisoformat(date + {4: "-01-01", 7: "-01"}.get(len(date), ""))
    except ValueError:
        return None
    return (d.replace(tzinfo=d.tzinfo or timezone.utc) - _EPOCH) // timedelta(microseconds=1)


def number(identifier: str) -> int | None:
    own = identifier.removeprefix("<urn:record:").removesuffix(">")
    if identifier.startswith("<urn:record:") and own.removeprefix("-").isdecimal() and -(2**63) <= int(own) < 2**63:
        return int(own)
    return int.from_bytes(hashlib.sha256(identifier.encode()).digest()[:8], "big") >> 1 if identifier else None


def unzipped(data: bytes) -> Iterator[bytes | None]:
    """The contents of gzip members in pieces, one member after the other; other data as it is. A damaged member is skipped up to the next one's magic number, and None stands for it."""
    if not data.startswith(_GZIP):
        yield data
        return
    view, at = memoryview(data), 0
    while 0 <= at < len(data):
        member, began = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(data):
                fed = view[at : at + _FEED]
                if piece := member.decompress(fed):
                    yield piece
                at += len(fed) - len(member.unused_data)
            if not member.eof:
                yield None
        except zlib.error:
            yield None
            at = data.find(_GZIP, began + 1)
            continue
        if at < len(data) and not data.startswith(_GZIP, at):  # bytes between members
            yield None
            at = data.find(_GZIP, at)


def parse(pieces: Iterator[bytes | None]) -> Iterator[tuple[dict[str, str], int | None, dict[str, str], bytes] | None]:
    """Each record's named fields, HTTP status, HTTP headers (lower-case names) and payload.

    Bytes that are no record, or the rest of one whose member is damaged, are skipped up to what looks like the next record; None stands for each such gap. What is held is one record.
    """
    kept, gap = bytearray(), False
    for piece in pieces:
        if piece is None:
            kept.clear()  # the record that was begun has lost its end
        else:
            kept += piece
        for r in [None] if piece is None else _records(kept, gap, False):
            if r is not None or not gap:
                yield r
            gap = r is None
    for r in _records(kept, gap, True):
        if r is not None or not gap:
            yield r
        gap = r is None


def _records(kept: bytearray, gap: bool, last: bool) -> Iterator[tuple | None]:
    """The whole records at the beginning of kept, which are taken off it. gap: whether what precedes kept is no record. None where bytes are skipped."""
    at = 0
    while at < len(kept):
        start = _RECORD.match(kept, at)
        if not start:
            found = _RECORD.search(kept, at)
            skip = found.start() if found else len(kept) if last else max(at, len(kept) - _LINE)
            begun = not found and not last and not gap and b"WARC/".startswith(kept[at : at + 5])
            if begun:  # a record's first line may still be coming
                break
            if kept[at:skip].strip():
                gap = True
                yield None
            at = skip
            if not found:
                break
            continue
        end = kept.find(b"\r\n\r\n", at)
        fields = {}
        for line in bytes(kept[at : max(end, at)]).split(b"\r\n")[1:]:
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = fields.get("content-length", "")
        stop = end + 4 + int(size) if size.isdecimal() else 0
        if not last and (end < 0 or len(kept) < stop + 4):
            break
        if end < 0 or not size.isdecimal() or len(kept) < stop:  # no length, or cut: a later record may stand inside what the length covers
            gap = True
            yield None
            at += 5
            continue
        block = bytes(kept[end + 4 : stop])
        at = stop + 4 if kept.startswith(b"\r\n\r\n", stop) else stop
        head, _, payload = block.partition(b"\r\n\r\n")
        status, headers = None, {}
        if head.startswith(b"HTTP/"):
            lines = head.decode("utf-8", "replace").split("\r\n")
            part = lines[0].split(" ")
            status = int(part[1]) if len(part) > 1 and part[1].isdigit() else None
            for k, _, v in (x.partition(":") for x in lines[1:]):
                k, v = k.strip().lower(), v.strip()
                headers[k] = f"{headers[k]}, {v}" if k in headers else v
        else:
            payload = block
        gap = False
        yield fields, status, headers, payload
    del kept[:at]


def write_records(records: DataFrame) -> DataFrame:
    """record_id and warc (binary), a WARC record for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [to_bytes(r["kind"] or "response", r["url"] or "", iso(r["ts"]), r["status"] or 0, dict(r["headers"] or {}), r["payload"], str(r["record_id"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("record_id"), pa.array(out, pa.binary())], ["record_id", "warc"])

    return records.select(F.col("record_id").cast("long").alias("record_id"), "kind", "url", "ts", "status", "headers", "payload").mapInArrow(run, "record_id long, warc binary")


def read_records(files: DataFrame, lost: bool = False) -> DataFrame:
    """Records of the column content (binary; one or more WARC records each, as spark.read.format('binaryFile') gives files). lost: also a row of kind lost for each gap where bytes were no record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = ["record_id", "kind", "url", "ts", "status", "headers", "payload"]

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        rows, size = [], 0
        for b in batches:
            for data in b.column("content"):
                data = data.as_py()
                for record in parse(unzipped(data or b"")):
                    if record is None:
                        if lost:
                            rows.append((None, "lost", None, None, None, None, None))
                        continue
                    f, status, headers, payload = record
                    kind, profile = f.get("warc-type"), f.get("warc-profile", "").rstrip("/").rpartition("/")[2]
                    if kind == "revisit" and profile not in ("", PROFILE):
                        kind = f"revisit:{profile}"
                    rows.append((number(f.get("warc-record-id", "")), kind, f.get("warc-target-uri"), microseconds(f.get("warc-date", "")), status, list(headers.items()), payload))
                    size += len(payload) + 100
                    if size >= 8_000_000:
                        yield send()
                        size = 0
        if rows:
            yield send()

    return files.select(F.col("content").cast("binary").alias("content")).mapInArrow(run, "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload binary")


def flat(resolved: DataFrame) -> DataFrame:
    """resolve()'s rows with the headers as text, sorted name=value pairs by line."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "\n")
    return resolved.withColumn("headers", text)

"""From captured bytes to TCP observations: headers a batch at a time, what is made of them in column expressions. Rows that aren't valid TCP drop out, never fail."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netglean.functions import octets, tcp
from netglean.functions.filters import FilterConfig
from netglean.operators import headers
from netglean.operators.headers import ETHERNET_V4, ETHERNET_V6


def _schema(df: DataFrame, more: str) -> StructType:
    """df's columns and more, all of which may be null."""
    return StructType([StructField(f.name, f.dataType) for f in df.schema] + StructType.fromDDL(more).fields)


def datalink_format(data: Column) -> Column:
    """null, raw_ip or ethernet, in this order of tries; null when none fits."""
    n, first = F.octet_length(data), octets.u8(data, 0)
    nibble, words = F.floor(first / 16), first.bitwiseAND(15)
    raw = ((nibble == 4) & (words >= 5) & (n >= words * 4)) | ((nibble == 6) & (n >= 40))
    inner = F.floor(octets.u8(data, 14) / 16)
    ether = ((octets.u16(data, 12) == ETHERNET_V4) & (inner == 4)) | ((octets.u16(data, 12) == ETHERNET_V6) & (inner == 6))
    return F.when((n >= 24) & (octets.u16(data, 0) == 0x1E00), "null").when((n >= 20) & raw, "raw_ip").when((n >= 34) & ether, "ethernet")


def _once(df: DataFrame, value: Column, name: str, keep: list[str], all_rows: bool = False) -> DataFrame:
    """df with value as a column that later expressions read but never repeat; rows without one drop out unless all_rows. A filter above doesn't pull it apart."""
    some = F.array(value) if all_rows else F.array_compact(F.array(value))
    return df.select(*keep, F.explode(some).alias(name))


def endpoints(packets: DataFrame) -> DataFrame:
    """packets with src, dst, sport and dport for filters, null where a packet isn't plainly TCP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *headers.endpoints(b.column("data"))], [*b.schema.names, "src", "dst", "sport", "dport"])

    return packets.mapInArrow(run, _schema(packets, headers.ENDPOINTS))


def apply_filter(packets: DataFrame, config: FilterConfig) -> DataFrame:
    """Packets that the configuration keeps; those it can't judge are kept."""
    if not config.filters:
        return packets
    return endpoints(packets).where(config.predicate(F.col("src"), F.col("dst"), F.col("sport"), F.col("dport"))).select(*packets.columns)


def decode(packets: DataFrame) -> DataFrame:
    """One row for each valid TCP segment of packets (capture, packet_no, ts, data): addresses, header fields, options walked and in bytes, and payload."""
    kept = packets.select("capture", "packet_no", "ts")
    names = [*kept.columns, *(f.name for f in StructType.fromDDL(headers.SEGMENTS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, fields, _ = headers.segments(b.column("data"))
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in names[:3]), *fields], names)

    return packets.select("capture", "packet_no", "ts", F.col("data").cast("binary").alias("data")).mapInArrow(run, _schema(kept, headers.SEGMENTS))


def judge(packets: DataFrame) -> DataFrame:
    """A row for each packet (capture, packet_no, ts, data) with decode()'s columns and reason, one of headers.REASONS where it gives no segment; then the columns are null. One pass gives results and rejects."""
    names = ["capture", "packet_no", "ts", *(f.name for f in StructType.fromDDL(headers.SEGMENTS)), "reason"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, fields, reason = headers.segments(b.column("data"))
            keep = keep.to_numpy(zero_copy_only=False)
            back = pa.array(np.cumsum(keep) - 1, mask=~keep)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:3]), *(f.take(back) for f in fields), reason], names)

    kept = packets.select("capture", "packet_no", "ts")
    return packets.select("capture", "packet_no", "ts", F.col("data").cast("binary").alias("data")).mapInArrow(run, _schema(kept, f"{headers.SEGMENTS}, reason STRING"))


def observe(segments: DataFrame, standard_mtu: bool = False, keep: dict[str, str] | None = None) -> DataFrame:
    """decode()'s rows as signature observations: direction, TTL and window classes, layout, quirks, MTU and the signature's text. keep: further columns by their new names."""
    c = F.col
    v4 = c("ip_version") == 4
    header = F.when(v4, c("words")).otherwise(40)
    ip_bytes = F.when(v4, c("words") * 4).otherwise(40)
    client = tcp.from_client(c("flags"))
    reserved, dont = c("frag").bitwiseAND(0x8000) != 0, c("frag").bitwiseAND(0x4000) != 0
    df = segments.select(
        "capture", "packet_no", "ts", "src", "dst", "sport", "dport", "flags", F.when(client, "request").otherwise("response").alias("direction"), c("ip_version").cast("string").alias("version"), tcp.ttl_class(c("ttl")).alias("ttl"),
        F.when(v4, F.greatest(c("words") - 5, F.lit(0)) * 4).otherwise(0).alias("olen"), c("opt.mss").alias("mss"), tcp.window_class(c("window"), c("opt.mss"), header, F.array_contains("opt.layout", "ts"), c("ip_version")).alias("window"),
        c("opt.wscale").alias("wscale"), c("opt.layout").alias("layout"),
        F.concat(tcp.ip_quirks(c("ip_version"), c("ecn") != 0, reserved, dont, c("ident"), c("flow")), tcp.tcp_quirks(c("flags"), c("seq"), c("ack"), c("urgent")), c("opt.quirks")).alias("quirks"),
        F.when(F.octet_length("payload") == 0, "0").otherwise("+").alias("payload"), F.when(client & c("opt.mss").isNotNull(), tcp.mtu(c("opt.mss"), ip_bytes, c("tcp_header"), standard_mtu)).alias("mtu"),
        c("opt.malformed").alias("malformed"), c("opt.ts").alias("tcp_ts"), tcp.uptime_role(c("flags"), c("sport"), c("dport")).alias("role"),
        *(c(old).alias(new) for new, old in (keep or {}).items()),
    )
    df = _once(df, F.struct(*df.columns), "x", []).select("x.*")
    text = tcp.signature_text(c("version"), tcp.ttl_text(c("ttl")), c("olen"), c("mss"), tcp.window_text(c("window")), c("wscale"), c("layout"), c("quirks"), c("payload"))
    return df.withColumn("signature_text", text)

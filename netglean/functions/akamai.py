"""Fingerprints of HTTP/2 clients from their first frames: settings, window, priorities and pseudo-header order.

Frames are ARRAY<STRUCT<type INT, stream_id LONG, flags INT, payload BINARY>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netglean.functions import octets

#: Frame types.
HEADERS, PRIORITY, SETTINGS, WINDOW_UPDATE = 1, 2, 4, 8


def first_payload(frames: Column, kind: int) -> Column:
    return F.get(F.filter(frames, lambda f: (f["type"] == kind) & (f["stream_id"] == 0)), F.lit(0))["payload"]


def settings(frames: Column) -> Column:
    """ARRAY<STRUCT<id, value>> of the first SETTINGS frame on stream 0; null where there is none or it is empty."""
    p = first_payload(frames, SETTINGS)
    n = F.floor(F.octet_length(p) / 6).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(octets.u16(p, i * 6).alias("id"), octets.u32(p, i * 6 + 2).alias("value"))))


def window(frames: Column) -> Column:
    """Increment of the first WINDOW_UPDATE on stream 0, or 0."""
    return F.coalesce(octets.u32(first_payload(frames, WINDOW_UPDATE), 0).bitwiseAND(0x7FFFFFFF), F.lit(0))


def priorities(frames: Column) -> Column:
    """ARRAY<STRUCT<stream_id, exclusive, depends_on, weight>> of all PRIORITY frames that are long enough."""
    some = F.filter(frames, lambda f: (f["type"] == PRIORITY) & (F.octet_length(f["payload"]) >= 5))
    return F.transform(some, lambda f: F.struct(f["stream_id"].alias("stream_id"), (octets.u8(f["payload"], 0) >= 128).alias("exclusive"), octets.u32(f["payload"], 0).bitwiseAND(0x7FFFFFFF).alias("depends_on"), octets.u8(f["payload"], 4).alias("weight")))


def pseudo_letter(name: Column) -> Column:
    return F.when(name == ":method", "m").when(name == ":path", "p").when(name == ":authority", "a").when(name == ":scheme", "s").when(name == ":status", "st").otherwise(F.concat(F.lit("?"), F.regexp_replace(name, "^:+", "")))


def text(settings_: Column, window_: Column, priorities_: Column, pseudo: Column) -> Column:
    """id:value;...|window or 00|stream:exclusive:depends:weight+1,... or 0|pseudo-header letters."""
    s = F.array_join(F.transform(settings_, lambda x: F.concat_ws(":", x["id"].cast("string"), x["value"].cast("string"))), ";")
    w = F.when(window_ == 0, "00").otherwise(window_.cast("string"))
    p = F.array_join(F.transform(priorities_, lambda x: F.concat_ws(":", x["stream_id"].cast("string"), x["exclusive"].cast("int").cast("string"), x["depends_on"].cast("string"), (x["weight"] + 1).cast("string"))), ",")
    return F.concat_ws("|", s, w, F.when(p == "", "0").otherwise(p), F.array_join(F.transform(pseudo, pseudo_letter), ","))


def fingerprint(frames: Column, pseudo: Column) -> Column:
    """STRUCT<text, hash>; null without settings. pseudo: names of the pseudo-headers, in order."""
    named = lambda t: F.struct(t.alias("text"), F.substring(F.sha2(t.cast("binary"), 256), 1, 32).alias("hash"))
    of = lambda f: F.when(settings(f).isNotNull(), octets.let(text(settings(f), window(f), priorities(f), pseudo), named))
    return octets.let(frames, of)


#: Names of the settings of RFC 9113, 6.5.2, by id.
SETTING_NAMES = {1: "header_table_size", 2: "enable_push", 3: "max_concurrent_streams", 4: "initial_window_size", 5: "max_frame_size", 6: "max_header_list_size"}


def named_settings(frames: Column) -> Column:
    """STRUCT of the known settings over all SETTINGS frames, of each the last; null where none names it."""
    every = F.flatten(F.transform(F.filter(frames, lambda f: f["type"] == SETTINGS), lambda f: F.coalesce(settings(F.array(F.struct(f["type"].alias("type"), F.lit(0).cast("long").alias("stream_id"), f["payload"].alias("payload")))), F.array().cast("array<struct<id: int, value: bigint>>"))))
    last = lambda k: F.try_element_at(F.filter(every, lambda x: x["id"] == k), F.lit(-1))["value"]
    return F.struct(*((last(k) != 0 if name == "enable_push" else last(k)).alias(name) for k, name in SETTING_NAMES.items()))

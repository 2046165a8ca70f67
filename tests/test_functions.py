"""Expressions on single values; the Akamai hash is a published vector."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from netglean.functions import akamai, http, ja4, tcp, uptime
from netglean.functions.filters import FilterConfig, IpFilter, PortFilter, SubnetFilter
from netglean.operators import headers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").select("i", column.alias("x")).orderBy("i").collect()]


def test_ttl(spark):
    want = {0: "0-", 32: "32+0", 57: "57+7", 34: "34+30", 20: "20+12", 240: "240+15", 1: "1", 33: "33", 97: "97", 150: "150", 224: "224"}
    assert many(spark, [(t,) for t in want], "t int", tcp.ttl_text(tcp.ttl_class(F.col("t")))) == list(want.values())


def test_window(spark):
    rows = [(30000, 1200, 40, False, 4), (6000, 1337, 40, False, 4), (12288, 1337, 40, False, 4), (27760, 1400, 40, True, 4), (10007, 1460, 40, False, 4), (0, 900, 40, False, 4)]
    w = tcp.window_class(F.col("w"), F.col("m"), F.col("h"), F.col("ts"), F.col("v"))
    assert many(spark, rows, "w int, m int, h int, ts boolean, v int", tcp.window_text(w)) == ["mss*25", "mtu*4", "%4096", "mss*20", "10007", "0"]


def test_mtu_trap(spark):
    assert one(spark, tcp.mtu(F.lit(1460), F.lit(20), F.lit(44))) == 1504
    assert one(spark, tcp.mtu(F.lit(1460), F.lit(20), F.lit(44), standard=True)) == 1500


def test_options(spark):
    raw = ["020405B40402080A000000010000000001030307", "01010003", "02", "1E", "0204", ""]
    o = many(spark, [(r,) for r in raw], "h string", headers.options(F.unhex("h")))
    assert o[0]["layout"] == ["mss", "sok", "ts", "nop", "ws"] and o[0]["mss"] == 1460 and o[0]["wscale"] == 7 and o[0]["ts"]["val"] == 1
    assert o[1]["layout"] == ["nop", "nop", "eol+1"] and o[1]["quirks"] == ["opt+"]
    assert [x["malformed"] for x in o] == [False, False, True, True, True, False]
    o = many(spark, [(r,) for r in ["020405B41E0A0000", "0101", "0204"]], "h string", headers.options(F.unhex("h"), strict=True))
    assert [(x["layout"], x["malformed"]) for x in o] == [(["mss"], True), (["nop", "nop"], False), ([], True)]


def test_rounding(spark):
    want = {11: 10, 12: 15, 13: 15, 17: 20, 18: 20, 22: 25, 48: 50, 250: 250, 1000: 1000, 987: 1000, 101: 100}
    assert many(spark, [(float(k),) for k in want], "hz double", uptime.rounded(F.col("hz"))) == list(want.values())


def test_language(spark):
    want = {"da;q=0.4,nl;q=0.95,it": "Italian", "sv": "Swedish", "pt-PT;q=0.3,cs;q=0.31": "Czech", "": None, "fi;q=0.2,,;q=0.9,hu;q=0.6": "Hungarian"}
    assert many(spark, [(k,) for k in want], "a string", http.language(F.col("a"))) == list(want.values())


def test_alpn_pair(spark):
    want = {"x": "x0", "spdy/3": "s3", "http/1.0": "h0", "aé": "a9", "": "00"}
    assert many(spark, [(k,) for k in want], "a string", ja4.alpn_pair(F.col("a"))) == list(want.values())


def test_diagnosis(spark):
    rows = [(None, None, None), ("x", "Linux", "Linux"), ("x", "Windows", "Linux"), ("x", None, None)]
    assert many(spark, rows, "u string, f string, o string", http.diagnosis(F.col("u"), F.col("f"), F.col("o"))) == ["anonymous", "generic", "dishonest", "none"]


def test_akamai_golden(spark):
    frame = lambda kind, stream, payload: F.struct(F.lit(kind).alias("type"), F.lit(stream).cast("long").alias("stream_id"), F.lit(0).alias("flags"), F.unhex(F.lit(payload)).alias("payload"))
    frames = F.array(frame(4, 0, "000300000064000400600000"), frame(8, 0, "00EEFF01"), frame(2, 3, "00000000C8"))
    got = one(spark, akamai.fingerprint(frames, F.array().cast("array<string>")))
    assert (got["text"], got["hash"]) == ("3:100;4:6291456|15662849|3:0:0:201|", "615d5e7e5f5dec88cdda5886e78b5964")


def test_ipv6_text():
    raw = {"20010db8000000000000000000000001": "2001:db8::1", "00000000000000000000000000000001": "::1", "00000000000000000000000000000000": "::", "20010db8000100000000000000010000": "2001:db8:1::1:0", "fe80000000000000aaaa000000000000": "fe80::aaaa:0:0:0"}
    o, zero = headers.Octets(pa.array([bytes.fromhex(k) for k in raw])), np.zeros(len(raw), np.int64)
    assert o.address(zero > 0, zero, zero).to_pylist() == list(raw.values())
    assert o.number(14, 2).tolist() == [1, 1, 0, 0, 0] and o.number(15, 2).tolist() == [headers.MISSING] * 5


def test_settings_and_extension_headers(spark):
    frame = lambda kind, stream, payload: F.struct(F.lit(kind).alias("type"), F.lit(stream).cast("long").alias("stream_id"), F.lit(0).alias("flags"), F.unhex(F.lit(payload)).alias("payload"))
    got = one(spark, akamai.named_settings(F.array(frame(4, 0, "000200000001000400000009"), frame(4, 0, "000400000007009900000001"), frame(4, 0, ""), frame(8, 0, "00000001"))))
    assert got.asDict() == {"header_table_size": None, "enable_push": True, "max_concurrent_streams": None, "initial_window_size": 7, "max_frame_size": None, "max_header_list_size": None}
    rows = [(6, "0605"), (44, "06"), (0, "3A01"), (0, "3AFF"), (0, "3A"), (60, "")]
    assert many(spark, rows, "n int, h string", tcp.ipv6_option_length(F.col("n"), F.unhex("h"))) == [0, 8, 16, 0, 0, 0]


def test_filters(spark):
    df = spark.createDataFrame([("10.1.2.3", "8.8.8.8", 1234, 443), ("192.168.1.1", "8.8.4.4", 443, 99), (None, None, None, None), ("2001:db8::5", "::1", 5, 80)], "src string, dst string, sport int, dport int")
    run = lambda c: [r.i for r in df.withColumn("i", F.monotonically_increasing_id() * 0 + F.coalesce("sport", F.lit(-1))).where(c.predicate(F.col("src"), F.col("dst"), F.col("sport"), F.col("dport"))).collect()]
    assert run(FilterConfig()) == [1234, 443, -1, 5]
    assert run(FilterConfig("allow", (PortFilter().destination(443),))) == [1234, -1]
    assert run(FilterConfig("allow", (PortFilter().source(443).any_port(),))) == [1234, 443, -1]
    assert run(FilterConfig("allow", (PortFilter().destination_range(80, 99),))) == [-1, 5]
    assert run(FilterConfig("deny", (SubnetFilter().allow("10.0.0.0/8", "2001:db8::/32"),))) == [443, -1]
    assert run(FilterConfig("allow", (IpFilter().allow("8.8.4.4").source_only(),))) == [-1]
    assert run(FilterConfig("allow", (PortFilter().any_port(),))) == [-1]

"""HTTP/2 completeness and frame sizes, early rejection of flows, analyses stopped one by one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from netglean.functions import http
from netglean.operators import flows, wire
from netglean.plans import jobs
from tests.test_engine import hello, segment


def frame(kind, stream, payload):
    return len(payload).to_bytes(3, "big") + bytes([kind, 0]) + stream.to_bytes(4, "big") + payload


def test_http2_completeness(spark):
    settings, headers = frame(4, 0, b"123456"), frame(1, 1, b"\x82")
    cases = {settings: False, headers: True, settings + headers: True, wire.PREFACE + settings + headers: True, wire.PREFACE + settings + headers[:-1]: False, frame(1, 0, b"x"): False, frame(0, 3, bytes(20_000)) + headers: True, wire.PREFACE: False, b"": False, headers[:8]: False, settings[:-1] + headers: True}
    cases[settings[:-1] + headers] = wire.http2_complete(settings[:-1] + headers)  # the headers' first byte ends the settings; what follows is cut
    df = spark.createDataFrame([(bytearray(k), v) for k, v in cases.items()] + [(None, None)], "data binary, want boolean")
    got = df.select("want", wire.parse_http2_complete(F.col("data")).alias("got")).collect()
    assert all(r.want == r.got for r in got) and cases[settings[:-1] + headers] is False
    sizes = spark.createDataFrame([(bytearray(settings + headers),)], "data binary").select(F.transform(wire.parse_frames(F.col("data")), wire.frame_size)).first()[0]
    assert sizes == [len(settings), len(headers)]


def test_early_rejection_loses_no_message(monkeypatch):
    """Every message is found as without the rejection; bytes of other protocols are never put together."""
    rng = random.Random(1)
    starts = [f"{m} / HTTP/1.1\r\nHost: h\r\nX: {'y' * 20}\r\n\r\n".encode() for m in http.METHODS] + [b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n", b"HTTP/1.0 404 N\r\n\r\n", wire.PREFACE + frame(4, 0, b"") + frame(1, 1, b"\x82\x84"), frame(4, 0, b"") + frame(1, 1, b"\x88"), b"\x16\x03\x01\x02\x00" + bytes(90), b"SSH-2.0-x\r\n", b"xGET / HTTP/1.1\r\n\r\n"]
    found = []
    for data in starts * 6:
        cuts = sorted(rng.sample(range(1, len(data)), min(3, len(data) - 1)))
        parts = [(a, data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rng.shuffle(parts)
        for side in (0, 1):
            results = []
            for check in (flows._may_begin, lambda side, parts: True):
                monkeypatch.setattr(flows, "_may_begin", check)
                flow = flows.HttpFlow(0, True)
                results.append([flow.add(side == 0, 24, seq, p) for seq, p in parts])
            monkeypatch.undo()
            assert results[0] == results[1]
            found.append(any(results[0]))
    assert 0.3 < sum(found) / len(found) < 0.9
    assert not flows._may_begin(0, [(0, b"\x16\x03\x01")]) and not flows._may_begin(1, [(0, b"SSH-"), (4, b"2.0-x")])


def test_faults_of_packets(spark):
    h = hello()
    bad = h[:43] + b"\x40" + h[44:]  # a session id that is too long
    made = [(0, segment("10.0.0.1", "10.0.0.2", 1111, 443, 1, 24, h)), (1, segment("10.0.0.1", "10.0.0.2", 1112, 443, 1, 24, bad[:30])), (2, segment("10.0.0.1", "10.0.0.2", 1112, 443, 31, 24, bad[30:])), (3, b"\0" * 60), (4, segment("10.0.0.1", "10.0.0.2", 1, 2, 1, 2, options=b"\x02\x09\x05\xb4")), (5, segment("10.0.0.1", "10.0.0.2", 1, 2, 1, 3))]
    df = spark.createDataFrame([("c", i, None, len(d), bytearray(d)) for i, d in made], "capture string, packet_no long, ts timestamp, orig_len int, data binary")
    assert sorted((r.packet_no, r.reason) for r in flows.faults(df).collect()) == [(2, "hello"), (3, "link"), (4, "options"), (5, "flags")]


def test_one_of_two_analyses_is_stopped(spark):
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    long = jobs.Running(spark, lambda: spark.range(0, 10_000, 1, 2).select(slow("id").alias("x")).agg(F.sum("x")).first()[0])
    short = jobs.Running(spark, lambda: spark.range(0, 20, 1, 2).select(slow("id").alias("x")).agg(F.sum("x")).first()[0])
    time.sleep(1)
    long.stop()
    with pytest.raises(jobs.Stopped):
        long.result(5)
    assert short.result(60) == 190
    broken = jobs.Running(spark, lambda: spark.sql("SELECT nothing").first())
    with pytest.raises(Exception, match="nothing"):
        broken.result(30)

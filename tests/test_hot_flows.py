"""Flows that are cut into stretches against the same flows in one task."""

import random

import pytest
from pyspark.sql import functions as F

from netglean.operators import flows
from netglean.plans import analyze
from tests.test_engine import OPTIONS, REQUEST, hello, segment

ANSWER = b"HTTP/1.1 200 OK\r\nServer: nginx/\r\n\r\n"


def packets(seed, n, pace):
    """One busy flow and some others: connections that open, go on and close, messages and hellos in pieces, clocks that go on, stop and jump."""
    rng = random.Random(seed)
    out, t, client, server, h = [], 1_000_000, ("10.0.0.1", 1111), ("10.0.0.2", 80), hello()
    queue = []
    for no in range(n):
        t += rng.randrange(pace)
        if rng.random() < 0.01:
            t += rng.choice([19_000, 31_000, 61_000])
        if not queue:
            kind = rng.random()
            if kind < 0.2:
                queue = [(0, 2, b"")] + rng.sample([(0, 24, REQUEST[:20]), (0, 24, REQUEST[20:])], 2) + [(1, 24, ANSWER[:9]), (1, 24, ANSWER[9:])] + [(0, 17, b"")] * (rng.random() < 0.5)
            elif kind < 0.3:
                at = rng.randrange(1, len(h))
                queue = [(rng.randrange(2), 24, h[:at]), (0, 24, h[at:]), (1, 24, h[at:])][: rng.randrange(1, 4)]
            else:
                queue = [(rng.randrange(2), 16, rng.choice([b"", b"data"]))] * rng.randrange(1, 9)
        side, flags, payload = queue.pop(0)
        a, b = (client, server) if side == 0 else (server, client)
        if rng.random() < 0.1:
            a, b = (f"10.0.1.{rng.randrange(3)}", 999), server
        stamp = t // 10 * (1 if rng.random() < 0.98 else 3)
        options = b"\x01\x01\x08\x0a" + (stamp % 2**32).to_bytes(4, "big") + bytes(4) if rng.random() < 0.7 else OPTIONS if flags == 2 else b""
        out.append(("c", no, t * 1000, len(payload) + 60, bytearray(segment(a[0], b[0], a[1], b[1], no * 7 % 1000, flags, payload, options))))
    return out


@pytest.mark.parametrize("seed, n, pace, hot", [(1, 1500, 400, 250), (2, 1200, 20, 250), (3, 200, 3000, 1000)])
def test_stretches_equal_one_task(spark, seed, n, pace, hot):
    df = spark.createDataFrame(packets(seed, n, pace), "capture string, packet_no long, us long, orig_len int, data binary").withColumn("ts", F.timestamp_micros("us")).drop("us")
    plain = analyze.analyze(df)
    cut = analyze.analyze(df, analyze.AnalysisConfig(hot_packets=hot))
    assert cut.columns == plain.columns
    rows = lambda x: sorted(map(str, x.collect()))
    want, got = rows(plain), rows(cut)
    assert len(want) > n / 20 and got == want
    told = plain.select(*(F.count(c).alias(c) for c in plain.columns)).first()
    assert n < 1000 or all(told[c] for c in ("http_request", "http_response", "tls", "client_uptime", "server_uptime"))


def test_stretches_of_a_flow_are_several(spark):
    df = spark.createDataFrame([(f"f{i % 7 == 0}", i) for i in range(7000)], "flow string, packet_no long")
    got = {(r["flow"], r["stretch"]): r["count"] for r in flows._stretches(df, 1500).groupBy("flow", "stretch").count().collect()}
    assert got[("fTrue", 0)] == 1000 and len(got) == 5 and max(got.values()) < 1800

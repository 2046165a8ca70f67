"""Streams that begin with a batch's state, and states that are bounded by count."""

import random

import pytest
from pyspark.sql import functions as F

from netglean.functions import uptime
from netglean.operators import decode, flows
from netglean.sources import pcap
from netglean.streaming import processors
from tests.test_engine import REQUEST, hello, segment

ANSWER = b"HTTP/1.1 200 OK\r\nServer: nginx/\r\n\r\n"


def stamped(t):
    return b"\x01\x01\x08\x0a" + int(t * 100).to_bytes(4, "big") + bytes(4)


def mixed(seed, n):
    """(time, packet) of n clients whose request, answer, hello and timestamps are spread over seconds."""
    rng, h, out = random.Random(seed), hello(), []
    for i in range(n):
        c, port, t = f"10.0.{i % 3}.1", 1000 + i, 1 + rng.random() * 5
        a, b = rng.randrange(1, len(REQUEST)), rng.randrange(6, len(h))
        steps = [(c, "10.9.0.1", port, 80, 1, 2, b""), (c, "10.9.0.1", port, 80, 2, 24, REQUEST[:a]), (c, "10.9.0.1", port, 80, 2 + a, 24, REQUEST[a:]), ("10.9.0.1", c, 80, port, 1, 24, ANSWER), (c, "10.9.0.2", port, 443, 1, 24, h[:b]), (c, "10.9.0.2", port, 443, 1 + b, 24, h[b:])]
        for step in steps:
            out.append((t, segment(*step, stamped(t))))
            t += rng.random() * 2
    return sorted(out, key=lambda p: p[0])


def run(spark, df, where):
    q = df.writeStream.format("json").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start(f"{where}/out")
    q.awaitTermination(200)
    return spark.read.schema(df.schema).json(f"{where}/out")


@pytest.mark.parametrize("most", [None, 10_000])
def test_batch_then_stream_equals_one_batch(spark, tmp_path, most):
    made = mixed(7, 12)
    cut = next(i for i, p in enumerate(made) if p[0] > 5)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "x.pcap").write_bytes(pcap.write_pcap(made[cut:]))
    batch = lambda rows, first: decode.decode(spark.createDataFrame([("f", first + i, t, bytearray(d)) for i, (t, d) in enumerate(rows)], "capture string, packet_no long, t double, data binary").withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long"))))
    pcap.register(spark)
    stream = decode.decode(spark.readStream.format("pcap").load(str(folder)).withColumn("capture", F.lit("f")).withColumn("packet_no", F.col("packet_no") + cut))
    early, whole = batch(made[:cut], 0), batch(made, 0)
    kinds = {
        "http": (processors.http_stream(stream, processors.after_http(early), most), flows.http_messages, "packet_no, side, text"),
        "tls": (processors.tls_stream(stream, processors.after_tls(early), most), flows.tls_hellos, "packet_no, hello.sni"),
        "uptime": (processors.uptime_stream(decode.observe(stream), processors.after_uptimes(decode.observe(early)), most), lambda s: flows.uptimes(decode.observe(s)), "packet_no, role, hz, minutes"),
    }
    for name, (out, one, columns) in kinds.items():
        rows = lambda df: sorted(tuple(r) for r in df.selectExpr(*columns.split(", ")).collect())  # noqa: B023, E731
        want, before = rows(one(whole)), rows(one(early))
        got = rows(run(spark, out, tmp_path / name))
        assert before + got and sorted(before + got) == want, name
        alone = rows(one(batch(made[cut:], cut)))
        assert len(got) > len(alone), name  # what began in the batch went on in the stream


class Handle:
    """Keeps timers and a map of states, as the engine does."""

    def __init__(self):
        self.map, self.timers = {}, []

    def getMapState(self, *_):
        return self

    def registerTimer(self, t):
        self.timers.append(t)

    def iterator(self):
        return iter(list(self.map.items()))

    def getValue(self, k):
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]


class Packet(dict):
    __getattr__ = dict.__getitem__


class Expired:
    def __init__(self, t):
        self.t = t

    def getExpiryTimeInMs(self):
        return self.t


def plainly(packets, most):
    """Anchors of most keys at most, in order of packets, and what they tell."""
    open_, told = {}, []
    for r in packets:
        open_[r.entry], hz = uptime.step(open_.get(r.entry), r.t_ms, r.tsval)
        if hz is not None:
            told.append((r.packet_no, hz))
        if len(open_) > most:
            del open_[min(open_, key=lambda k: (open_[k].since, k))]
    return {(k,): tuple(v) for k, v in open_.items()}, told


@pytest.mark.parametrize("seed", range(4))
def test_the_latest_are_kept(seed):
    """Batches of packets in any order leave the same states, and tell the same, as one packet after another."""
    rng = random.Random(seed)
    handle, p, packets, got = Handle(), processors.Bounded(processors.Uptimes, 5), [], []
    p.init(handle)
    t = 0
    for _ in range(12):
        rows = []
        for _ in range(rng.randrange(1, 25)):
            t += rng.choice((rng.randrange(1, 400), 0, 31_000 * (rng.random() < 0.05)))
            rows.append(Packet(entry=f"k{rng.randrange(12)}", capture="c", packet_no=len(packets) + len(rows), role="client", t_ms=t, tsval=t // 10))
        packets += rows
        got += [(r.packet_no, r.raw_hz) for r in p.handleInputRows(("b",), rng.sample(rows, len(rows)), None)]
        assert (handle.map, got) == plainly(packets, 5)
    assert len(got) > 5 and len(handle.map) == 5
    ends = sorted(v[0] + uptime.LIFETIME_MS for v in handle.map.values())
    assert set(ends) <= set(handle.timers)
    list(p.handleExpiredTimer(("b",), None, Expired(ends[2])))
    assert sorted(v[0] + uptime.LIFETIME_MS for v in handle.map.values()) == [e for e in ends if e > ends[2]]


def test_keys_that_begin_once_keep_the_latest():
    handle = Handle()
    p = processors.Bounded(processors.Uptimes, 7)
    p.init(handle)
    rows = [Packet(entry=f"k{i}", capture="c", packet_no=i, role="client", t_ms=i * 10, tsval=i) for i in range(100)]
    for a in range(0, 100, 9):
        list(p.handleInputRows(("b",), rows[a : a + 9], None))
        assert sorted(k[0] for k in handle.map) == sorted(f"k{i}" for i in range(max(0, min(a + 9, 100) - 7), min(a + 9, 100)))
    p.handleInitialState(("b",), {"entry": "old", "since": 1, "ref_ms": 1, "ref": 1, "bad": False}, None)
    assert ("old",) not in handle.map and len(handle.map) == 7

"""Captures read in blocks against one reader, with record headers inside payloads, cut and damaged files, and both byte orders."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from netglean.sources import capture, pcap


@pytest.fixture
def blocks(spark):
    """Sets the size of blocks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def set_(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield set_
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def written(packets, order="<", unit=1, zone=0):
    magic = next(m for m, k in pcap.MAGIC.items() if k == (order, unit))
    out = magic + struct.pack(f"{order}HHiIII", 2, 4, zone, 0, 65535, 1)
    return out + b"".join(struct.pack(f"{order}IIII", s, f, len(d), max(len(d), n)) + d for s, f, n, d in packets)


def made(rng, n, size=400):
    t, out = 1_700_000_000, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 5])
        kind = rng.random()
        if kind < 0.3:  # a capture inside a payload, ending with it or not
            inner = written([(t + j, j, 0, rng.randbytes(rng.randrange(60))) for j in range(rng.randrange(1, 60))])
            data = rng.choice([inner, inner[24:], inner[24:] + b"x", b"\n" + inner])
        elif kind < 0.4:
            data = rng.choice([b"", b"\n", b"\n" * 300, bytes(700), b"\r\n" * 50])
        else:
            data = rng.randbytes(rng.randrange(size))
        out.append((t, rng.randrange(1_000_000), rng.choice([0, 3000]), data))
    return out


def one_task(data):
    return [(no, ts.timestamp(), orig, raw) for no, ts, orig, raw in pcap.packets(data)]


def got(spark, path):
    rows = pcap.read_pcap(spark, str(path)).select("packet_no", (F.unix_micros("ts") / 1e6).alias("t"), "orig_len", "data").orderBy("packet_no").collect()
    return [(r[0], r[1], r[2], bytes(r[3])) for r in rows]


@pytest.mark.parametrize("size", [300, 20_000])
@pytest.mark.parametrize("order, unit", [("<", 1), (">", 1000)])
def test_blocks_equal_one_task(spark, blocks, tmp_path, size, order, unit):
    rng = random.Random(size)
    packets = [(s, f * unit, n, d) for s, f, n, d in made(rng, 8 if size < 1000 else 300)]
    (tmp_path / "a.pcap").write_bytes(data := written(packets, order, unit))
    blocks(size)
    assert got(spark, tmp_path / "a.pcap") == one_task(data)


def test_folder_damage_and_other_formats(spark, blocks, tmp_path):
    rng = random.Random(5)
    whole = written(made(rng, 150))
    bad = written(made(rng, 40)) + struct.pack("<IIII", 1, 1, pcap.MOST_PACKET + 1, 5) + written(made(rng, 40))[24:]
    files = {"a": whole[:-7], "c": bad, "d": b"no capture at all\n" * 500, "e": b"", "f": whole[:24], "g": whole + b"\n", "h": whole[:10]}
    for name, data in files.items():
        (tmp_path / f"{name}.pcap").write_bytes(data)
    blocks(30_000)
    del files["e"]  # Spark lists no empty files, so they have no number
    want = [(pcap.FILE * i + no, *rest) for i, (_, data) in enumerate(sorted(files.items())) for no, *rest in one_task(data)]
    assert got(spark, tmp_path) == want


def test_a_planted_chain_is_found_out(spark, blocks, tmp_path):
    """Each block begins inside a long payload full of record headers, whose chain merges with the true one or doesn't."""
    inner = written([(1_700_000_000 + j, j, 0, bytes([j % 256]) * 30) for j in range(400)])[24:]
    data = written([(1_700_000_000 + i, 0, 0, inner + b"z" * (i % 3)) for i in range(20)])
    (tmp_path / "p.pcap").write_bytes(data)
    blocks(25_000)
    assert got(spark, tmp_path / "p.pcap") == one_task(data)
    _, rows = capture.index(spark, str(tmp_path / "p.pcap"), {})
    assert len(rows) > 9 and capture.follow(rows)[1]  # blocks were wrong at first


def test_resync():
    rng = random.Random(1)
    packets = made(rng, 60)
    data = written(packets)[24:]
    assert capture.resync(data) == (0, "<")
    assert capture.resync(bytes(5000)) is None and capture.resync(b"") is None

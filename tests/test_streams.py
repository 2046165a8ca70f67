"""Limits and offsets of capture streams, sinks that commit, counters of running streams."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from netglean.functions.filters import FilterConfig, PortFilter
from netglean.plans import analyze, metrics
from netglean.sources import lines, pcap
from netglean.streaming import results
from tests.test_engine import REQUEST, capture, segment


@pytest.mark.parametrize("restarts", [False, True])
def test_ten_thousand_files_under_a_limit(tmp_path, restarts):
    folder = tmp_path / "in"
    folder.mkdir()
    make = lambda a, b: [(folder / f"{(i * 7919) % 100_000:06d}.pcap").touch() for i in range(a, b)]
    make(0, 9000)
    position = str(tmp_path / "position")
    reader = pcap._StreamReader(str(folder), 700, position)
    start, seen, numbers = reader.initialOffset(), [], []
    for step in range(30):
        if step == 5:
            make(9000, 10_000)  # names below those that were read
        if restarts and step % 4 == 3:
            reader = pcap._StreamReader(str(folder), 700, position)
        end = json.loads(json.dumps(reader.latestOffset()))
        if end == start:
            break
        got = [p.value for p in reader.partitions(start, end)]
        assert got == [p.value for p in pcap._StreamReader(str(folder)).partitions(start, end)]  # a batch that is planned again is the same
        assert len(got) <= 700 and len(json.dumps(end)) < 200
        seen += [g[0] for g in got]
        numbers += [g[2] for g in got]
        start = end
    assert len(seen) == len(set(seen)) == 10_000 and numbers == list(range(10_000))


def test_limit_of_a_running_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(7):
        (folder / f"{i}.pcap").write_bytes(pcap.write_pcap([(float(i), segment("10.0.0.1", "10.0.0.2", 1000 + i, 80, 1, 2))]))
    pcap.register(spark)
    df = spark.readStream.format("pcap").option("maxFilesPerTrigger", "3").option("position", str(tmp_path / "p")).load(str(folder))
    q = df.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    sizes = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    q.stop()
    assert sizes == [3, 3, 1] and spark.table("limited").select("packet_no").distinct().count() == 7


def test_commits(tmp_path):
    f = lines.Folder(str(tmp_path))
    f.commit("1", [f.stage(iter([("a",), ("b",)])), f.stage(iter([])), None])
    assert [open(x).read() for x in f.files()] == ["a\nb\n"]
    f.commit("1", [f.stage(iter([("a",)]))])  # again
    assert len(f.files()) == 1 and os.listdir(f.staged) == []
    (tmp_path / "part-2-00000.txt").write_text("half")  # a commit that was cut off before its list
    assert len(f.files()) == 1
    f.commit("2", [f.stage(iter([("c",)]))])
    assert [open(x).read() for x in f.files()] == ["a\nb\n", "c\n"]
    f.abort([f.stage(iter([("d",)]))])
    assert os.listdir(f.staged) == []


def test_a_batch_that_comes_again_is_written_once(spark, tmp_path):
    """The stream ends between the sink's commit and its own: the batch's entry in the commit log is missing when it starts again."""
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    folder.mkdir()
    pcap.register(spark)
    lines.register(spark)
    for i in range(3):
        (tmp_path / "x").write_bytes(capture())
        (tmp_path / "x").rename(folder / f"{i}.pcap")
        for again in (False, True):
            if again:
                last = max((p for p in (state / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
                last.unlink()
                (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
            q = results.ndjson(spark.readStream.format("pcap").load(str(folder)), analyze.AnalysisConfig(http=False, tls=False)).writeStream.format("lines").option("path", out).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
            q.awaitTermination(120)
            q.stop()
    got = [json.loads(r.value) for r in lines.committed(spark, out).collect()]
    syns = [(x["packet_no"] // pcap.FILE, x["packet_no"] % pcap.FILE) for x in got if "syn" in x or "syn_ack" in x]
    assert sorted(syns) == [(i, j) for i in range(3) for j in range(6)]


def test_batch_writer(spark, tmp_path):
    lines.register(spark)
    out = str(tmp_path / "out")
    frame = lambda a, b: spark.range(a, b, 1, 3).select(F.col("id").cast("string").alias("value"))
    read = lambda: sorted(int(r.value) for r in lines.committed(spark, out).collect())
    frame(0, 10).write.format("lines").mode("append").save(out)
    frame(10, 15).write.format("lines").mode("append").save(out)
    assert read() == list(range(15))
    with pytest.raises(Exception):
        spark.range(4).select(F.when(F.col("id") < 3, "x").otherwise(F.raise_error(F.lit("no"))).alias("value")).write.format("lines").mode("append").save(out)
    assert read() == list(range(15))
    frame(0, 3).write.format("lines").mode("overwrite").save(out)
    assert read() == [0, 1, 2]
    assert lines.committed(spark, str(tmp_path / "none")).count() == 0


def test_counters_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    pcap.register(spark)
    for i in range(3):
        made = [(10.0 * i + j / 10, segment("10.0.0.1", "10.0.0.2", 1111 + j % 3, 80 if j % 2 else 443, j, 2 if j % 5 == 0 else 24, REQUEST)) for j in range(20)] + [(10.0 * i + 5, b"\0" * 30)]
        (folder / f"{i}.pcap").write_bytes(pcap.write_pcap(made))
    filters = FilterConfig().with_filter(PortFilter().destination(80))
    counters = metrics.StreamCounters()
    spark.streams.addListener(counters)
    try:
        out = results.ndjson(spark.readStream.format("pcap").option("maxFilesPerTrigger", "1").option("position", str(tmp_path / "p")).load(str(folder)), analyze.AnalysisConfig(filters=filters))
        q = out.writeStream.format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(counters)
    got = counters.of(q)
    want = metrics.capture_stats(pcap.read_pcap(spark, str(folder)), filters).agg(*(F.sum(c).alias(c) for c in ("packets", "bytes", "kept", "tcp"))).first()
    assert (got["packets"], got["bytes"], got["kept"], got["decoded"]) == (want["packets"], want["bytes"], want["kept"], want["tcp"])
    assert got["matched"] == spark.table("counted").count() and got["late"] == 0
    shutil.rmtree(tmp_path / "c")

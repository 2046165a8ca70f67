"""python -m netglean pcap FILE ... | stream FOLDER: fingerprints of captures, as JSON lines or text."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from netglean.functions.filters import FilterConfig, IpFilter, PortFilter
from netglean.plans import analyze, jobs, sinks
from netglean.sources import lines, pcap, signatures
from netglean.streaming import processors, results


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="netglean", description=__doc__)
    p.add_argument("mode", choices=["pcap", "stream"])
    p.add_argument("path", nargs="+")
    p.add_argument("-p", "--port", type=int, action="append", default=[], help="only packets of these ports")
    p.add_argument("-I", "--ip", action="append", default=[], help="only packets of these addresses")
    p.add_argument("--protocol", choices=["all", "tcp", "http", "tls"], default="all")
    p.add_argument("--format", choices=["json", "text"], default="json")
    p.add_argument("--signatures", default=None)
    p.add_argument("--output", default=None, help="a folder for results, else they are printed")
    p.add_argument("--checkpoint", default=None, help="stream: a folder that all machines share, where state and offsets are kept, so that a stopped stream goes on")
    p.add_argument("--once", action="store_true", help="stream: end when the files that are there have been read")
    p.add_argument("--most-files", type=int, default=None, help="stream: files of a batch at most")
    p.add_argument("--workers", type=int, default=None, help="local tasks at once, where no cluster is given")
    p.add_argument("--hot-packets", type=int, default=None, help="pcap: flows of more packets than this are dealt to several tasks")
    p.add_argument("--most-connections", type=int, default=None, help="stream: open connections that are kept at most")
    a = p.parse_args(argv)
    builder = SparkSession.builder.appName("netglean")
    if a.workers:
        builder = builder.master(f"local[{a.workers}]")
    spark = builder.config("spark.sql.streaming.stateStore.providerClass", processors.STORE).getOrCreate()
    filters = FilterConfig()
    if a.port:
        filters = filters.with_filter(PortFilter().source(*a.port).any_port())
    if a.ip:
        filters = filters.with_filter(IpFilter().allow(*a.ip))
    on = {x: a.protocol in ("all", x) for x in ("tcp", "http", "tls")}
    config = analyze.AnalysisConfig(**on, filters=filters, hot_packets=a.hot_packets, most_connections=a.most_connections)
    sigs = signatures.load(a.signatures or signatures.DEFAULT)
    show = sinks.to_ndjson if a.format == "json" else sinks.to_text

    def emit(out) -> None:
        if a.output:
            out.write.mode("append").text(a.output)
        else:
            for row in out.toLocalIterator():
                print(row.value)

    if a.mode == "pcap":
        for path in a.path:
            emit(show(analyze.analyze(pcap.read_pcap(spark, path), config, sigs)))
        return
    pcap.register(spark)
    reader = spark.readStream.format("pcap")
    if a.most_files:
        if not a.checkpoint:
            p.error("--most-files needs --checkpoint")
        reader = reader.option("maxFilesPerTrigger", str(a.most_files)).option("position", f"{a.checkpoint.removeprefix('file://').rstrip('/')}.position")
    packets = reader.load(a.path[0])
    out = (results.ndjson if a.format == "json" else results.text)(packets, config, sigs)
    writer = out.writeStream.outputMode("append")
    if a.output:  # a batch that is repeated after a failure is written once
        lines.register(spark)
        writer = writer.format("lines").option("path", a.output)
    else:
        writer = writer.foreachBatch(lambda df, _: emit(df))
    if a.checkpoint:
        writer = writer.option("checkpointLocation", a.checkpoint)
    query = (writer.trigger(availableNow=True) if a.once else writer).start()
    try:
        query.awaitTermination()
    except KeyboardInterrupt:
        jobs.drain(query)


if __name__ == "__main__":
    main()

"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query is run once to warm the JVM and REPEAT times for the figure, the median; results are counted by
the noop sink, which computes every column. packets_per_s has the packets a second: one for each row of events (lineitem in tcp_bulk_match), PACKETS of them where a flow is made of each.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from netglean.plans import queries

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))
HEADLINE = ("tcp_bulk_match", "tcp_os_match", "tcp_signature_text", "window_classify", "mtu_link", "uptime_anchor_fold", "http_header_order", "http_browser_match", "flow_reassembly", "ja4_sorted", "akamai_fingerprint", "tls_client_hello", "packet_decode")

PACKETS = {"flow_reassembly": 5}


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    events, lines = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("events", "lineitem"))
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEAT + 1):
            began = time.time()
            queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    rates = {n: round((lines if n == "tcp_bulk_match" else events) * PACKETS.get(n, 1) / s) for n, s in seconds.items()}
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "packets_per_s": rates, "sf": os.path.basename(SF.rstrip("/")), "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()

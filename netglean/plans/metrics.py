"""Counts of what an analysis meets, in place of a worker pool's statistics."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from netglean.functions.filters import FilterConfig
from netglean.operators import decode


def observed(packets: DataFrame, name: str = "packets") -> tuple[DataFrame, Observation]:
    """packets, and an observation that after the first action on them has packets, bytes and cut (captured only in part)."""
    seen = Observation(name)
    return packets.observe(seen, F.count("*").alias("packets"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.count_if(F.octet_length("data") < F.col("orig_len")).alias("cut")), seen


def capture_stats(packets: DataFrame, filters: FilterConfig | None = None) -> DataFrame:
    """By capture and link type (null: unknown): packets, bytes, those that the filters keep, and valid TCP segments among them. One pass, then one small shuffle."""
    df = packets.select("capture", "packet_no", "ts", "data", decode.datalink_format(F.col("data")).alias("link"))
    ends = decode.endpoints(df)
    keep = filters.predicate(F.col("src"), F.col("dst"), F.col("sport"), F.col("dport")) if filters and filters.filters else F.lit(True)
    tcp = F.col("sport").isNotNull()
    return ends.groupBy("capture", "link").agg(F.count("*").alias("packets"), F.sum(F.octet_length("data")).alias("bytes"), F.count_if(keep).alias("kept"), F.count_if(keep & tcp).alias("tcp"))


#: Names under which a stream's plan tells what it counts.
PACKETS, SEGMENTS, RESULTS = "netglean_packets", "netglean_segments", "netglean_results"


def count_packets(packets: DataFrame, filters: FilterConfig | None = None) -> DataFrame:
    """A stream's packets that the filters keep; packets, bytes and kept are counted as they pass."""
    if not filters or not filters.filters:
        return packets.observe(PACKETS, F.count("*").alias("packets"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.count("*").alias("kept"))
    keep = filters.predicate(F.col("src"), F.col("dst"), F.col("sport"), F.col("dport"))
    df = decode.endpoints(packets).withColumn("_keep", keep)
    return df.observe(PACKETS, F.count("*").alias("packets"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.count_if("_keep").alias("kept")).where("_keep").select(*packets.columns)


def count_rows(df: DataFrame, name: str, column: str) -> DataFrame:
    return df.observe(name, F.count("*").alias(column))


class StreamCounters(StreamingQueryListener):
    """Adds up, for each query (by its id), what the plans of count_packets() and count_rows() tell with every batch, and the rows that came too late for their state (late).

    Register with spark.streams.addListener(); of a batch that is repeated after a failure only the progress that was told counts.
    """

    def __init__(self):
        self.totals: dict[str, Counter] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            own = self.totals.setdefault(str(p.id), Counter())
            for row in p.observedMetrics.values():
                own.update({k: int(v) for k, v in row.asDict().items() if v is not None})
            own["late"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            own["batches"] += 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def of(self, query) -> dict[str, int]:
        """Totals of a running or ended query."""
        with self._lock:
            return dict(self.totals.get(str(query.id), {}))

"""Whole analyses over streams: the same results as analyze(), a row for each result as it comes, of one packet several. metrics.StreamCounters adds up what is counted on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from netglean.operators import decode
from netglean.plans import analyze, metrics, sinks
from netglean.plans.analyze import AnalysisConfig
from netglean.sources import signatures
from netglean.sources.signatures import Signatures
from netglean.streaming import processors


def ndjson(packets: DataFrame, config: AnalysisConfig | None = None, sigs: Signatures | None = None) -> DataFrame:
    """value: JSON objects of a stream's results. Connections, hellos and uptimes go on from one batch to the next, by the state of processors."""
    return _results(packets, config, sigs, sinks.to_ndjson)


def text(packets: DataFrame, config: AnalysisConfig | None = None, sigs: Signatures | None = None) -> DataFrame:
    """value: blocks of text of a stream's results."""
    return _results(packets, config, sigs, sinks.to_text)


def _results(packets: DataFrame, config: AnalysisConfig | None, sigs: Signatures | None, show) -> DataFrame:
    config = config or AnalysisConfig()
    sigs = (sigs or signatures.load()) if config.matcher else None
    segments = decode.decode(decode.apply_filter(packets, config.filters))
    # every branch decodes the packets; they are counted in the first
    first = metrics.count_rows(decode.decode(metrics.count_packets(packets, config.filters)), metrics.SEGMENTS, "decoded")
    parts: list[DataFrame] = []
    if config.tcp:
        observed = decode.observe(segments, config.standard_mtu)
        counted = decode.observe(first, config.standard_mtu)
        parts += [analyze.tcp_results(counted, sigs, config.tcp_matcher), analyze.uptime_rows(processors.uptime_stream(observed, most=config.most_connections))]
    if config.http:
        parts.append(analyze.http_rows(processors.http_stream(segments if parts else first, most=config.most_connections), sigs, config.corrected_software, config.http_matcher))
    if config.tls:
        parts.append(analyze.tls_rows(processors.tls_stream(segments if parts else first, most=config.most_connections)))
    return metrics.count_rows(reduce(DataFrame.union, [show(p.where(analyze.not_empty(p))) for p in parts]), metrics.RESULTS, "matched")

"""Whole analyses: packets in, one wide row of results for each packet out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netglean.functions import http, ja4, uptime
from netglean.functions.filters import FilterConfig
from netglean.operators import decode, flows, matching
from netglean.sources import signatures
from netglean.sources.signatures import Signatures


@dataclass(frozen=True)
class AnalysisConfig:
    """Which protocols are analysed, and whether observations are matched; signatures are needed for that."""

    tcp: bool = True
    http: bool = True
    tls: bool = True
    matcher: bool = True
    filters: FilterConfig = field(default_factory=FilterConfig)
    reassemble_tls: bool = True
    #: Matchers in place of the signature files': each adds to observations kind, class, name, flavor, signature, dist and score.
    tcp_matcher: Callable[[DataFrame], DataFrame] | None = None
    http_matcher: Callable[[DataFrame], DataFrame] | None = None
    standard_mtu: bool = False
    corrected_software: bool = False
    #: Flows of more packets than this are dealt to several tasks, at the cost of reading the packets twice more; None: a flow is one task.
    hot_packets: int | None = None
    #: Streams: open connections, hellos and anchors, each, that are kept at most; the oldest go. None: they go by time alone.
    most_connections: int | None = None

    def __post_init__(self):
        if not (self.tcp or self.http or self.tls):
            raise ValueError("no protocol is on")


def _label() -> list[Column]:
    """Names of the result for a signature's label."""
    return [F.col("name"), F.col("class").alias("family"), F.col("flavor").alias("variant"), F.when(F.col("kind") == "s", "specified").when(F.col("kind") == "g", "generic").alias("kind")]


def tcp_results(observed: DataFrame, sigs: Signatures | None, matcher: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """capture, packet_no, the columns keep, and the structs syn, syn_ack and mtu: every answer counts as syn_ack."""
    obs = observed
    if sigs is None:
        blank = {c: F.lit(None).cast("string") for c in ("kind", "class", "name", "flavor", "signature", "link")} | {"dist": F.lit(None).cast("int"), "score": F.lit(None).cast("double")}
        m = obs.withColumns(blank)
    else:
        m = matching.match_mtu(matcher(obs) if matcher else matching.match_tcp(obs, sigs), sigs)
    quality = matching.quality(sigs is not None, F.col("name"), F.col("score"))
    body = F.struct(F.struct("src", "sport").alias("source"), F.struct("dst", "dport").alias("destination"), F.when(F.col("name").isNotNull(), F.struct(*_label())).alias("os"), quality.alias("quality"), F.col("signature_text").alias("signature"), F.coalesce("ttl.dist", "ttl.ttl").alias("distance"))
    link = F.struct("mtu", F.col("link"), matching.quality(sigs is not None, F.col("link"), F.when(F.col("link").isNotNull(), F.lit(1.0))).alias("quality"))
    return m.select("capture", "packet_no", *keep, F.when(F.col("direction") == "request", body).alias("syn"), F.when(F.col("direction") == "response", body).alias("syn_ack"), F.when(F.col("mtu").isNotNull(), link).alias("mtu"))


def http_rows(messages: DataFrame, sigs: Signatures | None, corrected: bool = False, matcher: Callable[[DataFrame], DataFrame] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """http_request and http_response of messages, with a row for each; with keep also for rows without a message."""
    obs = flows.http_observations(messages, keep)
    if sigs is None:
        m = obs.withColumns({c: F.lit(None).cast("string") for c in ("kind", "class", "name", "flavor", "signature")} | {"score": F.lit(None).cast("double")})
        family = F.lit(None).cast("string")
    else:
        m, family = matcher(obs) if matcher else matching.match_http(obs, sigs, corrected), matching.ua_family(F.col("user_agent"), sigs)
    quality = matching.quality(sigs is not None, F.col("name"), F.col("score"))
    text = http.signature_text(F.col("version"), F.col("horder"), F.transform("habsent", lambda x: x["name"]), F.col("software"))
    label = F.when(F.col("name").isNotNull(), F.struct(*_label()))
    request = F.struct("method", "uri", "user_agent", "lang", http.diagnosis(F.col("user_agent"), family, F.col("name")).alias("diagnosis"), label.alias("browser"), quality.alias("quality"), text.alias("signature"), "cookies", "referer", "header_count")
    response = F.struct("status_code", F.lit("none").alias("diagnosis"), label.alias("web_server"), quality.alias("quality"), text.alias("signature"), "header_count")
    return m.select("capture", "packet_no", *keep, F.when(F.col("direction") == "request", request).alias("http_request"), F.when(F.col("direction") == "response", response).alias("http_response"))


def tls_rows(hellos: DataFrame) -> DataFrame:
    return hellos.select("capture", "packet_no", F.struct(*(v.alias(k) for k, v in ja4.fingerprints(F.col("hello")).items())).alias("tls"))


def _uptimes() -> list[Column]:
    told = F.struct("hz", "days", "hours", "minutes", "wrap_days")
    return [F.when((F.col("role") == side) & F.col("hz").isNotNull(), told).alias(f"{side}_uptime") for side in ("client", "server")]


def uptime_rows(told: DataFrame) -> DataFrame:
    """capture, packet_no and the structs client_uptime and server_uptime."""
    return told.select("capture", "packet_no", *_uptimes())


RESULTS = ("syn", "syn_ack", "mtu", "client_uptime", "server_uptime", "http_request", "http_response", "tls")


def not_empty(df: DataFrame) -> Column:
    return F.coalesce(*(F.when(F.col(c).isNotNull(), 1) for c in RESULTS if c in df.columns)).isNotNull()


def analyze(packets: DataFrame, config: AnalysisConfig | None = None, sigs: Signatures | None = None) -> DataFrame:
    """One row for each packet with any result. Packets are (capture, packet_no, ts, data); what a protocol that is off would give isn't computed."""
    config = config or AnalysisConfig()
    sigs = (sigs or signatures.load()) if config.matcher else None
    segments = decode.decode(decode.apply_filter(packets, config.filters))
    base = ("ts", "src", "sport", "dst", "dport", "flags", "seq", "raw", "role", "tsval")
    if config.tcp:
        observed = decode.observe(segments, config.standard_mtu, {"seq": "seq", "raw": "payload"})
        df = tcp_results(observed.withColumn("tsval", F.col("tcp_ts.val")), sigs, config.tcp_matcher, base)
    else:
        df = segments.withColumns({"raw": F.col("payload"), "role": F.lit(None).cast("string"), "tsval": F.lit(None).cast("long")}).select("capture", "packet_no", *base)
    # all that spans packets comes from one pass; each packet's results are columns of its row, so nothing is joined
    df = flows.told(df, config.http, config.tls, config.tcp, config.reassemble_tls, config.hot_packets)
    done = [c for c in ("syn", "syn_ack", "mtu") if config.tcp]
    if config.tcp:
        hz = uptime.rounded(F.col("raw_hz"))
        df = df.withColumn("hz", hz).withColumn("u", uptime.split(F.col("tsval"), F.col("hz"))).withColumns({x: F.col(f"u.{x}") for x in ("days", "hours", "minutes", "wrap_days")})
        df, done = df.select("*", *_uptimes()), [*done, "client_uptime", "server_uptime"]
    if config.tls:
        df, done = df.withColumn("tls", F.when(F.col("hello").isNotNull(), F.struct(*(v.alias(k) for k, v in ja4.fingerprints(F.col("hello")).items())))), [*done, "tls"]
    if config.http:
        text = F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string"))
        df, done = http_rows(df.withColumn("text", text), sigs, config.corrected_software, config.http_matcher, tuple(done)), [*done, "http_request", "http_response"]
    df = df.select("capture", "packet_no", *(c for c in RESULTS if c in done))
    # with TCP every segment is a syn or a syn_ack; asked as a condition, that would have the results made once more
    return df if config.tcp else df.where(not_empty(df))


def analyze_tcp(packets: DataFrame, sigs: Signatures | None = None, **options) -> DataFrame:
    return analyze(packets, AnalysisConfig(http=False, tls=False, **options), sigs)


def analyze_http(packets: DataFrame, sigs: Signatures | None = None, **options) -> DataFrame:
    return analyze(packets, AnalysisConfig(tcp=False, tls=False, **options), sigs)


def analyze_tls(packets: DataFrame, **options) -> DataFrame:
    return analyze(packets, AnalysisConfig(tcp=False, http=False, matcher=False, **options))

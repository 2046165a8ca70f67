"""Results as JSON lines or as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_ndjson(results: DataFrame) -> DataFrame:
    """One column, value: a JSON object for each row, nulls left out."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("value"))


def write_ndjson(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    to_ndjson(results).write.mode(mode).text(path)


def _block(title: str, ends: Column, lines: list[tuple[str, Column]]) -> Column:
    rows = [F.concat(F.lit(f"| {name:<12} = "), F.coalesce(value.cast("string"), F.lit("???"))) for name, value in lines]
    return F.concat_ws("\n", F.concat(F.lit(f".-[ {title} ]- "), ends), F.lit("|"), *rows, F.lit("`----"))


def to_text(results: DataFrame) -> DataFrame:
    """One column, value: a block for each result of each row."""
    at = F.concat_ws("#", "capture", F.col("packet_no").cast("string"))
    name = lambda c, os: F.concat_ws("/", F.col(f"{c}.{os}.name"), F.col(f"{c}.{os}.family"), F.col(f"{c}.{os}.variant"))
    ends = lambda c: F.format_string("%s/%d -> %s/%d", F.col(f"{c}.source.src"), F.col(f"{c}.source.sport"), F.col(f"{c}.destination.dst"), F.col(f"{c}.destination.dport"))
    blocks = []
    for c, title in (("syn", "syn"), ("syn_ack", "syn+ack")):
        if c in results.columns:
            blocks.append(F.when(F.col(c).isNotNull(), _block(title, ends(c), [("os", F.when(F.col(f"{c}.os").isNotNull(), name(c, "os"))), ("dist", F.col(f"{c}.distance")), ("params", F.coalesce(f"{c}.os.kind", F.lit("none"))), ("quality", F.col(f"{c}.quality.score")), ("raw_sig", F.col(f"{c}.signature"))])))
    if "mtu" in results.columns:
        blocks.append(F.when(F.col("mtu").isNotNull(), _block("mtu", at, [("link", F.col("mtu.link")), ("raw_mtu", F.col("mtu.mtu"))])))
    for c in ("client_uptime", "server_uptime"):
        if c in results.columns:
            blocks.append(F.when(F.col(c).isNotNull(), _block(c.replace("_", " "), at, [("uptime", F.format_string("%d days, %d hrs, %d min (modulo %d days)", *(F.col(f"{c}.{x}") for x in ("days", "hours", "minutes", "wrap_days")))), ("raw_freq", F.format_string("%d Hz", F.col(f"{c}.hz")))])))
    if "http_request" in results.columns:
        blocks.append(F.when(F.col("http_request").isNotNull(), _block("http request", at, [("browser", F.when(F.col("http_request.browser").isNotNull(), name("http_request", "browser"))), ("lang", F.col("http_request.lang")), ("params", F.col("http_request.diagnosis")), ("raw_sig", F.col("http_request.signature"))])))
        blocks.append(F.when(F.col("http_response").isNotNull(), _block("http response", at, [("server", F.when(F.col("http_response.web_server").isNotNull(), name("http_response", "web_server"))), ("raw_sig", F.col("http_response.signature"))])))
    if "tls" in results.columns:
        blocks.append(F.when(F.col("tls").isNotNull(), _block("tls client", at, [(k, F.col(f"tls.{k}")) for k in ("sni", "version", "alpn", "ja4", "ja4_r", "ja4_o", "ja4_s1")])))
    return results.select(F.explode(F.array_compact(F.array(*blocks))).alias("value"))

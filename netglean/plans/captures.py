"""Queries over captures as files and over many networks, tokens and kinds of rejected packets, and SQL that computes the same from the formulas."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netglean.functions import networks
from netglean.operators import decode, tries, wire
from netglean.plans import analyze, queries
from netglean.sources import pcap
from netglean.sources.shared import folder


def written(packets: DataFrame, path: str) -> None:
    """Packets (packet_no, ts, orig_len, data) as capture files in path, a file for each range of numbers. Each packet's last byte must be a line feed, as lines are what Spark writes."""
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = head
        for b in batches:
            out = []
            for us, orig, data in zip(b.column("us").to_pylist(), b.column("orig_len").to_pylist(), b.column("data").to_pylist()):
                out.append(first + struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(data), max(orig, len(data))) + data[:-1])
                first = b""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["line"])

    rows = packets.repartitionByRange("packet_no").sortWithinPartitions("packet_no").select(F.unix_micros("ts").alias("us"), "orig_len", "data")
    rows.mapInArrow(run, "line binary").select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def capture_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's packets written as capture files, which are read again in blocks and decoded."""
    path = f"{folder(spark)}/captures-{uuid.uuid4().hex}"
    made = queries.frames_of(queries._events(spark, sf_dir)).withColumn("data", F.concat("data", F.lit(b"\n")))
    written(made, path)
    back = pcap.read_pcap(spark, path)
    seg = decode.decode(back)
    return seg.select((F.col("seq") - 1).alias("e"), F.unix_millis("ts").alias("ms"), "src", "sport", F.octet_length("payload").alias("n_payload"))


CAPTURE_BLOCKS = """
SELECT event_id AS e, event_id * 10 AS ms, '10.' || (event_id % 200) || '.' || ((event_id // 200) % 256) || '.1' AS src, CAST(1024 + event_id % 60000 AS INT) AS sport, 0 AS n_payload
FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0"""


def packet_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why packets give no segment, counted with those that do: every packet of the table counts once."""
    made = queries.frames_of(queries._events(spark, sf_dir))
    cut = F.expr("CASE WHEN packet_no % 23 = 0 THEN substring(data, 1, 10) WHEN packet_no % 29 = 0 THEN substring(data, 1, 30) ELSE data END")
    flags = F.expr("CASE WHEN packet_no % 31 = 0 THEN overlay(data PLACING X'03' FROM 34 + CASE packet_no % 3 WHEN 0 THEN 14 WHEN 1 THEN 0 ELSE 4 END FOR 1) ELSE data END")
    judged = decode.judge(made.withColumn("data", flags).withColumn("data", cut))
    return judged.groupBy(F.coalesce("reason", F.lit("segment")).alias("reason")).agg(F.count("*").alias("n"), F.sum("packet_no").alias("numbers"))


PACKET_REJECTS = """
SELECT CASE WHEN e % 23 = 0 THEN 'link' WHEN e % 17 = 0 THEN 'protocol' WHEN e % 19 = 0 THEN 'fragment' WHEN e % 29 = 0 THEN 'short' WHEN e % 31 = 0 THEN 'flags' ELSE 'segment' END AS reason, count(*) AS n, CAST(sum(e) AS BIGINT) AS numbers
FROM (SELECT event_id AS e FROM events) GROUP BY 1"""


def _blocks() -> list[str]:
    four = [f"10.{k * 7 % 256}.{k * 13 % 256}.0/{24 + k % 3}" for k in range(4000)]
    six = [f"2001:db8:{k * 5 % 4096:x}::/48" for k in range(0, 4000, 3)]
    return four + six + [f"::ffff:192.168.{k}.0/120" for k in range(0, 256, 5)]


def filter_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both families, and IPv4 ones written as IPv6, against 5,385 blocks."""
    ip = F.expr("""CASE e % 3 WHEN 0 THEN concat_ws('.', '10', (e * 3) % 256, (e DIV 7) % 256, e % 256) WHEN 1 THEN concat('2001:db8:', lower(hex((e * 11) % 4096)), '::', lower(hex(e % 60000 + 1)))
                   ELSE concat('::ffff:192.168.', (e DIV 5) % 256, '.', e % 256) END""")
    df = queries._events(spark, sf_dir).select("e", ip.alias("ip"))
    return df.select("e", "ip", networks.inside(_blocks())(F.col("ip")).alias("inside"))


FILTER_NETWORKS = """
WITH k AS (SELECT range AS k FROM range(4000)), v4 AS (SELECT DISTINCT (k * 7) % 256 AS b, (k * 13) % 256 AS c, CAST(256 >> (k % 3) AS INT) AS size FROM k), w AS (SELECT b, c, max(size) AS size FROM v4 GROUP BY b, c),
v6 AS (SELECT DISTINCT (k * 5) % 4096 AS g FROM k WHERE k % 3 = 0), a AS (
  SELECT event_id AS e, (event_id * 3) % 256 AS b, (event_id // 7) % 256 AS c, event_id % 256 AS d, (event_id * 11) % 4096 AS g, (event_id // 5) % 256 AS m FROM events)
SELECT e, CASE e % 3 WHEN 0 THEN '10.' || a.b || '.' || a.c || '.' || d WHEN 1 THEN '2001:db8:' || lower(to_hex(a.g)) || '::' || lower(to_hex(e % 60000 + 1)) ELSE '::ffff:192.168.' || m || '.' || d END AS ip,
  CASE e % 3 WHEN 0 THEN coalesce(d < w.size, false) WHEN 1 THEN v6.g IS NOT NULL ELSE m % 5 = 0 END AS inside
FROM a LEFT JOIN w ON w.b = a.b AND w.c = a.c LEFT JOIN v6 ON v6.g = a.g"""

TOKENS = [f"{a}{b}{c}" for a in "qxz" for b in "0123456789abcdef" for c in ("", "/", "7a", "f/2")]


def agent_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User agents made of the table's numbers in hexadecimal digits, and the first token of a table of 192 that each contains."""
    agent = F.expr("concat('agent/', lower(hex(e * 2654435761)), CASE WHEN e % 3 = 0 THEN ' q' WHEN e % 3 = 1 THEN ' x' ELSE ' z' END, lower(hex(e % 4096)), '/', e % 10)")
    df = queries._events(spark, sf_dir).select("e", agent.alias("agent"))
    return df.select("e", "agent", tries.first_token(TOKENS, [f"family {t}" for t in TOKENS])(F.col("agent")).alias("family"))


def _tokens_sql() -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TOKENS))
    return f"""
WITH t(i, token) AS (VALUES {values}), a AS (
  SELECT event_id AS e, 'agent/' || lower(to_hex(CAST(event_id * 2654435761 AS BIGINT))) || CASE WHEN event_id % 3 = 0 THEN ' q' WHEN event_id % 3 = 1 THEN ' x' ELSE ' z' END || lower(to_hex(event_id % 4096)) || '/' || (event_id % 10) AS agent FROM events)
SELECT e, agent, arg_min('family ' || token, i) FILTER (contains(agent, token)) AS family FROM a, t GROUP BY e, agent"""


def flow_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in bytes of a flow for each event: HTTP/1 over IPv4, TLS over IPv6, and HTTP/2 over either. A SYN, its answer, what the client says in two segments (HTTP/1: in either order) and the server's answer; the
    last but one carries a timestamp, and was captured before the one in front of it."""
    e = F.col("e")
    n = e.cast("string")
    df = queries._hello_records(queries._events(spark, sf_dir))
    lit = queries._literal
    req, half = queries._request(e).cast("binary"), F.lit(11)
    res = F.concat(F.lit("HTTP/1.1 "), (200 + e % 5).cast("string"), F.lit(" OK\r\nServer: s\r\n\r\n")).cast("binary")
    block = F.concat(lit(":method", queries._said("GET")), lit(":path", F.concat(F.lit("/p"), n)), lit(":authority", queries._said("h")))
    h2 = F.concat(F.lit(wire.PREFACE), queries._frame(4, 0, 0, F.lit(b"")), queries._frame(1, 5, 1, block))
    answer = F.concat(queries._frame(4, 0, 0, F.lit(b"")), queries._frame(1, 4, 1, lit(":status", (200 + e % 5).cast("string"))))
    kind = e % 3
    first = F.when(kind == 0, F.substr(req, F.lit(1), half)).when(kind == 1, F.substr("record", F.lit(1), F.lit(30))).otherwise(F.substr(h2, F.lit(1), F.lit(50)))
    rest = F.when(kind == 0, F.substr(req, half + 1)).when(kind == 1, F.substr("record", F.lit(31))).otherwise(F.substr(h2, F.lit(51)))
    flip, empty = (kind == 0) & (e % 2 == 1), F.lit(b"")
    one = lambda no, client, flags, seq, payload, t, ts: F.struct(F.lit(no).alias("no"), F.lit(client).alias("client"), F.lit(flags).alias("flags"), seq.alias("seq"), payload.alias("payload"), F.lit(t).alias("t"), F.lit(ts).alias("ticks"))
    early, late = F.lit(2), F.lit(13)
    parts = F.array(
        one(0, True, "02", F.lit(1), empty, 0, 0), one(1, False, "12", F.lit(1), empty, 1, -1), one(2, True, "18", F.when(flip, late).otherwise(early), F.when(flip, rest).otherwise(first), 2000, -1),
        one(3, True, "18", F.when(flip, early).otherwise(late), F.when(flip, first).otherwise(rest), 1000, 100), one(4, False, "18", F.lit(2), F.when(kind == 0, res).when(kind == 1, empty).otherwise(answer), 2500, -1),
    )
    p = df.select("e", F.explode(parts).alias("p")).select("e", "p.*")
    h = lambda x, k: F.lpad(F.hex(x), k, "0")
    client = F.col("client")
    own, port = h(1025 + e % 60000, 4), F.when(e % 3 == 1, "01BB").otherwise("0050")
    stamp = F.when(F.col("ticks") >= 0, F.concat(F.lit("0101080A"), h(e * 100 + 100 + F.col("ticks"), 8), F.lit("00000000"))).otherwise("")
    options = F.concat(F.when(F.col("no") == 0, "020405B4").otherwise(""), stamp)
    header = 20 + F.length(options) / 2
    tcp = F.concat(F.when(client, own).otherwise(port), F.when(client, port).otherwise(own), h(F.col("seq"), 8), F.lit("00000000"), h((header / 4).cast("long") * 16, 2), F.col("flags"), F.lit("16D000000000"), options)
    size = (header + F.octet_length("payload")).cast("long")
    a4, b4 = F.concat(F.lit("0A01"), h(F.floor(e / 60000), 2), h(e % 250 + 1, 2)), F.lit("0A020001")
    a6, b6 = F.concat(F.lit("20010DB8" + "0" * 16), h(F.floor(e / 60000), 4), h(e % 250 + 1, 4)), F.lit("20010DB8" + "0" * 23 + "9")
    swap = lambda a, b: F.concat(F.when(client, a).otherwise(b), F.when(client, b).otherwise(a))
    v4 = F.concat(F.lit("000000000001000000000002080045" + "00"), h(size + 20, 4), h(e % 65536, 4), F.lit("400040060000"), swap(a4, b4))
    v6 = F.concat(F.lit("00000000000100000000000286DD60000000"), h(size, 4), F.lit("0640"), swap(a6, b6))
    data = F.concat(F.unhex(F.concat(F.when(_v6(), v6).otherwise(v4), tcp)), F.col("payload"))
    return p.select(F.lit("made").alias("capture"), (e * 8 + F.col("no")).alias("packet_no"), F.timestamp_millis(e * 10 + F.col("t")).alias("ts"), F.octet_length(data).alias("orig_len"), data.alias("data"))


def _v6():
    return (F.col("e") % 3 == 1) | (F.col("e") % 6 == 2)


def whole_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """analyze() of flow_packets(), which large flows would be cut for: what each packet tells of HTTP, TLS, uptime and MTU."""
    r = analyze.analyze(flow_packets(spark, sf_dir))
    return r.select(
        "packet_no", F.col("syn").isNotNull().alias("syn"), "mtu.mtu", F.col("http_request.method").alias("method"), F.col("http_request.uri").alias("uri"), F.col("http_response.status_code").alias("status_code"), F.col("tls.ja4").alias("ja4"),
        F.col("client_uptime.hz").alias("hz"), F.col("client_uptime.days").alias("days"), F.col("client_uptime.hours").alias("hours"), F.col("client_uptime.minutes").alias("minutes"),
    )


def _whole_sql() -> str:
    return f"""
WITH j AS ({queries._ja4_sql("sorted", in_bytes=True)}), p AS (SELECT event_id AS e, no, event_id % 3 AS kind, (event_id * 100 + 200) // 100 AS s FROM events, (SELECT range AS no FROM range(5)))
SELECT e * 8 + no AS packet_no, no = 0 AS syn, CAST(CASE WHEN no = 0 THEN CASE WHEN kind = 1 OR e % 6 = 2 THEN 1516 ELSE 1496 END END AS INT) AS mtu, CASE WHEN kind <> 1 AND no = 3 THEN 'GET' END AS method, CASE WHEN kind <> 1 AND no = 3 THEN '/p' || e END AS uri,
  CAST(CASE WHEN kind <> 1 AND no = 4 THEN 200 + e % 5 END AS INT) AS status_code, CASE WHEN kind = 1 AND no = 3 THEN j.full END AS ja4, CASE WHEN no = 3 THEN 100 END AS hz,
  CAST(CASE WHEN no = 3 THEN s // 86400 END AS INT) AS days, CAST(CASE WHEN no = 3 THEN s % 86400 // 3600 END AS INT) AS hours, CAST(CASE WHEN no = 3 THEN s % 3600 // 60 END AS INT) AS minutes
FROM p JOIN j USING (e)"""


QUERIES = {f.__name__: f for f in (capture_blocks, packet_rejects, filter_networks, agent_tokens, whole_analysis)}


def sql() -> dict[str, str]:
    return {"capture_blocks": CAPTURE_BLOCKS, "packet_rejects": PACKET_REJECTS, "filter_networks": FILTER_NETWORKS, "agent_tokens": _tokens_sql(), "whole_analysis": _whole_sql()}

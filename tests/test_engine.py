"""Sources, wire formats, signatures, whole analyses and streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from netglean.operators import decode, flows, http2, wire
from netglean.plans import analyze, catalog, metrics, queries, sinks
from netglean.sources import pcap, signatures

SF = "/root/testdata/sf0.001"
FAST = ["tcp_os_match", "ttl_classify", "window_classify", "mtu_link", "flag_validity_direction", "quirks_text", "filter_allow", "filter_deny", "freq_round", "uptime_anchor_fold", "http_browser_match", "accept_language", "ja4_sorted", "akamai_fingerprint", "tcp_options_walk", "packet_decode", "packets_mixed", "flow_reassembly", "flow_reopened", "http2_exchange", "akamai_segments", "uptime_by_answers", "capture_stats", "http_metadata", "tls_client_hello", "tls_reassembly", "protocol_union", "pcap_scan", "ndjson_sink", "signature_parse", "http_detect", "tls_version", "filter_any_port", "capture_blocks", "packet_rejects", "filter_networks", "agent_tokens", "whole_analysis"]


def rows(values):
    return sorted(repr(tuple(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in values)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(catalog.sql()[name])
    assert names == sorted(want.columns)
    assert rows(map(tuple, got.select(*names).collect())) == rows(want.project(",".join(f'"{n}"' for n in names)).fetchall() if hasattr(want, "fetchall") else want.df()[names].values.tolist())


def segment(src, dst, sport, dport, seq, flags, payload=b"", options=b""):
    head = sport.to_bytes(2, "big") + dport.to_bytes(2, "big") + seq.to_bytes(4, "big") + bytes(4) + bytes([(5 + len(options) // 4) << 4, flags]) + (29200).to_bytes(2, "big") + bytes(4) + options
    ip = b"\x45\x00" + (20 + len(head) + len(payload)).to_bytes(2, "big") + b"\x00\x01\x40\x00\x40\x06\x00\x00" + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return bytes(12) + b"\x08\x00" + ip + head + payload


def hello() -> bytes:
    ext = b"\x00\x00\x00\x09\x00\x07\x00\x00\x04host" + b"\x00\x10\x00\x05\x00\x03\x02h2" + b"\x0a\x0a\x00\x00" + b"\x00\x2b\x00\x03\x02\x03\x04"
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x04\x13\x01\x0a\x0a" + b"\x01\x00" + len(ext).to_bytes(2, "big") + ext
    msg = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + len(msg).to_bytes(2, "big") + msg


OPTIONS = bytes.fromhex("020405b40402080a00000001000000000103030a")[:20]
REQUEST = b"GET /a HTTP/1.1\r\nHost: h\r\nUser-Agent: curl/7.68.0 and later\r\n\r\n"


def capture():
    c, s = "10.0.0.1", "10.0.0.2"
    h = hello()
    return pcap.write_pcap([
        (1.0, segment(c, s, 1111, 80, 1, 2, options=OPTIONS)), (1.1, segment(c, s, 1111, 80, 12, 24, REQUEST[10:])), (1.2, segment(c, s, 1111, 80, 2, 24, REQUEST[:10])), (1.3, segment(s, c, 80, 1111, 1, 24, b"HTTP/1.1 200 OK\r\nServer: nginx/\r\n\r\n")),
        (2.0, segment(c, s, 2222, 443, 1, 24, h[:20])), (2.1, segment(c, s, 2222, 443, 21, 24, h[20:])), (2.2, b"\x00" * 10), (2.3, b""),
    ])


def test_pcap_source(spark, tmp_path):
    path = tmp_path / "a.pcap"
    path.write_bytes(capture() + b"\x01\x02")
    pcap.register(spark)
    a = spark.read.format("pcap").load(str(path)).orderBy("packet_no").collect()
    b = pcap.read_pcap(spark, str(path)).orderBy("packet_no").collect()
    assert len(a) == len(b) == 8 and [bytes(r.data) for r in a] == [bytes(r.data) for r in b] and a[0].ts == b[0].ts
    assert list(pcap.packets(b"not a capture")) == []


def test_whole_analysis(spark, tmp_path):
    path = tmp_path / "b.pcap"
    path.write_bytes(capture())
    r = analyze.analyze(pcap.read_pcap(spark, str(path))).orderBy("packet_no").cache()
    got = {x.packet_no: x for x in r.collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5} and got[0].syn.os.name == "Linux" and got[0].mtu.mtu == 1500 and got[1].syn_ack is not None
    assert got[2].http_request.uri == "/a" and got[2].http_request.browser.name == "curl" and got[3].http_response.status_code == 200
    assert got[5].tls.sni == "host" and got[5].tls.ja4.startswith("t13d0103h2_") and got[4].tls is None
    lines = [x.value for x in sinks.to_ndjson(r).collect()]
    assert len(lines) == 6 and any('"ja4"' in x for x in lines)
    assert any(".-[ syn ]-" in x.value for x in sinks.to_text(r).collect())
    only = analyze.analyze_tcp(pcap.read_pcap(spark, str(path)))
    assert "tls" not in only.columns and only.count() == 6


def test_signature_file_errors():
    for bad in ("junk", "[tcp:request]\nsig = 4:64:0:*:*,*:mss::0", "[tcp:request]\nlabel = s:x:y:\nsig = 4:64"):
        with pytest.raises(signatures.SignatureError):
            signatures.parse(bad)
    s = signatures.parse("classes = a,b\n[mtu]\nlabel = L\nsig = 1500\n[http:request]\nua_os = Linux,iOS=[iPad],X\n")
    assert s.classes == ["a", "b"] and s.mtu == [(0, "L", 1500)] and s.ua_os == [(0, "Linux", "Linux"), (1, "iPad", "iOS"), (2, "X", "X")]
    assert signatures.parse("ua_os = Linux,iOS=[iPad],X", compat=True).ua_os == [(0, "Linux", None), (1, "iOS", None)]
    assert signatures.parse_tcp("*:64-:0:265:%512,0:mss,sok,ts:ack+:0")[1] == ("bad", 64, None)


def test_hpack():
    assert len(wire._CODES) == 257 and sum(2.0**-n for n, _ in wire._CODES) == 1
    d = wire.Hpack()
    assert d.decode(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))[3] == (":authority", "www.example.com")
    assert d.decode(bytes.fromhex("828684be5886a8eb10649cbf"))[-1] == ("cache-control", "no-cache")
    block = bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")
    frame = len(block).to_bytes(3, "big") + b"\x01\x04\x00\x00\x00\x01" + block
    assert wire.pseudo_headers(wire.PREFACE + frame) == [":method", ":scheme", ":path", ":authority"]
    assert dict(wire.http2_headers(wire.PREFACE + frame))[":path"] == "/"
    assert wire.http2_headers(frame) is None and wire.pseudo_headers(b"") == []


def test_hello_reader():
    r, h = wire.HelloReader(), hello()
    assert r.add(h[:3]) is None and r.add(h[3:])["sni"] == "host" and r.add(h) is None
    assert wire.client_hello(h[:-1]) is None and wire.client_hello(b"") is None


def test_streams_equal_batch(spark, tmp_path):
    from netglean.streaming import processors

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.pcap").write_bytes(capture())
    pcap.register(spark)
    stream = decode.decode(spark.readStream.format("pcap").load(str(tmp_path / "in")))
    for name, out in (("tls", processors.tls_stream(stream)), ("http", processors.http_stream(stream))):
        q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    seg = decode.decode(pcap.read_pcap(spark, str(tmp_path / "in" / "c.pcap")))
    assert [r.hello.sni for r in spark.table("tls").collect()] == [r.hello.sni for r in flows.tls_hellos(seg).collect()] == ["host"]
    assert sorted((r.side, r.text) for r in spark.table("http").collect()) == sorted((r.side, r.text) for r in flows.http_messages(seg).where(F.col("packet_no").isNotNull()).collect() if r.text and "HTTP/" in r.text)


def test_connections_on_the_same_ports(spark, tmp_path):
    """Ports that are used again, after an answer, a FIN or a minute, and hellos after many segments of data."""
    c, s, h = "10.0.0.1", "10.0.0.2", hello()
    answer = b"HTTP/1.1 200 OK\r\nServer: nginx/\r\n\r\n"
    rows = []
    for t, port in ((1, 1111), (2, 1111), (100, 1111), (200, 3333)):
        rows += [(t, segment(c, s, port, 80, 1, 2)), (t + 0.1, segment(c, s, port, 80, 2, 24, REQUEST.replace(b"/a", b"/%d" % t))), (t + 0.2, segment(s, c, 80, port, 1, 24, answer))]
    rows += [(300, segment(c, s, 4444, 80, 1, 2)), (300.1, segment(c, s, 4444, 80, 2, 17)), (301, segment(c, s, 4444, 80, 7, 2)), (301.1, segment(c, s, 4444, 80, 8, 24, REQUEST.replace(b"/a", b"/301")))]
    rows += [(400, segment(c, s, 2222, 443, 1, 24, h)), *((401 + i / 1000, segment(c, s, 2222, 443, 1 + i, 24, b"\x17\x03\x03" + bytes(20))) for i in range(300)), (402, segment(c, s, 2222, 443, 9, 24, h))]
    rows += [(500, segment(c, s, 5555, 80, 1, 2)), *((500 + i / 100, segment(c, s, 5555, 80, 1000 + i, 24, b"x")) for i in range(1, 300)), (504, segment(c, s, 5555, 80, 2, 24, REQUEST.replace(b"/a", b"/500")))]
    (tmp_path / "c.pcap").write_bytes(pcap.write_pcap(rows))
    packets = pcap.read_pcap(spark, str(tmp_path / "c.pcap"))
    r = analyze.analyze(packets, analyze.AnalysisConfig(tcp=False)).collect()
    assert sorted(x.http_request.uri for x in r if x.http_request) == ["/1", "/100", "/2", "/200", "/301", "/500"]
    assert sum(x.http_response is not None for x in r) == 4 and sum(x.tls is not None for x in r) == 2


def literal(name: bytes, value: bytes) -> bytes:
    return b"\x00" + bytes([len(name)]) + name + bytes([len(value)]) + value


def frame(kind: int, flags: int, stream: int, payload: bytes) -> bytes:
    return len(payload).to_bytes(3, "big") + bytes([kind, flags]) + stream.to_bytes(4, "big") + payload


def test_flows_read_http2(spark, tmp_path):
    from netglean.streaming import processors

    c, s = "10.0.0.1", "10.0.0.2"
    block = b"\x82\x86\x84" + literal(b"user-agent", b"curl/8.1") + literal(b"cookie", b"a=1; b") + literal(b"cookie", b"c=2") + literal(b"referer", b"http://r/") + literal(b"accept-language", b"de,en;q=0.5")
    ask = wire.PREFACE + frame(4, 0, 0, b"") + frame(1, 4, 1, block)
    reply = frame(4, 0, 0, b"") + frame(1, 4, 1, b"\x88" + literal(b"server", b"nginx/1.0")) + frame(0, 1, 1, b"body")
    rows = [(1.0, segment(c, s, 1111, 80, 1, 2)), (1.1, segment(c, s, 1111, 80, 42, 24, ask[40:])), (1.2, segment(c, s, 1111, 80, 2, 24, ask[:40])), (1.3, segment(s, c, 80, 1111, 1, 24, reply[:20])), (1.4, segment(s, c, 80, 1111, 21, 24, reply[20:])), (2.0, segment(c, s, 2222, 80, 1, 2)), (2.1, segment(c, s, 2222, 80, 2, 24, REQUEST))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.pcap").write_bytes(pcap.write_pcap(rows))
    packets = pcap.read_pcap(spark, str(tmp_path / "in" / "c.pcap"))
    got = {x.packet_no: x for x in analyze.analyze_http(packets).collect()}
    assert set(got) == {2, 4, 6} and got[6].http_request.uri == "/a"
    q = got[2].http_request
    assert (q.method, q.uri, q.user_agent, q.referer, q.lang, q.header_count) == ("GET", "/", "curl/8.1", "http://r/", "German", 2)
    assert [tuple(x) for x in q.cookies] == [("a", "1", 0), ("b", None, 1), ("c", "2", 2)] and q.signature.startswith("2:user-agent=[curl/8.1],accept-language=[de,en;q=0.5]:Host,Connection,Accept,")
    assert got[4].http_response.status_code == 200 and got[4].http_response.signature.startswith("2:server=[nginx/1.0]:Content-Type,") and got[4].http_response.signature.endswith(":nginx/1.0")
    pcap.register(spark)
    out = processors.http_stream(decode.decode(spark.readStream.format("pcap").load(str(tmp_path / "in"))))
    run = out.writeStream.format("memory").queryName("http2").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    run.stop()
    assert sorted((r.packet_no, r.side, r.h2 and r.h2.uri) for r in spark.table("http2").collect()) == [(2, "request", "/"), (4, "response", None), (6, "request", None)]


def test_flows_over_rotated_files(spark, tmp_path):
    """A SYN, the halves of a request and of a hello in files of their own, in batch and as a stream of one file a batch."""
    from netglean.streaming import processors

    c, s, h, folder = "10.0.0.1", "10.0.0.2", hello(), tmp_path / "in"
    folder.mkdir()
    files = [[(1.0, segment(c, s, 1111, 80, 1, 2)), (1.1, segment(c, s, 2222, 443, 1, 24, h[:20]))], [(2.0, segment(c, s, 1111, 80, 2, 24, REQUEST[:10])), (2.1, segment(c, s, 2222, 443, 21, 24, h[20:]))], [(3.0, segment(c, s, 1111, 80, 12, 24, REQUEST[10:]))]]
    for i, rows_ in enumerate(files):
        (folder / f"{i}.pcap").write_bytes(pcap.write_pcap(rows_))
    pcap.register(spark)
    for packets in (pcap.read_pcap(spark, str(folder)), spark.read.format("pcap").load(str(folder))):
        seg = decode.decode(packets)
        assert [(r.packet_no, r.side) for r in flows.http_messages(seg).collect()] == [(2 * pcap.FILE, "request")]
        assert [(r.packet_no, r.hello.sni) for r in flows.tls_hellos(seg).collect()] == [(pcap.FILE + 1, "host")]
    late = folder / "2.pcap"
    late.rename(tmp_path / "2.pcap")
    for last in (False, True):
        if last:
            (tmp_path / "2.pcap").rename(late)
        q = processors.http_stream(decode.decode(spark.readStream.format("pcap").load(str(folder)))).writeStream.format("json").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        q.stop()
    assert [(r.packet_no, r.side) for r in spark.read.json(str(tmp_path / "out")).collect()] == [(2 * pcap.FILE, "request")]


def test_matchers_of_ones_own_and_counters(spark):
    def every(obs):
        return obs.withColumns({"kind": F.lit("s"), "class": F.lit("mine"), "name": F.lit("any"), "flavor": F.lit(None).cast("string"), "signature": F.lit("x"), "dist": F.lit(0), "score": F.lit(1.0)})

    made = queries.frames_of(spark.range(100).withColumnRenamed("id", "e"))
    counted, seen = metrics.observed(made)
    got = analyze.analyze(counted, analyze.AnalysisConfig(http=False, tls=False, tcp_matcher=every))
    assert {(r.syn.os.name, r.syn.os.family) for r in got.collect()} == {("any", "mine")}
    n = seen.get
    assert n["packets"] == 100 and n["bytes"] > 6000 and n["cut"] == 0


def test_settings_are_read_once(spark):
    data = wire.PREFACE + bytes.fromhex("0000060400000000000003000000640000040800000000000000ffff")
    df = http2.with_fingerprint(spark.createDataFrame([(bytearray(data),), (bytearray(data[24:]),), (bytearray(data[:30]),), (None,)], "data binary"), "data")
    assert [r.akamai and r.akamai.text for r in df.collect()] == ["3:100|65535|0|", "3:100|65535|0|", None, None]
    r = http2.FrameReader()
    assert [len(r.add(data[a:b])) for a, b in ((0, 20), (20, 38), (38, 60))] == [0, 0, 28]


def test_stream_of_whole_analysis(spark, tmp_path):
    """State goes on from one run to the next, and a file that comes later counts though its name is less."""
    import json

    from netglean.streaming import results

    c, s, h, folder = "10.0.0.1", "10.0.0.2", hello(), tmp_path / "in"
    folder.mkdir()
    files = {"b.pcap": [(1.0, segment(c, s, 1111, 80, 1, 2)), (1.1, segment(c, s, 2222, 443, 1, 24, h[:20])), (1.2, segment(c, s, 1111, 80, 2, 24, REQUEST[:10]))], "a.pcap": [(2.1, segment(c, s, 2222, 443, 21, 24, h[20:])), (3.0, segment(c, s, 1111, 80, 12, 24, REQUEST[10:]))]}
    pcap.register(spark)
    for name, made in files.items():
        (tmp_path / name).write_bytes(pcap.write_pcap(made))
        (tmp_path / name).rename(folder / name)
        out = results.ndjson(spark.readStream.format("pcap").load(str(folder)))
        q = out.writeStream.format("text").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        q.stop()
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len([x for x in got if "syn" in x or "syn_ack" in x]) == 5
    assert [(x["packet_no"], x["http_request"]["uri"]) for x in got if "http_request" in x] == [(pcap.FILE + 1, "/a")]
    assert [x["tls"]["sni"] for x in got if "tls" in x] == ["host"]

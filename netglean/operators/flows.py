"""What spans packets: uptime samples, HTTP exchanges and TLS hellos over segments, in batch. One conversation's packets meet by its key.

A flow's packets come in order to one task (or, if told() is asked to cut large flows, to several that hand on the state), which holds only what the open connection still needs: a side's segments until its
headers are whole, at most the MOST_HEAD bytes of least sequence numbers, as headers that are longer are never read.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netglean.functions import http, tcp, uptime
from netglean.operators import decode, wire
from netglean.sources.shared import kept

HTTP_LIFE_MS, TLS_LIFE_MS = 60_000, 20_000
MOST_HEAD = (http.MOST_HEADERS + 2) * (http.MOST_LINE + 2)
_LETTERS = {m[:1].encode() for m in http.METHODS} | {wire.PREFACE[:1]}
_STARTS = (re.compile(rb"(?:" + "|".join(http.METHODS).encode() + rb")[ \t]+\S+[ \t]+HTTP/1\.[01][ \t]*\r?\n"), re.compile(rb"HTTP/1\.[01][ \t]+\d{3}[ \t\r\n]"))


def uptimes(observed: DataFrame) -> DataFrame:
    """observe()'s rows that tell an uptime: capture, packet_no, role, hz, days, hours, minutes, wrap_days. Time is the packets' own, their order that of packet_no."""
    samples = observed.where("tcp_ts IS NOT NULL AND ts IS NOT NULL").select("capture", "packet_no", "ts", "src", "sport", "dst", "dport", "flags", "role", F.col("tcp_ts.val").alias("tsval"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("raw"))
    out = told(samples, False, False, True, only=("capture", "packet_no", "role", "tsval", "raw_hz")).where("raw_hz IS NOT NULL").withColumn("hz", uptime.rounded(F.col("raw_hz")))
    return out.select("capture", "packet_no", "role", "hz", uptime.split(F.col("tsval"), F.col("hz")).alias("u")).select("capture", "packet_no", "role", "hz", "u.*")


def told_uptimes(samples: DataFrame, key: list[str]) -> DataFrame:
    """The samples (key columns, packet_no, t_ms, tsval; long) that tell a frequency, with hz, days, hours, minutes and wrap_days. A direction's samples pass in order of packet_no, one anchor at a time."""
    columns = [*key, "packet_no", "t_ms", "tsval"]
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def start():
        anchor = None

        def step(r):
            nonlocal anchor
            anchor, hz = uptime.step(anchor, r["t_ms"], r["tsval"])
            return [{**r, "raw_hz": hz}] if hz is not None else []

        return step

    told = _in_order(samples.select(*columns), key, start, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", raw_hz double")
    told = told.withColumn("hz", uptime.rounded(F.col("raw_hz")))
    return told.select(*key, "packet_no", "tsval", "hz", uptime.split(F.col("tsval"), F.col("hz")).alias("u")).select(*key, "packet_no", "tsval", "hz", "u.*")


def answered_uptimes(samples: DataFrame, key: list[str]) -> DataFrame:
    """Uptimes by uptime.Tracker: samples (key columns, packet_no, t_ms, tsval, from_client) of one key are both directions of a connection."""
    columns = [*key, "packet_no", "t_ms", "tsval", "from_client"]
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def start():
        tracker = uptime.Tracker()

        def step(r):
            hz = tracker.step(r["t_ms"], r["tsval"], r["from_client"])
            return [{**r, "raw_hz": hz}] if hz is not None else []

        return step

    told = _in_order(samples.select(*columns), key, start, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", raw_hz double")
    told = told.withColumn("hz", uptime.rounded(F.col("raw_hz")))
    return told.select(*key, "packet_no", "hz", uptime.split(F.col("tsval"), F.col("hz")).alias("u")).select(*key, "packet_no", "hz", "u.*")


def flow_key(df: DataFrame) -> DataFrame:
    """df with flow, the same for both directions, and forward, whether the packet goes from the lesser endpoint."""
    a, b = F.concat_ws("|", "src", "sport"), F.concat_ws("|", "dst", "dport")
    return df.withColumn("flow", F.concat_ws("~", "capture", F.least(a, b), F.greatest(a, b))).withColumn("forward", a <= b)


def _may_begin(side: int, parts: list[tuple[int, bytes]]) -> bool:
    """Whether a side's bytes may be a message, by the first nine: a method's letter, an answer's name, or a frame's header. Bytes of other protocols are never put together."""
    head = parts[0][1][:9]
    for _, data in parts[1:]:
        if len(head) == 9:
            break
        head += data[: 9 - len(head)]
    if side == 0:
        return head[:1] in _LETTERS
    return b"HTTP/1.".startswith(head[:7]) or len(head) < 9 or wire.looks_like_http2(head)


class HttpFlow:
    """A connection: when it began, whether forward is from its client, and each side's segments (seq, payload) until its headers are whole."""

    def __init__(self, since: int | None, forward: bool):
        self.since, self.forward, self.parts, self.done, self.closed = since, forward, ([], []), [False, False], False
        self.sizes = [0, 0]  # bytes of each side's segments

    def add(self, forward: bool, flags: int, seq: int, payload: bytes) -> tuple[str, bytes, dict | None] | None:
        """The side and bytes of the message that this packet completes, and what wire.http2_message() reads if it is HTTP/2."""
        side, found = int(forward != self.forward), None
        if payload and not self.done[side]:
            parts = self.parts[side]
            if parts and seq < parts[-1][0]:
                bisect.insort(parts, (seq, payload), key=lambda p: p[0])
            else:
                parts.append((seq, payload))
            size = self.sizes[side] + len(payload)
            while size - len(parts[-1][1]) >= MOST_HEAD:
                size -= len(parts.pop()[1])
            self.sizes[side] = size
            if message := self._message(side):
                parts.clear()
                self.sizes[side] = 0
                self.done[side], found = True, (("request", "response")[side], *message)
        self.closed = self.closed or bool(flags & (tcp.FIN | tcp.RST)) or all(self.done)
        return found

    def take(self, parts: tuple[list, list], done: list[bool], closed: bool) -> None:
        """Goes on from what another had."""
        self.parts, self.done, self.closed = parts, done, closed
        self.sizes = [sum(len(p[1]) for p in side) for side in parts]

    def _message(self, side: int) -> tuple[bytes, dict | None] | None:
        if not _may_begin(side, self.parts[side]):
            return None
        parts = self.parts[side]
        whole = parts[0][1] if len(parts) == 1 else b"".join([p[1] for p in parts])
        if _STARTS[side].match(whole):
            return (whole, None) if b"\r\n\r\n" in whole else None
        h2 = wire.http2_message(whole, side == 0)
        return (whole, h2) if h2 else None


def http_step(flow: HttpFlow | None, t: int | None, forward: bool, flags: int, seq: int, payload: bytes) -> tuple[HttpFlow | None, tuple[str, bytes, dict | None] | None]:
    """The connection that is open after a packet, and the message that the packet completes.

    A connection begins at a SYN, whose sender is the client, and lives 60 s; a SYN after both messages, a FIN or a RST begins another.
    """
    if flow is not None and t is not None and flow.since is not None and t - flow.since >= HTTP_LIFE_MS:
        flow = None
    if flags & tcp.SYN and (flow is None or flow.closed):
        flow = HttpFlow(t, forward)
    return (flow, flow.add(forward, flags, seq, payload)) if flow is not None else (None, None)


def _in_order(df: DataFrame, key: list[str], start: Callable, schema: str) -> DataFrame:
    """The rows that start()'s function gives for each of df's rows, a dict; one is made for each key, and gets its rows in order of packet_no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if (k := tuple(r[c] for c in key)) != last:
                    last, step = k, start()
                rows += step(r)
            yield pa.RecordBatch.from_pylist(rows, out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(*key).sortWithinPartitions(*key, "packet_no").mapInArrow(run, schema)


def http_messages(segments: DataFrame) -> DataFrame:
    """First request and first response of each connection: capture, packet_no (that completes it), flow, side, bytes, h2 (HTTP/2), text.

    A side's payloads are put together by sequence number, neither trimmed nor freed of repetitions, until its headers are whole.
    """
    marks = F.col("flags").bitwiseAND(tcp.SYN | tcp.FIN | tcp.RST) != 0
    out = told(_payloads(segments.where(marks | (F.octet_length("payload") > 0))), True, False, False, only=("capture", "packet_no", "flow", "side", "bytes", "h2"))
    return out.withColumn("text", F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string")))


def _payloads(segments: DataFrame) -> DataFrame:
    """decode()'s columns as told() takes them, without what uptimes need."""
    return segments.select("capture", "packet_no", "ts", "src", "sport", "dst", "dport", "flags", F.col("seq").cast("long").alias("seq"), F.col("payload").cast("binary").alias("raw"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("tsval"))


HTTP_SCHEMA = f"capture string, packet_no long, flow string, side string, bytes binary, h2 {wire.HTTP2}"


class Connection:
    """What one flow's packets tell in order: messages, hellos of each direction, and uptimes of each direction and role."""

    def __init__(self, with_http: bool, with_tls: bool, with_uptime: bool, reassemble: bool, noted: bool = False):
        self.with_http, self.with_tls, self.with_uptime, self.reassemble, self.noted = with_http, with_tls, with_uptime, reassemble, noted
        self.http, self.anchors, self.readers = None, {}, {}
        self.touched: set[str] = set()  # if noted, parts of the state that a packet has read

    def step(self, t: int | None, forward: bool, flags: int, seq: int, payload: bytes, role: str | None, tsval: int | None) -> tuple[float | None, tuple | None, dict | None, str | None]:
        """The raw frequency, message and hello that a packet tells, and hello if it ends a handshake's beginning that can't be read."""
        hz = found = hello = fault = None
        if self.with_uptime and tsval is not None and t is not None:
            if self.noted:
                self.touched.add(f"a{int(forward)}{role}")
            self.anchors[forward, role], hz = uptime.step(self.anchors.get((forward, role)), t, tsval)
        if self.with_http and (payload or flags & (tcp.SYN | tcp.FIN | tcp.RST)):
            if self.noted:
                self.touched.add("h")
            self.http, found = http_step(self.http, t, forward, flags, seq, payload)
        if self.with_tls and payload:
            if self.noted:
                self.touched.add(f"r{int(forward)}")
            if self.reassemble:
                hello, fault = self._hello(t, forward, payload)
            elif wire.is_tls(payload):
                hello = wire.client_hello(payload)
                fault = "hello" if hello is None else None
        return hz, found, hello, fault

    def _hello(self, t: int | None, forward: bool, payload: bytes) -> tuple[dict | None, str | None]:
        reader, since = self.readers.get(forward, (None, None))
        if reader is not None and since is not None and t is not None and t - since >= TLS_LIFE_MS:
            reader = None
        if reader is None:
            if not wire.is_tls(payload):
                self.readers.pop(forward, None)
                return None, None
            reader, since = wire.HelloReader(), t
        hello = reader.add(payload)
        self.readers[forward] = (None, None) if reader.done else (reader, since)
        return hello, "hello" if reader.done and hello is None else None


    def parts(self) -> list[tuple[str, str]]:
        """Of a connection that notes them: the parts of the state that packets have read, as they are now, as texts; an empty one is what a new connection has."""
        out = []
        for name in sorted(self.touched):
            if name == "h":
                f = self.http
                value = f and (f.since, f.forward, f.parts, f.done, f.closed)
            elif name[0] == "a":
                value = tuple(self.anchors[name[1] == "1", name[2:] if name[2:] != "None" else None])
            else:
                reader, since = self.readers.get(name[1] == "1", (None, None))
                value = reader and (reader.buffer, since)
            out.append((name, repr(value) if value else ""))
        return out

    def take(self, parts: list[tuple[str, str]]) -> None:
        """Goes on from parts()."""
        for name, text in parts:
            if not text:
                continue
            value = ast.literal_eval(text)
            if name == "h":
                self.http = HttpFlow(value[0], value[1])
                self.http.take(tuple(map(list, value[2])), list(value[3]), value[4])
            elif name[0] == "a":
                self.anchors[name[1] == "1", name[2:] if name[2:] != "None" else None] = uptime.Anchor(*value)
            else:
                reader = wire.HelloReader()
                reader.buffer = value[0]
                self.readers[name[1] == "1"] = (reader, value[1])


_PACKET = ("_t", "forward", "flags", "seq", "raw", "role", "tsval")
_PARTS = "array<struct<part: string, value: string>>"


def _stretches(df: DataFrame, most: int) -> DataFrame:
    """df with stretch, 0 but in flows of more than most packets, which are cut into stretches of packet numbers. What reaches the driver is a few numbers for each stretch."""
    n = df.groupBy("flow").count().where(F.col("count") > most)
    sizes = {r["flow"]: r["count"] for r in n.collect()}
    if not sizes:
        return df.withColumn("stretch", F.lit(0))
    cuts = -(-max(sizes.values()) // most)
    names = df.sparkSession.createDataFrame([(f,) for f in sizes], "flow string")
    ends = df.join(F.broadcast(names), "flow", "left_semi").groupBy("flow").agg(F.array_distinct(F.percentile_approx("packet_no", [i / cuts for i in range(1, cuts)], 10 * cuts)).alias("_ends"))
    ends = df.sparkSession.createDataFrame(ends.collect(), "flow string, _ends array<long>")
    return df.join(F.broadcast(ends), "flow", "left").withColumn("stretch", F.when(F.col("_ends").isNull(), 0).otherwise(F.size(F.filter("_ends", lambda x: x < F.col("packet_no"))))).drop("_ends")


def _carried(df: DataFrame, config: tuple) -> DataFrame:
    """For each stretch but a flow's first, the connection's state when it begins: flow, stretch, state.

    All stretches run at once as if each began a connection, and tell the parts of the state that they read, as they leave them. A part that a stretch doesn't read passes it. Stretches
    that got another state than they had assumed run again, until none does. As state lives for a minute of packet time at most, that is soon, unless a stretch is shorter.
    """
    hot = kept(df.join(df.where("stretch > 0").select("flow").distinct(), "flow", "left_semi").select("flow", "stretch", "packet_no", *_PACKET), "stretches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, flow, out = None, None, []
        for b in batches:
            for key, stretch, state, *packet in zip(*(b.column(c).to_pylist() for c in ("flow", "stretch", "state", *_PACKET))):
                if (key, stretch) != last:
                    if last:
                        out += [(*last, *p) for p in flow.parts()]
                    last, flow = (key, stretch), Connection(*config, noted=True)
                if state is not None:
                    flow.take([(p["part"], p["value"]) for p in state])
                    continue
                packet[4] = packet[4] or b""
                flow.step(*packet)
        if last:
            out += [(*last, *p) for p in flow.parts()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.string()))], ["flow", "stretch", "part", "value"])

    def told_parts(states: DataFrame | None) -> DataFrame:
        rows = hot.withColumn("state", F.lit(None).cast(_PARTS))
        if states is not None:
            rows = rows.join(F.broadcast(states.select("flow", "stretch")), ["flow", "stretch"], "left_semi").unionByName(states.withColumn("packet_no", F.lit(-1).cast("long")), allowMissingColumns=True)
        return rows.repartition("flow", "stretch").sortWithinPartitions("flow", "stretch", "packet_no").mapInArrow(run, "flow string, stretch int, part string, value string")

    every = kept(hot.select("flow", "stretch").distinct(), "stretch-keys")

    def begun(parts: DataFrame) -> DataFrame:
        """State at each stretch's beginning: of every part the last value before it."""
        all_ = every.join(parts.select("flow", "part").distinct(), "flow").join(parts, ["flow", "stretch", "part"], "left")
        before = Window.partitionBy("flow", "part").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
        have = all_.withColumn("value", F.last("value", ignorenulls=True).over(before)).where("stretch > 0 AND value <> ''")
        return kept(have.groupBy("flow", "stretch").agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("state")), "stretch-states")

    parts = kept(told_parts(None), "stretch-parts")
    states = begun(parts)
    changed = states
    while not changed.isEmpty():
        again = kept(told_parts(changed), "stretch-parts")
        parts = kept(parts.join(changed.select("flow", "stretch"), ["flow", "stretch"], "left_anti").unionByName(again), "stretch-parts")
        old, states = states, begun(parts)
        both = every.join(states, ["flow", "stretch"], "left").join(old.withColumnRenamed("state", "old"), ["flow", "stretch"], "left")
        changed = kept(both.where("NOT state <=> old").select("flow", "stretch", F.coalesce("state", F.array().cast(_PARTS)).alias("state")), "stretch-changed")
    return states


def _plain(a: pa.Array) -> list:
    """a's values as Python's, by numpy: to_pylist() makes an object of its own for each value first."""
    if a.null_count == 0 or pa.types.is_binary(a.type) or pa.types.is_string(a.type):
        return a.to_numpy(zero_copy_only=False).tolist()
    if a.null_count == len(a):
        return [None] * len(a)
    if not pa.types.is_integer(a.type):
        return a.to_pylist()
    out = a.fill_null(0).to_numpy(zero_copy_only=False).astype(object)
    out[a.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


def told(df: DataFrame, with_http: bool, with_tls: bool, with_uptime: bool, reassemble: bool = True, hot: int | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """df with raw_hz, side, bytes, h2 and hello, null where a packet tells none, and fault where it ends a ClientHello that can't be read. All that spans packets is found in one pass over flows, after one exchange.

    df: capture, packet_no, ts, src, sport, dst, dport, flags, seq, raw (payload), role and tsval; further columns go along. hot: flows of more packets than this are cut
    into stretches for several tasks, with equal results; that reads df twice more. only: the columns to give, of packets that tell something; the others don't travel.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    more = StructType.fromDDL(f"raw_hz double, side string, bytes binary, h2 {wire.HTTP2}, hello {wire.HELLO}, fault string")
    kinds = [to_arrow_type(f.dataType) for f in more]
    config = (with_http, with_tls, with_uptime, reassemble)
    df = flow_key(df).withColumn("_t", F.unix_millis("ts"))
    if only is not None:
        df = df.select(*dict.fromkeys(("flow", "packet_no", *_PACKET, *(c for c in only if c in df.columns))))
    names = [f.name for f in df.schema if only is None or f.name in only]
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema if f.name in names] + [f for f in more if only is None or f.name in only])
    places = [(i, kinds[i]) for i, f in enumerate(more) if only is None or f.name in only]
    key = ["flow"]
    if hot is not None:
        df, key = _stretches(df, hot), ["flow", "stretch"]
        states = _carried(df, config).withColumn("packet_no", F.lit(-1).cast("long"))
        df = df.withColumn("state", F.lit(None).cast(_PARTS)).unionByName(states, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, flow = None, None
        for b in batches:
            rows, at, real = [], [], np.ones(b.num_rows, bool)
            states = b.column("state").to_pylist() if hot is not None else [None] * b.num_rows
            for i, (own, state, t, forward, flags, seq, raw, role, tsval) in enumerate(zip(zip(*(_plain(b.column(c)) for c in key)), states, *(_plain(b.column(c)) for c in _PACKET))):
                if own != last:
                    last, flow = own, Connection(*config)
                if state is not None:
                    flow.take([(p["part"], p["value"]) for p in state])
                    real[i] = False
                    continue
                hz, found, hello, fault = flow.step(t, forward, flags, seq, raw or b"", role, tsval)
                if hz is not None or found or hello is not None or fault is not None:
                    at.append(i)
                    rows.append((hz, *(found or (None, None, None)), hello, fault))
            some = list(zip(*rows)) or [()] * len(kinds)
            if only is not None:
                keep = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(keep) for c in names), *(pa.array(some[i], kind) for i, kind in places)], schema.names)
                continue
            mask = pa.array(real)
            found = np.full((len(kinds), b.num_rows), None, object)
            for i, values in enumerate(some):
                for j, v in zip(at, values):
                    found[i, j] = v
            yield pa.RecordBatch.from_arrays([*(b.column(c) if real.all() else b.column(c).filter(mask) for c in names), *(pa.array(found[i][real].tolist(), kind) for i, kind in places)], schema.names)

    # flows are in the order of their hashes, as the texts of many begin alike
    out = df.repartition(*key).sortWithinPartitions(F.xxhash64(*key), *key, "packet_no").mapInArrow(run, schema)
    return out if only is None else out.select(*only)


def faults(packets: DataFrame) -> DataFrame:
    """Of packets (capture, packet_no, ts, data) those that something is wrong with: capture, packet_no and reason, one of headers.REASONS, options (the TCP options don't fit their lengths) or hello (a ClientHello that can't be
    read ends here; also if it is a record that is too long)."""
    judged = decode.judge(packets)
    early = judged.select("capture", "packet_no", F.coalesce("reason", F.when(F.col("opt.malformed"), "options")).alias("reason"))
    late = told(_payloads(judged.where("reason IS NULL AND octet_length(payload) > 0")), False, True, False, only=("capture", "packet_no", "fault")).select("capture", "packet_no", F.col("fault").alias("reason"))
    return early.unionByName(late).where("reason IS NOT NULL")


def http_observations(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages (text, h2, side) as observations: version, header order, absent headers, software, and the fields that are reported.

    keep: columns that go along; then rows without a message stay, and have no direction.
    """
    c = F.col
    req, res = http.parsed(c("text"), True), http.parsed(c("text"), False)
    request = F.when(c("h2").isNull() & (c("side") == "request") & http.is_request(c("text")), req).alias("request")
    response = F.when(c("h2").isNull() & (c("side") == "response") & http.is_response(c("text")), res).alias("response")
    # a message is parsed once, whatever reads it below
    df = decode._once(messages, F.struct(request, response), "_parsed", messages.columns, True).select(*messages.columns, "_parsed.*")
    some = F.expr("request IS NOT NULL OR response IS NOT NULL OR h2 IS NOT NULL")
    df = df.withColumn("direction", F.when(some, c("side"))) if keep else df.where(some).withColumn("direction", c("side"))
    client = c("side") == "request"
    either = lambda a, b, h2: F.when(c("h2").isNotNull(), h2).when(c("request").isNotNull(), a).otherwise(b)
    last = lambda name: F.try_element_at(F.filter("h2.headers", lambda h: (F.lower(h["name"]) == name) & h["value"].isNotNull()), F.lit(-1))["value"]
    missing = lambda headers: F.when(client, http.absent(headers, True)).otherwise(http.absent(headers, False))
    version = either(F.get(c("request.first"), F.lit(2)), F.get(c("response.first"), F.lit(0)), F.lit("HTTP/2"))
    agent = F.when(c("h2").isNull(), http.first_value(c("request.headers"), "user-agent")).when(client, last("user-agent"))
    accept = F.when(c("h2").isNull(), http.first_value(c("request.headers"), "accept-language")).when(client, last("accept-language"))
    return df.select(
        "capture", "packet_no", "flow", *keep, "direction", F.when(version == "HTTP/2", "2").when(version == "HTTP/1.0", "0").otherwise("1").alias("version"),
        either(http.header_order(c("request.headers"), True), http.header_order(c("response.headers"), False), F.transform("h2.headers", lambda h: F.struct(F.lit(False).alias("optional"), h["name"].alias("name"), h["value"].alias("value")))).alias("horder"),
        F.transform(either(http.absent(c("request.headers"), True), http.absent(c("response.headers"), False), missing(c("h2.headers"))), lambda x: F.struct(F.lit(False).alias("optional"), x.alias("name"), F.lit(None).cast("string").alias("value"))).alias("habsent"),
        either(agent, http.first_value(c("response.headers"), "server"), F.when(client, agent).otherwise(last("server"))).alias("software"), agent.alias("user_agent"), http.language(accept).alias("lang"),
        F.coalesce("h2.method", F.get(c("request.first"), F.lit(0))).alias("method"), F.coalesce("h2.uri", F.get(c("request.first"), F.lit(1))).alias("uri"), F.coalesce("h2.status", F.get(c("response.first"), F.lit(1))).try_cast("int").alias("status_code"), F.when(client, F.coalesce("h2.cookies", "request.cookies")).alias("cookies"), F.coalesce("h2.referer", "request.referer").alias("referer"),
        either(c("request.header_count"), c("response.header_count"), F.size("h2.headers")).alias("header_count"), either(c("request.malformed"), c("response.malformed"), F.lit(False)).alias("malformed"), either(c("request.duplicates"), c("response.duplicates"), F.lit(False)).alias("duplicates"),
    )


TLS_SCHEMA = f"capture string, packet_no long, hello {wire.HELLO}"


def tls_hellos(segments: DataFrame, reassemble: bool = True) -> DataFrame:
    """ClientHellos: capture, packet_no (that completes it), hello. Segments of one direction are joined in order of arrival for 20 s from the first record; without reassemble each segment stands alone."""
    data = segments.where(F.octet_length("payload") > 0)
    start = (F.octet_length("payload") >= 5) & (F.hex(F.substring("payload", 1, 2)) == "1603") & (F.hex(F.substring("payload", 3, 1)) <= "04")
    if not reassemble:
        return data.where(start).select("capture", "packet_no", wire.parse_client_hello("payload").alias("hello")).where("hello.version IS NOT NULL")
    return told(_payloads(data), False, True, False, only=("capture", "packet_no", "hello")).where("hello IS NOT NULL")

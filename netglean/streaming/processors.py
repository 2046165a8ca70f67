"""Uptime, TLS and HTTP flows over streams: state by key with a lifetime in event time, the same steps as in batch.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider. Late rows beyond the watermark are dropped.

Each kind of flow is a fold: how a packet changes a key's state, and what it tells. Processors keep the state: of each key apart, or of many keys together, of which at most a number
stay. A stream may begin with the state that a batch ended with (after_uptimes(), after_tls(), after_http()); together they then tell what one batch of all packets would.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from netglean.functions import uptime
from netglean.operators import flows, wire

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "30 seconds"


class Uptimes:
    """State: uptime.Anchor of a direction and role."""

    key = ("capture", "src", "sport", "dst", "dport", "role")
    life = uptime.LIFETIME_MS
    state, names = "since long, ref_ms long, ref long, bad boolean", ("since", "ref_ms", "ref", "bad")
    out = "capture string, packet_no long, role string, tsval long, raw_hz double"

    @staticmethod
    def load(state: tuple) -> uptime.Anchor:
        return uptime.Anchor(*state)

    @staticmethod
    def dump(anchor: uptime.Anchor) -> tuple:
        return tuple(anchor)

    @staticmethod
    def step(anchor: uptime.Anchor | None, r: Row) -> tuple[uptime.Anchor, Row | None]:
        anchor, hz = uptime.step(anchor, r["t_ms"], r["tsval"])
        return anchor, Row(capture=r["capture"], packet_no=r["packet_no"], role=r["role"], tsval=r["tsval"], raw_hz=hz) if hz is not None else None


class Reading(NamedTuple):
    since: int
    reader: wire.HelloReader


class Hellos:
    """State: what has come of a direction's ClientHello."""

    key = ("capture", "src", "sport", "dst", "dport")
    life = flows.TLS_LIFE_MS
    state, names = "since long, buffer binary", ("since", "buffer")
    out = flows.TLS_SCHEMA

    @staticmethod
    def load(state: tuple) -> Reading:
        reader = wire.HelloReader()
        reader.buffer = bytes(state[1])
        return Reading(state[0], reader)

    @staticmethod
    def dump(now: Reading) -> tuple:
        return now.since, now.reader.buffer

    @staticmethod
    def step(now: Reading | None, r: Row) -> tuple[Reading | None, Row | None]:
        raw = bytes(r["payload"])
        if now is not None and r["t_ms"] - now.since >= flows.TLS_LIFE_MS:
            now = None
        if now is None:
            if not wire.is_tls(raw):
                return None, None
            now = Reading(r["t_ms"], wire.HelloReader())
        hello = now.reader.add(raw)
        return None if now.reader.done else now, Row(capture=r["capture"], packet_no=r["packet_no"], hello=_row(hello)) if hello is not None else None


class Messages:
    """State: flows.HttpFlow."""

    key = ("flow",)
    life = flows.HTTP_LIFE_MS
    state = "since long, forward boolean, request array<struct<seq: long, data: binary>>, response array<struct<seq: long, data: binary>>, done_request boolean, done_response boolean, closed boolean"
    names = ("since", "forward", "request", "response", "done_request", "done_response", "closed")
    out = flows.HTTP_SCHEMA

    @staticmethod
    def load(state: tuple) -> flows.HttpFlow:
        flow = flows.HttpFlow(state[0], state[1])
        flow.take(tuple([(p[0], bytes(p[1])) for p in side] for side in state[2:4]), list(state[4:6]), state[6])
        return flow

    @staticmethod
    def dump(flow: flows.HttpFlow) -> tuple:
        return flow.since, flow.forward, *flow.parts, *flow.done, flow.closed

    @staticmethod
    def step(flow: flows.HttpFlow | None, r: Row) -> tuple[flows.HttpFlow | None, Row | None]:
        flow, found = flows.http_step(flow, r["t_ms"], r["forward"], r["flags"], r["seq"], bytes(r["payload"] or b""))
        return flow, Row(capture=r["capture"], packet_no=r["packet_no"], flow=r["flow"], side=found[0], bytes=found[1], h2=_row(found[2])) if found else None


def _row(value):
    """Dicts, also in lists, as rows."""
    if isinstance(value, dict):
        return Row(**{k: _row(v) for k, v in value.items()})
    return [_row(v) for v in value] if isinstance(value, list) else value


class Each(StatefulProcessor):
    """State of each key apart, whose first field is when it began; its own timer clears it, not one of a state before."""

    def __init__(self, fold: type):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update(tuple(initialState[f] for f in self.fold.names))
        self.handle.registerTimer(initialState["since"] + self.fold.life)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.fold.load(self.state.get()) if self.state.exists() else None
        began = now.since if now is not None else None
        had = now is not None
        for r in sorted(rows, key=lambda r: r.packet_no):
            now, out = self.fold.step(now, r)
            if out is not None:
                yield out
        if now is not None:
            self.state.update(self.fold.dump(now))
            if now.since != began:
                self.handle.registerTimer(now.since + self.fold.life)
        elif had:
            self.state.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists() and self.state.get()[0] + self.fold.life <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class Bounded(StatefulProcessor):
    """States of many keys (column entry) together. When more than most are open, the one that began first goes, of equals the least key; a timer of each clears it at its end."""

    def __init__(self, fold: type, most: int):
        self.fold, self.most = fold, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getMapState("states", "entry string", self.fold.state)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        since = {k[0]: v[0] for k, v in self.states.iterator()}
        self.states.updateValue((initialState["entry"],), tuple(initialState[f] for f in self.fold.names))
        since[initialState["entry"]] = initialState["since"]
        self.handle.registerTimer(initialState["since"] + self.fold.life)
        if len(since) > self.most:
            self.states.removeKey((min(since, key=lambda k: (since[k], k)),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        since = {k[0]: v[0] for k, v in self.states.iterator()}
        before = set(since)
        oldest = [(s, k) for k, s in since.items()]
        heapq.heapify(oldest)
        met: dict = {}
        for r in sorted(rows, key=lambda r: r.packet_no):
            k = r["entry"]
            now = met[k] if k in met else self.fold.load(self.states.getValue((k,))) if k in since else None
            met[k], out = self.fold.step(now, r)
            if out is not None:
                yield out
            if met[k] is None:
                since.pop(k, None)
            elif since.get(k) != met[k].since:
                since[k] = met[k].since
                heapq.heappush(oldest, (since[k], k))
                self.handle.registerTimer(since[k] + self.fold.life)
            while len(since) > self.most:
                s, k = heapq.heappop(oldest)
                if since.get(k) == s:
                    del since[k]
                    met[k] = None
        for k, now in met.items():
            if now is not None:
                self.states.updateValue((k,), self.fold.dump(now))
            elif k in before:
                self.states.removeKey((k,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ended = [k for k, v in self.states.iterator() if v[0] + self.fold.life <= expiredTimerInfo.getExpiryTimeInMs()]
        for k in ended:
            self.states.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def _entry(fold: type) -> Column:
    return F.to_json(F.array(*(F.col(c).cast("string") for c in fold.key)))


def _stream(data: DataFrame, fold: type, initial: DataFrame | None, most: int | None, buckets: int | None) -> DataFrame:
    """What fold tells of data. most: open states that are kept at most, dealt evenly to buckets (the session's shuffle partitions, if none are given), each of which keeps its latest."""
    key = list(fold.key)
    if most is None:
        begin = initial.groupBy(*key) if initial is not None else None
        return data.groupBy(*key).transformWithState(Each(fold), fold.out, "append", "EventTime", begin)
    n = min(buckets or int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), most)
    dealt = lambda df: df.withColumn("entry", _entry(fold)).withColumn("bucket", F.pmod(F.xxhash64("entry"), F.lit(n))).groupBy("bucket")
    return dealt(data).transformWithState(Bounded(fold, most // n), fold.out, "append", "EventTime", dealt(initial) if initial is not None else None)


def _after(data: DataFrame, fold: type) -> DataFrame:
    """The states that are open after data (of a batch), key columns and state: one pass over each key's packets in order."""
    key = list(fold.key)
    kinds = StructType([data.schema[c] for c in key] + StructType.fromDDL(fold.state).fields)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, rows = None, None, []
        ended = lambda: [dict(zip(kinds.names, (*last, *_plain(fold.dump(now)))))] if now is not None else []
        for b in batches:
            for r in b.to_pylist():
                if (k := tuple(r[c] for c in key)) != last:
                    rows += ended()
                    last, now = k, None
                now, _ = fold.step(now, r)
            yield pa.RecordBatch.from_pylist(rows, arrow)
            rows = []
        yield pa.RecordBatch.from_pylist(ended(), arrow)

    return data.repartition(*key).sortWithinPartitions(*key, "packet_no").mapInArrow(run, kinds)


def _plain(state: tuple) -> tuple:
    """Segments of a state as dicts."""
    return tuple([{"seq": s, "data": d} for s, d in v] if isinstance(v, list) else v for v in state)


def _samples(observed: DataFrame) -> DataFrame:
    return observed.where("tcp_ts IS NOT NULL AND ts IS NOT NULL").select("capture", "packet_no", "ts", "src", "sport", "dst", "dport", "role", F.unix_millis("ts").alias("t_ms"), F.col("tcp_ts.val").alias("tsval"))


def _payloads(segments: DataFrame) -> DataFrame:
    return segments.where((F.octet_length("payload") > 0) & F.col("ts").isNotNull()).withColumn("t_ms", F.unix_millis("ts"))


def _both_ways(segments: DataFrame) -> DataFrame:
    return flows.flow_key(segments.where("ts IS NOT NULL")).withColumn("t_ms", F.unix_millis("ts"))


def after_uptimes(observed: DataFrame) -> DataFrame:
    """Anchors after a batch of decode.observe()'s rows, for uptime_stream()."""
    return _after(_samples(observed).drop("ts"), Uptimes)


def after_tls(segments: DataFrame) -> DataFrame:
    """Hellos that are open after a batch of decode.decode()'s segments, for tls_stream()."""
    return _after(_payloads(segments).select(*Hellos.key, "packet_no", "t_ms", "payload"), Hellos)


def after_http(segments: DataFrame) -> DataFrame:
    """Connections that are open after a batch of decode.decode()'s segments, for http_stream()."""
    return _after(_both_ways(segments).select("capture", "flow", "packet_no", "t_ms", "forward", "flags", "seq", "payload"), Messages)


def uptime_stream(observed: DataFrame, initial: DataFrame | None = None, most: int | None = None, buckets: int | None = None) -> DataFrame:
    """decode.observe()'s rows of a stream that tell an uptime."""
    told = _stream(_samples(observed).withWatermark("ts", WATERMARK), Uptimes, initial, most, buckets)
    told = told.withColumn("hz", uptime.rounded(F.col("raw_hz")))
    return told.select("capture", "packet_no", "role", "hz", uptime.split(F.col("tsval"), F.col("hz")).alias("u")).select("capture", "packet_no", "role", "hz", "u.*")


def tls_stream(segments: DataFrame, initial: DataFrame | None = None, most: int | None = None, buckets: int | None = None) -> DataFrame:
    """decode.decode()'s segments of a stream as hellos."""
    return _stream(_payloads(segments).withWatermark("ts", WATERMARK), Hellos, initial, most, buckets)


def http_stream(segments: DataFrame, initial: DataFrame | None = None, most: int | None = None, buckets: int | None = None) -> DataFrame:
    """decode.decode()'s segments of a stream as the first request and response of each connection."""
    out = _stream(_both_ways(segments).withWatermark("ts", WATERMARK), Messages, initial, most, buckets)
    return out.withColumn("text", F.when(F.is_valid_utf8(F.col("bytes").cast("string")), F.col("bytes").cast("string")))

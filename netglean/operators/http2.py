"""HTTP/2 client fingerprints from bytes: of a whole column, and of a direction's segments as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.functions import akamai
from netglean.operators import flows, wire


def with_fingerprint(df: DataFrame, data: str, name: str = "akamai") -> DataFrame:
    """df with the STRUCT<text, hash> of the frames in a binary column, with or without the preface; null without settings, or if the first headers can't be decoded."""
    read = df.withColumn("_frames", wire.parse_frames(F.col(data))).withColumn("_pseudo", wire.parse_pseudo_headers(F.col(data)))
    return read.withColumn(name, F.when(F.col("_pseudo").isNotNull(), akamai.fingerprint(F.col("_frames"), F.col("_pseudo")))).drop("_frames", "_pseudo")


class FrameReader:
    """A connection's bytes as they come: add() gives the bytes of the frames that are whole since the last call.

    Frames of earlier calls aren't looked at again, so a fingerprint has only what comes together with the settings.
    """

    def __init__(self):
        self.buffer, self.started = b"", False

    def add(self, data: bytes) -> bytes:
        self.buffer += data
        start = len(wire.PREFACE) if not self.started and self.buffer.startswith(wire.PREFACE) else 0
        found, end = wire.frames(self.buffer[start:], skip_preface=False)
        if not found:
            return b""
        out, self.buffer, self.started = self.buffer[start : start + end], self.buffer[start + end :], True
        return out


def has_settings(data: bytes) -> bool:
    first = next((p for k, s, _, p in wire.frames(data, skip_preface=False)[0] if k == akamai.SETTINGS and not s), b"")
    return len(first) >= 6


def fingerprints(segments: DataFrame) -> DataFrame:
    """The first fingerprint of each direction of each connection: capture, packet_no (that completes it), src, sport, dst, dport, text and hash.

    A SYN begins another connection. Segments count in order of arrival.
    """
    key = ["capture", "src", "sport", "dst", "dport"]
    syn = F.col("flags").bitwiseAND(2) != 0
    data = segments.where(syn | (F.octet_length("payload") > 0)).select(*key, "packet_no", syn.alias("syn"), F.col("payload").cast("binary").alias("payload"))

    def start():
        reader, done = FrameReader(), False

        def step(r):
            nonlocal reader, done
            if r["syn"]:
                reader, done = FrameReader(), False
            frames = b"" if done else reader.add(r["payload"] or b"")
            if not has_settings(frames) or wire.pseudo_headers(frames) is None:
                return []
            done = True
            return [{**{c: r[c] for c in (*key, "packet_no")}, "frames": frames}]

        return step

    kinds = {f.name: f.dataType.simpleString() for f in data.schema}
    out = flows._in_order(data, key, start, ", ".join(f"{c} {kinds[c]}" for c in (*key, "packet_no")) + ", frames binary")
    return with_fingerprint(out, "frames", "f").select(*key, "packet_no", "f.text", "f.hash")

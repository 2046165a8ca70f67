"""Capture files as a Spark data source: spark.read.format("pcap").load(path), and as a stream over a folder of rotated files.

The files of a folder, in order of their names, are one capture, so that connections go on from one file to the next. A packet's number is FILE times
that of its file, which begins at 0, and its own in the file. A stream counts the files that it saw before.
The data source opens files as local paths, so all machines must see the folder (read_pcap() reads any store that Spark reads, and a large file in many tasks). It reads a file's packets one by one.
"""

from __future__ import annotations

import io
import json
import os
import struct
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import islice
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "capture string, packet_no long, ts timestamp, orig_len int, data binary"
FILE = 1 << 40
SETTLE_NS = 200_000_000
#: A longer one is taken for damage.
MOST_PACKET = 1 << 24
#: Magic numbers of the classic format, with the byte order and the fraction's unit.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}


def packets(data: bytes | BinaryIO) -> Iterator[tuple[int, datetime, int, bytes]]:
    """Number, time, original length and bytes of each packet of a capture in memory or in an open file; a damaged tail ends it, other formats hold none."""
    file = io.BytesIO(data) if isinstance(data, bytes) else data
    if (kind := MAGIC.get((head := file.read(24))[:4])) is None or len(head) < 24:
        return
    (order, unit), no = kind, 0
    while len(head := file.read(16)) == 16:
        sec, frac, size, orig = struct.unpack(f"{order}IIII", head)
        if size > MOST_PACKET or len(raw := file.read(size)) < size:
            return
        yield no, datetime.fromtimestamp(sec, timezone.utc).replace(microsecond=min(frac // unit, 999_999)), orig, raw
        no += 1


def write_pcap(rows: Iterator[tuple[float, bytes]], linktype: int = 1) -> bytes:
    """A classic little-endian capture of (time in seconds, bytes)."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, linktype)]
    for ts, data in rows:
        out.append(struct.pack("<IIII", int(ts), round(ts % 1 * 1e6) % 1_000_000, len(data), len(data)) + data)
    return b"".join(out)


def _files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, f) for f in os.listdir(path) if not f.startswith((".", "_")))
    return [path]


class _File(InputPartition):
    def __init__(self, path: str, capture: str, number: int):
        super().__init__((path, capture, number))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        return [_File(f, self.path, i) for i, f in enumerate(_files(self.path))]

    def read(self, partition: _File) -> Iterator[tuple]:
        path, capture, number = partition.value
        with open(path, "rb") as f:
            for no, ts, orig, raw in packets(f):
                yield capture, FILE * number + no, ts, orig, raw


class _StreamReader(DataSourceStreamReader):
    """Each batch has the files that came after those before, a partition for each; within a batch they go by their names, and a file's number says how many came before.

    Files come in the order of their inodes' last change, which a rename into the folder is; an offset is the last one's time and name and the count, whatever the number of files. Files must come whole, by a rename, and stay as
    they are. The newest files are listed again SETTLE_NS after they came, so that no other of the same moment is missed.

    most: files of a batch at most (without it all that are there); it needs position, a file of this query alone that remembers the last offset, as Spark doesn't tell a source where it stands. After a crash a batch may have
    up to twice as many. A trigger that ends when all is read (availableNow) asks for one batch only.
    """

    def __init__(self, path: str, most: int | None = None, position: str | None = None):
        if most is not None and not position:
            raise ValueError("maxFilesPerTrigger needs position")
        self.path, self.most, self.position, self.at = path, most, position, None

    def _came(self) -> list[tuple[int, str]]:
        return sorted((os.stat(f).st_ctime_ns, os.path.basename(f)) for f in _files(self.path))

    def initialOffset(self) -> dict:
        return {"time": 0, "name": "", "count": 0}

    def latestOffset(self) -> dict:
        if self.at is None and self.position and os.path.exists(self.position):
            with open(self.position, encoding="utf-8") as f:
                self.at = json.load(f)
        at, came = self.at or self.initialOffset(), self._came()
        if came and (wait := came[-1][0] + SETTLE_NS - time.time_ns()) > 0:
            time.sleep(min(wait, SETTLE_NS) / 1e9)
            came = [x for x in self._came() if x <= came[-1]]
        new = [x for x in came if x > (at["time"], at["name"])]
        if self.most is not None:
            new = new[: self.most]
        if new:
            self.at = {"time": new[-1][0], "name": new[-1][1], "count": at["count"] + len(new)}
            if self.position:
                with open(f"{self.position}.half", "w", encoding="utf-8") as f:
                    json.dump(self.at, f)
                os.replace(f"{self.position}.half", self.position)
        return self.at or at

    def partitions(self, start: dict, end: dict) -> list[_File]:
        low, high = ((x["time"], x["name"]) for x in (start, end))
        if self.at is None or (self.at["time"], self.at["name"]) < high:
            self.at = end
        names = sorted(name for when, name in self._came() if low < (when, name) <= high)
        return [_File(os.path.join(self.path, n) if os.path.isdir(self.path) else self.path, self.path, start["count"] + i) for i, n in enumerate(names)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _Reader(self.path).read(partition)

    def commit(self, end: dict) -> None:
        pass


class PcapSource(DataSource):
    """Options: path, a file or a folder; of streams also maxFilesPerTrigger and position."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        most = self.options.get("maxFilesPerTrigger")
        return _StreamReader(self.options["path"], int(most) if most else None, self.options.get("position"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of files of any size in any store that Spark reads, a file's blocks in many tasks (netglean.sources.capture). Several files are one capture, path."""
    from netglean.sources import capture

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")).select("path", F.xxhash64("path").alias("file"))
    found = sorted((r["path"], r["file"]) for r in files.collect())
    if len({f for _, f in found}) < len(found):
        raise ValueError("two paths have the same hash")
    return capture.read(spark, path, path if len(found) > 1 else found[0][0] if found else path, {f: FILE * i for i, (_, f) in enumerate(found)})


def parse_files(files: DataFrame, named: Callable[[str], tuple[str, int]] = lambda path: (path, 0)) -> DataFrame:
    """Packets of files (path, content). named: the capture that a path belongs to, and the number of its first packet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"]):
                capture, base = named(name)
                every = ((capture, base + no, *p) for no, *p in packets(bytes(data)))
                while rows := list(islice(every, 10_000)):
                    yield pd.DataFrame(rows, columns=["capture", "packet_no", "ts", "orig_len", "data"])

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def from_bytes(spark: SparkSession, raw: list[bytes], capture: str = "memory") -> DataFrame:
    """Packets held in memory, numbered in order, without times."""
    return spark.createDataFrame([(capture, i, None, len(r), bytearray(r)) for i, r in enumerate(raw)], SCHEMA)

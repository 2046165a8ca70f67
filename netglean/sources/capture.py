"""Capture files of any size over many tasks, from any store that Spark reads.

Spark splits a file into blocks; a block's bytes come as its lines, in order, and are put together again. Two passes read the file. The first finds where records begin in each block: from a
candidate header a chain of headers must follow that fit in time, length and byte order. It tells for each block its size, where its first record
begins, how many begin in it and where the next one would, a few numbers. The driver follows these from block to block (from the file's header on, each block's end says where the next one's first
record must begin), so a header that is planted inside a payload is found out: blocks that began elsewhere are indexed again from the right place. The counts then number the packets. The second
pass parses each block from its known place; the one record that crosses a border is in pieces in the first pass's table, which meet by the packet's number.

A file whose magic number is unknown holds no packets; a record longer than pcap.MOST_PACKET, or a cut tail, ends its file, as in pcap.packets(). What the driver holds is a row of
a few numbers for each block of a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netglean.sources import pcap
from netglean.sources.shared import kept

#: A chain of so many headers makes a candidate the first record; it is looked for in a block's first WINDOW bytes.
CHAIN, WINDOW = 24, 1 << 22
#: Most seconds between neighbouring packets of a chain.
GAP = 7 * 86400
HEADER, FILE_HEADER = 16, 24
_INDEX = "file long, block long, size long, first binary, order string, sync long, n long, next long, partial binary, head binary, tail binary"
_PIECES = "no long, piece long, order string, unit int, data binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_INDEX_ARROW, _PIECES_ARROW = (pa.schema([(n, _KINDS[k]) for n, k in map(str.split, x.split(", "))]) for x in (_INDEX, _PIECES))
_ROWS = 10_000


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of bytes in order, with their file (a hash of its path) and where their block begins."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """File and block, and some of its bytes, in order. A file's last line may get a line feed that isn't there; one stray byte is no record."""
    for b in batches:
        file, block = (b.column(c).to_numpy() for c in ("file", "block"))
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for a, z in pairwise([0, *cuts.tolist(), b.num_rows]):
            if z > a:
                yield (int(file[a]), int(block[a])), b"\n".join(b.column("line").slice(a, z - a).to_pylist()) + b"\n"


def resync(data: bytes) -> tuple[int, str] | None:
    """Where the first record header of data may be, and its byte order: the first place from which CHAIN headers follow each other, or as many (at least one) as there are."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(raw) - HEADER + 1
    found = []
    for order in "<>":
        if n <= 0:
            continue
        weights = [1, 1 << 8, 1 << 16, 1 << 24][:: 1 if order == "<" else -1]
        word = lambda at: sum(w * raw[at + i : at + i + n] for i, w in enumerate(weights))  # noqa: B023, E731
        size, full = word(8), word(12)
        ok = (word(0) > 0) & (word(4) < 1_000_000_000) & (size > 0) & (size <= full) & (full <= pcap.MOST_PACKET)
        for at in np.flatnonzero(ok).tolist():
            if found and at >= found[0][0]:
                break
            if _chained(data, at, order):
                found = [(at, order)]
                break
    return found[0] if found else None


def _chained(data: bytes, at: int, order: str) -> bool:
    before = None
    for _ in range(CHAIN):
        if at + HEADER > len(data):
            return True
        sec, frac, size, full = struct.unpack_from(f"{order}IIII", data, at)
        if frac >= 1_000_000_000 or not size <= full <= pcap.MOST_PACKET or before is not None and abs(sec - before) > GAP:
            return False
        before, at = sec, at + HEADER + size
    return True


class _Walk:
    """Steps from header to header through the bytes of one block as they come."""

    def __init__(self, start: int | None, order: str | None):
        self.start, self.order, self.at = start, order, start  # where the first record begins, and where the next one does
        self.n, self.end, self.damaged = 0, 0, False
        self.kept, self.base = bytearray(), 0  # bytes still needed, and where they begin
        self.first, self.head, self.tail = b"", bytearray(), b""  # the block's first bytes, those before its first record, those of a record that isn't whole

    def add(self, data: bytes, last: bool = False) -> Iterator[tuple[tuple[int, int, int], bytes]]:
        """Seconds, fraction and original length, and the bytes, of each record that data completes."""
        if self.start is not None:
            self.head += data[: max(self.start - self.end, 0)]
        self.kept += data
        self.end += len(data)
        self.first += data[: max(FILE_HEADER - len(self.first), 0)]
        if self.at is None and not self.damaged and (last or len(self.kept) >= WINDOW):
            if found := resync(bytes(self.kept)):
                self.at, self.order = found
                self.start, self.head = self.at, self.kept[: self.at]
            self.damaged = found is None
        if self.damaged:
            self.kept.clear()
        if self.damaged or self.at is None:
            return
        pos, have = self.at - self.base, len(self.kept)
        while pos + HEADER <= have:
            sec, frac, size, orig = struct.unpack_from(f"{self.order}IIII", self.kept, pos)
            stop = pos + HEADER + size
            if size > pcap.MOST_PACKET:
                self.damaged = True
                break
            if stop > have and not last:
                break
            self.n += 1
            if stop <= have:
                yield (sec, frac, orig), bytes(self.kept[pos + HEADER : stop])
            else:
                self.tail = bytes(self.kept[pos:])
            pos = stop
        self.at = self.base + pos
        if last and 0 <= pos < have and not self.damaged:
            self.tail = bytes(self.kept[pos:])
        drop = min(pos, have)
        if drop > WINDOW:
            del self.kept[:drop]
            self.base += drop


def index(spark: SparkSession, path: str | list[str], starts: dict) -> tuple[DataFrame, list[dict]]:
    """A row for each block of the files: where records begin as far as the block itself tells, or from starts. The written table also has the bytes of the records that cross borders; the list, in order, only numbers."""

    def row(key: tuple[int, int], walk: _Walk) -> dict:
        for _ in walk.add(b"", True):
            pass
        known = walk.start is not None
        inside = len(walk.tail) if 0 < len(walk.tail) < HEADER else 0  # of a header that the border cuts
        return dict(file=key[0], block=key[1], size=walk.end, first=walk.first, order=walk.order, sync=walk.start, n=walk.n, next=walk.at if known and not walk.damaged else None, partial=walk.tail[:inside], head=bytes(walk.head) if key[1] else b"", tail=walk.tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk = None, None
        for k, data in _pieces(batches):
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([row(key, walk)], _INDEX_ARROW)
                key = k
                walk = _Walk(*starts.get(k, (FILE_HEADER, pcap.MAGIC.get(data[:4], "<")[0]) if k[1] == 0 else (None, None)))
            for _ in walk.add(data):
                pass
        if key is not None:
            yield pa.RecordBatch.from_pylist([row(key, walk)], _INDEX_ARROW)

    table = kept(_lines(spark, path).mapInArrow(run, _INDEX), "capture-index")
    return table, sorted((r.asDict() for r in table.drop("head", "tail").collect()), key=lambda r: (r["file"], r["block"]))


def follow(rows: list[dict]) -> tuple[dict, dict]:
    """Of one file's blocks in order: (file, block) to (where its first record begins, byte order, that one's number, unit of fractions), and the starts of blocks that began elsewhere.

    After such a block its own end is taken for right until it has been indexed again.
    """
    out, again = {}, {}
    kind = pcap.MAGIC.get(bytes(rows[0]["first"])[:4]) if rows[0]["block"] == 0 and len(rows[0]["first"]) == FILE_HEADER else None
    if kind is None:
        return out, again
    order, unit = kind
    begins, due, no, head = 0, FILE_HEADER, 0, b""  # where the block begins and the next record does, that one's number, and what of its header lies before the block
    for r in rows:
        key, size = (r["file"], r["block"]), r["size"]
        if head:  # its length is known with the block's first bytes
            head += bytes(r["first"])[: HEADER - len(head)]
            if len(head) == HEADER:
                length = struct.unpack(f"{order}IIII", head)[2]
                if length > pcap.MOST_PACKET:
                    break
                due, no, head = due + HEADER + length, no + 1, b""
        start = min(size, due - begins) if not head else size
        out[key] = (start, order, no + bool(head), unit)
        if r["sync"] != start or r["order"] != order:
            again[key] = (start, order)
        if start < size:
            if r["next"] is None:  # damage, which ends the file, or nothing found before the block is indexed again
                break
            no, due, head = no + r["n"], begins + r["next"], bytes(r["partial"])
        begins += size
    return out, again


def plan(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, dict]:
    """The index of files and follow() of every file, with blocks indexed again until each begins where the one before ends."""
    starts: dict = {}
    while True:
        table, rows = index(spark, path, starts)
        by_file: dict = {}
        for r in rows:
            by_file.setdefault(r["file"], []).append(r)
        out, again = {}, {}
        for own in by_file.values():
            a, b = follow(own)
            out |= a
            again |= b
        if not again:
            return table, out
        starts = starts | again


def _packets(capture: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of number, microseconds, original length and bytes."""
    no, us, orig, data = zip(*rows) if rows else ((), (), (), ())
    times = pa.array(us, pa.int64()).cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array([capture] * len(no), pa.string()), pa.array(no, pa.int64()), times, pa.array([x - (x >> 31 << 32) for x in orig], pa.int32()), pa.array(data, pa.binary())], ["capture", "packet_no", "ts", "orig_len", "data"])


def _us(sec: int, frac: int, unit: int) -> int:
    return sec * 1_000_000 + min(frac // unit, 999_999)


def read(spark: SparkSession, path: str | list[str], capture: str, numbers: dict[int, int]) -> DataFrame:
    """Packets (pcap.SCHEMA) of files. numbers: what is added to the packets' numbers of each file, by the hash of its path."""
    table, where = plan(spark, path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk, rows = None, None, []

        def take(found: Iterator[tuple]) -> None:
            for (sec, frac, orig), data in found:
                rows.append((walk.no, _us(sec, frac, walk.unit), orig, data))
                walk.no += 1

        for k, data in _pieces(batches):
            if k != key:
                if walk is not None:
                    take(walk.add(b"", True))
                key, walk = k, None
                if k in where:
                    start, order, no, unit = where[k]
                    walk = _Walk(start, order)
                    walk.no, walk.unit = numbers[k[0]] + no, unit
            if walk is not None:
                take(walk.add(data))
            while len(rows) >= _ROWS:
                yield _packets(capture, rows[:_ROWS])
                del rows[:_ROWS]
        if walk is not None:
            take(walk.add(b"", True))
        yield _packets(capture, rows)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (k := (r["file"], r["block"])) in where:
                    _, order, no, unit = where[k]
                    no += numbers[r["file"]]
                    # a record whose header is whole is counted where it begins
                    for at, data, part in ((no - 1, r["head"], 0), (no + r["n"] - (len(r["tail"]) >= HEADER), r["tail"], 1)):
                        if data:
                            out.append(dict(no=at, piece=2 * r["block"] + part, order=order, unit=unit, data=data))
            yield pa.RecordBatch.from_pylist(out, _PIECES_ARROW)

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        raw, order = b"".join(t.column("data").to_pylist()), t.column("order")[0].as_py()
        rows = []
        if len(raw) >= HEADER:
            sec, frac, size, orig = struct.unpack_from(f"{order}IIII", raw)
            if size <= min(pcap.MOST_PACKET, len(raw) - HEADER):
                rows = [(t.column("no")[0].as_py(), _us(sec, frac, t.column("unit")[0].as_py()), orig, raw[HEADER : HEADER + size])]
        return pa.Table.from_batches([_packets(capture, rows)])

    cut = table.mapInArrow(pieces, _PIECES).groupBy("no").applyInArrow(joined, pcap.SCHEMA)  # a record for each border of blocks
    return _lines(spark, path).mapInArrow(whole, pcap.SCHEMA).unionByName(cut)

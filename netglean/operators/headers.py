"""Header fields of whole Arrow batches of packets with numpy: all rows at once, no loop over packets. A position past a packet's end gives MISSING."""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -1
ETHERNET_V4, ETHERNET_V6, TCP = 0x0800, 0x86DD, 6
#: Names of TCP option kinds.
OPTION_NAMES = {1: "nop", 2: "mss", 3: "ws", 4: "sok", 5: "sack", 8: "ts"}
_OPTION_QUIRKS = ("opt+", "exws", "ts1-", "ts2+")
OPTIONS = "STRUCT<layout: ARRAY<STRING>, mss: INT, wscale: INT, quirks: ARRAY<STRING>, ts: STRUCT<val: BIGINT, ecr: BIGINT>, malformed: BOOLEAN>"
_DECIMAL = pa.array([str(i) for i in range(256)])


class Octets:
    """Bytes of a BINARY column's rows; a null has none."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, b"").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.start, self.size = offsets[:-1], np.diff(offsets)

    def at(self, position: np.ndarray | int) -> np.ndarray:
        """One byte of each row."""
        there = (position >= 0) & (position < self.size)
        return np.where(there, self.data[np.where(there, self.start + position, 0)].astype(np.int64), MISSING)

    def number(self, position: np.ndarray | int, n: int) -> np.ndarray:
        """A big-endian unsigned number of n bytes of each row."""
        out, there = np.zeros(len(self.size), np.int64), np.ones(len(self.size), bool)
        for i in range(n):
            b = self.at(position + i)
            out, there = out * 256 + b, there & (b != MISSING)
        return np.where(there, out, MISSING)

    def cut(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """Bytes from start to end of each row, as far as they are there."""
        end = np.minimum(end, self.size)
        count = np.maximum(end - start, 0)
        ends = np.cumsum(count)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start + start - (ends - count), count)
        return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(self.data[at])])

    def ipv4(self, position: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*(_DECIMAL.take(pa.array(np.maximum(self.at(position + i), 0))) for i in range(4)), ".")

    def address(self, v4: np.ndarray, at4: np.ndarray, at6: np.ndarray) -> pa.Array:
        """Address texts: of IPv4 where v4, else of IPv6 in its shortest form."""
        out = self.ipv4(np.where(v4, at4, 0))
        if v4.all():
            return out
        six = pa.array([None if is4 else str(ipaddress.IPv6Address(self.data[s : s + 16].tobytes())) for is4, s in zip(v4.tolist(), (self.start + at6).tolist())], pa.string())
        return pc.if_else(pa.array(v4), out, six)


def ints(values: np.ndarray, kind: pa.DataType = pa.int32(), mask: np.ndarray | None = None) -> pa.Array:
    return pa.array(values, kind, mask=(values == MISSING) if mask is None else mask)


def walk_options(o: Octets, start: np.ndarray, size: np.ndarray, syn: np.ndarray, strict: bool = False) -> pa.Array:
    """OPTIONS of each row: the option bytes are size bytes from start. All rows step from option to option together; a header has at most 40 bytes of them.

    Beyond a length that doesn't fit the walk goes on at the end, with malformed set; strict: it stops before that option. syn: whether a peer's
    timestamp is out of place. Quirks are in the order met.
    """
    rows, most = len(size), int(size.max(initial=0))
    nonzero = np.zeros((rows, most + 1), bool)  # whether any byte from a position on isn't 0
    for i in reversed(range(most)):
        nonzero[:, i] = nonzero[:, i + 1] | ((i < size) & (o.at(start + i) > 0))
    at, malformed = np.zeros(rows, np.int64), np.zeros(rows, bool)
    mss, scale, val, ecr = (np.full(rows, MISSING) for _ in range(4))
    codes = []
    everyone = np.arange(rows)
    while (going := at < size).any():
        inside = lambda n: np.where(at + n < size, o.at(start + at + n), MISSING)  # noqa: B023, E731
        big = lambda n, k: sum(inside(n + j) << 8 * (k - 1 - j) for j in range(k))  # noqa: B023, E731
        kind, told = inside(0), inside(1)
        length = np.where(kind <= 1, 1, np.maximum(np.where(told == MISSING, 2, told), 2))
        bad = going & (kind > 1) & ((told < 2) | (at + told > size))
        malformed |= bad
        if strict:
            going &= ~bad
        data = np.where(going, np.minimum(at + length, size) - at - 2, 0)
        mss = np.where((kind == 2) & (data >= 2), big(2, 2), mss)
        scale = np.where((kind == 3) & (data >= 1), inside(2), scale)
        stamped = (kind == 8) & (data >= 8)
        mine, theirs = big(2, 4), big(6, 4)
        val, ecr = np.where(stamped, mine, val), np.where(stamped, theirs, ecr)
        quirks = (kind == 0) & nonzero[everyone, np.minimum(at + 1, most)], (kind == 3) & (data >= 1) & (inside(2) > 14), (kind == 8) & (data >= 4) & (mine == 0), stamped & syn & (theirs != 0)
        code = np.where(kind == 0, 256 + size - at - 1, kind) + sum(q.astype(np.int64) << 20 + i for i, q in enumerate(quirks))
        codes.append(np.where(going, code, MISSING).astype(np.int32))
        at = np.where(~going | (kind == 0), size, at + length)
    # headers have few different sequences of options
    seen = np.ascontiguousarray(np.stack([*codes, np.full(rows, MISSING, np.int32)], axis=1))
    _, first, which = np.unique(seen.view(np.dtype((np.void, seen.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
    layouts, quirks = [], []
    for row in seen[first].tolist():
        row = [c for c in row if c != MISSING]
        kinds = [c & 0xFFFFF for c in row]
        layouts.append([f"eol+{k - 256}" if k >= 256 else OPTION_NAMES.get(k, f"?{k}") for k in kinds])
        quirks.append([name for c in row for i, name in enumerate(_OPTION_QUIRKS) if c >> 20 + i & 1])
    which = pa.array(which)
    none = val == MISSING
    ts = pa.StructArray.from_arrays([ints(val, pa.int64()), ints(ecr, pa.int64())], ["val", "ecr"], mask=pa.array(none))
    lists = pa.list_(pa.string())
    return pa.StructArray.from_arrays([pa.array(layouts, lists).take(which), ints(mss), ints(scale), pa.array(quirks, lists).take(which), ts, pa.array(malformed)], ["layout", "mss", "wscale", "quirks", "ts", "malformed"])


def options(raw: Column, syn: Column | bool = True, strict: bool = False) -> Column:
    """walk_options() of a column of option bytes."""

    def walk(column: pa.Array, syns: pa.Array) -> pa.Array:
        o = Octets(column)
        return walk_options(o, np.zeros(len(column), np.int64), o.size, pc.fill_null(syns, False).to_numpy(zero_copy_only=False), strict)

    walk.__annotations__ = {"column": pa.Array, "syns": pa.Array, "return": pa.Array}
    return F.arrow_udf(walk, OPTIONS)(raw, F.lit(syn) if isinstance(syn, bool) else syn)


ENDPOINTS = "src STRING, dst STRING, sport INT, dport INT"


def endpoints(column: pa.Array) -> list[pa.Array]:
    """ENDPOINTS of each packet, null where it isn't plainly TCP."""
    d = Octets(column)
    kind, nibble, family = d.number(12, 2), d.at(0) >> 4, d.at(0)
    o = np.where((d.size >= 14) & np.isin(kind, (ETHERNET_V4, ETHERNET_V6)), 14, np.where(np.isin(nibble, (4, 6)), 0, np.where(np.isin(family, (2, 28, 30)), 4, MISSING)))
    b0 = np.where(o == MISSING, MISSING, d.at(o))
    v4, words = b0 >> 4 == 4, b0 & 15
    is4, is6 = v4 & (d.at(o + 9) == TCP) & (words >= 5), (b0 >> 4 == 6) & (d.at(o + 6) == TCP)
    t = np.where(is4, o + words * 4, o + 40)
    known = (is4 | is6) & (d.size >= t + 4)
    mask = pa.array(~known)
    some = Octets(column.filter(pa.array(known)))
    back = pc.if_else(mask, pa.scalar(None, pa.int64()), pa.array(np.cumsum(known) - 1))
    v4, o, t = v4[known], o[known], t[known]
    return [x.take(back) for x in (some.address(v4, o + 12, o + 8), some.address(v4, o + 16, o + 24), ints(some.number(t, 2)), ints(some.number(t + 2, 2)))]


SEGMENTS = (
    "ip_version INT, src STRING, dst STRING, sport INT, dport INT, ttl INT, words INT, frag INT, ident INT, ecn INT, flow BIGINT, tcp_header INT, flags INT, seq BIGINT, ack BIGINT, window INT, urgent INT, "
    f"option_bytes BINARY, payload BINARY, opt {OPTIONS}"
)


#: Why a packet gives no segment, in the order in which that is judged: no link or IP header that is known, another protocol, a fragment, too few bytes for its headers, flags that no segment has.
REASONS = ("link", "protocol", "fragment", "short", "flags")


def segments(column: pa.Array) -> tuple[pa.Array, list[pa.Array], pa.Array]:
    """Which packets are valid TCP segments, the SEGMENTS fields of those, and each packet's reason for giving none (null for those)."""
    d = Octets(column)
    kind, nibble = d.number(12, 2), d.at(0) >> 4
    o = np.where((d.size >= 14) & np.isin(kind, (ETHERNET_V4, ETHERNET_V6)), 14, np.where((d.size >= 20) & np.isin(nibble, (4, 6)), 0, np.where((d.size >= 24) & (d.number(0, 2) == 0x1E00), 4, MISSING)))
    b0 = np.where(o == MISSING, MISSING, d.at(o))
    v4, v6 = b0 >> 4 == 4, b0 >> 4 == 6
    words = b0 & 15
    whole = (v4 & (words >= 5) & (d.number(o + 6, 2) & 0x3FFF == 0) & (d.at(o + 9) == TCP)) | (v6 & (d.at(o + 6) == TCP))
    t = o + np.where(v4, words * 4, 40)
    flags, tcp_words = d.at(t + 13), d.at(t + 12) >> 4
    has = lambda m: flags & m != 0
    fine = has(0x17) & ~(has(2) & has(5)) & ~(has(1) & has(4))
    enough = (d.size >= t + 20) & (tcp_words >= 5)
    ok = whole & enough & fine
    tcp = np.where(v4, d.at(o + 9), d.at(o + 6)) == TCP
    seen = np.select([~(v4 | v6), ~tcp, v4 & (d.number(o + 6, 2) & 0x3FFF != 0), (v4 & (words < 5)) | ~enough, ~fine], range(5), 5)
    reason = pa.array(REASONS).take(pa.array(seen, mask=ok))
    keep = pa.array(ok)
    d = Octets(column.filter(keep))
    o, t, v4, words, flags = o[ok], t[ok], v4[ok], words[ok], flags[ok]
    pick = lambda a, b: np.where(v4, a, b)
    size = tcp_words[ok] * 4
    stop = o + pick(d.number(o + 2, 2), d.number(o + 4, 2) + 40)
    end = np.minimum(d.size, np.maximum(stop, t + size))
    option_size = np.maximum(np.minimum(t + size, d.size) - t - 20, 0)
    only4 = lambda x: ints(x, mask=~v4)
    return keep, [
        ints(pick(4, 6)), d.address(v4, o + 12, o + 8), d.address(v4, o + 16, o + 24), ints(d.number(t, 2)), ints(d.number(t + 2, 2)), ints(pick(d.at(o + 8), d.at(o + 7))), only4(words), only4(d.number(o + 6, 2)), only4(d.number(o + 4, 2)),
        ints(pick(d.at(o + 1) & 3, d.number(o, 2) >> 4 & 3)), ints(d.number(o, 4) & 0xFFFFF, pa.int64(), v4), ints(size), ints(flags), ints(d.number(t + 4, 4), pa.int64()), ints(d.number(t + 8, 4), pa.int64()), ints(d.number(t + 14, 2)), ints(d.number(t + 18, 2)),
        d.cut(t + 20, t + size), d.cut(t + size, end), walk_options(d, t + 20, option_size, flags & 0x17 == 2),
    ], reason

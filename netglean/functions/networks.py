"""Many networks at once: nested and overlapping blocks of both families become sorted intervals of address bytes that don't touch; an address is looked up by binary search."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEY = "S18"  # family, address filled up to 16 bytes, and a last byte that isn't 0, as numpy drops zeros at the end


def _key(version: int, address: int) -> bytes:
    return bytes([version]) + address.to_bytes(4 if version == 4 else 16, "big").ljust(16, b"\0") + b"\1"


def intervals(networks: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest keys of the union of CIDR blocks, ascending."""
    ends = sorted((n.version, int(n.network_address), int(n.broadcast_address)) for n in (ipaddress.ip_network(x, strict=False) for x in networks))
    out: list[list[int]] = []
    for version, low, high in ends:
        if out and out[-1][0] == version and low <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], high)
        else:
            out.append([version, low, high])
    return np.array([_key(v, a) for v, a, _ in out], _KEY), np.array([_key(v, b) for v, _, b in out], _KEY)


def keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of address texts, each distinct one parsed once, and which are addresses."""
    d = texts.dictionary_encode()
    seen, fine = [], []
    for t in d.dictionary.to_pylist():
        try:
            a = ipaddress.ip_address(t)
            seen.append(_key(a.version, int(a)))
        except ValueError:
            seen.append(b"")
        fine.append(bool(seen[-1]))
    there = d.indices.is_valid().to_numpy(zero_copy_only=False)
    at = d.indices.fill_null(0).to_numpy(zero_copy_only=False)
    if not seen:
        return np.zeros(len(at), _KEY), np.zeros(len(at), bool)
    return np.array(seen, _KEY)[at], np.array(fine)[at] & there


def inside(networks: Iterable[str]) -> Callable[[Column], Column]:
    """A predicate on address texts: whether one of the blocks contains the address. False for null and for what is no address; IPv4 addresses that are written as IPv6 ones are IPv6."""
    low, high = intervals(networks)

    def look(texts: pa.Array) -> pa.Array:
        key, fine = keys(texts)
        if not len(low):
            return pa.array(np.zeros(len(key), bool))
        at = np.searchsorted(low, key, "right") - 1
        return pa.array(fine & (at >= 0) & (key <= high[np.maximum(at, 0)]))

    look.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    found = F.arrow_udf(look, "boolean")
    return lambda ip: found(ip.cast("string"))

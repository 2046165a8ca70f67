"""Filters by port, address and subnet, as predicates on source and destination columns."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from netglean.functions import networks

#: So many IPv4 blocks stay comparisons of numbers; more, and all of IPv6, are looked up among sorted intervals.
FEW_BLOCKS = 8


def _any(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


@dataclass(frozen=True)
class PortFilter:
    """Ports and half-open ranges of each side. A side without any is free; both sides must agree. any_port: one side's match is enough."""

    sources: tuple[int, ...] = ()
    destinations: tuple[int, ...] = ()
    source_ranges: tuple[tuple[int, int], ...] = ()
    destination_ranges: tuple[tuple[int, int], ...] = ()
    either: bool = False

    def source(self, *ports: int) -> PortFilter:
        return replace(self, sources=self.sources + ports)

    def destination(self, *ports: int) -> PortFilter:
        return replace(self, destinations=self.destinations + ports)

    def source_range(self, start: int, end: int) -> PortFilter:
        return replace(self, source_ranges=(*self.source_ranges, (start, max(end - 1, 0))))

    def destination_range(self, start: int, end: int) -> PortFilter:
        return replace(self, destination_ranges=(*self.destination_ranges, (start, max(end - 1, 0))))

    def any_port(self) -> PortFilter:
        return replace(self, either=True)

    @staticmethod
    def _in(c: Column, ports, ranges) -> Column:
        return _any([c.isin(*ports)] * bool(ports) + [c.between(a, b) for a, b in ranges])

    def match(self, sport: Column, dport: Column) -> Column:
        if self.either:
            ports, ranges = self.sources + self.destinations, self.source_ranges + self.destination_ranges
            return self._in(sport, ports, ranges) | self._in(dport, ports, ranges)
        out = F.lit(True)
        for c, ports, ranges in ((sport, self.sources, self.source_ranges), (dport, self.destinations, self.destination_ranges)):
            if ports or ranges:
                out = out & self._in(c, ports, ranges)
        return out


@dataclass(frozen=True)
class IpFilter:
    """Addresses, checked on one side or either. A text that is no address is an error."""

    addresses: tuple[str, ...] = ()
    check_source: bool = True
    check_destination: bool = True

    def allow(self, *addresses: str) -> IpFilter:
        return replace(self, addresses=self.addresses + tuple(str(ipaddress.ip_address(a)) for a in addresses))

    def source_only(self) -> IpFilter:
        return replace(self, check_source=True, check_destination=False)

    def destination_only(self) -> IpFilter:
        return replace(self, check_source=False, check_destination=True)

    def match(self, src: Column, dst: Column) -> Column:
        return _any([c.isin(*self.addresses) for c, on in ((src, self.check_source), (dst, self.check_destination)) if on and self.addresses])


def ip_number(ip: Column) -> Column:
    """An IPv4 text as LONG, else null."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return F.when(ok, sum((F.get(parts, F.lit(i)).try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), F.get(parts, F.lit(0)).try_cast("long") * 256**3))


@dataclass(frozen=True)
class SubnetFilter:
    """CIDR blocks of both families, as many as there are, checked on one side or either."""

    networks: tuple[str, ...] = ()
    check_source: bool = True
    check_destination: bool = True

    def allow(self, *networks: str) -> SubnetFilter:
        return replace(self, networks=self.networks + tuple(str(ipaddress.ip_network(n, strict=False)) for n in networks))

    def source_only(self) -> SubnetFilter:
        return replace(self, check_source=True, check_destination=False)

    def destination_only(self) -> SubnetFilter:
        return replace(self, check_source=False, check_destination=True)

    def _in(self, ip: Column) -> Column:
        blocks = [*map(ipaddress.ip_network, self.networks)]
        if len(blocks) > FEW_BLOCKS or any(n.version == 6 for n in blocks):
            return networks.inside(self.networks)(ip)
        number = ip_number(ip)
        return _any([F.coalesce(number.between(int(n.network_address), int(n.broadcast_address)), F.lit(False)) for n in blocks])

    def match(self, src: Column, dst: Column) -> Column:
        return _any([self._in(c) for c, on in ((src, self.check_source), (dst, self.check_destination)) if on])


@dataclass(frozen=True)
class FilterConfig:
    """All filters that are set must match. allow keeps matches, deny drops them; without filters all pass. Rows whose ports or addresses are unknown pass."""

    mode: str = "allow"
    filters: tuple = field(default=())

    def with_filter(self, f) -> FilterConfig:
        return replace(self, filters=(*self.filters, f))

    def predicate(self, src: Column, dst: Column, sport: Column, dport: Column) -> Column:
        if not self.filters:
            return F.lit(True)
        both = F.lit(True)
        for f in self.filters:
            both = both & (f.match(sport, dport) if isinstance(f, PortFilter) else f.match(src, dst))
        unknown = src.isNull() | dst.isNull() | sport.isNull() | dport.isNull()
        return unknown | (both if self.mode == "allow" else ~both)

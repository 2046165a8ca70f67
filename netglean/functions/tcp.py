"""TCP observations as column expressions: initial TTL, window multiples, options, MTU and the signature's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netglean.functions import octets

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = (1 << i for i in range(8))
#: Ordinary Ethernet MTU, header sizes, timestamp option with padding, largest multiple, farthest distance.
ETHERNET_MTU, HEADERS_V4, HEADERS_V6, TIMESTAMP_BYTES, MOST_MULTIPLE, MOST_HOPS = 1500, 40, 60, 12, 255, 30


def hops(ttl: Column) -> Column:
    """Distance to the least usual initial TTL that is not below."""
    return F.when(ttl > 128, 255 - ttl).when(ttl > 64, 128 - ttl).when(ttl > 32, 64 - ttl).otherwise(32 - ttl)


def ttl_class(ttl: Column) -> Column:
    """STRUCT<kind, ttl, dist>: bad for 0, distance within 30 hops, else value."""
    d = hops(ttl)
    kind = F.when(ttl == 0, "bad").when(d <= MOST_HOPS, "distance").otherwise("value")
    return F.struct(kind.alias("kind"), ttl.cast("int").alias("ttl"), F.when((ttl != 0) & (d <= MOST_HOPS), d.cast("int")).alias("dist"))


def ttl_text(t: Column) -> Column:
    kind, n = t["kind"], t["ttl"].cast("string")
    return F.when(kind == "bad", F.concat(n, F.lit("-"))).when(kind == "distance", F.concat_ws("+", n, t["dist"].cast("string"))).when(kind == "guess", F.concat(n, F.lit("+?"))).otherwise(n)


def window_class(win: Column, mss: Column, header: Column, has_ts: Column, version: Column) -> Column:
    """STRUCT<kind, n>: the first of the known multiples that the window is.

    header is what the caller knows of header bytes; the packet decoder passes IPv4 header words but IPv6 header bytes.
    """
    mss = F.coalesce(mss, F.lit(0))
    made = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"))

    def multiple(kind: str, of: Column, when: Column | None = None) -> Column:
        safe = F.when(of > 0, of)
        ok = (F.pmod(win, safe) == 0) & (F.floor(win / safe) <= MOST_MULTIPLE)
        return F.when(ok if when is None else when & ok, made(kind, F.floor(win / safe)))

    base = F.when(version == 4, HEADERS_V4).when(version == 6, HEADERS_V6)
    tries = [multiple("mss", mss), multiple("mss", mss - TIMESTAMP_BYTES, has_ts)]
    tries += [F.when(win % m == 0, made("mod", F.lit(m))) for m in (4096, 2048, 1024, 512, 256)]
    tries += [multiple("mtu", F.lit(ETHERNET_MTU)), multiple("mtu", ETHERNET_MTU - base), multiple("mtu", ETHERNET_MTU - base - TIMESTAMP_BYTES, has_ts)]
    tries.append(multiple("mtu", F.least(mss + F.when(header > 0, header).otherwise(base), F.lit(65535))))
    plain = made("value", win)
    return F.when((win == 0) | (mss < 100), plain).otherwise(F.coalesce(*tries, plain))


def window_text(w: Column) -> Column:
    kind, n = w["kind"], w["n"].cast("string")
    return F.when(kind == "any", "*").when(kind == "value", n).when(kind == "mod", F.concat(F.lit("%"), n)).otherwise(F.concat_ws("*", kind, n))


def mtu(mss: Column, ip_header: Column, tcp_header: Column, standard: bool = False) -> Column:
    """MSS with the IP header and the TCP options, or with the plain TCP header where there are no options; at most 65535. standard: always the plain header."""
    extra = F.lit(20) if standard else F.when(tcp_header > 20, tcp_header - 20).otherwise(tcp_header)
    return F.least(mss + ip_header + extra, F.lit(65535)).cast("int")


def valid_flags(flags: Column) -> Column:
    """Whether flags make sense: some of SYN, ACK, FIN, RST, no SYN with FIN or RST, no FIN with RST."""
    has = lambda m: flags.bitwiseAND(m) != 0
    return has(SYN | ACK | FIN | RST) & ~(has(SYN) & has(FIN | RST)) & ~(has(FIN) & has(RST))


def from_client(flags: Column) -> Column:
    """A SYN alone; every other segment counts as an answer."""
    return (flags.bitwiseAND(SYN) != 0) & (flags.bitwiseAND(ACK) == 0)


def uptime_role(flags: Column, sport: Column, dport: Column) -> Column:
    """client or server for timestamp samples: by SYN flags, else by ports."""
    syn, ack = flags.bitwiseAND(SYN) != 0, flags.bitwiseAND(ACK) != 0
    return F.when(syn & ~ack, "client").when(syn & ack, "server").when((sport > 1024) & (dport <= 1024), "client").otherwise("server")


def ip_quirks(version: Column, ecn: Column, reserved: Column, df: Column, ident: Column, flow: Column) -> Column:
    """Array of the IP header's quirks, in the order of signatures."""
    v4 = [F.when(ecn, "ecn"), F.when(reserved, "0+"), F.when(df, "df"), F.when(df & (ident != 0), "id+"), F.when(~df & (ident == 0), "id-")]
    v6 = [F.when(flow != 0, "flow"), F.when(ecn, "ecn")]
    return F.when(version == 4, F.array_compact(F.array(*v4))).otherwise(F.array_compact(F.array(*v6)))


def tcp_quirks(flags: Column, seq: Column, ack: Column, urgent: Column) -> Column:
    has = lambda m: flags.bitwiseAND(m) != 0
    return F.array_compact(F.array(
        F.when(has(ECE | CWR), "ecn"), F.when(seq == 0, "seq-"), F.when(has(ACK) & (ack == 0), "ack-"), F.when(~has(ACK) & (ack != 0) & ~has(RST), "ack+"),
        F.when(has(URG), "urgf+"), F.when(~has(URG) & (urgent != 0), "uptr+"), F.when(has(PSH), "pushf+"),
    ))


def ipv6_option_length(next_header: Column, payload: Column) -> Column:
    """Bytes of an IPv6 packet's first extension header, modulo 256: none before TCP, 8 of a fragment, else what the header itself says."""
    return F.when((next_header == 6) | (F.octet_length(payload) == 0), 0).when(next_header == 44, 8).otherwise(F.coalesce(((octets.u8(payload, 1) + 1) * 8).bitwiseAND(255), F.lit(0)))


def signature_text(version: Column, ttl: Column, olen: Column, mss: Column, window: Column, wscale: Column, layout: Column, quirks: Column, payload: Column) -> Column:
    """version:ttl:olen:mss:window,scale:layout:quirks:payload, where a missing MSS or scale is '*'; layout and quirks are arrays."""
    star = lambda c: F.coalesce(c.cast("string"), F.lit("*"))
    return F.concat_ws(":", star(version), ttl, olen.cast("string"), star(mss), F.concat_ws(",", window, star(wscale)), F.concat_ws(",", layout), F.concat_ws(",", quirks), payload)

"""JA4 fingerprints of TLS clients from decoded hellos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that vary by connection (session ticket, pre-shared key, padding), server name, ALPN.
TICKET, PSK, PADDING, SNI, ALPN = 0x23, 0x29, 0x15, 0x00, 0x10


def is_grease(x: Column) -> Column:
    """Both bytes equal and of the form 0x?A."""
    return (x.bitwiseAND(0x0F0F) == 0x0A0A) & (F.shiftright(x, 8) == x.bitwiseAND(0xFF))


def without_grease(a: Column) -> Column:
    return F.filter(a, lambda x: ~is_grease(x))


def without_ephemeral(a: Column) -> Column:
    return F.filter(a, lambda x: ~x.isin(TICKET, PSK, PADDING))


def hex4(a: Column) -> Column:
    return F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))


def alpn_pair(alpn: Column) -> Column:
    """First and last character of a protocol's name, '9' in place of others than ASCII, '0' after a single one, '00' without any."""
    plain = lambda c: F.when(c.rlike(r"^[\x00-\x7F]$"), c).otherwise("9")
    n, a = F.length(alpn), F.coalesce(alpn, F.lit(""))
    last = F.when(n > 1, plain(F.substr(a, F.length(a), F.lit(1)))).otherwise("0")
    return F.when(a == "", "00").otherwise(F.concat(plain(F.substring(a, 1, 1)), last))


def hash12(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def version(legacy: Column, extensions: Column) -> Column:
    """13 when supported_versions (43) is there, else the hello's own version; 12 where it is none that is known."""
    known = F.when(legacy == 0x0304, "13").when(legacy == 0x0303, "12").when(legacy == 0x0302, "11").when(legacy == 0x0301, "10").when(legacy == 0x0300, "s3")
    return F.when(F.array_contains(extensions, 43), "13").otherwise(F.coalesce(known, F.lit("12")))


def ja4(version_: Column, ciphers: Column, extensions: Column, sig_algs: Column, sni: Column, alpn: Column, mode: str = "sorted") -> Column:
    """STRUCT<a, b, c, full, raw> of one mode: sorted (JA4), original (wire order) or stable (without ephemeral extensions). Lists come with or without GREASE."""
    ciphers, extensions = without_grease(ciphers), without_grease(extensions)
    if mode == "stable":
        extensions = without_ephemeral(extensions)
    two = lambda n: F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")
    a = F.concat(F.lit("t"), version_, F.when(sni.isNotNull(), "d").otherwise("i"), two(F.size(ciphers)), two(F.size(extensions)), alpn_pair(alpn))
    if mode == "original":
        c_list, e_list = hex4(ciphers), hex4(extensions)
    else:
        c_list, e_list = F.array_sort(hex4(ciphers)), F.array_sort(hex4(F.filter(extensions, lambda x: ~x.isin(SNI, ALPN))))
    b_raw, e_raw, s_raw = F.array_join(c_list, ","), F.array_join(e_list, ","), F.array_join(hex4(sig_algs), ",")
    c_raw = F.when((e_raw != "") & (s_raw != ""), F.concat_ws("_", e_raw, s_raw)).otherwise(e_raw)
    b, c = hash12(b_raw), hash12(c_raw)
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.concat_ws("_", a, b, c).alias("full"), F.concat_ws("_", a, b_raw, c_raw).alias("raw"))


def fingerprints(hello: Column) -> dict[str, Column]:
    """The nine published values of a decoded hello, by their names in JSON."""
    args = (version(hello["version"], hello["extensions"]), hello["ciphers"], hello["extensions"], hello["sig_algs"], hello["sni"], hello["alpn"])
    plain, original, stable = ja4(*args), ja4(*args, mode="original"), ja4(*args, mode="stable")
    return {"sni": hello["sni"], "version": args[0], "alpn": hello["alpn"], "ja4": plain["full"], "ja4_r": plain["raw"], "ja4_o": original["full"], "ja4_or": original["raw"], "ja4_s1": stable["full"], "ja4_s1r": stable["raw"]}

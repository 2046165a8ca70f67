"""HTTP/1 messages as column expressions: detection, headers, header order, language, diagnosis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netglean.functions import languages
from netglean.functions.octets import let

#: Headers that may be missing, whose values don't count, and that are expected; methods; limits.
REQUEST_OPTIONAL = ("Cookie", "Referer", "Origin", "Range", "If-Modified-Since", "If-None-Match", "Via", "X-Forwarded-For", "Authorization", "Proxy-Authorization", "Cache-Control")
RESPONSE_OPTIONAL = ("Set-Cookie", "Last-Modified", "ETag", "Content-Length", "Content-Disposition", "Cache-Control", "Expires", "Pragma", "Location", "Refresh", "Content-Range", "Vary")
REQUEST_SKIP_VALUE = ("Host", "User-Agent")
RESPONSE_SKIP_VALUE = ("Date", "Content-Type", "Server")
REQUEST_COMMON = ("Host", "User-Agent", "Connection", "Accept", "Accept-Encoding", "Accept-Language", "Accept-Charset", "Keep-Alive")
RESPONSE_COMMON = ("Content-Type", "Connection", "Keep-Alive", "Accept-Ranges", "Date")
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH", "TRACE", "CONNECT", "PROPFIND", "PROPPATCH", "MKCOL", "COPY", "MOVE", "LOCK", "UNLOCK")
MOST_HEADERS, MOST_LINE = 100, 8192

HEADER = "STRUCT<optional: BOOLEAN, name: STRING, value: STRING>"


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def is_request(text: Column) -> Column:
    """At least 16 bytes, and a first line of method, target and HTTP/1.0 or 1.1."""
    return (F.octet_length(text) >= 16) & text.rlike(rf"\A(?:{'|'.join(METHODS)})[ \t]+\S+[ \t]+HTTP/1\.[01][ \t]*\r?(?:\n|\z)")


def is_response(text: Column) -> Column:
    """At least 12 bytes, and a first line of HTTP/1.0 or 1.1 and three digits."""
    return (F.octet_length(text) >= 12) & text.rlike(r"\AHTTP/1\.[01][ \t]+\d{3}(?:[ \t\r\n]|\z)")


def complete(text: Column) -> Column:
    """Whether the headers have ended."""
    return F.locate("\r\n\r\n", text) > 0


def _head(text: Column) -> Column:
    crlf = F.locate("\r\n\r\n", text)
    lf = F.locate("\n\n", text)
    return F.when(crlf > 0, F.substr(text, F.lit(1), crlf - 1)).when(lf > 0, F.substr(text, F.lit(1), lf - 1))


def parsed(text: Column, request: bool) -> Column:
    """STRUCT<first ARRAY<STRING>, headers ARRAY<STRUCT<name, value, position>>, cookies, malformed, duplicates>.

    Null before the blank line has come, or when limits are passed. Requests' Cookie and Referer are taken out of the list of headers.
    """
    return let(F.split(F.regexp_replace(_head(text), "\r\n", "\n"), "\n"), lambda lines: let(_pairs(lines), lambda pairs: _message(lines, pairs, request)))


def _pairs(lines: Column) -> Column:
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.transform(rest, lambda x, i: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.substr(x, F.locate(":", x) + 1)).alias("value"), i.alias("position"), (F.locate(":", x) > 0).alias("ok")))


def _message(lines: Column, pairs: Column, request: bool) -> Column:
    good = F.filter(pairs, lambda p: p["ok"] & (p["name"] != ""))
    bare = F.transform(good, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), p["position"].alias("position")))
    kept = F.filter(bare, lambda p: ~F.lower(p["name"]).isin("cookie", "referer")) if request else bare
    lower = F.transform(bare, lambda p: F.lower(p["name"]))
    fits = (F.size(pairs) <= MOST_HEADERS) & ~F.exists(lines, lambda x: F.octet_length(x) > MOST_LINE)
    cookie = first_value(bare, "cookie")
    cookies = F.filter(F.transform(F.split(F.coalesce(cookie, F.lit("")), ";"), lambda c: F.trim(c)), lambda c: c != "")
    pairs_of = F.transform(cookies, lambda c, i: F.struct(F.trim(F.substring_index(c, "=", 1)).alias("name"), F.when(F.locate("=", c) > 0, F.trim(F.substr(c, F.locate("=", c) + 1))).alias("value"), i.alias("position")))
    out = F.struct(F.split(F.trim(F.get(lines, F.lit(0))), r"[ \t]+").alias("first"), kept.alias("headers"), pairs_of.alias("cookies"), first_value(bare, "referer").alias("referer"), (F.size(good) < F.size(pairs)).alias("malformed"), (F.size(lower) > F.size(F.array_distinct(lower))).alias("duplicates"), F.size(bare).alias("header_count"))
    return F.when(lines.isNotNull() & fits, out)


def first_value(headers: Column, name: str) -> Column:
    """The value of the first header of this (lower-case) name."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def header_order(headers: Column, request: bool) -> Column:
    """Array of headers as in signatures: optional ones without a value, then those whose values don't count, then name and value."""
    optional = _names(REQUEST_OPTIONAL if request else RESPONSE_OPTIONAL)
    skip = _names(REQUEST_SKIP_VALUE if request else RESPONSE_SKIP_VALUE)
    return F.transform(headers, lambda h: F.struct(F.array_contains(optional, h["name"]).alias("optional"), h["name"].alias("name"), F.when(~F.array_contains(optional, h["name"]) & ~F.array_contains(skip, h["name"]), h["value"]).alias("value")))


def absent(headers: Column, request: bool) -> Column:
    """Expected headers that aren't there, whatever their case."""
    lower = F.transform(headers, lambda h: F.lower(h["name"]))
    return F.filter(_names(REQUEST_COMMON if request else RESPONSE_COMMON), lambda x: ~F.array_contains(lower, F.lower(x)))


def header_text(h: Column) -> Column:
    return F.concat(F.when(h["optional"], "?").otherwise(""), h["name"], F.when(h["value"].isNotNull(), F.concat(F.lit("=["), h["value"], F.lit("]"))).otherwise(""))


def signature_text(version: Column, order: Column, missing: Column, software: Column) -> Column:
    """version:headers:absent:software, the last '???' when unknown."""
    return F.concat_ws(":", version, F.array_join(F.transform(order, header_text), ","), F.array_join(missing, ","), F.coalesce(software, F.lit("???")))


def language(accept: Column) -> Column:
    """Name of the language of the highest quality, the earliest on ties; null if none is known."""
    names = F.create_map(*(F.lit(x) for pair in languages.NAMES.items() for x in pair))
    parts = F.transform(F.split(accept, ","), lambda p, i: F.struct(F.trim(F.get(F.split(p, ";"), F.lit(0))).alias("tag"), F.get(F.split(p, ";"), F.lit(1)).alias("q"), i.alias("i")))
    rated = F.transform(F.filter(parts, lambda p: p["tag"] != ""), lambda p: F.struct(
        F.coalesce(F.when(F.regexp_replace(p["q"], "^(?:q=)+", "").rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.regexp_replace(p["q"], "^(?:q=)+", "").try_cast("float")), F.lit(1.0).cast("float")).alias("q"), (-p["i"]).alias("i"), F.try_element_at(names, F.substring_index(p["tag"], "-", 1)).alias("name"),
    ))
    return F.array_max(F.filter(rated, lambda r: r["name"].isNotNull()))["name"]


def diagnosis(user_agent: Column, family: Column, system: Column) -> Column:
    """anonymous without a user agent; with both families known generic or dishonest; else none."""
    return F.when(user_agent.isNull(), "anonymous").when(family.isNotNull() & system.isNotNull(), F.when(F.lower(family) == F.lower(system), "generic").otherwise("dishonest")).otherwise("none")


def distance(observed: Column, signature: Column) -> Column:
    """Errors of an observed header list against a signature's, classed 0 to 3; null when there are 12 or more.

    The signature's pointer moves at every step; the observed one only on equal names, so what is unexpected makes the rest disagree.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("errors"))

    def step(a: Column, s: Column) -> Column:
        o = F.get(observed, a["at"])
        same = o["name"].eqNullSafe(s["name"])
        wrong = F.when(same & o["value"].eqNullSafe(s["value"]), 0).otherwise(F.when(s["optional"], 0).otherwise(1))
        return F.struct((a["at"] + same.cast("int")).alias("at"), (a["errors"] + wrong).alias("errors"))

    errors = F.aggregate(signature, zero, step, lambda a: a["errors"] + F.greatest(F.size(observed) - a["at"], F.lit(0)))
    return F.when(errors <= 2, 0).when(errors <= 5, 1).when(errors <= 8, 2).when(errors <= 11, 3)


def metadata(text: Column) -> Column:
    """STRUCT about the headers of a message: header_count, duplicates (lower-case names that occur again, as often as they do), case_variations (the spellings of those), malformed, first_line_length, headers_length."""

    def told(lines: Column, pairs: Column) -> Column:
        names = F.transform(F.filter(pairs, lambda p: p["ok"] & (p["name"] != "")), lambda p: p["name"])
        lower = F.transform(names, F.lower)
        again = F.filter(lower, lambda x, i: F.array_position(lower, x) - 1 < i)
        cases = F.transform(F.array_distinct(again), lambda k: F.struct(k.alias("key"), F.filter(names, lambda n: F.lower(n) == k).alias("value")))
        return F.struct(
            F.size(names).alias("header_count"), again.alias("duplicates"), F.map_from_entries(cases).alias("case_variations"), (F.size(names) < F.size(pairs)).alias("malformed"),
            F.length(F.get(lines, F.lit(0))).alias("first_line_length"), F.aggregate(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.lit(0), lambda a, x: a + F.length(x)).alias("headers_length"),
        )

    lines = F.split(F.regexp_replace(_head(text), "\r\n", "\n"), "\n")
    return let(lines, lambda ls: let(_pairs(ls), lambda pairs: F.when(ls.isNotNull(), told(ls, pairs))))

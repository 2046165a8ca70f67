"""Signature files: sections of labels and signatures, read into rows and small DataFrames."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger(__name__)
DEFAULT = Path(__file__).with_name("default.fp")

TTL = "STRUCT<kind: STRING, ttl: INT, dist: INT>"
WINDOW = "STRUCT<kind: STRING, n: INT>"
HEADERS = "ARRAY<STRUCT<optional: BOOLEAN, name: STRING, value: STRING>>"
LABEL = "label_idx INT, sig_idx INT, kind STRING, class STRING, name STRING, flavor STRING, text STRING"
TCP_SCHEMA = f"direction STRING, {LABEL}, version STRING, ttl {TTL}, olen INT, mss INT, window {WINDOW}, wscale INT, layout ARRAY<STRING>, quirks ARRAY<STRING>, payload STRING"
HTTP_SCHEMA = f"direction STRING, {LABEL}, version STRING, horder {HEADERS}, habsent {HEADERS}, software STRING"
MTU_SCHEMA = "ord INT, link STRING, mtu INT"
UA_SCHEMA = "ord INT, ua STRING, family STRING"
#: Names of quirks.
QUIRKS = frozenset("df id+ id- ecn 0+ flow seq- ack+ ack- uptr+ urgf+ pushf+ ts1- ts2+ opt+ exws bad".split())


class SignatureError(ValueError):
    pass


@dataclass
class Signatures:
    classes: list[str] = field(default_factory=list)
    mtu: list[tuple] = field(default_factory=list)
    tcp: list[tuple] = field(default_factory=list)
    http: list[tuple] = field(default_factory=list)
    ua_os: list[tuple] = field(default_factory=list)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        make = lambda rows, schema: spark.createDataFrame(rows, schema)
        return {"tcp": make(self.tcp, TCP_SCHEMA), "http": make(self.http, HTTP_SCHEMA), "mtu": make(self.mtu, MTU_SCHEMA), "ua_os": make(self.ua_os, UA_SCHEMA), "classes": make([(c,) for c in self.classes], "class STRING")}


def parse_label(text: str) -> tuple[str, str | None, str, str | None]:
    """(s or g, class or None for '!', name, flavor or None)."""
    parts = text.split(":", 3)
    if len(parts) != 4 or parts[0] not in ("s", "g") or not parts[2]:
        raise SignatureError(f"label {text!r}")
    return parts[0], None if parts[1] == "!" else parts[1], parts[2], parts[3] or None


def _int(text: str, top: int) -> int:
    if not text.isdigit() or int(text) > top:
        raise SignatureError(f"number {text!r}")
    return int(text)


def parse_ttl(text: str) -> tuple[str, int, int | None]:
    if m := re.fullmatch(r"(\d+)-", text):
        return "bad", _int(m[1], 255), None
    if m := re.fullmatch(r"(\d+)\+\?", text):
        return "guess", _int(m[1], 255), None
    if m := re.fullmatch(r"(\d+)\+(\d+)", text):
        return "distance", _int(m[1], 255), _int(m[2], 255)
    return "value", _int(text, 255), None


def parse_window(text: str) -> tuple[str, int | None]:
    if text == "*":
        return "any", None
    for prefix, kind, top in (("mss*", "mss", 255), ("mtu*", "mtu", 255), ("%", "mod", 65535)):
        if text.startswith(prefix):
            return kind, _int(text[len(prefix) :], top)
    return "value", _int(text, 65535)


def parse_option(text: str) -> str:
    if text in ("nop", "mss", "ws", "sok", "sack", "ts") or re.fullmatch(r"(eol\+|\?)\d{1,3}", text):
        return text
    raise SignatureError(f"option {text!r}")


def parse_tcp(text: str) -> tuple:
    """version, ttl, olen, mss, window, wscale, layout, quirks, payload; '*' for MSS and scale is None."""
    parts = text.split(":")
    if len(parts) != 8 or parts[0] not in ("4", "6", "*") or parts[7] not in ("0", "+", "*"):
        raise SignatureError(f"signature {text!r}")
    window, comma, scale = parts[4].partition(",")
    quirks = [q for q in parts[6].split(",") if q]
    if not comma or not set(quirks) <= QUIRKS:
        raise SignatureError(f"signature {text!r}")
    star = lambda x, top: None if x == "*" else _int(x, top)
    return parts[0], parse_ttl(parts[1]), _int(parts[2], 255), star(parts[3], 65535), parse_window(window), star(scale, 255), [parse_option(o) for o in parts[5].split(",")], quirks, parts[7]


def parse_header(text: str) -> tuple[bool, str, str | None]:
    optional = text.startswith("?")
    name, _, value = text.removeprefix("?").partition("=")
    return optional, name, value[1:-1] if value.startswith("[") and value.endswith("]") else None


def _headers(text: str) -> list[tuple]:
    return [h for h in map(parse_header, re.split(r",(?![^\[]*\])", text)) if h[1]]


def parse_http(text: str) -> tuple:
    """version, headers, absent headers, software; the last takes all that is left."""
    version, _, rest = text.partition(":")
    fields, depth, cur = [], 0, []
    for i, c in enumerate(rest):
        depth += (c == "[") - (c == "]")
        if c == ":" and depth <= 0:
            fields.append("".join(cur))
            cur = []
            if len(fields) == 2:
                fields.append(rest[i + 1 :])
                break
        else:
            cur.append(c)
    if version not in ("0", "1", "*") or len(fields) != 3:
        raise SignatureError(f"signature {text!r}")
    return version, _headers(fields[0]), _headers(fields[1]), fields[2]


def parse_ua_os(text: str, compat: bool = False) -> list[tuple[str, str | None]]:
    """Pairs of a token and a family. compat: values are letters and digits only, and everything after the first that isn't is lost."""
    if compat:
        m = re.match(r"[A-Za-z0-9]+(?:=[A-Za-z0-9]+)?(?:,[A-Za-z0-9]+(?:=[A-Za-z0-9]+)?)*", text)
        pairs = [p.partition("=") for p in (m[0].split(",") if m else [])]
        return [(a, b or None) for a, _, b in pairs]
    out = []
    for part in re.split(r",(?![^\[]*\])", text):
        family, eq, token = part.strip().partition("=")
        out.append((token.strip("[]") if eq else family, family))
    return [p for p in out if p[0]]


def parse(text: str, compat: bool = False) -> Signatures:
    """Reads a file's text. Anything but lists and comments before the first section is an error; names that are unknown are skipped with a warning."""
    out, section, label = Signatures(), None, None
    index: dict[tuple, tuple[int, int]] = {}
    for no, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith(";"):
            continue
        if m := re.fullmatch(r"\[([a-z]+)(?::([a-z]+))?\]", line):
            section, label = (m[1], m[2]), None
            continue
        name, eq, value = (x.strip() for x in line.partition("="))
        if eq and name == "classes":
            out.classes += [c.strip() for c in value.split(",") if c.strip()]
        elif eq and name == "ua_os":
            start = len(out.ua_os)
            out.ua_os += [(start + i, ua, family) for i, (ua, family) in enumerate(parse_ua_os(value, compat))]
        elif section is None or not eq:
            raise SignatureError(f"line {no}: {line!r}")
        elif name == "label":
            label = value if section[0] == "mtu" else parse_label(value)
            a, _ = index.get(section, (-1, 0))
            index[section] = (a + 1, 0)
        elif name == "sig":
            if label is None:
                raise SignatureError(f"line {no}: a signature before its label")
            a, b = index[section]
            index[section] = (a, b + 1)
            if section[0] == "mtu":
                out.mtu.append((len(out.mtu), label, _int(value, 65535)))
            elif section[0] == "tcp":
                out.tcp.append((section[1], a, b, *label, value, *parse_tcp(value)))
            elif section[0] == "http":
                out.http.append((section[1], a, b, *label, value, *parse_http(value)))
            else:
                LOG.warning("section %s is unknown", section)
        elif name != "sys":
            LOG.warning("line %d: name %s is unknown", no, name)
    return out


def load(path: str | Path = DEFAULT, compat: bool = False) -> Signatures:
    return parse(Path(path).read_text(encoding="utf-8"), compat)

"""Nearest signatures: TCP observations meet only signatures with their exact key, an array of them by a broadcast hash join, and the least distance wins; header lists walk a trie.

Signature tables are files' contents of bounded size (at most MOST_SIGNATURES rows, checked), so they are sent to all tasks. Wildcards are
exploded into keys beforehand. Distances that are null are incompatible. Ties go to the first label and signature of the file.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netglean.functions import http
from netglean.operators import tries
from netglean.sources.signatures import Signatures

MOST_SIGNATURES = 100_000
FEW_TOKENS = 32


def _bounded(rows: list) -> list:
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"{len(rows)} signatures; at most {MOST_SIGNATURES} are sent to all tasks")
    return rows


def tcp_index(sigs: DataFrame) -> DataFrame:
    """One row for each key of a signature: IP version, layout and payload class, wildcards exploded."""
    versions = F.when(F.col("version") == "*", F.array(F.lit("4"), F.lit("6"))).otherwise(F.array("version"))
    payloads = F.when(F.col("payload") == "*", F.array(F.lit("0"), F.lit("+"))).otherwise(F.array("payload"))
    return sigs.withColumn("k_layout", F.array_join("layout", ",")).withColumn("k_version", F.explode(versions)).withColumn("k_payload", F.explode(payloads))


def ttl_distance(o: Column, s: Column) -> Column:
    """0 when equal, 2 when not, by pairs of kinds; null for pairs that can't be compared."""
    off = lambda same: F.when(same, 0).otherwise(2)
    is_ = lambda a, b: (o["kind"] == a) & (s["kind"] == b)
    same = o["ttl"] == s["ttl"]
    out = F.when(is_("value", "value") | is_("bad", "bad") | is_("guess", "guess") | is_("guess", "value") | is_("value", "guess"), off(same))
    out = out.when(is_("distance", "distance"), off(same & (o["dist"] == s["dist"])))
    out = out.when(is_("distance", "value"), off(o["ttl"] + o["dist"] == s["ttl"]))
    return out.when(is_("value", "distance"), off(o["ttl"] == s["ttl"] + s["dist"]))


def window_distance(o: Column, s: Column, mss: Column) -> Column:
    off = lambda same: F.when(F.coalesce(same, F.lit(False)), 0).otherwise(2)
    ratio = F.floor(o["n"] / F.when(mss > 0, mss))
    return F.when(s["kind"] == "any", 0).when(o["kind"] == s["kind"], off(o["n"] == s["n"])).when((o["kind"] == "value") & (s["kind"] == "mss"), off(ratio == s["n"]))


def tcp_distance(s: Column) -> Column:
    """Sum over the nine fields of an observation (columns) and the signature s (a struct); null if one is incompatible. Version, layout and payload agree by the key."""
    o = F.col
    wild = lambda name, cost: F.when(s[name].isNull() | s[name].eqNullSafe(o(name)), 0).otherwise(cost)
    quirks = F.when(o("quirks") == s["quirks"], 0)
    return quirks + ttl_distance(o("ttl"), s["ttl"]) + F.when(o("olen") == s["olen"], 0).otherwise(2) + wild("mss", 2) + window_distance(o("window"), s["window"], o("mss")) + wild("wscale", 1)


def _score(d: Column, steps: list[tuple[int, float]]) -> Column:
    out = F.when(d <= steps[0][0], steps[0][1])
    for top, value in steps[1:]:
        out = out.when(d <= top, value)
    return F.when(d.isNotNull(), out.otherwise(0.05))


#: Scores by largest distance.
TCP_SCORES = [(0, 1.0), (1, 0.95), (2, 0.9), (4, 0.8), (6, 0.7), (9, 0.6), (12, 0.4), (15, 0.2), (18, 0.1)]
HTTP_SCORES = [(0, 1.0), (1, 0.95), (2, 0.9), (3, 0.8), (5, 0.7), (7, 0.6), (9, 0.4), (11, 0.2), (12, 0.1)]


def tcp_score(d: Column) -> Column:
    return _score(d, TCP_SCORES)


def http_score(d: Column) -> Column:
    return _score(d, HTTP_SCORES)


def software_distance(observed: Column, signature: Column, corrected: bool = False) -> Column:
    """0 if the signature's text contains the observed one, else 3; corrected: the other way round."""
    return F.when(observed.contains(signature) if corrected else signature.contains(observed), 0).otherwise(3)


def http_distance(s: Column, corrected: bool = False) -> Column:
    return http.distance(F.col("horder"), s["horder"]) + http.distance(F.col("habsent"), s["habsent"]) + software_distance(F.coalesce("software", F.lit("???")), s["software"], corrected)


def quality(enabled: bool, label: Column, score: Column) -> Column:
    """STRUCT<status, score>: disabled, not_matched or matched."""
    status = F.when(label.isNotNull(), "matched").otherwise("not_matched") if enabled else F.lit("disabled")
    return F.struct(status.alias("status"), score.alias("score"))


def _best(obs: DataFrame, index: DataFrame, keys: dict[str, Column], distance: Callable[[Column], Column], score: Callable[[Column], Column]) -> DataFrame:
    """obs with dist, kind, class, name, flavor, signature and score of the best match, null where none is compatible.

    Each observation meets the array of its key's signatures, which all tasks hold, and keeps the least: no shuffle, one pass. keys: the observation's value of each of index's key columns.
    """
    fields = [c for c in index.columns if c not in keys]
    bag = index.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_signatures"))
    bag = F.broadcast(bag.select(*(F.col(k).alias(f"_{k}") for k in keys), "_signatures"))
    on = [value.eqNullSafe(F.col(f"_{k}")) for k, value in keys.items()]
    names = ("kind", "class", "name", "flavor")

    def told(s: Column) -> Column:
        d = distance(s)
        return F.when(d.isNotNull(), F.struct(d.alias("dist"), s["label_idx"].alias("label_idx"), s["sig_idx"].alias("sig_idx"), *(s[n].alias(n) for n in names), s["text"].alias("signature")))

    out = obs.join(bag, reduce(lambda a, b: a & b, on), "left").withColumn("_m", F.array_min(F.transform("_signatures", told)))
    return out.select(*obs.columns, *(F.col(f"_m.{x}").alias(x) for x in ("dist", *names, "signature")), score(F.col("_m.dist")).alias("score"))


def match_tcp(obs: DataFrame, sigs: Signatures) -> DataFrame:
    """obs has direction, version, ttl, olen, mss, window, wscale, layout, quirks and payload."""
    _bounded(sigs.tcp)
    index = tcp_index(sigs.frames(obs.sparkSession)["tcp"])
    keys = {"direction": F.col("direction"), "k_version": F.col("version"), "k_layout": F.array_join("layout", ","), "k_payload": F.col("payload")}
    return _best(obs, index, keys, tcp_distance, tcp_score)


def match_http(obs: DataFrame, sigs: Signatures, corrected: bool = False) -> DataFrame:
    """obs has direction, version, horder, habsent and software. HTTP/2 observations have a version that no signature has.

    The least http_distance(), found by a walk of the signatures' trie for each different observation of a batch.
    """
    rows = [(label, sig, kind, class_, name, flavor, direction, version, horder, habsent, software, text) for direction, label, sig, kind, class_, name, flavor, text, version, horder, habsent, software in _bounded(sigs.http)]
    match = tries.header_matcher(rows, {"*": ("0", "1")}, corrected)
    out = obs.withColumn("_m", match(F.col("direction"), F.col("version"), F.to_json(F.struct("horder", "habsent", "software"))))
    return out.select(*obs.columns, *(F.col(f"_m.{x}").alias(x) for x in ("dist", "kind", "class", "name", "flavor", "signature")), http_score(F.col("_m.dist")).alias("score"))


def match_mtu(obs: DataFrame, sigs: Signatures, mtu: str = "mtu") -> DataFrame:
    """obs with link, the first label that lists the MTU."""
    _bounded(sigs.mtu)
    first = sigs.frames(obs.sparkSession)["mtu"].groupBy(F.col("mtu").alias("_mtu")).agg(F.min_by("link", "ord").alias("link"))
    return obs.join(F.broadcast(first), F.col(mtu) == F.col("_mtu"), "left").drop("_mtu")


def ua_family(user_agent: Column, sigs: Signatures) -> Column:
    """Family of the first token of the table that the user agent contains. A table of few tokens is a constant of the expression, of more an automaton."""
    rows = _bounded(sigs.ua_os)
    if not rows:
        return F.lit(None).cast("string")
    if len(rows) > FEW_TOKENS:
        return tries.first_token([ua for _, ua, _ in rows], [family for *_, family in rows])(user_agent)
    table = F.from_json(F.lit(json.dumps([{"ua": ua, "family": family} for _, ua, family in rows])), "array<struct<ua: string, family: string>>")  # folded once
    return F.get(F.filter(table, lambda x: user_agent.contains(x["ua"])), F.lit(0))["family"]

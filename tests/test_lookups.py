"""Tries, automata and intervals against plain comparisons with every entry."""

import ipaddress
import random
import time

import pytest
from pyspark.sql import functions as F

from netglean.functions import http, networks
from netglean.functions.filters import FilterConfig, SubnetFilter
from netglean.operators import matching, tries
from netglean.sources.signatures import Signatures

OBSERVED = f"direction string, version string, horder array<{http.HEADER}>, habsent array<{http.HEADER}>, software string"


def header(rng, names):
    return rng.random() < 0.2, rng.choice(names), rng.choice([None, None, "a", "b"])


def table(rng, n, names):
    out = Signatures()
    for i in range(n):
        out.http.append((rng.choice(["request", "response"]), i // 3, i % 3, "s", "x", f"n{i}", None, f"t{i}", rng.choice("01*"), [header(rng, names) for _ in range(rng.randrange(1, 12))], [(False, rng.choice(names), None) for _ in range(rng.randrange(3))], rng.choice(["", "curl", "Mozilla/5", "???"])))
    return out


@pytest.mark.parametrize("corrected", [False, True])
def test_header_trie_equals_distances(spark, corrected):
    rng = random.Random(3)
    names = [f"H{i}" for i in range(9)]
    sigs = table(rng, 60, names)
    observed = [(rng.choice(["request", "response", None]), rng.choice("012"), [(False, *header(rng, names)[1:]) for _ in range(rng.randrange(12))], [(False, rng.choice(names), None) for _ in range(rng.randrange(3))], rng.choice([None, "curl", "Mozilla", "curl/7"])) for _ in range(200)]
    for s in rng.sample(sigs.http, 40):  # near copies
        observed.append((s[0], "1", [h for h in s[9] if rng.random() < 0.9], s[10], s[11]))
    obs = spark.createDataFrame([(i, *o) for i, o in enumerate(observed)], "i long, " + OBSERVED)
    got = {r["i"]: (r["dist"], r["name"]) for r in matching.match_http(obs, sigs, corrected).collect()}
    rows = [(s[1], s[2], s[5], s[0], v, s[9], s[10], s[11]) for s in sigs.http for v in (("0", "1") if s[8] == "*" else (s[8],))]
    all_ = spark.createDataFrame(rows, f"label_idx int, sig_idx int, name string, s_direction string, s_version string, s_horder array<{http.HEADER}>, s_habsent array<{http.HEADER}>, s_software string")
    s = F.struct(F.col("s_horder").alias("horder"), F.col("s_habsent").alias("habsent"), F.col("s_software").alias("software"))
    every = obs.join(F.broadcast(all_), F.expr("direction = s_direction AND version = s_version")).withColumn("dist", matching.http_distance(s, corrected)).where("dist IS NOT NULL")
    want = {r["i"]: (r["dist"], r["name"]) for r in every.groupBy("i").agg(F.min_by(F.struct("dist", "name"), F.struct("dist", "label_idx", "sig_idx")).alias("b")).select("i", "b.*").collect()}
    assert len(want) > 100 and got == {i: want.get(i, (None, None)) for i in range(len(observed))}


def test_header_trie_of_many_signatures():
    """Of 5,000 signatures of one stock of headers a walk leaves most branches: the nearest is found, and time grows far less than their number."""
    rng = random.Random(4)
    times = {}
    for n in (500, 5000):
        trie, kept = tries.HeaderTrie(), []
        for i in range(n):
            own = [(False, f"h{(i // 40 + j) % 30}", f"v{rng.randrange(3)}") for j in range(12)]
            trie.add(own, (i, 0), [], "s", (i,))
            kept.append(own)
        tried = [[h[1:] for h in kept[rng.randrange(n)]] for _ in range(60)]
        began = time.perf_counter()
        found = [trie.best(o, [], "s", False) for o in tried]
        times[n] = time.perf_counter() - began
        for o, (d, (label,)) in zip(tried[:10], found):
            each = [(tries.error_class(tries.list_errors(o, tuple(k))), i) for i, k in enumerate(kept)]
            assert (d, label) == min(e for e in each if e[0] is not None)
    assert times[5000] < 6 * times[500]


def test_tokens(spark):
    rng = random.Random(5)
    tokens = ["abcd", "bc", "", "zz"][:2] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(10_000)]
    texts = [None, "", "xxabcdx", *("".join(rng.choice("abcx") for _ in range(rng.randrange(12))) for _ in range(400))]
    plain = lambda t: None if t is None else next((f"f{i}" for i, x in enumerate(tokens) if x in t), None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    sigs = Signatures()
    sigs.ua_os = [(i, x, f"f{i}") for i, x in enumerate(tokens)]
    got = {r["i"]: r["f"] for r in df.select("i", matching.ua_family(F.col("t"), sigs).alias("f")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert tries.Tokens(["b", "", "a"]).first("ca") == 1 and tries.Tokens(["b"]).first("ca") is None


def test_networks(spark):
    rng = random.Random(6)
    four = lambda: ipaddress.IPv4Address(0x0A000000 + rng.randrange(1 << 22))
    six = lambda: ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.randrange(1 << 20) << 76) + rng.randrange(1 << 16))
    mapped = lambda: ipaddress.IPv6Address((0xFFFF << 32) + int(four()))
    blocks = [str(ipaddress.ip_network(f"{make()}/{bits}", strict=False)) for make, lo, hi, n in ((four, 18, 33, 25_000), (six, 44, 129, 20_000), (mapped, 114, 129, 5_000)) for bits in [rng.randrange(lo, hi) for _ in range(n)]]
    sets = {(n.version, n.prefixlen, int(n.network_address)) for n in map(ipaddress.ip_network, blocks)}

    def within(a):
        bits = a.max_prefixlen
        return any((a.version, p, int(a) >> bits - p << bits - p) in sets for p in range(bits + 1))

    texts = [str(make()) for make in (four, six, mapped) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "x", "1.2.3", "::ffff:10.0.0.1"]], "ip string")
    got = {r["ip"]: r["f"] for r in df.select("ip", networks.inside(blocks)(F.col("ip")).alias("f")).collect()}
    assert all(got[t] == within(ipaddress.ip_address(t)) for t in [*texts, "::ffff:10.0.0.1"]) and not any(got[t] for t in (None, "", "x", "1.2.3"))
    assert 0.02 < sum(got[t] for t in texts) / len(texts) < 0.98


def test_mapped_addresses_in_filters(spark):
    df = spark.createDataFrame([("::ffff:10.2.3.4", "::1", 1, 2), ("10.2.3.4", "::1", 1, 2), (None, "::1", 1, 2)], "src string, dst string, sport int, dport int")
    for block, want in (("::ffff:10.2.0.0/112", [True, False]), ("::ffff:0:0/96", [True, False]), ("10.2.0.0/16", [False, True])):
        c = FilterConfig().with_filter(SubnetFilter().allow(block))
        got = [r[0] for r in df.select(c.predicate(*(F.col(x) for x in df.columns))).collect()]
        assert got == [*want, True]

"""Different texts of one doc_id, columns of any name, ordinary strings that are no secrets, and damaged archives."""

import gzip
import hashlib
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from netglean.llm import quality_classifier, quality_rules, secret_scan, substring_dedup, warc


def test_substring_dedup_of_different_texts_of_one_id(spark):
    """Against windows looked up in order of doc_id, then of the texts' hashes."""
    rng = random.Random(1)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (300, 200, 400))
    rows = [(1, a), (2, a + b), (2, a[:150]), (2, a[:150]), (3, c), (-7, b[:120]), (2, c[50:260]), (None, a), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {(r.doc_id, r.text): (r.h, r.g) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g")).collect()}
    texts = sorted({(d, t or "") for d, t in rows if d is not None}, key=lambda r: (r[0], key[r]))
    seen, want = {}, {}
    for d, t in texts:
        data, gone = t.encode(), [False] * len(t.encode())
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = [True] * 100
            seen.setdefault(w, (d, i))
        left = bytes(x for x, g in zip(data, gone) if not g)
        want[d, t] = (sum(gone), hashlib.sha256(left).hexdigest())
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df).where("doc_id IS NOT NULL").collect())
    assert got == sorted((d, len((t or "").encode()), *want[d, t or ""]) for d, t in rows if d is not None)


def test_columns_with_dots(spark):
    text = "the cat and the dog are in the house with a password=hunter2xyz of theirs " * 8
    df = spark.createDataFrame([(1, text, "x", 5), (2, "short", "y", 5)], "`doc_id` long, `text` string, `a.b` string, `n_chars` long")
    assert quality_rules.keep(df).columns == df.columns == secret_scan.redact(df).columns
    got = {r["doc_id"]: (r["a.b"], r["text"]) for r in secret_scan.redact(df).collect()}
    assert got[2] == ("y", "short") and got[1][0] == "x" and "hunter2xyz" not in got[1][1]


def ordinary():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha window network garden merge column stream travel before silent energy".split())
    return {
        "rules": [c * n for c in "=-_+" for n in range(20, 60, 7)] + ["=-" * 15, "-_" * 20, "+--" * 12 + "+"],
        "uuids": [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(100)] + [str(uuid.UUID(int=rng.getrandbits(128))).upper() for _ in range(50)],
        "documents": ["/".join(f"RFC{rng.randrange(1000, 9999)}" for _ in range(3)) for _ in range(100)] + [f"ISO-{rng.randrange(9999)}/IEC-{rng.randrange(99999)}-{rng.randrange(2030)}" for _ in range(50)],
        "accounts": [f"{rng.choice(['DE', 'FR', 'ES', 'PL'])}{rng.randrange(10**20):020d}" for _ in range(100)],
        "bases": ["".join(rng.choice("ACGT") for _ in range(rng.randrange(20, 90))) for _ in range(100)],
        "dates": [f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}/{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(100)],
        "paths": ["/" + "/".join(word() for _ in range(4)) + f"/{word()}-{rng.randrange(99)}" for _ in range(100)],
        "numbers": ["".join(rng.choice("0123456789") for _ in range(rng.randrange(20, 40))) for _ in range(100)],
    }


def test_ordinary_strings_are_no_secrets(spark):
    rows = [(kind, f"see {x} for more") for kind, xs in ordinary().items() for x in xs]
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.find(spark.createDataFrame(rows, "kind string, text string"), model).groupBy("kind").agg(F.avg((F.size("markov") > 0).cast("int")).alias("share"))
    shares = {r["kind"]: r["share"] for r in found.collect()}
    assert max(shares.values()) <= 0.02, shares


def test_random_strings_stay_secrets(spark):
    rng = random.Random(4)
    kinds = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    rows = [(k, f"x {''.join(rng.choice(c) for _ in range(rng.randrange(28, 60)))} y") for k, c in kinds.items() for _ in range(300)]
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    found = secret_scan.find(spark.createDataFrame(rows, "kind string, text string"), model).groupBy("kind").agg(F.avg((F.size(F.concat("base", "markov")) > 0).cast("int")).alias("share"))
    shares = {r["kind"]: r["share"] for r in found.collect()}
    assert min(shares.values()) >= 0.95, shares


def test_classifier_takes_one_text_of_an_id(spark):
    """Repeated ids and rows in any order give the model of the ids' least texts."""
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice("the of and a house river light".split()) for _ in range(60))
    bad = lambda: " ".join(rng.choice("## $$ %% 11 22 XX".split()) for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    more = [*rows, *((i, "~" + bad()) for i in range(80)), *rows]
    rng.shuffle(more)
    one, two = (quality_classifier.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, more))
    assert abs(one.weight - two.weight).max() < 1e-9 and one.threshold == two.threshold


def record(i, body=b"body"):
    block = b"HTTP/1.1 200 OK\r\nX: %d\r\n\r\n" % i + body
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(block)) + block + b"\r\n\r\n"


def ids(pieces):
    got = [r if r is None else warc.number(r[0]["warc-record-id"]) for r in warc.parse(pieces)]
    return [r for r in got if r is not None], got.count(None)


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 20])
def test_archives_in_pieces(size):
    """Records at the borders of pieces, stray bytes, a wrong length, and a cut end."""
    cut = lambda data: iter([data[i : i + size] for i in range(0, len(data), size)])
    rs = [record(i, b"WARC/" * (i % 3) + b"x" * (i * 37 % 500)) for i in range(60)]
    assert ids(cut(b"".join(rs))) == (list(range(60)), 0)
    assert ids(cut(b"".join(rs[:20]) + b"stray \x00 bytes" + b"".join(rs[20:]))) == (list(range(60)), 1)
    assert ids(cut(b"".join(rs[:20]) + rs[20].replace(b"Content-Length: ", b"Content-Length: x") + b"".join(rs[21:])))[0] == [*range(20), *range(21, 60)]
    assert ids(cut(b"".join(rs)[:-9]))[0] == list(range(59))
    assert ids(cut(b"")) == ([], 0)


def test_damaged_members_cost_one_record():
    rng = random.Random(6)
    members = [gzip.compress(record(i, rng.randbytes(300))) for i in range(50)]
    assert ids(warc.unzipped(b"".join(members))) == (list(range(50)), 0)
    bad = members[7][:60] + bytes([members[7][60] ^ 255, members[7][61] ^ 255]) + members[7][62:]
    got, gaps = ids(warc.unzipped(b"".join([*members[:7], bad, *members[8:]])))
    assert got == [i for i in range(50) if i != 7] and gaps >= 1
    assert ids(warc.unzipped(b"".join(members)[:-40]))[0] == list(range(49))
    assert ids(warc.unzipped(b"".join([*members[:9], b"between", *members[9:]])))[0] == list(range(50))


def test_reading_is_linear():
    member = gzip.compress(record(1, b"z" * 2000))
    times = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        assert sum(1 for _ in warc.parse(warc.unzipped(member * n))) == n
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * times[0]


def test_losses_are_told(spark):
    data = b"".join([gzip.compress(record(1)), b"junk", gzip.compress(record(2))])
    df = spark.createDataFrame([(bytearray(data),), (None,), (bytearray(b"no archive"),)], "content binary")
    assert [r["record_id"] for r in warc.read_records(df).orderBy("record_id").collect()] == [1, 2]
    assert warc.read_records(df, lost=True).where("kind = 'lost'").count() == 2

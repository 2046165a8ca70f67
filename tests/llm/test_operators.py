"""Each operator against a plain version of itself, and on nulls, empty and repeated rows, long texts, ties and extra columns."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netglean.llm.components import connected_components
from netglean.llm import bpe, decontaminate, jaccard_join, pretokens, queries, quality_classifier, quality_rules, quotation, secret_scan, substring_dedup, token_counts, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, n string"


def docs(spark, rows):
    """With a column whose name many operators use themselves."""
    return spark.createDataFrame([(d, t, "x") for d, t in rows], DOC)


def nasty():
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "B", "é", "ß", "9", "中", "'s", "!", "<|endoftext|>", "\r\n", "🙂", "word", "aaaa", "\x00"]
    return [None, "", " ", "a" * 20000, "ab " * 5000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300))]


def test_token_counts(spark):
    texts = nasty()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in enumerate(texts)]
    got = token_counts.token_counts(docs(spark, enumerate(texts)), public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, got.collect())) == want
    assert token_counts.token_counts(docs(spark, [(1, "x")]).limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert pretokens.PATTERN == public_tokenizers.PATTERN
    texts = nasty()
    ids = [lib.encode_ordinary(x or "") for x in texts]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(",".join(map(str, x)).encode()), sha((t or "").encode())) for i, (x, t) in enumerate(zip(ids, texts))]
    assert sorted(map(tuple, bpe.encode_documents(docs(spark, enumerate(texts)), path).collect())) == want
    words = [w.encode() for t in texts if t for w in re.findall(r"\S+", t)][:400]
    merger = bpe.TreeMerger(ranks)
    alone = [merger.grow_one(w) for w in words]
    assert alone == [x for w in words for x in merger.grow(1 << max(len(w) - 1, 1).bit_length(), [w])]


def jaccard_plain(rows, k, num, den):
    own = []
    for d, t in rows:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        own.append((d, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = {d: d for d, _ in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(own):
        for b, t in own[:i]:
            if s and t and den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((d, len(s), find(d)) for d, s in own)


def copies(seed, n):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(200)]
    rows = [(3, None), (4, ""), (5, " \n\t"), (6, "One"), (7, "one"), (8, "one two")]
    for i in range(10, n):
        if rng.random() < 0.6 and i > 12:
            w = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 12, 13, 20, 40, 100, 300]))]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("k", "num", "cell"), [(3, 90, 6000), (5, 80, 8)])
def test_jaccard_join(spark, monkeypatch, k, num, cell):
    monkeypatch.setattr(jaccard_join, "CELL", cell)
    rows = copies(k, 200)
    got = jaccard_join.jaccard_join(docs(spark, rows), k, num, 100)
    assert sorted(map(tuple, got.collect())) == jaccard_plain(rows, k, num, 100)


def test_jaccard_join_odd_rows(spark):
    got = jaccard_join.jaccard_join(docs(spark, [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None)]), 3, 90, 100)
    assert sorted(map(str, got.collect())) == sorted(map(str, [got.sparkSession.createDataFrame([x], "doc_id long, n_shingles long, component_id long").first() for x in [(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None)]]))
    assert jaccard_join.jaccard_join(docs(spark, [(1, "x")]).limit(0)).count() == 0


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    """Rows are told apart by doc_id and text; null doc_ids come last; equal rows leave the one of the least other columns."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "y"), (5, a, "x"), (5, b, "x"), (7, b, "x"), (None, b, "x"), (None, c, "n"), (None, c, "m"), (9, None, "x"), (9, "", "w"), (None, None, "z"), (8, a + " tail", "x"), (3, "few", "x")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, DOC)).collect()
    first, second = sorted((a, b), key=lambda t: hashlib.md5(t.encode()).digest())
    want = [(5, a, "x"), (7, b, "x"), (None, c, "m"), (9, "", "w"), (None, None, "z"), (3, "few", "x")]
    if second == a:  # 5's first text is b, so that 7's goes, and a, the further text of 5, comes after 8's copy of it
        want[:2] = [(5, b, "x"), (8, a + " tail", "x")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))
    assert jaccard_join.one_of_each(docs(spark, rows[:0] or [(1, "x")]).limit(0)).count() == 0
    assert jaccard_join.one_of_each(docs(spark, [(1, "x y")])).columns == ["doc_id", "text", "n"]


def test_components_of_a_hub(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1200)] + [(None, 3), (5, 5)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(400)] + [(i, 1000) for i in range(1000, 1201)]


@pytest.mark.parametrize("bits", [16384, 64])
def test_signature_tree(monkeypatch, bits):
    monkeypatch.setattr(jaccard_join, "BITS", bits)
    rng, t = random.Random(1), jaccard_join.Threshold(80, 100)
    base = [rng.getrandbits(64) for _ in range(80)]
    own = [np.array(sorted({*rng.sample(base, 80 - e), *(rng.getrandbits(64) for _ in range(e))}), np.uint64) for e in (rng.randint(0, 20) for _ in range(90))]
    u, v = jaccard_join.link_cell(own, t)
    want = []
    for i in range(90):
        for j in range(i):
            shared = len(np.intersect1d(own[i], own[j]))
            if 100 * shared >= 80 * (len(own[i]) + len(own[j]) - shared):
                want.append((i, j))
    a, b = jaccard_join.forest(*map(np.array, zip(*want)))
    c, d = jaccard_join.forest(u, v)
    assert (a.tolist(), b.tolist()) == (c.tolist(), d.tolist())


def dedup_plain(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if (w := b[p : p + length]) in seen:
                gone[p : p + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [None, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "SEND_BYTES", 5000)
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randint(50, 200))) for _ in range(6)]
    rows = [(i * 3, "".join(rng.choice(passages) if rng.random() < 0.4 else rng.choice(["a", "ab", "xyz "]) * rng.randint(10, 200) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 99), (1003, "x" * 100), (1004, "x" * 101), (-5, rows[4][1])]
    assert sorted(map(tuple, substring_dedup.substring_dedup(docs(spark, rows), hot=hot).collect())) == dedup_plain(rows, 100)


def test_substring_dedup_odd_rows(spark):
    q = "q" * 150
    got = substring_dedup.substring_dedup(docs(spark, [(1, q), (1, q), (None, q), (2, q)])).select("doc_id", "n_removed", "n_spans").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 149, 1), (1, 149, 1), (None, 0, 0), (2, 150, 1)]))
    assert substring_dedup.substring_dedup(docs(spark, [(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [0, 2])
def test_substring_dedup_with_colliding_hashes(spark, monkeypatch, bits):
    """Hashes of so few bits agree for different strings; nothing is removed or left because of that."""
    few, real = np.uint64(2**bits - 1), substring_dedup.SuffixSort.hash
    monkeypatch.setattr(substring_dedup.SuffixSort, "hash", lambda self, at, n: real(self, at, n) & few)
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(30)) for _ in range(12)]
    texts = [rng.choice(texts) for _ in range(60)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at, count, length = np.arange(60) * 30, np.full(60, 11), 20
    doc, start = substring_dedup.repeated(data, at, count, np.zeros(60, np.uint64), np.arange(60), np.zeros(60, np.int64), length)
    seen, want = set(), []
    for d, t in enumerate(texts):
        for i in range(11):
            if t[i : i + length] in seen:
                want.append((d, i))
            seen.add(t[i : i + length])
    assert sorted(zip(doc.tolist(), start.tolist())) == want


def test_substring_dedup_of_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghij klmn") for _ in range(2_500_000))
    rows = [(1, long), (2, "é" + long[1_000_000:1_000_150] + "x"), (3, long[:99])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got == {1: (2_500_000, 0, 0), 2: (153, 150, 1), 3: (99, 0, 0)}


def test_suffix_sort():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(500)), np.uint8)
    bounds = np.array([0, 100, 101, 103, 300, 480])
    got = substring_dedup.SuffixSort(data, 20).sort(np.arange(480), bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        assert got[a:b].tolist() == sorted(range(a, b), key=lambda p: bytes(data[p : p + 20]))


def rules_plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len({i + j for i, g in enumerate(grams) if g in twice for j in range(3)})


LOWER = {i: i + 32 for i in range(65, 91)}


def test_quality_rules(spark):
    texts = [None, "", " \n ", "cat the\x85", "cat the\u2028", "a\u017f A\u017f as. THE, the.. the", "one two three four " * 60_000, "a b c", "the cat of a dog " * 30, "x y z x y z x", "l\nl\n \nl", "# * a", *nasty()[5:60]]
    got = quality_rules.quality_rules(docs(spark, enumerate(texts))).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [rules_plain(t) for t in texts]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert [r.n_stop_words for r in got] == [sum(x.translate(LOWER).rstrip("\n") in quality_rules.STOP_WORDS or x[-1] in ".,;:" and x[:-1].translate(LOWER) in quality_rules.STOP_WORDS for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    assert quality_rules.quality_rules(docs(spark, [(1, "x")]).limit(0)).count() == 0 and quality_rules.quality_rules(docs(spark, [(1, "x"), (1, "x"), (None, "x")])).count() == 3
    kept = quality_rules.keep(docs(spark, enumerate(texts)))
    assert kept.columns == ["doc_id", "text", "n"] and kept.count() == sum(r.kept for r in got)


def secrets_plain(t):
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    found = [[(m.start(), i, f"{k}:{m.start()}:{m.end()}") for m in r.finditer(t or "") if ok(m)] for i, (k, r, ok) in enumerate(kinds)]
    return *map(len, found), hashlib.sha256(",".join(x[2] for x in sorted(sum(found, []))).encode()).hexdigest()


def test_secret_scan(spark):
    key = "Zx9Qk2LmP0vRt7YwB4nHs8Dc"
    texts = [None, "", f"é Token = '{'a1' * 15}' AKIA{'Z' * 16} " + "f" * 24, "password: short secret=abc", "PASSWD:abcdef passwd: zzzzzz", "AKIAAKIA" + "9" * 12, f"use {key} now", "ordinary_identifier_of_the_program and customerAccountManagerService", "token==abcdefg", "x" * 50000 + " api_key=" + "q" * 8]
    got = secret_scan.secret_scan(docs(spark, enumerate(texts))).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got] == [secrets_plain(t) for t in texts]
    assert "markov:4:28" in got[6].spans and got[7].spans == ""
    clean = secret_scan.redact(docs(spark, enumerate(texts))).orderBy("doc_id").collect()
    assert clean[6].text == "use [SECRET] now" and clean[7].text == texts[7] and clean[0].text is None and "AKIA" not in clean[2].text and clean[2].n == "x"


def test_secret_models_on_unseen_strings(spark):
    """Random strings are told from names that training never saw: recall and false alarms, against the mean log-likelihood ratio computed plainly."""
    rng = random.Random(12)
    table = {k: "".join(chr(c) for c in range(33, 127) if chr(c).isalnum() or (k == "base64" and chr(c) in "+/")) for k in ("base62", "base64")}
    secrets = ["".join(rng.choice(table[rng.choice(list(table))]) for _ in range(rng.randint(24, 48))) for _ in range(400)]
    docs_ = [w for t in pd.read_parquet(f"{SF}/documents.parquet").text.dropna().tolist() for w in re.findall(r"[A-Za-z]{4,}", t)]
    names = [rng.choice("_-/").join(rng.choice(docs_) for _ in range(6))[:60] for _ in range(400)] + ["".join(rng.choice(docs_).capitalize() for _ in range(5))[:60] for _ in range(200)]
    texts = [f"see {x} there" for x in secrets + names]
    got = secret_scan.secret_scan(docs(spark, enumerate(texts))).orderBy("doc_id").collect()
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    ratio = lambda x: sum(model[ord(a) * 128 + ord(b)] for a, b in zip(x, x[1:])) / (len(x) - 1)
    base = [bool(r.n_assign + r.n_access + r.n_hex) for r in got]
    for r, t, b in zip(got, secrets + names, base):
        if not b and len(t) >= 20:
            assert (r.n_markov == 1) == (ratio(t) > secret_scan.THRESHOLD)
    recall, alarms = sum(bool(r.spans) for r in got[:400]) / 400, sum(bool(r.spans) for r in got[400:]) / 600
    assert recall >= 0.98 and alarms <= 0.02, (recall, alarms)


def test_secret_scan_odd_tables(spark):
    rows = docs(spark, [(1, "password=abcdefgh"), (1, "password=abcdefgh"), (None, "password=abcdefgh")])
    assert secret_scan.secret_scan(rows).where("n_assign = 1").count() == 3 and secret_scan.secret_scan(rows.limit(0)).count() == 0
    assert secret_scan.redact(rows.limit(0)).count() == 0 and secret_scan.redact(rows).where("text = '[SECRET]' AND n = 'x'").count() == 3


def test_classifier_odd_tables(spark):
    one = docs(spark, [(1, "good words of the kind"), (1, "good words of the kind"), (1, "##"), (2, "## ** ||"), (None, None)])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0)], "doc_id long, quality int, score int")
    got = quality_classifier.classify(one, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality_classifier.classify(one.limit(0), labels).count() == 0 and {r.score for r in quality_classifier.classify(one, labels.limit(0)).collect()} == {0.5}


def test_tokenizers_odd_tables(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs(spark, [(1, "two words"), (1, "two words"), (None, "two words"), (2, "a" * 300_000), (3, "é x " * 50_000)])
    got = bpe.encode_documents(rows, path).collect()
    assert len(got) == 5 and len({r.ids_sha256 for r in got}) == 3 and bpe.encode_documents(rows.limit(0), path).count() == 0
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in ("two words", "a" * 300_000, "é x " * 50_000)}
    assert token_counts.token_counts(rows, public_tokenizers.path("byte_bpe_50k.json")).where("doc_id = 1 AND n_bytes = 9").count() == 2


def test_classifier(spark):
    a = quality_classifier.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    m = a.toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    h = m[m.held_out]
    assert len(h) > 50 and (h.predicted == h.quality).mean() >= 0.95
    odd = quality_classifier.classify(docs(spark, [(1, None), (None, "x"), (2, "y" * 30000)]), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert {r.score for r in odd.collect()} == {0.5}


def test_decontaminate(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    item = [rng.choice(words) for _ in range(40)]
    edited = item.copy()
    for i in (3, 11, 19, 30):
        edited[i] = "other"
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(1, " ".join(noise(100) + item + noise(50))), (2, ", ".join(noise(30) + edited).upper()), (3, " ".join(noise(400))), (4, " ".join(item[:8] + noise(60))), (5, None), (6, ""), (None, " ".join(item)), (1, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item), 1), (8, None, 1), (None, "a b", 1), (9, "Zed yes", 1)], "item_id long, text string, score int")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0 and got[2, 7] < 1
    assert {r.doc_id for r in decontaminate.decontaminate(docs(spark, rows), bench, block_bytes=50).collect()} == {3, 4, 5, 6}
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def local_score(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


@pytest.mark.parametrize("whole", [False, True])
def test_decontaminate_finds_edited_copies(spark, whole):
    """Copies with a word replaced, added or left out at every 5th to 7th are found as brute force over all pairs finds them, whether or not another document holds the item whole."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: noise(n) for i, n in enumerate((40, 40, 18, 90, 7))}
    edits = [lambda x: ["other"], lambda x: [x, "added"], lambda x: []]
    rows = [noise(30) + [y for j, x in enumerate(item) for y in (edit(x) if j % every == every - 1 else [x])] + noise(rng.choice([0, 25])) for item in items.values() for every in (5, 6, 7) for edit in edits]
    rows += [noise(200) for _ in range(5)] + ([noise(9) + item for item in items.values()] if whole else [])
    want = {(d, i): round(x, 6) for d, r in enumerate(rows) for i, item in items.items() if (x := local_score(item, r) / (2 * len(item))) >= 0.5}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(spark, [(d, " ".join(r)) for d, r in enumerate(rows)]), bench).collect()}
    assert got == want and len(want) >= 45


def test_decontaminate_finds_random_edits(spark):
    """Of copies with random edits that exhaustive alignment accepts, at least 0.9 are found, and nothing else."""
    rng = random.Random(16)
    words = [f"w{i}" for i in range(2000)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    items, rows = {i: noise(rng.randint(15, 60)) for i in range(10)}, []
    for item in items.values():
        for rate in (0.1, 0.2, 0.25, 0.3, 0.35):
            for _ in range(3):
                rows.append(noise(20) + [y for x in item for y in ([x] if rng.random() >= rate else rng.choice([["other"], [x, "more"], []]))] + noise(20))
        rows.append([y for j, x in enumerate(item) for y in ([x] if j % 4 < 3 else ["other"])])  # every 4th word replaced
    want = {(d, i) for d, r in enumerate(rows) for i, item in items.items() if local_score(item, r) / (2 * len(item)) >= 0.5 or local_score(item, r) >= 26}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, [(d, " ".join(r)) for d, r in enumerate(rows)]), bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 100
    assert {d for d, _ in want if d % 16 == 15} == {d for d, _ in got if d % 16 == 15}


def test_decontaminate_long_texts_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    long = docs(spark, [(1, "word " * 400_000 + item), (2, "other " * 300_000)])
    assert [(r.doc_id, r.item_id, r.end_word) for r in decontaminate.contaminated(long, bench).collect()] == [(1, 1, 400_030)]
    assert decontaminate.contaminated(long.limit(0), bench).count() == 0 and decontaminate.decontaminate(long.limit(0), bench).count() == 0
    assert [r.doc_id for r in decontaminate.decontaminate(long, bench).collect()] == [2] and decontaminate.decontaminate(long, bench.limit(0)).count() == 2


def test_decontaminate_finds_passages_of_long_items(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    noise = lambda n: [rng.choice(words) for _ in range(n)]
    item, far = noise(59), noise(900)
    rows = [noise(50) + item[:29] + noise(50), noise(20) + far[300:500] + noise(20), noise(20) + far[-13:], item[:12] + noise(60), noise(30) + item[5:25] + ["other"] + item[26:30], noise(300)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(far))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs(spark, [(d, " ".join(r)) for d, r in enumerate(rows)]), bench).collect()}
    assert got == {(0, 1): round(29 / 59, 6), (1, 2): round(200 / 900, 6), (2, 2): round(13 / 900, 6), (4, 1): round(23.5 / 59, 6)}


def test_warc(spark):
    make = lambda i, kind, url, ts, status, headers, payload: (i, kind, url, ts, status, headers, payload, "x")
    rows = [
        make(1, "response", "http://A.example:80/p/?utm_source=x#f", 1, 200, {"etag": '"1"', "content-type": "t"}, bytearray(b"one")), make(2, "response", "https://a.example/p", 5, 200, {"etag": '"2"'}, bytearray(b"two")), make(3, "response", "https://a.example/p", 6, 404, {}, None),
        make(10, "revisit", "https://www.a.example/p/", 4, 304, {"etag": 'W/"1"', "date": "d", "server": "s"}, None), make(11, "revisit", "https://a.example/p", 7, 304, {"etag": '"1"'}, None), make(12, "revisit", "https://a.example/q", 9, 304, {}, None), make(13, "revisit", "https://a.example/p", 8, 304, {}, None), make(14, "revisit", None, 9, 304, None, None),
    ]
    r = {x.record_id: x for x in warc.resolve(spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload binary, _bin string")).collect()}
    assert {k: (v.original_id, v.verdict) for k, v in r.items()} == {10: (1, "resolved"), 11: (None, "changed"), 12: (None, "missing"), 13: (2, "unchecked"), 14: (None, "missing")}
    assert r[10].headers == {"etag": 'W/"1"', "content-type": "t", "date": "d"} and r[10].digest == hashlib.sha256(b"one").hexdigest()
    rec = warc.captures(spark.read.parquet(f"{SF}/pages.parquet"))
    back = warc.read_records(warc.write_records(rec).select(F.col("warc").alias("content")))
    cols = ["record_id", "kind", "url", "ts", "status", "payload"]
    assert rec.where("payload IS NOT NULL").select(cols).exceptAll(back.select(cols)).count() == 0 and rec.count() == back.count()


def resolved_plain(records):
    """Original and verdict of each revisit, looking at all earlier records."""
    order = lambda r: (r.ts is not None, r.ts or 0, r.record_id, r.kind, hashlib.sha256(bytes(r.payload or b"")).hexdigest())
    out = []
    for r in records:
        if r.kind != "revisit":
            continue
        full = [x for x in records if x.kind == "response" and x.status == 200 and x.canonical and x.canonical == r.canonical and order(x) < order(r)]
        best, own = max(full, key=order, default=None), r.headers or {}
        theirs = (best.headers or {}) if best else {}
        tag = lambda v: v and v.strip().removeprefix("W/")
        if best is None:
            verdict = "missing"
        elif own.get("etag") is not None:
            verdict = "resolved" if tag(own["etag"]) == tag(theirs.get("etag")) else "changed"
        elif own.get("last-modified") is not None:
            verdict = "resolved" if own["last-modified"] == theirs.get("last-modified") else "changed"
        else:
            verdict = "unchecked"
        ok = verdict in ("resolved", "unchecked")
        merged = {**theirs, **{k: v for k, v in own.items() if k in warc.PERMITTED}} if ok else None
        out.append((r.record_id, verdict, best.record_id if ok else None, merged and sorted(merged.items())))
    return out


def test_warc_against_brute_force(spark):
    """Ties, repeated rows, null times, and one URL with half of all records, over many partitions."""
    rng = random.Random(13)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        headers = {k: rng.choice('"1" W/"1" "2"'.split()) for k in ("etag", "last-modified", "date", "server") if rng.random() < 0.4}
        url = "http://hot.example/" if i % 2 else f"https://www.h{rng.randint(0, 9)}.example/p?b=1&a={rng.randint(0, 1)}"
        rows.append((i // 3 if rng.random() < 0.2 else 1000 + i, kind, url, None if rng.random() < 0.05 else rng.randint(0, 60), rng.choice([200, 200, 404]), headers or None, bytearray(str(i).encode()), "x"))
    rows += rng.sample([r for r in rows if r[1] == "revisit"], 10)
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload binary, _value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = [(r.record_id, r.verdict, r.original_id, r.headers and sorted(r.headers.items())) for r in warc.resolve(df).collect()]
        records = df.withColumn("canonical", warc.canonical_url(F.col("url"))).collect()
        assert warc.resolve(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, got)) == sorted(map(str, resolved_plain(records))) and {x[1] for x in got} == {"resolved", "changed", "unchecked", "missing"}


def test_warc_query_reads_what_it_writes(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got, want = queries.op9_warc_revisits(spark, SF), warc.flat(warc.resolve(warc.captures(pages)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_warc_of_others(spark):
    def record(kind, ident, date, profile=""):
        block = b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\nbody" if kind == "response" else b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n"
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{ident}>\r\nWARC-Target-URI: http://a.example/\r\nWARC-Date: {date}\r\n" + (f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/{profile}\r\n" if profile else "")
        return (head + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"

    ids = [f"{a}1234567-1234-4123-8123-123456789012" for a in "abcd"]
    raw = [record("response", ids[0], "2024-01-02T00:00:00Z"), record("response", ids[1], "2024-01-04T00:00:00.5Z"), record("revisit", ids[2], "2024-01-03T00:00:00Z", "server-not-modified"), record("revisit", ids[3], "2024-01-05T00:00:00Z", "identical-payload-digest")]
    rows = [[r.asDict() for r in warc.read_records(spark.createDataFrame([(bytearray(x),)], "content binary")).collect()] for x in (b"".join(raw), b"".join(map(gzip.compress, raw)), gzip.compress(b"".join(raw)))]
    assert rows[0] == rows[1] == rows[2] and len({r["record_id"] for r in rows[0]}) == 4
    assert rows[0][1]["ts"] == 1704326400500000 and rows[0][3]["kind"] == "revisit:identical-payload-digest"
    got = warc.resolve(warc.read_records(spark.createDataFrame([(bytearray(gzip.compress(b"".join(raw))),)], "content binary"))).collect()
    assert [(r.original_id, r.verdict) for r in got] == [(rows[0][0]["record_id"], "resolved")]


def test_warc_revisits_of_every_page(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.resolve(warc.captures(pages))
    assert got.count() == pages.count() and {r.verdict for r in got.select("verdict").collect()} >= {"resolved", "changed", "unchecked"}


def test_quotation(spark):
    m = [(1, 0, "u", "Hello there\nfriend"), (1, 1, "a", "hi\n\nsecond  para"), (1, 2, "u", "> > Hello there\n> > friend\n> second para\nyes"), (1, 3, "a", "> Hello there\nok"), (2, 0, "u", "> Hello there\nfrom afar"), (2, 0, "u", "> Hello there\nfrom afar"), (3, None, None, None), (None, 1, "x", "> nothing like it")]
    df = spark.createDataFrame([(*x, 1) for x in m], "conv_id int, turn int, role string, text string, id int")
    got = [tuple(r[c] for c in ("conv_id", "turn", "clean", "n_quotes", "n_linked", "n_foreign", "parent_turn", "depth")) for r in quotation.link_quotations(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 0, "Hello there\nfriend", 0, 0, 0, None, 0), (1, 1, "hi\n\nsecond  para", 0, 0, 0, 0, 1), (1, 2, "yes", 2, 2, 0, 1, 2), (1, 3, "ok", 1, 1, 0, 0, 1), (2, 0, "from afar", 1, 0, 1, None, 0), (2, 0, "from afar", 1, 0, 1, None, 0), (3, None, "", 0, 0, 0, None, 0), (None, 1, "", 1, 0, 0, None, 0)]))
    assert quotation.link_quotations(df.limit(0)).count() == 0


def test_quotation_of_what_comes_later_too(spark):
    """A passage that stands later in the message's own conversation, the one of the least conv_id, and in another."""
    m = [(1, 0, "u", "> shared words"), (1, 1, "a", "shared words"), (2, 0, "u", "shared words"), (3, 0, "u", "> only here later"), (3, 1, "a", "only here later"), (4, 0, "u", "> nowhere at all")]
    got = quotation.link_quotations(spark.createDataFrame(m, "conv_id int, turn int, role string, text string")).collect()
    assert {(r.conv_id, r.turn) for r in got if r.n_foreign} == {(1, 0)} and sum(r.n_foreign for r in got) == 1


def threads_plain(messages):
    """Per message (conv, turn, role, text, in that order sorted by conversation): its counts, parent, root, depth and position, looking at all pairs."""
    own, seen = [], set()
    for m in messages:
        if m not in seen:
            seen.add(m)
            own.append(m)
    own.sort(key=lambda m: (m[0], m[1], quotation.message_id(*m)))
    parts = [quotation.passages(m[3]) for m in own]
    norm = lambda t: " ".join(t.lower().split())
    texts = [{norm(t) for level, ls in p if not level for t in [*ls, "\n".join(ls)]} for p in parts]
    out = {}
    for i, m in enumerate(own):
        links, n_foreign = [], 0
        for no, (level, ls) in enumerate(parts[i]):
            if not level:
                continue
            tries = [norm("\n".join(ls)), norm(ls[0])]
            found = [max((j for j in range(len(own)) if own[j][0] == m[0] and own[j][1] < m[1] and t in texts[j]), default=None) for t in tries]
            source = next((j for j in found if j is not None), None)
            links.append((level, no, source))
            n_foreign += source is None and any(t in texts[j] and own[j][0] != m[0] for t in tries for j in range(len(own)))
        best = min((x for x in links if x[2] is not None), default=(0, 0, i - 1 if i and own[i - 1][0] == m[0] else None))[2]
        root, depth = (i, 0) if best is None else (out[own[best]][-1], out[own[best]][5] + 1)
        position = 0 if not i or own[i - 1][0] != m[0] else out[own[i - 1]][6] + 1
        out[m] = (len(links), sum(x[2] is not None for x in links), n_foreign, None if best is None else own[best][1], own[root][1], depth, position, root)
    return [(*m[:3], quotation.unquoted(m[3]), *out[m][:7]) for m in messages]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotation_of_random_threads(spark, seed):
    """Nested, edited, repeated and foreign quotations; one conversation has half of all messages, and so lies in many partitions."""
    rng = random.Random(seed)
    words, messages = ["alpha", "Beta", "gamma", "delta", "EPS", "zeta", "eta", "theta"], []
    for turn in range(60):
        for conv in (0, *rng.sample(range(1, 9), 1)):
            text = "\n".join(" ".join(rng.choices(words, k=3)) for _ in range(rng.randint(1, 3)))
            if rng.random() < 0.1:
                text = "Thank you"
            if messages and rng.random() < 0.6:
                c, _, _, q = rng.choice([m for m in messages if m[0] == conv] or messages if rng.random() < 0.8 else messages)
                q = "\n".join(rng.choice(["> ", ">", " >  "]) + x.upper().replace(" ", "  ") for x in q.split("\n")[: rng.randint(1, 9)])
                text = rng.choice([q + "\n" + text, text + "\n\n" + q, q + "\n> never said\n" + text, q])
            messages.append((conv, turn if rng.random() < 0.9 else max(turn - 1, 0), rng.choice("ua"), text))
            if rng.random() < 0.05:
                messages.append(messages[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string").repartition(5)
        linked = quotation.link_quotations(df)
        got = [tuple(r[c] for c in ("conv_id", "turn", "role", "clean", "n_quotes", "n_linked", "n_foreign", "parent_turn", "root_turn", "depth", "position")) for r in linked.collect()]
        whole = quotation.conversations(linked, most=7).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = threads_plain(messages)
    assert sorted(got) == sorted(want) and max(x[9] for x in got) > 5 and any(x[6] for x in got)
    assert max(len(r.messages) for r in whole) == 7
    chats = {}
    for r in sorted(whole, key=lambda r: (r.conv_id, r.part)):
        chats.setdefault(r.conv_id, []).extend((m.position, m.role, m.text) for m in r.messages)
    assert chats == {c: sorted({(x[10], x[2], x[3]) for x in want if x[0] == c}) for c in {x[0] for x in want}}


def test_quotation_made_and_taken_away(spark):
    """What quoting() adds is linked and removed again; a message quotes the one before, or the one before that."""
    m = [(c, t, "u", f"Text {c} {t}\nand  more of it") for c in range(3) for t in range(7)]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotation.link_quotations(quotation.quoting(df)).collect()}
    assert {k: r.clean for k, r in got.items()} == {x[:2]: x[3] for x in m}
    assert all(r.n_quotes == r.n_linked == (0 if not t or t == 0 else 2 if t % 3 == 0 else 1) and r.parent_turn == (None if not t else t - 2 if t % 3 == 2 else t - 1) for (_, t), r in got.items())


def test_quotation_of_long_texts(spark):
    """Time and memory are linear in a text's length."""
    long = "\n".join(f"line {i}" for i in range(200_000))
    m = [(1, 0, "u", long), (1, 1, "a", "\n".join("> " + x for x in long.split("\n")) + "\nyes"), (1, 2, "u", "> line 199999\nend" + " x" * 1_000_000)]
    got = {r.turn: r for r in quotation.link_quotations(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_quotes, got[1].n_linked, got[1].parent_turn, got[1].clean) == (1, 1, 0, "yes") and got[2].parent_turn == 0 and got[2].clean.startswith("end x")


def test_pipeline(spark):
    import corpus_pipeline

    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    d = pd.read_parquet(f"{SF}/documents.parquet")
    d = d[d.doc_id.isin([r.doc_id for r in quality_rules.quality_rules(spark.createDataFrame(d)).where("kept").collect()])]
    comp = {a: c for a, _, c in jaccard_plain(list(zip(d.doc_id.tolist(), d.text)), 5, 80, 100)}
    d = d[[comp[i] == i for i in d.doc_id]]
    bench = {" ".join(re.findall(r"[^\W_]+", t.lower())) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text}
    d = d[[not any(b in " ".join(re.findall(r"[^\W_]+", t.lower())) for b in bench) for t in d.text]]
    assert set(got) == set(d.doc_id) and len(corpus_pipeline.STAGES) == 5
    whole = [(i, t) for i, t in zip(d.doc_id, d.text) if secrets_plain(t)[:3] == (0, 0, 0)]
    same = sum(got[i] == hashlib.sha256(t.encode()).hexdigest() for i, t in whole)
    assert same >= 0.98 * len(whole) and same < len(d) + 1


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows and ids, a leak without doc_id, a secret, and columns with names that stages use themselves."""
    import corpus_pipeline

    rng = random.Random(20)
    words = [w for t in pd.read_parquet(f"{SF}/documents.parquet").query("lang == 'en'").text.dropna() for w in re.findall(r"[a-z]+", t)] + ["the", "of", "and", "to"] * 300
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, c, d, item = (prose(n) for n in (120, 130, 140, 150, 40))
    rows = [
        (1, a, "en", "s", 1, 7, "k"), (1, a, "en", "s", 1, 7, "k"), (1, b, None, None, None, None, None), (2, a + " tail", "en", "s", 2, 1, "j"), (None, c, "en", "s", 3, 2, "x"), (None, c, "en", "r", 3, 2, "x"),
        (None, prose(60) + " " + item + " " + prose(60), "en", "s", 4, 3, "x"), (3, None, "en", "s", 5, 4, "x"), (4, "", "en", "s", 6, 5, "x"), (5, "few words", "en", "s", 7, 6, "x"), (6, d + " password=abcdefghij1", "en", "s", 8, 7, "x"),
    ]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, _node string")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs_.columns, name
    kept = sorted(map(tuple, left.collect()), key=str)
    first = min((a, b), key=lambda t: hashlib.md5(t.encode()).digest())
    want = [(None, c, "en", "r", 3, 2, "x"), (6, d + " [SECRET]", "en", "s", len(d) + 9, 7, "x"), (1, b, None, None, None, None, None), (1, a, "en", "s", 1, 7, "k") if first == a else (2, a + " tail", "en", "s", 2, 1, "j")]
    want = [(*x[:4], len(x[1]), *x[5:]) for x in want]  # redaction counts characters anew
    assert kept == sorted(want, key=str)
    tokens = corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in tokens) == sorted((str(x[0]), hashlib.sha256(x[1].encode()).hexdigest()) for x in want)
    left = docs_.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
    assert left.count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_keys_and_signatures_lose_no_link(monkeypatch, num):
    """Sets at the threshold have a key in common whose signatures are close; gathering rows keeps them together."""
    rng, t = np.random.default_rng(num), jaccard_join.Threshold(num, 100)
    monkeypatch.setattr(jaccard_join, "MANY", 3)

    def fresh(n):
        return rng.integers(0, 2**64, n, dtype=np.uint64)

    for n in [1, 2, 5, 9, 10, 20, 33, 100, 400] * 5:
        base = np.unique(fresh(n))
        family = [base]
        for _ in range(12):
            swap = int(rng.integers(0, n * (100 - num) // (100 + num) + 1))
            family.append(np.unique(np.concatenate((rng.permutation(base)[swap:], fresh(swap)))))
        ks = [jaccard_join.keys_of(s, t) for s in family]
        doc = np.repeat(np.arange(len(family)), [len(k[0]) for k in ks])
        marks = jaccard_join.Marks(*(np.concatenate(x) for x in zip(*ks)), np.zeros(len(doc), np.uint8), doc)
        marks.gather()
        marks.match()
        u, v = marks.forest()
        joined = {(a, b) for x in set(v.tolist()) for a in [x, *u[v == x]] for b in [x, *u[v == x]]}
        for i, a in enumerate(family):
            for j, b in enumerate(family[:i]):
                same = len(np.intersect1d(a, b))
                if 100 * same >= num * (len(a) + len(b) - same) and a.tobytes() != b.tobytes():
                    assert (i, j) in joined

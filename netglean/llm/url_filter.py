"""URL filter: rules for hosts and paths, and for what no rule fits a logistic regression on hashed character n-grams of host and path.

A URL's host is what stands after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; its path goes on up to a question mark or hash. A rule
fits its host and all subdomains if the path begins with the rule's; of those that fit, the one of the longest text (host and path) holds, of equally long ones the longer host. Few rules
become one column expression; many are joined by host and path prefix, where only distinct pairs of host and path travel.

The model's features are the n-grams of GRAMS code points of host and path, each framed by markers and hashed with its part's salt into BUCKETS counts. It is trained
by Newton steps on a small table of labelled URLs (at most MOST_LABELLED rows, those with the least hashes; a driver-side fit). Weights are rounded to
multiples of 1/UNIT and the path's and host's sums are means, so that a score is exact integer arithmetic, equal in every engine, and doesn't grow with a URL's length.

A null URL or one without :// has an empty host and path, fits no rule and is allowed, like every score that is not above 0. Each row has its own result, so repeated rows and ties have no effect;
long URLs are worked on whole; an empty table gives an empty result. Further columns have no influence.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAMS, BUCKETS, UNIT, RIDGE = (3, 4), 1 << 12, 1 << 16, 0.02
MOST_LABELLED = 20_000
#: Rules up to this many become an expression.
FEW_RULES = 200
_BASE, _MODULUS, _SALT = 1_000_003, (1 << 31) - 1, (17, 7919)  # of the n-grams' hash; salts of host and path
_OPEN, _CLOSE = 2, 3  # code points that frame a text
_CHUNK = 1 << 21  # code points that are worked on at once

#: Rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Words of unwanted and of ordinary hosts, and syllables of made-up names (ordinary), from which labelled() makes the training table.
UNWANTED = "casino poker slots betting bets gamble jackpot lottery pills pharma viagra replica cheap loans payday credit cash bonus winner prize xxx adult escort webcam torrent crack keygen warez spam ads tracker phishing malware clickbait free".split()
ORDINARY = "news blog garden history library museum school science travel recipes music weather city sport forum docs wiki journal health market studio design coffee river mountain photo market-place open".split()
ONSETS, RHYMES = "b c d f g h k l m n p r s t v w br cl dr fl gr pl pr sh st th tr wh".split(), "a e i o an ar en er es in ing ion it on or ous un y".split()


def labelled() -> list[tuple[str, int]]:
    """A small table of URLs with labels, 1 for unwanted: every word in some hosts and paths, and made-up names, by a fixed rule."""
    out = []
    for i in range(500):
        name = "".join(ONSETS[(i * 11 + j * (i // 27 + 5)) % len(ONSETS)] + RHYMES[(i * 5 + j * (i // 18 + 7)) % len(RHYMES)] for j in range(2 + i % 2))
        site, top = ("", ".example", "-online")[i % 3], ("com", "net", "org", "info")[i // 3 % 4]
        out.append((f"http{'s' * (i % 2)}://{('', 'www.', 'm.', 'blog.')[i // 2 % 4]}{name}{site}.{top}{('', '/', f'/{i}', f'/en/{i * 7}.html', f'/{name}/{i}/')[i % 5]}", 0))
    for words, label in ((UNWANTED, 1), (ORDINARY, 0)):
        for i, a in enumerate(words):
            for j in range(1, 6):
                b = words[(i * 7 + j * 5) % len(words)]
                top, sub = ("com", "net", "org", "info")[(i + j) % 4], ("", "www.", "m.", "blog.")[(i + 2 * j) % 4]
                page = ("", "/", f"/{(i * 31 + j * 17) % 900}", f"/en/{(i * 13 + j) % 1000}.html", f"/{('de', 'fr', 'es')[j % 3]}/{i * j}/")[(i + 3 * j) % 5]
                site = ("", ".example", "-online")[(i + j) % 3]
                out.append((f"http://{sub}{a}-{b}{site}.{top}{page}", label))
                if label:
                    plain = ORDINARY[(i * 3 + j * 7) % len(ORDINARY)]
                    out.append((f"http://{sub}{f'{a}-{plain}' if j % 2 else f'{plain}-{a}'}{('.example', '-online', '')[(i + j) % 3]}.{top}{page}", 1))
                if label == 0:
                    out.append((f"https://{sub}{a}{b}{site}.{top}{page}", 0))
                else:
                    out.append((f"https://{sub}{ORDINARY[(i + j) % len(ORDINARY)]}.{top}/{a}/{b}{page}", 1))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)


def _order(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))


def by_expression(pairs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pairs (host, path) with rule and rule_verdict, by one expression that tries the longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in reversed(_order(rules)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return pairs.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def by_join(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with a table of rules (host, path, verdict) of any size.

    A distinct pair has one candidate for each of its host's suffixes and each length that rules' paths have (there are few), and meets rules by
    equality of both; pairs then meet their rule. Rules that differ in the verdict alone: the lesser verdict, allow, holds.
    """
    r = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    r = r.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    lengths = sorted(x[0] for x in r.select(F.char_length("rule_path")).distinct().collect())
    label = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    heads = F.transform(F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.substring("path", F.lit(1), n))
    tried = pairs.select("host", "path").distinct().select("host", "path", F.explode(hosts).alias("rule_host"), heads.alias("heads")).select("host", "path", "rule_host", F.explode("heads").alias("rule_path"))
    size = F.char_length("rule_host")
    best = tried.join(r, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), F.struct(size + F.char_length("rule_path"), size)).alias("r"))
    return pairs.join(best, ["host", "path"], "left").select(*pairs.columns, F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.rule_verdict").alias("rule_verdict"))


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, each framed, and the rows' offsets."""
    texts = pc.fill_null(column, "")
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    off = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(off[-1], np.int64)
    inner = np.ones(off[-1], bool)
    inner[off[:-1]] = inner[off[1:] - 1] = False
    out[inner] = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    out[off[:-1]], out[off[1:] - 1] = _OPEN, _CLOSE
    return out, off


def grams(column: pa.Array, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The row and bucket of every n-gram of the texts."""
    c, off = _points(column)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    rows, buckets = [], []
    for n in GRAMS:
        if len(c) < n:
            continue
        h = np.full(len(c) - n + 1, salt * n, np.int64)
        for i in range(n):
            h = (h * _BASE + c[i : len(c) - n + 1 + i]) % _MODULUS
        inside = row[: len(h)] == row[n - 1 :]
        rows.append(row[: len(h)][inside])
        buckets.append(h[inside] % BUCKETS)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Model:
    """Integer weights, for n-grams of the host and of the path, and the bias, all in 1/UNIT."""

    weights: tuple[np.ndarray, np.ndarray]
    bias: int

    def scores(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """UNIT times the log-odds that a URL is unwanted, rounded down; 0 for an empty host and path."""
        out = np.full(len(host), self.bias, np.int64)
        some = np.zeros(len(host), bool)
        for column, weight, salt in zip((host, path), self.weights, _SALT):
            row, bucket = grams(column, salt)
            total = np.zeros(len(column), np.int64)
            np.add.at(total, row, weight[bucket])
            n = np.bincount(row, minlength=len(column))
            out += total // np.maximum(n, 1)
            some |= pc.utf8_length(pc.fill_null(column, "")).to_numpy(zero_copy_only=False) > 0
        return np.where(some, out, 0)


def _matrix(host: pa.Array, path: pa.Array) -> np.ndarray:
    x = np.zeros((len(host), 2 * BUCKETS + 1))
    x[:, -1] = 1
    for k, (column, salt) in enumerate(zip((host, path), _SALT)):
        row, bucket = grams(column, salt)
        np.add.at(x, (row, k * BUCKETS + bucket), 1)
        x[:, k * BUCKETS : (k + 1) * BUCKETS] /= np.maximum(np.bincount(row, minlength=len(host)), 1)[:, None]
    return x


def train(host: pa.Array, path: pa.Array, label: np.ndarray) -> Model:
    """Logistic regression by Newton steps with a ridge, in the space of the labelled rows (there are fewer of them than buckets or about as many); without both labels all weights are 0."""
    zero = np.zeros(BUCKETS, np.int64)
    if not (label.any() and (~label).any()):
        return Model((zero, zero), 0)
    x = _matrix(host, path)
    x[:, :-1] *= 30  # means of n-gram counts are small; this sets the ridge's strength against them
    gram, a = x @ x.T, np.zeros(len(x))
    share = np.where(label, 0.5 / label.mean(), 0.5 / (~label).mean())  # both labels weigh the same
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(gram @ a, -30, 30)))
        v = np.maximum(share * p * (1 - p), 1e-9)
        new = np.linalg.solve(v[:, None] * gram + RIDGE * len(x) / 30 * np.eye(len(x)), v * (gram @ a) + share * (label - p))
        done, a = np.abs(new - a).max() < 1e-7, new
        if done:
            break
    w = x.T @ a
    w[:-1] *= 30
    q = np.round(w * UNIT).astype(np.int64)
    return Model((q[:BUCKETS], q[BUCKETS : 2 * BUCKETS]), int(q[-1]))


def train_table(urls: DataFrame) -> Model:
    """The model of labelled URLs (url, label 0 or 1): at most MOST_LABELLED distinct ones, those with the least hashes; contradictory ones are left out."""
    known = urls.where("url IS NOT NULL AND label IN (0, 1)").groupBy("url").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    host, path = parts(F.col("url"))
    rows = known.orderBy(F.xxhash64("url"), "url").limit(MOST_LABELLED).select(host.alias("host"), path.alias("path"), "label").collect()
    return train(pa.array([r["host"] for r in rows], pa.string()), pa.array([r["path"] for r in rows], pa.string()), np.array([r["label"] == 1 for r in rows], bool))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, model: Model) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of each page (page_id, url)."""
    host, path = parts(F.col("url").cast("string"))
    pairs = pages.select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        few = [tuple(r) for r in rules.select("host", "path", "verdict").limit(FEW_RULES + 1).collect()]
        found = by_join(pairs, rules) if len(few) > FEW_RULES else by_expression(pairs, few)
    else:
        found = by_expression(pairs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.add(pc.utf8_length(b.column("host")), pc.utf8_length(b.column("path"))).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(size), 0
            while at < b.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, "right")))
                part = b.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(part.column("host"), part.column("path")))], [*part.schema.names, "score"])
                at = stop

    kind = found.schema["page_id"].dataType.simpleString()
    scored = found.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, rule_verdict string, score long")
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


@functools.cache
def own_model() -> Model:
    """The model of labelled()."""
    rows = labelled()
    cut = [re.match(r"[^/]*://([^/?#]*)([^?#]*)", u).groups() for u, _ in rows]
    return train(pa.array([h for h, _ in cut]), pa.array([p for _, p in cut]), np.array([y == 1 for _, y in rows]))


def sql(model: Model, rules: list[tuple[str, str, str]]) -> str:
    """DuckDB SQL for judge() with this model and these rules."""
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for h, p, v in _order(rules))
    sums = []
    for k, (name, salt) in enumerate(zip(("host", "path"), _SALT)):
        for n in GRAMS:
            h = f"{salt * n}::BIGINT"
            for i in range(n):
                h = f"(({h}) * {_BASE} + unicode(substr(t, i + {i}, 1))) % {_MODULUS}"
            sums.append(f"SELECT page_id, {k} AS part, w[{k} + 1][({h}) % {BUCKETS} + 1] AS x FROM (SELECT page_id, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM (SELECT page_id, concat(chr({_OPEN}), {name}, chr({_CLOSE})) AS t FROM u)), weights")
    lists = ", ".join(f"[{', '.join(map(str, w.tolist()))}]" for w in model.weights)
    return rf"""
WITH weights AS MATERIALIZED (SELECT [{lists}] AS w), r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS MATERIALIZED (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), g AS (
  {" UNION ALL ".join(sums)}
), s AS (
  SELECT page_id, sum(x)::BIGINT AS score FROM (SELECT page_id, part, floor(sum(x) / count(*)) AS x FROM g GROUP BY page_id, part) GROUP BY page_id
), f AS (
  SELECT page_id, host, path, CASE {when} END AS r, CASE WHEN host = '' AND path = '' THEN 0 ELSE coalesce(score, 0) + {model.bias} END AS score FROM u LEFT JOIN s USING (page_id)
)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score::BIGINT AS score FROM f
"""

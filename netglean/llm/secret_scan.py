"""Secret scans by built-in functions: fixed patterns, and Markov models of random strings and of identifiers.

Spans are (start, end) in code points, end exclusive. A null text counts as empty and has no spans. Documents are judged
one by one, so ties and repeated rows have no effect; an empty table gives an empty result; extra columns are ignored. Long texts are scanned whole.

The two models are first-order Markov chains over characters, counted from labelled samples (text, is_random).
A candidate, a run of 20 or more characters of tokens, is a secret when the mean log-likelihood ratio of its
transitions is over a threshold, it has at least LEAST_CHARACTERS different characters, and it isn't of an ordinary SHAPE (a UUID, a number of groups
of letters followed by digits). A transition counts the less, the fewer samples of its first character there were. What reaches the driver of the models is one row for each pair of ASCII characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and the least length of the group of that number; kinds are listed in the order of ties.
BASE = (("assign", ASSIGN, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24))
#: The hex pattern takes whole runs of 24 or more, which equals dropping shorter runs; a cheap test of texts for each kind.
HINT = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "markov": r"[A-Za-z0-9+/_=-]{20}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Least mean log-likelihood ratio of a transition, in nats.
THRESHOLD = 0.7
#: Least number of different characters of a random string (rules, sequences of bases and repetitions have fewer), and shapes of ordinary identifiers; digits alone, with up to four letters
#: before them or separators between them, are numbers of accounts, dates and versions.
LEAST_CHARACTERS = 10
SHAPES = (r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", r"[A-Za-z]{0,4}[0-9]+([-_/=+][A-Za-z]{0,4}[0-9]+)*", r"([A-Za-z]{2,12}[-_/=+]?[0-9]{0,5}[-_/=+])+[A-Za-z]{0,12}[-_/=+]?[0-9]{0,5}")
#: A transition's ratio is multiplied by n / (n + SHRINK), n the samples of its first character.
SHRINK = 50
#: How many labelled samples of each class the default training set has.
SAMPLES = 4000

#: Parts of ordinary names in programs and prose.
PARTS = (
    "account address array background buffer cache change channel client color column command config connection content context control "
    "count create customer data database date default delete description device directory document element email enable end error event "
    "field file filter format function group handler header height image index input instance interface invoice item label language length "
    "level limit list location manager master memory message method model module name network node number object option order output page "
    "parameter parent password path payment point position process product project property query record request resource response result "
    "schema screen search section select server service session setting shipping source start state status storage string system table "
    "target task template thread time timestamp title token total transaction transfer type update user value version view warning width window "
    "ation erung keit heit mente ciones tion ment eaux ouche asado undes chen lich ning thing there ering ented inate ourage ennes"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """n random strings (hexadecimal, base64 and base62 digests) and n identifiers in several styles, the same each time."""
    ids = spark.range(n, numPartitions=1)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(digest))
    random = ids.select(F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(b64, "[+/=]", ""))).otherwise(b64).alias("text"), F.lit(True).alias("is_random"))
    parts = F.array(*map(F.lit, PARTS))
    pick = [F.element_at(parts, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))) + 1).cast("int")) for k in range(4)]
    four = F.array(*pick)
    styles = [F.array_join(four, "_"), F.array_join(four, "-"), F.array_join(F.transform(four, F.initcap), ""), F.upper(F.array_join(four, "_")), F.array_join(four, ""), F.array_join(four, "/"), F.concat(F.array_join(four, "_"), F.lit("_"), (F.col("id") % 100).cast("string")), F.array_join(four, "=")]
    name = styles[0]
    for k, s in enumerate(styles[1:], 1):
        name = F.when(F.col("id") % len(styles) == k, s).otherwise(name)
    return random.unionByName(ids.select(name.alias("text"), F.lit(False).alias("is_random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition between ASCII characters, at index 128 * first + second, with one added to each count and drawn to 0 where samples are few."""
    pairs = samples.where(F.length("text") > 1).select("is_random", F.explode(F.expr("transform(sequence(1, length(text) - 1), i -> ascii(substr(text, i, 1)) * 128 + ascii(substr(text, i + 1, 1)))")).alias("pair"))
    pairs = pairs.where("pair < 16384").groupBy("pair").agg(F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("o"))
    table = "+/_=-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    seen = {x["pair"]: (x["r"], x["o"]) for x in pairs.collect()}  # at most one row for each pair of characters
    out = [0.0] * 16384
    for a in map(ord, table):
        n = sum(sum(seen.get(a * 128 + b, (0, 0))) for b in map(ord, table))
        r, o = (sum(seen.get(a * 128 + b, (0, 0))[k] + 1 for b in map(ord, table)) for k in (0, 1))
        for b in map(ord, table):
            x, y = seen.get(a * 128 + b, (0, 0))
            out[a * 128 + b] = round((math.log((x + 1) / r) - math.log((y + 1) / o)) * n / (n + SHRINK), 4)
    return out


def spans(text: Column, kind: str, pattern: str, keep: str) -> Column:
    """Array of (start, order, kind, end) of a pattern's matches m with group g that hold keep; null where the hint finds none."""
    order = ["assign", "access", "hex", "markov"].index(kind)
    pattern = pattern.replace("\\", "\\\\").replace("'", "\\'")
    group = 2 if kind == "assign" else 0
    t = "text"
    body = f"""
      transform(array(struct(split({t}, '{pattern}', -1) AS p, regexp_extract_all({t}, '{pattern}', 0) AS m, regexp_extract_all({t}, '{pattern}', {group}) AS g)),
        x -> aggregate(
          arrays_zip(x.p, x.m, x.g),
          struct(0 AS at, CAST(array() AS ARRAY<STRUCT<start: INT, ord: INT, kind: STRING, end: INT>>) AS out),
          (acc, y) -> struct(
            acc.at + length(y.p) + coalesce(length(y.m), 0) AS at,
            CASE WHEN y.m IS NOT NULL AND {keep} THEN concat(acc.out, array(struct(acc.at + length(y.p) AS start, {order} AS ord, '{kind}' AS kind, acc.at + length(y.p) + length(y.m) AS end)))
                 ELSE acc.out END AS out),
          acc -> acc.out))[0]"""
    return F.when(text.rlike(HINT[kind]), F.expr(body))


def find(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns assign, access, hex and markov, sorted arrays of spans; those by the models don't touch the others."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, ord: INT, kind: STRING, end: INT>>)")
    df = docs
    for kind, pattern, _, least in BASE:
        df = df.withColumn(kind, F.coalesce(spans(F.col("text"), kind, pattern, f"length(y.g) >= {least}"), none))
    table = "from_json('[" + ",".join(map(str, model)) + "]', 'array<double>')"
    ratio = f"""aggregate(zip_with(slice(split(y.m, ''), 1, length(y.m) - 1), slice(split(y.m, ''), 2, length(y.m) - 1), (a, b) -> {table}[ascii(a) * 128 + ascii(b)]), 0D, (acc, v) -> acc + v) > {threshold}D * (length(y.m) - 1)"""
    ordinary = "|".join(SHAPES)
    ratio = f"""size(array_distinct(split(y.m, ''))) >= {LEAST_CHARACTERS} AND NOT y.m RLIKE '^({ordinary})$' AND {ratio}"""
    df = df.withColumn("markov", F.coalesce(spans(F.col("text"), "markov", CANDIDATE, ratio), none))
    df = df.withColumn("base", F.concat("assign", "access", "hex"))
    return df.withColumn("markov", F.expr("CASE WHEN size(markov) = 0 OR size(base) = 0 THEN markov ELSE filter(markov, m -> NOT exists(base, b -> b.start < m.end AND m.start < b.end)) END"))


def listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: counts of each kind of pattern, a hash of their spans, and all spans with those of the models."""
    model = train(samples if samples is not None else labelled_samples(docs.sparkSession))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    df = find(df, model, threshold)
    return df.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(F.sort_array("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "markov"))).alias("spans"),
        F.size("markov").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of text, or run of overlapping spans, replaced by mark, and n_chars renewed where there is one; other columns stay."""
    model = train(samples if samples is not None else labelled_samples(docs.sparkSession))
    kept = docs.columns
    df = find(docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce("text", F.lit("")).alias("text")), model, threshold)
    df = df.select("row", "text", F.sort_array(F.concat("base", "markov")).alias("spans"))
    mark = mark.replace("\\", "\\\\").replace("'", "\\'")
    cut = f"""
      aggregate(spans, struct(0 AS at, CAST(array() AS ARRAY<STRING>) AS out),
        (acc, x) -> CASE WHEN x.start < acc.at OR (acc.at > 0 AND x.start = acc.at) THEN struct(greatest(acc.at, x.end) AS at, acc.out AS out)
          ELSE struct(x.end AS at, concat(acc.out, array(substring(text, acc.at + 1, x.start - acc.at), '{mark}')) AS out) END,
        acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1)))"""
    new = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.expr(cut))
    df = df.select("row", new.alias("new"))
    return df.select(*(F.col("new").alias("text") if c == "text" else F.when(F.col("new").isNotNull(), F.length("new")).otherwise(F.col("row.n_chars")).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in kept))

"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words and fails. Every document is judged by itself, so
ties and repeated rows have no effect; an empty table gives an empty result; extra columns are ignored.
Repeated 3-word windows are sought by hash first; only texts with an equal pair of hashes are
looked at by their strings, so the counts are exact.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Frequent function words of English, Spanish, French and German.
STOP_WORDS = (
    "the of and to in a is that it was for on with are by an this from as or "
    "de la el que en los las del un una por con es para su al y se lo como "
    "le les des et est une du dans pour qui au il sur ce pas ne "
    "der die und den das ist von zu mit im nicht ein eine sich auf dem"
).split()


class Rule(NamedTuple):
    """Kept while low <= 100 * part / whole <= high; part and whole are names of counts, a missing bound doesn't bind."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols", "n_symbols", "n_words", None, 20),
    Rule("stop_words", "n_stop_words", "n_words", 5, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def counts(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, or the column key, and the counts that rules name, all from built-in functions."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long").alias("doc_id") if key is None else key.alias("doc_id")
    df = docs.select(key, text.alias("text"))
    df = df.select("doc_id", "text", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    df = df.withColumn("hashes", F.expr("CASE WHEN size(w) >= 4 THEN transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END"))
    stop = rf"(?i)(?<![^\x20\x09-\x0D])(?:{'|'.join(STOP_WORDS)})(?=[.,;:]?(?:[\x20\x09-\x0D]|\z))"
    repeated = """
        CASE WHEN hashes IS NULL OR size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE
          transform(
            array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g, i AS i)))),
            s -> aggregate(
              sort_array(transform(filter(s, (x, j) -> x.g = get(s, j - 1).g OR x.g = get(s, j + 1).g), x -> x.i)),
              struct(-10 AS last, 0L AS n),
              (acc, p) -> struct(p AS last, acc.n + least(3, p - acc.last) AS n),
              acc -> acc.n))[0] END"""
    return df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike(r"[#*$%&|<>]"), F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
        F.regexp_count("text", F.lit(stop)).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def verdict(rules: tuple[Rule, ...]) -> Column:
    out = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 100, F.col(r.whole)
        if r.low is not None:
            out = out & (part >= whole * r.low)
        if r.high is not None:
            out = out & (part <= whole * r.high)
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    return _judged(counts(docs), rules)


def _judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs without the rows that the rules reject, all columns as they are."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    # an id in the projection keeps the filter above it; pushed down, it would repeat every count's expression
    judged = _judged(counts(docs, row), rules).withColumn("at", F.monotonically_increasing_id())
    return judged.where("kept AND at >= 0").select(*(F.col(f"doc_id.`{c}`").alias(c) for c in docs.columns))


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    parts = [f"{r.part} * 100 {op} {r.whole} * {bound}" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " AND ".join(parts)


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT row_id, unnest(range(1, len(w) - 1)) AS i, w FROM d
), t AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), r AS (
  SELECT row_id, count(*) AS n FROM (SELECT DISTINCT row_id, i + unnest([0, 1, 2]) AS at FROM t WHERE n > 1) GROUP BY row_id
), c AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_full_match(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '({"|".join(STOP_WORDS)})[.,;:]?'))) AS n_stop_words, len(lines) AS n_lines
  FROM d LEFT JOIN r USING (row_id)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM c
)
SELECT *, NOT base_failed AND {_sql_rules(RULES)} AS kept FROM b
"""

"""The queries that apply the operators to their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from netglean.llm import bpe, decontaminate, jaccard_join, merkle, quality_classifier, quality_rules, quotation, secret_scan, substring_dedup, token_counts, url_filter, warc, whitening
from netglean.llm.shared import table


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's conversations as mail that quotes the two messages before, and then without the quotations."""
    return quotation.link_quotations(quotation.quoting(table(spark, sf_dir, "conversations")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses and revisits made of the table's pages, written as WARC records, read again and resolved."""
    written = warc.write_records(warc.captures(table(spark, sf_dir, "pages")))
    return warc.flat(warc.resolve(warc.read_records(written.withColumnRenamed("warc", "content"))))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.RULES, url_filter.own_model())


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_token_counts, op3_quotation_links, op4_substring_dedup, op5_quality_rules, op6_quality_classifier, op7_secret_scan, op8_decontamination, op9_warc_revisits, op10_byte_bpe, op11_url_filter, op12_embedding_whitening, op13_merkle_manifest)}

OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE q.n * 100 >= p.n * 90 AND p.n * 100 >= q.n * 90
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.y, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x) c USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), near AS (
  SELECT *, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM src WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), mail AS (
  SELECT conv_id, turn, role, CASE turn % 3
    WHEN 0 THEN concat_ws(chr(10), '> > ' || replace(two, chr(10), chr(10) || '> > '), '> ' || replace(one, chr(10), chr(10) || '> '), text)
    WHEN 1 THEN concat_ws(chr(10), '> ' || split_part(one, chr(10), 1), text)
    ELSE concat_ws(chr(10), '> ' || replace(replace(translate(two, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), ' ', '  '), chr(10), chr(10) || '> '), text) END AS text
  FROM near
), line AS (
  SELECT conv_id, turn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM mail)
), parsed AS (
  SELECT conv_id, turn, i, line, regexp_extract(line, '^[ \t]*((>[ \t]*)+)') <> '' AS quoted,
         length(regexp_replace(regexp_extract(line, '^[ \t]*((>[ \t]*)+)'), '[^>]', '', 'g')) AS level,
         regexp_replace(regexp_replace(line, '^[ \t]*((>[ \t]*)+)', ''), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS body
  FROM line
), runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM (
    SELECT *, CASE WHEN level = lag(level) OVER w AND body <> '' AND lag(body) OVER w <> '' THEN 0 ELSE 1 END AS opens FROM parsed WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i))
), passage AS (
  SELECT conv_id, turn, min(i) AS i, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS whole, arg_min(body, i) AS first
  FROM runs WHERE body <> '' GROUP BY conv_id, turn, run
), own AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(t), '\s+', ' ', 'g')) AS t FROM (
    SELECT conv_id, turn, whole AS t FROM passage WHERE level = 0 UNION ALL SELECT conv_id, turn, body FROM runs WHERE level = 0 AND body <> '')
), quote AS (
  SELECT conv_id, turn, i, level, k, trim(regexp_replace(lower(CASE k WHEN 0 THEN whole ELSE first END), '\s+', ' ', 'g')) AS t FROM passage, (VALUES (0), (1)) tries(k) WHERE level > 0
), linked AS (
  SELECT q.conv_id, q.turn, q.i, q.level, arg_min(f.source, q.k) FILTER (f.source IS NOT NULL) AS source, bool_or(f.away) AS away
  FROM quote q LEFT JOIN (
    SELECT q.conv_id, q.turn, q.i, q.k, max(o.turn) FILTER (o.conv_id = q.conv_id AND o.turn < q.turn) AS source, bool_or(o.conv_id <> q.conv_id) AS away
    FROM quote q JOIN own o ON o.t = q.t GROUP BY ALL) f ON f.conv_id = q.conv_id AND f.turn = q.turn AND f.i = q.i AND f.k = q.k
  GROUP BY q.conv_id, q.turn, q.i, q.level
), counted AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, count_if(source IS NULL AND away) AS n_foreign, arg_min(source, (level, i)) FILTER (source IS NOT NULL) AS source
  FROM linked GROUP BY conv_id, turn
), clean AS (
  SELECT conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT quoted), ''), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS clean FROM parsed GROUP BY conv_id, turn
), tree AS (
  SELECT m.conv_id, m.turn, m.role, c.clean, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(n_foreign, 0) AS n_foreign,
         coalesce(q.source, lag(m.turn) OVER w) AS parent_turn, row_number() OVER w - 1 AS position
  FROM mail m JOIN clean c USING (conv_id, turn) LEFT JOIN counted q USING (conv_id, turn) WINDOW w AS (PARTITION BY m.conv_id ORDER BY m.turn)
), reply AS (
  SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM tree WHERE parent_turn IS NULL
  UNION ALL SELECT t.conv_id, t.turn, r.root_turn, r.depth + 1 FROM tree t JOIN reply r ON r.conv_id = t.conv_id AND r.turn = t.parent_turn
)
SELECT conv_id, turn, role, clean, n_quotes, n_linked, n_foreign, parent_turn, root_turn, depth, position FROM tree JOIN reply USING (conv_id, turn)
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)
), m AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1
), b AS (
  SELECT b.doc_id, b.i, b.x, sum(CASE WHEN m.p IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS x FROM (SELECT doc_id, h, unnest(range(0, n)) AS i FROM d)) b LEFT JOIN m ON m.doc_id = b.doc_id AND m.p = b.i
), e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM b
), k AS (
  SELECT doc_id, count_if(gone) AS n_removed, count_if(opens) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

SQL: dict[str, str] = {"op1_jaccard_join": OP1, "op3_quotation_links": OP3, "op4_substring_dedup": OP4, "op5_quality_rules": quality_rules.SQL, "op13_merkle_manifest": merkle.SQL}


def sql() -> dict[str, str]:
    """All of it; op11's has the weights that training gives."""
    return SQL | {"op11_url_filter": url_filter.sql(url_filter.own_model(), url_filter.RULES)}

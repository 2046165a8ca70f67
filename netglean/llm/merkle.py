"""Merkle manifest of a dataset: a digest for each row, a tree for each source, a tree over the sources, and a proof for each row.

H is the lowercase hex sha256 of its inputs' concatenation; digests go in as hex text. A row's leaf is H of its fields, each the number of its UTF-8 bytes, a colon and
the value, or a dash if null. Leaves of a source ascend by doc_id (null first; rows of one doc_id by their leaves); every ARITY consecutive nodes become one until one is left,
the source's subroot; subroots by source (null first) likewise give the root.

Rows are sorted over all partitions by ranges and numbered by the partitions' counts, so a source of any size is cut. The tree is built bottom-up, a written level for each
height; then proofs are pushed top-down, each level joined to its parents: a child prepends its siblings to the suffix that its parent inherited. Both group by
parent, so no key has more than ARITY rows.

Equal rows are leaves of their own, each with its own position. Nulls in any field have their own encoding, different from an empty text's. A long text is hashed where it is read and
travels no further. A lone leaf is its source's subroot, a lone subroot the root. An empty table has no root and gives an empty result. Further columns have no influence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netglean.llm.shared import forget, save

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"
_PART_BITS = 33  # of monotonically_increasing_id, below the partition's number


def digest(fields: list[Column]) -> Column:
    """H of the fields' encodings."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path, the digests before and after it at each height."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def _sorted(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """df, written in order over all its partitions, with the row's place _at and its partition's number _part."""
    df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return save(df.withColumn("_part", F.shiftright("_at", _PART_BITS)), tag)


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf and columns that go along) with sid, the number of the row's source, pos, its number in that, and width, how many rows the source has."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    rows = _sorted(leaves, order, "merkle-sorted")
    runs = rows.groupBy("_part", "source").agg(F.min("_at").alias("first"), F.count("*").alias("n"))
    every = Window.partitionBy("source")
    runs = save(runs.select("_part", "source", "first", F.coalesce(F.sum("n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(every).alias("width")), "merkle-runs")
    sources = _sorted(runs.groupBy("source").agg(F.first("width").alias("width")), order[:1], "merkle-sources")
    parts = sources.groupBy("_part").agg(F.min("_at").alias("first"), F.count("*").alias("n"))  # a row for each partition
    parts = parts.select("_part", "first", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("before"))
    ids = sources.join(parts, "_part").select("source", (F.col("_at") - F.col("first") + F.col("before")).alias("sid"))
    r, i = runs.alias("r"), ids.alias("i")
    runs_of = r.join(i, F.col("r.source").eqNullSafe(F.col("i.source"))).select(F.col("r._part").alias("part_of"), F.col("r.source").alias("source_of"), "first", "before", "width", "sid")
    out = rows.join(runs_of, (F.col("_part") == F.col("part_of")) & F.col("source").eqNullSafe(F.col("source_of")))
    out = save(out.select(*leaves.columns, "sid", (F.col("_at") - F.col("first") + F.col("before")).alias("pos"), "width"), "merkle-leaves")
    forget(rows, runs, sources)
    return out


def _up(width: int | Column) -> int | Column:
    return (width + ARITY - 1) // ARITY if isinstance(width, int) else F.floor((width + ARITY - 1) / ARITY)


def build(nodes: DataFrame, widest: int) -> list[DataFrame]:
    """All levels above nodes (sid, pos, width, node), each written: sid, pos, width, kids (the digests below) and node, as long as a tree has more than one node."""
    levels = [nodes]
    while widest > 1:
        kids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda k: k["node"]).alias("kids")
        up = levels[-1].where("width > 1").groupBy("sid", F.floor(F.col("pos") / ARITY).alias("parent")).agg(kids, F.first("width").alias("width"))
        up = up.select("sid", F.col("parent").alias("pos"), _up(F.col("width")).alias("width"), "kids", F.sha2(F.array_join("kids", ""), 256).alias("node"))
        levels.append(save(up, "merkle-level"))
        widest = _up(widest)
    return levels


def push(levels: list[DataFrame], tops: DataFrame, own: list[str]) -> DataFrame:
    """The lowest level's columns own with each row's path and top. tops: sid, path and top of each tree's last node."""
    above = None
    for k in range(len(levels) - 1, -1, -1):
        keep = own if k == 0 else ["sid", "pos", "kids"]
        out = levels[k].where("width = 1").join(tops, "sid").select(*keep, "path", "top")
        if above is not None:
            parent = above.select("sid", F.col("pos").alias("parent"), "kids", F.col("path").alias("suffix"), "top")
            below = levels[k].where("width > 1").select(*keep, *({"sid", "pos"} - {*keep}), F.floor(F.col("pos") / ARITY).alias("parent"))
            below = below.withColumnRenamed("kids", "own_kids").join(parent, ["sid", "parent"])
            at = F.col("pos") % ARITY
            step = F.struct(F.array_join(F.slice("kids", F.lit(1), at.cast("int")), "").alias("before"), F.array_join(F.slice("kids", (at + 2).cast("int"), F.lit(ARITY)), "").alias("after"))
            path = F.concat(F.array(step), F.col("suffix")).alias("path")
            out = out.unionByName(below.select(*(F.col("own_kids").alias("kids") if c == "kids" and k else F.col(c) for c in keep), path, "top"))
        if k:
            saved = save(out, "merkle-paths")
            if above is not None:
                forget(above)
            above = saved
    return out


def proofs(leaves: DataFrame) -> DataFrame:
    """leaves (source, doc_id, leaf; further columns go along, other than those added) with subroot, root and path, the siblings before and after the leaf's ancestors from the bottom up."""
    spark = leaves.sparkSession
    rows = numbered(leaves)
    widest, sources = rows.agg(F.max("width"), F.max("sid")).first()
    levels = build(rows.withColumn("node", F.col("leaf")), widest or 0)
    ends = levels[0].where("width = 1").select("sid", "node")
    for level in levels[1:]:
        ends = ends.unionByName(level.where("width = 1").select("sid", "node"))
    ends = save(ends.select(F.lit(0).cast("long").alias("sid"), F.col("sid").alias("pos"), F.lit((-1 if sources is None else sources) + 1).cast("long").alias("width"), "node"), "merkle-subroots")
    upper = build(ends, 0 if sources is None else sources + 1)
    last = upper[-1].select("node").first()  # one row: the root
    root = last["node"] if last else None
    above = spark.range(1).select(F.col("id").alias("sid"), F.array().cast(PATH).alias("path"), F.lit(root).cast("string").alias("top"))
    tops = push(upper, above, ["pos", "node"]).select(F.col("pos").alias("sid"), "path", F.col("node").alias("top"))
    out = push(levels, tops, [*leaves.columns])
    return out.select(*leaves.columns, F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "path")


def tampered(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf and presented, the leaf of the row as it arrives: where 5 divides the crc32 of the decimal doc_id its text has A-Z lower-cased. A null doc_id stays as it is."""
    fields = [F.col(c) for c in FIELDS]
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaf = digest(fields)
    return docs.select("source", "doc_id", leaf.alias("leaf"), F.when(hit, digest([*fields[:-1], low])).otherwise(leaf).alias("presented"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of each row, folded_root of the row as it arrives (tampered()), and whether it is verified."""
    leaves = save(tampered(docs), "merkle-rows")
    out = proofs(leaves).withColumn("folded_root", fold(F.col("presented"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of a decimal number s by the table crc.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i, 1))::UBIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"

SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS id, doc_id, source, x.leaf, x.presented FROM (
    SELECT *, sha256(concat(head, coalesce(concat(octet_length(encode(text)), ':', text), '-'))) AS leaf,
           sha256(concat(head, coalesce(concat(octet_length(encode(text)), ':', CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END), '-'))) AS presented
    FROM (SELECT *, coalesce(@CRC@ % 5 = 0, false) AS hit, concat(coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-')) AS head 
      FROM (SELECT *, doc_id::VARCHAR AS s FROM documents), (SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)))) x
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS width FROM d
), t AS (
  SELECT 0 AS h, sid, pos, width, leaf AS node FROM l
  UNION ALL SELECT h + 1, sid, pos // 16, (any_value(width) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE width > 1 GROUP BY h, sid, pos // 16
), s AS (
  SELECT sid, h, node, count(*) OVER () AS width FROM t WHERE width = 1
), u AS (
  SELECT 0 AS h, sid AS pos, width, node FROM s
  UNION ALL SELECT h + 1, pos // 16, (any_value(width) + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE width > 1 GROUP BY h, pos // 16
), a AS (
  SELECT h, sid, pos, node FROM t WHERE width > 1 UNION ALL SELECT 100 + h, 0, pos, node FROM u WHERE width > 1
), steps AS (
  SELECT x.h, x.sid, x.pos, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS before, coalesce(string_agg(y.node, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS after
  FROM a x JOIN a y ON x.h = y.h AND x.sid = y.sid AND x.pos // 16 = y.pos // 16 GROUP BY ALL
), f AS (
  SELECT id, CASE WHEN width = 1 THEN 100 ELSE 0 END AS h, sid AS tree, CASE WHEN width = 1 THEN sid ELSE pos END AS pos, '' AS proof, presented AS node, sid, width FROM l
  UNION ALL
  SELECT f.id, CASE WHEN f.h < 100 AND (f.width + 15) // 16 = 1 THEN 100 ELSE f.h + 1 END, f.tree, CASE WHEN f.h < 100 AND (f.width + 15) // 16 = 1 THEN f.sid ELSE f.pos // 16 END,
         f.proof || p.before || p.after, sha256(p.before || f.node || p.after), f.sid, (f.width + 15) // 16
  FROM f JOIN steps p ON p.h = f.h AND p.sid = (CASE WHEN f.h < 100 THEN f.tree ELSE 0 END) AND p.pos = f.pos
), e AS (
  SELECT id, arg_max(proof, h) AS proof, arg_max(node, h) AS node FROM f GROUP BY id
)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, sha256(e.proof) AS proof_sha256, e.node AS folded_root, e.node = r.node AS verified
FROM l JOIN s USING (sid) JOIN e USING (id) CROSS JOIN (SELECT node FROM u WHERE width = 1) r
""".replace("@CRC@", _CRC)

"""As-of lookup whose groups may be of any size: rows are sorted over all partitions, and partitions hand on what crosses their borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from netglean.llm.shared import save

#: What a row of a sorted table is: an ordinary one, one that waits for what the partitions before hand on, or a mark of a partition's first or last key.
ROW, OPEN, HEAD, TAIL = range(4)


def begins(columns: list[pa.Array]) -> np.ndarray:
    """Which rows differ from the row before in any column; nulls equal each other, and the first row begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return new


def latest_before(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the column name: of the earlier rows with equal keys, by order, the latest value that isn't null.

    Rows are dealt by ranges of keys and order, so a group of any size is cut into many partitions. One pass over a sorted partition
    carries the last value; its first key's rows that found none wait for what the partitions before it hand on: one
    row for each partition. Null keys equal each other. Rows that agree in all of order see each other in no defined order. The result reads a
    table in the shared folder, which forget() deletes.
    """
    columns = df.columns
    kind = df.select(value.alias("_value")).schema["_value"].dataType
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema] + [StructField(name, kind), StructField("_part", IntegerType()), StructField("_edge", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        head, held, inside = None, None, True  # the first key; the last key and its value; whether the last key is the first
        out, kinds = [*columns, name, "_part", "_edge"], None

        def rows(arrays: list[pa.Array], edge: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(edge), part, np.int32)), pa.array(edge.astype(np.int32))], out)

        for b in batches:
            if not b.num_rows:
                continue
            key, v = [b.column(k) for k in keys], b.column("_value")
            if head is None:
                head, kinds = [k.slice(0, 1) for k in key], [b.column(c).type for c in columns] + [v.type]
            else:
                key, v = [pa.concat_arrays([h, k]) for h, k in zip(held[:-1], key)], pa.concat_arrays([held[-1], v])
            at = np.arange(len(v))
            new = begins(key)
            first = np.maximum.accumulate(np.where(new, at, 0))
            last = np.maximum.accumulate(np.where(v.is_valid().to_numpy(zero_copy_only=False), at, -1))
            before = np.concatenate(([-1], last[:-1]))
            none = before < first
            waits = none & inside & (np.cumsum(new) == 1)
            x = len(v) - b.num_rows
            yield rows([*(b.column(c) for c in columns), v.take(pa.array(before, mask=none)).slice(x)], np.where(waits, OPEN, ROW)[x:])
            inside = inside and new.sum() == 1
            held = [k.slice(len(k) - 1) for k in key] + [v.slice(last[-1], 1) if last[-1] >= first[-1] else pa.nulls(1, v.type)]
        if head is not None:
            for own, edge in ((dict(zip(keys, head)), HEAD), (dict(zip([*keys, name], held)), TAIL)):
                yield rows([own.get(c, pa.nulls(1, t)) for c, t in zip([*columns, name], kinds)], np.array([edge]))

    by = [*map(F.col, keys), *order]
    sent = save(df.withColumn("_value", value).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, schema), name)
    before = Window.partitionBy(*keys).orderBy("_part", "_edge").rowsBetween(Window.unboundedPreceding, -1)
    carry = sent.where(F.col("_edge") >= HEAD).withColumn("_carry", F.last(name, ignorenulls=True).over(before)).where(F.col("_edge") == HEAD).select("_part", "_carry")
    found = sent.where(F.col("_edge") < HEAD).join(carry, "_part", "left")
    found = found.select(*(F.col(f"`{c}`") for c in columns), F.when(F.col("_edge") == OPEN, F.col("_carry")).otherwise(F.col(name)).alias(name))
    found.saved_at = sent.saved_at
    return found

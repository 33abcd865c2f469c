"""Running numbers and sums within keys, where one key may hold any share of the rows.

Rows are dealt by ranges of (key, order), so that a hot key spreads over many tasks; each task streams through its sorted rows with a few
numbers carried along, and what precedes a task's rows of a key is added from a small table of totals by key and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import discard, materialise
from docloom.shipping import ship


def starts(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before; the first does. Nulls equal each other."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            a, b = c.slice(1), c.slice(0, n - 1)
            new[1:] |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
            new[1:] |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return new


def running(rows: DataFrame, key: str, order: list[Column | str], sums: list[str]) -> DataFrame:
    """rows (a written table) with __at, the row's number within its key from 0, and __upto_<c>, the sum of each long column c up to and including the row.

    The result is a written table. Sums must stay within a long.
    """
    ship(rows.sparkSession)
    names = [f"__upto_{c}" for c in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, carried = None, 0, np.zeros(len(sums), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key)
            new = starts(k)
            new[0] = last is None or k[0] != last
            place = np.arange(b.num_rows)
            head = np.maximum.accumulate(np.where(new, place, -1))
            at = place - np.maximum(head, 0) + np.where(head < 0, count, 0)
            out = [pa.array(at)]
            for j, c in enumerate(sums):
                x = b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(x) - x
                upto = before + x - np.where(head < 0, -carried[j], before[np.maximum(head, 0)])
                carried[j] = upto[-1]
                out.append(pa.array(upto))
            last, count = k[b.num_rows - 1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, "__at", *names])

    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("__at", *names))])
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = materialise(dealt.mapInArrow(run, schema).withColumn("__task", F.spark_partition_id()), "running")
    total = local.groupBy(key, "__task").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__sum_{c}") for c in sums))
    earlier = Window.partitionBy(key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(key, "__task", F.sum("__n").over(earlier).alias("__n"), *(F.sum(f"__sum_{c}").over(earlier).alias(f"__sum_{c}") for c in sums))
    before = before.filter("__n IS NOT NULL")  # only keys that several tasks share
    out = local.join(before, [key, "__task"], "left").withColumn("__at", F.col("__at") + F.coalesce("__n", F.lit(0)))
    for c in sums:
        out = out.withColumn(f"__upto_{c}", F.col(f"__upto_{c}") + F.coalesce(f"__sum_{c}", F.lit(0)))
    whole = materialise(out.drop("__task", "__n", *(f"__sum_{c}" for c in sums)), "running")
    discard(local)
    return whole

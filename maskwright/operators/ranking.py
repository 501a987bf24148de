"""Numbers by order within groups of any size.

A window gives a whole group to one task. Here rows are sorted over ranges of
(group, order), numbered within their range, and shifted: only the first group
of a range can have begun before it, so the shifts are one number for each
range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from maskwright.operators.shared import shared_checkpoint, spread


def _counted(batches: Iterator[pa.RecordBatch], group: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The number of each row within its group and range, and of the group within the range."""
    part, held, n, seen = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.zeros(batch.num_rows, bool)
        for k, name in enumerate(group):
            column = batch.column(batch.schema.get_field_index(name))
            codes = np.asarray(column.dictionary_encode().indices.fill_null(-1))
            fresh[1:] |= codes[1:] != codes[:-1]
            fresh[0] |= held is None or held[k] != column[0].as_py()
        starts = np.flatnonzero(fresh)
        at = np.arange(batch.num_rows)
        begun = np.where(np.cumsum(fresh) > 0, starts[np.maximum(np.cumsum(fresh) - 1, 0)] if len(starts) else 0, -n)
        number, order = at - begun + 1, seen + np.cumsum(fresh)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(order, pa.int64()), pa.array(number, pa.int64())], names)
        held, n, seen = [batch.column(batch.schema.get_field_index(g))[-1].as_py() for g in group], int(number[-1]), int(order[-1])


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with column ``name``: 1, 2, ... by ``order`` within each group, nulls first; nulls in the group are one group.

    Rows that are equal in all of ``group`` and ``order`` get numbers in no
    defined order. No task has more than its range of rows.
    """
    part, nth, local = "__part", "__nth", "__local"
    made = StructType([*rows.schema.fields, StructField(part, IntegerType()), StructField(nth, LongType()), StructField(local, LongType())])
    keys = [F.col(f"`{c}`") for c in (*group, *order)]
    ranged = rows.repartitionByRange(spread(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    counted = shared_checkpoint(ranged.mapInArrow(partial(_counted, group=group, names=made.names), made))
    # The first and the last group of each range: two rows for each partition of the shuffle.
    ends = counted.groupBy(part).agg(F.max(nth).alias("groups"), F.min_by(F.struct(*group), F.struct(nth, local)).alias("head"), F.max(F.struct(nth, local)).alias("tail"), F.max_by(F.struct(*group), F.struct(nth, local)).alias("of"))
    ends = ends.select(part, "groups", "head", "of", F.col(f"tail.{local}").alias("n"))
    # A range that a group fills on to the next one adds its rows to those before; the driver's part is nothing, the window's a row for each range.
    before = Window.orderBy(part)
    follows = F.col("head").eqNullSafe(F.lag("of").over(before))
    chain = ends.withColumn("opens", F.when(follows & F.lag("groups").over(before).isNotNull(), 0).otherwise(1))
    # A chain of ranges whose heads are one group: it opens where the range before ends with the group but does not begin with it.
    chain = chain.withColumn("link", F.when((F.col("opens") == 0) & (F.lag("groups").over(before) == 1), 0).otherwise(1))
    chain = chain.withColumn("run", F.sum("link").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    chain = chain.withColumn("tail_before", F.when(F.col("opens") == 0, F.lag("n").over(before)).otherwise(0))
    shift = F.sum("tail_before").over(Window.partitionBy("run").orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
    shifts = chain.select(F.col(part).alias("__of"), F.when(F.col("opens") == 0, shift).otherwise(0).alias("__shift"))
    met = counted.join(F.broadcast(shifts), F.col(part) == F.col("__of"))
    number = F.col(local) + F.when(F.col(nth) == 1, F.col("__shift")).otherwise(0)
    return met.select(*(F.col(f"`{c}`") for c in rows.columns), number.alias(name))

"""Conversations in pieces: turns in order, whatever the size of a conversation.

Rows are sorted over ranges of (conversation, turn, role, text), so that a
conversation with a third of all rows lies in many ranges, and a scan of each
range cuts it into pieces of at most ROWS rows. A conversation within one range
that fits one piece stands alone, and its work ends where it lies. The others
(two for each range, and the long ones) go on as pieces in the order of
``(part, seq)``: small facts of all pieces of one meet, the texts don't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from maskwright.llm.common import shared_checkpoint, spread

#: Rows of a piece at most.
ROWS = 256
ORDER = ("conv_id", "turn", "role", "text")


def counted(rows: DataFrame) -> DataFrame:
    """Distinct rows with the number of their copies in ``times``; copies meet as sums, so no task has them all."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("times"))


def pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, part, seq, alone, turns)``: conversations that stand alone, and pieces of the others.

    ``rows`` has the columns of ORDER and more, all of them in each element of
    ``turns``. Null ids are one conversation, null turns come first.
    """
    fields = [f for f in rows.schema if f.name != "conv_id"]
    made = StructType([rows.schema["conv_id"], StructField("part", IntegerType()), StructField("seq", IntegerType()), StructField("alone", BooleanType()), StructField("turns", ArrayType(StructType(fields)))])
    by_order = rows.repartitionByRange(spread(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    cut = shared_checkpoint(by_order.mapInArrow(_cut, made))
    return cut.filter("alone"), cut.filter(~F.col("alone"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted range. The last conversation waits for the next batch, as it may go on there."""
    part, seq, carried, cuts, opened = TaskContext.get().partitionId(), 0, None, 0, True

    def made(table: pa.Table, begin: np.ndarray, end: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
        nonlocal seq
        names = [n for n in table.column_names if n != "conv_id"]
        items = pa.StructArray.from_arrays([table.column(n).combine_chunks() for n in names], fields=[table.schema.field(n) for n in names])
        lists = pa.ListArray.from_arrays(pa.array([*begin, end[-1]], pa.int32()), items.slice(0, end[-1]))
        seqs, seq = np.arange(seq, seq + len(begin), dtype=np.int32), seq + len(begin)
        ids = table.column("conv_id").combine_chunks().take(pa.array(begin))
        columns = [ids, pa.array(np.full(len(begin), part, np.int32)), pa.array(seqs), pa.array(alone), lists]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "seq", "alone", "turns"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
        codes = np.asarray(table.column("conv_id").combine_chunks().dictionary_encode().indices.fill_null(-1))
        first = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        # ``cuts`` counts the pieces that the carried conversation has given already; ``opened``: it is the first of the range.
        begin, alone = [], []
        for k, a in enumerate(first):
            b = first[k + 1] if k + 1 < len(first) else len(codes)
            places = list(range(a, b, ROWS))
            whole = len(places) == 1 and not (k == 0 and (cuts or opened)) and k + 1 < len(first)
            begin += places
            alone += [whole] * len(places)
        # The last piece is carried.
        rest = begin[-1]
        if len(begin) > 1:
            yield made(table, np.array(begin[:-1]), np.array(begin[1:]), np.array(alone[:-1]))
        went_on = len(first) == 1
        cuts = (cuts if went_on else 0) + len(range(first[-1], len(codes), ROWS)) - 1
        opened = opened and went_on
        carried = table.slice(rest)
    if carried is not None:
        n = carried.num_rows
        yield made(carried.combine_chunks(), np.array([0]), np.array([n]), np.array([False]))


def in_order(rows: DataFrame) -> DataFrame:
    """Small rows of pieces, those of one conversation in one partition and in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """The rows of each conversation, one after the other, from batches that are in order."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)
    while row is not None:
        of = row["conv_id"]

        def same() -> Iterator[dict]:
            nonlocal row
            while row is not None and row["conv_id"] == of:
                now, row = row, next(rows, None)
                yield now

        mine = same()
        yield of, mine
        for _ in mine:
            pass


def by_batch(made: Callable[[dict], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that turns each row into a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([made(row) for row in batch.to_pylist()], schema=schema)

    return run

"""What the operators of this folder share: tables, checkpoints, text batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark's own reader.

    A small table can lie in one row group, which is one task; if the scan has
    fewer partitions than there are cores, its rows are dealt out. Large tables
    stay as they are.
    """
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for checkpoints and tables between stages.

    It is the one that the cluster names in ``spark.checkpoint.dir``; only in a
    local session without it (tests, a laptop) is a temporary one made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Tasks among which the rows of one key are dealt in a salted join.
SALTS = 8


def salted_join(rows: DataFrame, few: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Join many rows with one row for each key, so that a key with a third of all rows is dealt over SALTS tasks.

    ``by`` is what the rows of a key are dealt by; the side with one row for
    each key is repeated. Adaptive execution does not split such a join where
    that side comes out of an aggregate.
    """
    (salt,) = unused([*rows.columns, *few.columns], 1)
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    each = few.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS)))))
    return dealt.join(each, [key, salt], how).drop(salt)


#: A key with more than this share of the rows is hot, so there are at most HOT hot keys.
HOT = 1000


def group_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Join rows with one row for each key, which has the number of rows of its key in column ``size``.

    The rows of hot keys stay where they are and meet a broadcast of their
    groups, of which there are at most HOT; the others are shuffled. Every row
    has a group; a null key has none.
    """
    least = groups.agg((F.sum(size) / HOT).alias("least")).first()["least"] or 0
    groups = groups.withColumnRenamed(key, "__of")
    hot, cold = groups.filter(F.col(size) > least).drop(size), groups.filter(F.col(size) <= least).drop(size)
    apart = rows.join(F.broadcast(hot.select("__of")), F.col(key) == F.col("__of"), "left_anti")
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__of"))
    return met.unionByName(apart.join(cold, F.col(key) == F.col("__of"))).drop("__of")


def unused(columns: list[str], n: int) -> list[str]:
    """``n`` names that none of these columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    names = (f"__made_{k}" for k in count())
    return list(islice((c for c in names if c not in taken), n))


def spread(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.Array) -> list[str]:
    """The Python strings of an Arrow column; null is the empty text."""
    return [t or "" for t in column.to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for the third of the rows whose labels no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def bounded_sample(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most ``limit`` rows, chosen by the hash of a key.

    The choice depends on the rows alone, not on how they are partitioned: the
    smallest hashes are kept. Of a larger table, only hashes below a bound that
    lets twice as many rows through reach the one task that ranks them.
    """
    rows, hashed = df.count(), F.xxhash64(key)
    if rows > 2 * limit:
        df = df.filter(hashed < int((2 * limit / rows - 0.5) * 2**64))
    return df.orderBy(hashed, key).limit(limit)


def labelled(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(__id, label, __text)``: the texts of a bounded sample ``(__id, label)``.

    One row for each id, that with the smallest text hash where an id is
    repeated: an id that a third of all rows has teaches once.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.groupBy("__id").agg(F.min_by(F.struct("label", "__text"), F.struct(F.xxhash64("__text"), "label")).alias("r"))
    return rows.select("__id", "r.label", "r.__text")


def batches(column: Iterator[pa.Array]) -> Iterator[list[str]]:
    for part in column:
        yield texts(part)

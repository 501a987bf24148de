"""Annotation files as tables, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "source string, sample string, scope struct<first_block: int, last_block: int>, conventions map<string, string>, "
    "annotations array<struct<block: int, items: array<array<string>>>>"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files, one row each, with the file's path as ``set``."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("set", F.input_file_name())


def annotations(files: DataFrame) -> DataFrame:
    """``(set, block_idx, ord, label, text)``, one row for each annotated value."""
    by_block = files.select("set", F.explode("annotations").alias("a"))
    items = by_block.select("set", F.col("a.block").alias("block_idx"), F.posexplode("a.items").alias("ord", "item"))
    return items.select("set", "block_idx", "ord", F.col("item")[0].alias("label"), F.col("item")[1].alias("text"))


def in_scope(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """Blocks ``(set, block_idx, text)`` from the first to the last annotated one, without blank ones."""
    scope = files.select("set", "scope.first_block", "scope.last_block")
    inside = F.col("block_idx").between(F.col("first_block"), F.col("last_block")) & F.col("text").rlike(r"(?U)\S")
    return blocks.join(scope, "set").filter(inside).drop("first_block", "last_block")


def as_json(scores: DataFrame) -> DataFrame:
    """One JSON text of a score table, by label."""
    row = F.struct(*(F.col(c) for c in scores.columns))
    return scores.agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def mapping_json(mapping: DataFrame) -> DataFrame:
    """A mapping as rows of JSON ``{type, original, replacement}``, by type and original."""
    rows = mapping.orderBy("label", "original").select(F.struct(F.col("label").alias("type"), "original", "replacement").alias("r"))
    return rows.select(F.to_json("r").alias("value"))

"""Text made of the relational tables, alike in Spark and in SQL.

The text tables hold addresses of mail and hosts, cards and phone numbers; the
other kinds get their text from these columns. Each view is a Spark function
and the SQL of the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that the derived texts choose from by a key.
CITIES = ("Pune", "Mumbai", "Navi Mumbai", "Springfield", "NAGPUR", "Punekar")
FIRST = ("Tarun", "Mohini", "Anita", "Meera", "Vikram", "Leela", "Arjun")
MIDDLE = ("Dev", "Kiran", "Mohan")
LAST = ("Desai", "Patil", "Joshi", "Rao", "Shah")
FORMS = ("Holdings Limited", "private limited", "Works LLP", "Bank Limited", "Road Limited")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over as many tasks as there are cores: a small table can lie in one row group, which is one task. Large ones stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def chosen(words: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


def sql_chosen(words: tuple[str, ...], key: str) -> str:
    return f"([{', '.join(f"'{w}'" for w in words)}])[CAST(({key}) % {len(words)} AS INT) + 1]"


def _padded(key: Column, top: int, width: int) -> Column:
    return F.lpad((key % top).cast("string"), width, "0")


def ssn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("SSN: "), _padded(k * 7, 1000, 3), F.lit("-"), _padded(k, 100, 2), F.lit("-"), _padded(k * 13, 10000, 4), F.lit("."))
    return dealt(read(spark, sf_dir, "customer")).select(k.alias("id"), text.alias("text"))


SSN = (
    "(SELECT c_custkey AS id, 'SSN: ' || lpad(CAST(c_custkey * 7 % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || "
    "lpad(CAST(c_custkey * 13 % 10000 AS VARCHAR), 4, '0') || '.' AS text FROM customer)"
)


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = chosen(("Date of Birth: ", "Dated ", "D.O.B. - ", "was born on ", "birth date of the company, which is long past: "), F.col("o_orderkey"))
    return dealt(read(spark, sf_dir, "orders")).select(F.col("o_orderkey").alias("id"), F.concat(lead, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("text"))


DATES = (
    "(SELECT o_orderkey AS id, "
    + sql_chosen(("Date of Birth: ", "Dated ", "D.O.B. - ", "was born on ", "birth date of the company, which is long past: "), "o_orderkey")
    + " || strftime(o_orderdate, '%d/%m/%Y') AS text FROM orders)"
)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("paid by the "), F.initcap(F.lower("c_mktsegment")), F.lit(" "), chosen(FORMS, k), F.lit(" on time"))
    return dealt(read(spark, sf_dir, "customer")).select(k.alias("id"), text.alias("text"))


COMPANIES = f"(SELECT c_custkey AS id, 'paid by the ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || {sql_chosen(FORMS, 'c_custkey')} || ' on time' AS text FROM customer)"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(chosen(("Plot 7, ", "sold to ", "No "), k), chosen(CITIES, k), F.lit(" "), _padded(k * 7919 + 1000, 1000000, 6), F.lit(", lot"))
    return dealt(read(spark, sf_dir, "supplier")).select(k.alias("id"), text.alias("text"))


ADDRESSES = (
    f"(SELECT s_suppkey AS id, {sql_chosen(('Plot 7, ', 'sold to ', 'No '), 's_suppkey')} || {sql_chosen(CITIES, 's_suppkey')} || ' ' || "
    "lpad(CAST((s_suppkey * 7919 + 1000) % 1000000 AS VARCHAR), 6, '0') || ', lot' AS text FROM supplier)"
)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(scope, id, name, mail)``: 40 customers to a scope, with names of two and three words."""
    k = F.col("c_custkey")
    first, middle, last = chosen(FIRST, k), chosen(MIDDLE, F.floor(k / 5)), chosen(LAST, F.floor(k / 3))
    name = F.when(k % 3 == 0, F.concat_ws(" ", first, middle, last)).otherwise(F.concat_ws(" ", first, last))
    mail = F.lower(F.concat(first, F.lit("."), last, F.lit("@mail.example.com")))
    return dealt(read(spark, sf_dir, "customer")).select(F.floor(k / 40).alias("scope"), k.alias("id"), name.alias("name"), mail.alias("mail"))


_FIRST, _MIDDLE, _LAST = sql_chosen(FIRST, "c_custkey"), sql_chosen(MIDDLE, "c_custkey // 5"), sql_chosen(LAST, "c_custkey // 3")
PEOPLE = (
    f"(SELECT c_custkey // 40 AS scope, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN {_FIRST} || ' ' || {_MIDDLE} || ' ' || {_LAST} ELSE {_FIRST} || ' ' || {_LAST} END AS name, "
    f"lower({_FIRST} || '.' || {_LAST} || '@mail.example.com') AS mail FROM customer)"
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate spans: the lines of an order are the candidates of a block."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    start = (k % 20).cast("int")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        start.alias("start"),
        (start + (k % 7 + 1).cast("int")).alias("end"),
        (F.col("l_suppkey") % 3).cast("int").alias("priority"),
        F.when(k % 2 == 0, 0.5).otherwise(1.0).alias("score"),
        n.cast("bigint").alias("ord"),
    )


CANDIDATES = (
    "(SELECT l_orderkey AS id, CAST(l_partkey % 20 AS INT) AS s, CAST(l_partkey % 20 + l_partkey % 7 + 1 AS INT) AS e, CAST(l_suppkey % 3 AS INT) AS priority, "
    "CASE WHEN l_partkey % 2 = 0 THEN 0.5 ELSE 1.0 END AS score, CAST(l_linenumber AS BIGINT) AS ord FROM lineitem)"
)


def labelled(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Spans with labels, a set for each return flag: annotations and predictions of the same blocks, by the shift."""
    k = F.col("l_partkey") + shift * F.col("l_linenumber")
    start = (k % 40).cast("int")
    rows = read(spark, sf_dir, "lineitem").filter((F.col("l_linenumber") + shift) % 4 != 0)
    return rows.select(
        F.col("l_returnflag").alias("set"),
        F.col("l_orderkey").alias("block_idx"),
        F.col("l_linenumber").cast("int").alias("ord"),
        start.alias("start"),
        (start + 4).alias("end"),
        chosen(("PERSON", "EMAIL", "LOCATION"), F.col("l_suppkey") + shift * F.col("l_linenumber")).alias("label"),
    )


def sql_labelled(shift: int) -> str:
    start = f"CAST((l_partkey + {shift} * l_linenumber) % 40 AS INT)"
    label = sql_chosen(("PERSON", "EMAIL", "LOCATION"), f"l_suppkey + {shift} * l_linenumber")
    return f"(SELECT l_returnflag AS grp, l_orderkey AS block_idx, l_linenumber AS ord, {start} AS s, {start} + 4 AS e, {label} AS label FROM lineitem WHERE (l_linenumber + {shift}) % 4 <> 0)"

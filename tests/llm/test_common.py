from pyspark.sql import functions as F

from maskwright.llm.common import bounded_sample, held_out, salted_join


def test_the_bound_on_hashes_changes_no_sample(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    got = {r.k for r in bounded_sample(rows.repartition(7), F.col("k"), 500).collect()}
    want = {r.k for r in rows.orderBy(F.xxhash64("k"), "k").limit(500).collect()}
    assert got == want and len(got) == 500
    assert bounded_sample(rows.limit(10), F.col("k"), 500).count() == 10 and bounded_sample(rows.limit(0), F.col("k"), 5).count() == 0


def test_salted_joins_are_joins(spark):
    rows = spark.createDataFrame([("hot", n) for n in range(500)] + [("cold", 1), (None, 2), ("none", 3)], "k string, n int")
    few = spark.createDataFrame([("hot", "h"), ("cold", "c")], "k string, v string")
    for how in ("inner", "left"):
        got = sorted(map(str, salted_join(rows, few, "k", F.col("n"), how).collect()))
        assert got == sorted(map(str, rows.join(few, "k", how).collect()))


def test_held_out_is_a_third(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(300).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {n: zlib.crc32(str(n).encode()) % 3 == 1 for n in range(300)}

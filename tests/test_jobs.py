"""The life of jobs over several batches and a restart."""

import datetime

import pytest

from maskwright.streaming import jobs


@pytest.fixture()
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, jobs.STORE)
    yield
    spark.conf.set(name, before)


def test_lives_of_jobs(spark, store, tmp_path):
    start = datetime.datetime(2030, 1, 1)
    at = lambda minutes: start + datetime.timedelta(minutes=minutes)
    batches = [
        [("a", "queued", at(0)), ("b", "queued", at(1)), ("b", "running", at(2)), ("a", "queued", at(0)), (None, "queued", at(0))],
        [("a", "done", at(5)), ("a", "running", at(3)), ("c", "error", at(6)), ("b", "running", at(2)), ("a", "nonsense", at(7))],
        [("b", "deleted", at(8)), ("a", "running", at(9)), ("d", "queued", at(40))],
        # The clock goes on: a and c are over, d is not.
        [("e", "queued", at(75))],
        [("e", "running", at(76)), ("b", "done", at(76))],
    ]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = []
    for rows in batches:  # each batch is a query of its own, which goes on from the checkpoint of the last
        spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.lived(spark.readStream.schema(jobs.EVENTS).parquet(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out)
        assert query.awaitTermination(180)
        seen.append(sorted((r.job_id, r.status) for r in spark.read.parquet(out).collect()))
    assert seen[0] == [("a", "queued"), ("b", "queued"), ("b", "running")]
    # In one batch the order is that of time: a runs before it is done, though it came in later.
    assert {*seen[1]} == {*seen[0], ("a", "done"), ("a", "running"), ("c", "error")}
    assert {*seen[2]} == {*seen[1], ("b", "deleted"), ("d", "queued")}
    last = spark.read.parquet(out)
    ended = {r.job_id: r["at"] for r in last.filter("status = 'expired'").collect()}
    assert ended.keys() == {"a", "c"} and ended["a"] == at(60) and ended["c"] == at(66)
    assert {(r.job_id, r.status) for r in jobs.standing(last).collect()} >= {("d", "queued"), ("e", "running")}
    assert last.groupBy("job_id", "status").count().filter("count > 1").count() == 0

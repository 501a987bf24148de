import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import digest
from tests.llm.cases import ROWS, awkward, empty


def plain_counts(data):
    total = np.zeros(digest.BUCKETS, np.int64)
    for k, (x, y, z) in enumerate(digest.TRIPLETS):
        for i in range(len(data) - z):
            total[digest.TABLES[0][data[i + x]] ^ digest.TABLES[1][data[i + y]] ^ digest.TABLES[2][data[i + z]] ^ np.uint8(43 * k)] += 1
    return total


def plain(rows):
    return in_order(sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode())))


def in_order(rows):
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = map(digest.digest, (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), digest.written(a), digest.written(b), digest.likeness(a, b), digest.likeness(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("text", ["", "a", "ab", "abc", "abcd", "abcde", "abcdéf" * 7])
def test_counts(text, monkeypatch):
    assert (digest.counts(text.encode()) == plain_counts(text.encode())).all()
    for size in (1, 3, 5, 7):
        monkeypatch.setattr(digest, "CHUNK", size)
        assert (digest.counts(text.encode()) == plain_counts(text.encode())).all()


def test_written_digests_are_read_back():
    for _, text in ROWS:
        d = digest.digest(text or "")
        assert (digest.read(digest.written(d)) == d).all()
        assert digest.likeness(d, d) == 1


def test_against_a_plain_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = digest.fingerprints(docs.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    near = np.array([(r.near_edited, r.near_next) for r in got if r.n_chars > 200])
    assert (near[:, 0] > near[:, 1]).mean() > 0.95


def test_awkward_rows(spark):
    assert sorted(map(tuple, digest.fingerprints(awkward(spark)).collect()), key=str) == plain(ROWS)
    assert digest.fingerprints(empty(spark)).count() == 0
    one = digest.fingerprints(awkward(spark).filter("doc_id = 6")).collect()
    assert [tuple(r) for r in one] == plain([(6, "word")])


@pytest.mark.parametrize("hot", [5, None])
def test_an_id_with_most_rows_is_dealt_over_parts(spark, hot):
    """Half of the rows have one id, and half of those one text; ties follow the hash of the text."""
    rows = [(n, f"text {n} of many") for n in range(200)] + [(hot, f"another text {n} of many") for n in range(200)] + [(hot, "the same text again")] * 200
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    got = digest.fingerprints(docs)
    assert sorted(map(tuple, got.collect()), key=str) == in_order(order)
    tasks = got.filter("doc_id is null" if hot is None else f"doc_id = {hot}").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 350

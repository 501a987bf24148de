"""The filter audit against every order played out over every document."""

import math
import re
from itertools import permutations

import duckdb
import pytest

from maskwright.llm import interactions, queries
from tests.llm.cases import ROWS

DOCS = "doc_id bigint, text string, source string, part string, mask int"
LABELS = "doc_id bigint, quality int, toxic int"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failed(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    out = []
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        out.append((doc_id, source or "", {k for k, v in fails.items() if v}))
    return out


def expected(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    out, judged = {}, failed(rows)
    for part in {p for _, p, _ in judged}:
        mine = [(d, f) for d, p, f in judged if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, own in enumerate(order, 1):
                gone = [x for x in left if own in x[1]]
                left = [x for x in left if own not in x[1]]
                total[own] += len(gone)
                redundant = sum(own in f for _, f in mine) - len(gone)
                out[part, order, step] = (len(left), len(gone), redundant, sum(f == {own} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, total[order[step - 1]])
    return out


def text(n):
    return " ".join([f"word{k % (n % 70 + 20)}" for k in range(n % 90)] + ["BIG" * (n % 3), "#" * (n % 5 == 0)])


def test_against_every_order(spark):
    rows = [(d, t, "a" if d else None) for d, t in ROWS] + [(100 + n, text(n % 60), ("x", "y", None, "")[n % 4]) for n in range(300)]
    rows += [(100, text(3), "z"), (None, text(3), "z"), (None, None, None)]
    labels = [(100 + n, (1, 0, None)[n % 3], (0, 0, 1, None)[n % 4]) for n in range(250)] + [(101, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(d, t, s, "p", 1) for d, t, s in rows], DOCS)
    got = {(r.part, r.filter_order, r.step): (*(r[c] for c in COLUMNS), r.shapley) for r in interactions.audited(docs, spark.createDataFrame(labels, LABELS)).collect()}
    want = expected(rows, [x for x in labels if x[0] is not None])
    assert got == want and len(want) % 600 == 0


def test_values_share_out_the_whole(spark, sf):
    """Efficiency: the five values add up to what all filters together remove, in each part."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = interactions.audited(docs, labels).filter("filter_order = 'ABCDE'").collect()
    for part in {r.part for r in rows}:
        mine = {r.step: r for r in rows if r.part == part}
        assert sum(r.shapley for r in mine.values()) == interactions.N_ORDERS * sum(r.removed for r in mine.values())
    assert math.factorial(5) == interactions.N_ORDERS


def test_sql(spark, sf):
    for t in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = ["part", "filter_order", "step", *COLUMNS, "shapley"]
    want = sorted(duckdb.sql(queries.INTERACTIONS).select(*names).fetchall())
    got = sorted(tuple(r) for r in queries.op12_filter_interactions(spark, sf).select(*names).collect())
    assert got == want and len(got) > 0


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    docs = spark.createDataFrame([(1, "x", "s", "p", 1)][:n], DOCS)
    rows = interactions.audited(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600 * n


def test_labels_are_not_broadcast(spark, tmp_path):
    """Not even where their file is small: they are repeated for the join."""
    docs = spark.createDataFrame([(k, "word " * 60, "web") for k in range(20)], "doc_id bigint, text string, source string")
    spark.createDataFrame([(k, 1, k % 2) for k in range(20)], LABELS).write.parquet(f"{tmp_path}/labels")
    counted = interactions.cells(docs, spark.read.parquet(f"{tmp_path}/labels"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    (joined,) = [line for line in plan.splitlines() if "LeftOuter" in line]
    assert "SortMergeJoin" in joined
    assert tuple(counted.selectExpr("sum(n)", "sum(good)", "sum(toxic)").first()) == (20, 20, 10)

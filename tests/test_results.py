"""Result objects: measures in one row for each set, errors in rows of their own."""

import json

from maskwright.operators import scoring

SPAN = "set string, block_idx int, ord int, start int, end int, label string, text string"


def test_no_row_grows_with_the_errors(spark):
    n = 3_000
    expected = spark.createDataFrame([("s", k, 0, 0, 4, "PERSON", f"p{k}") for k in range(n)] + [("t", 1, 0, 0, 4, "EMAIL", "e")], SPAN)
    predicted = spark.createDataFrame([("s", k, 0, 10 if k % 3 else 2, 14 if k % 3 else 6, "PERSON", f"q{k}") for k in range(n)] + [("t", 1, 0, 1, 3, "EMAIL", "f")], SPAN)
    rows = scoring.results(expected, predicted).collect()
    assert max(len(r.json) for r in rows) < 1_000

    listed = lambda part: [json.loads(r.json) for r in sorted((r for r in rows if r.part == part), key=lambda r: (r.set, r.block_idx, r.start))]
    assert listed("missed") == [[str(k), "PERSON", f"p{k}"] for k in range(n) if k % 3]
    assert listed("false_positives") == [[str(k), "PERSON", f"q{k}"] for k in range(n) if k % 3]
    heads = {r.set: json.loads(r.json) for r in rows if r.part == "measures"}
    hit, wrong = n // 3, n - n // 3
    assert heads["s"]["typed"]["PERSON"] == {"covered": hit, "matched": hit, "fp": wrong, "fn": wrong, "precision": 0.3333, "recall": 0.3333, "f1": 0.3333}
    assert heads["s"]["overall"] == heads["s"]["untyped"] == {"precision": 0.3333, "recall": 0.3333, "f1": 0.3333, "accuracy": 0.3333}
    assert heads["t"]["overall"]["f1"] == 1.0

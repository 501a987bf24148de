"""Writing replacements into texts and runs."""

import random

from pyspark.sql import functions as F

from maskwright.operators import spans

KIND = f"n int, runs array<string>, made array<{spans.REPLACEMENT}>"


def plain(runs, made):
    text = "".join(runs)
    size, landed, at = len(text), [], 0
    clamped = [(max(0, min(a, size)), max(0, min(b, size)), t) for a, b, t in made]
    for a, b, t in sorted((x for x in clamped if x[1] > x[0]), key=lambda x: (x[0], -x[1])):
        if a >= at:
            landed.append((a, b, t))
            at = b
    owner = [k for k, r in enumerate(runs) for _ in r]
    out = [[] for _ in runs]
    at = 0
    for a, b, t in [*landed, (size, size, "")]:
        for i in range(at, a):
            out[owner[i]].append(text[i])
        if b > a:
            out[owner[a]].append(t)
        at = b
    return landed, ["".join(o) for o in out]


def test_random_edits(spark):
    rng = random.Random(9)
    cases = []
    for n in range(500):
        runs = ["".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        size = sum(map(len, runs))
        made = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(-1, size)
            made.append((a, a + rng.randint(0, 6), rng.choice(["", "X", "long new text"])))
        # Equal places have no defined order beyond length.
        if len({(max(0, a), min(b, size)) for a, b, _ in made}) == len(made):
            cases.append((n, runs, made))
    data = spark.createDataFrame([(n, r, [(a, b, t, "L") for a, b, t in m]) for n, r, m in cases], KIND)
    text = F.array_join("runs", "")
    got = data.withColumn("landed", spans.resolve_replacements(F.col("made"), F.length(text))).select("n", "landed", spans.splice(text, F.col("landed")).alias("out"), spans.splice_runs(F.col("runs"), F.col("landed")).alias("new")).collect()
    by = {r.n: r for r in got}
    for n, runs, made in cases:
        landed, new = plain(runs, made)
        assert [(r.start, r.end, r.text) for r in by[n].landed] == landed
        assert by[n].out == "".join(new) and by[n].new == new, (runs, made)


def test_one_replacement_over_three_runs(spark):
    data = spark.createDataFrame([(1, ["ab", "cd", "ef"], [(1, 5, "X", "L")])], KIND)
    row = data.select(spans.splice_runs(F.col("runs"), F.col("made")).alias("new")).first()
    assert row.new == ["aX", "", "f"]

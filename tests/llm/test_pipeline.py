from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from maskwright.llm import ordinal, pii, toxicity  # noqa: E402
from tests.llm.cases import ROWS  # noqa: E402
from tests.llm.test_jaccard import plain_kept  # noqa: E402
from tests.llm.test_packing import plain_pieces  # noqa: E402
from tests.llm.test_pii import plain as plain_spans  # noqa: E402


def hidden(text):
    """Brute-force redaction of the fixed shapes."""
    out, at = "", 0
    for start, end, kind in sorted((a, b, pii.KINDS.index(k)) for k, a, b in plain_spans(text)):
        if start >= at:
            out += text[at:start] + f"[{pii.KINDS[kind].upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_each_stage_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    columns, at = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
        was = {r.doc_id: r for r in before.collect()}
        if name == "toxicity":
            model = toxicity.fit(before, labels)
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in toxicity.scored(before, model).collect() if not r.predicted}
        elif name == "quality":
            model = ordinal.fit(before, ordinal.ratings(labels))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in ordinal.graded(before, model).collect() if r.kept}
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == plain_kept([(i, r.text) for i, r in was.items()])
        elif name == "personal_data":
            now = {r.doc_id: r for r in docs.collect()}
            assert now.keys() == was.keys() and all(r.n_chars == len(r.text) for i, r in now.items() if r.text != was[i].text)
            found = {r.doc_id: r.spans for r in pii.personal_data(before).collect()}
            base = {i: ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(r.text)) for i, r in was.items()}
            assert all(now[i].text == hidden(was[i].text) for i in was if found[i] == base[i])
        else:
            assert sorted((tuple(r)[:5] for r in docs.collect()), key=str) == plain_pieces([(i, r.text) for i, r in was.items()])
        at[name] = len(was)
    assert at["toxicity"] > at["packing"] > 50


def test_run(spark, sf):
    rows, by = corpus_pipeline.run(spark, sf).collect(), defaultdict(int)
    for r in rows:
        by[r.sequence_id] += r.length
    assert rows and max(by.values()) <= 2048


def awkward_tables(spark, folder, rows):
    """Documents with nulls in any column, repeats, long and empty texts, and columns named like those that stages make."""
    docs = [(i, t, None if n % 3 else "en", None if n % 4 else "src", None if n % 5 else len(t or ""), f"c{n}", n, "s") for n, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, __made_0 string, sequence_id int, score string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, n % 2, n % 3 // 2) for n, (i, _) in enumerate(rows)] + [(None, 1, 1)] * bool(rows)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")


def test_awkward_and_empty_tables(spark, tmp_path):
    for name, rows in (("some", ROWS), ("none", [])):
        folder = str(tmp_path / name)
        awkward_tables(spark, folder, rows)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            kept = function(spark, docs, folder)
            assert kept.columns == docs.columns, stage
            before, after = {r.doc_id for r in docs.collect()}, [r.doc_id for r in kept.collect()]
            assert set(after) <= before and len(after) <= docs.count(), stage
        packed = corpus_pipeline.run(spark, folder).collect()
        assert {r.doc_id for r in packed} <= {i for i, _ in rows}
        for sequence in {r.sequence_id for r in packed}:
            spans = sorted((r.offset, r.length) for r in packed if r.sequence_id == sequence)
            assert [a for a, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048

"""Word files, annotation files, scoring, the command line and streams."""

import io
import json
import random
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from maskwright import cli
from maskwright.operators import scoring, spans
from maskwright.plans import redact
from maskwright.sources import annotations, docx
from maskwright.streaming import uploads

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RUN = '<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{}</w:t></w:r>'


def package(body: str, extra: dict[str, str] | None = None, rels: str = "") -> bytes:
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {NS}><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        z.writestr("word/media/image1.png", b"\x89PNG \x00\xff")
        for name, text in (extra or {}).items():
            z.writestr(name, text)
    return made.getvalue()


def paragraph(*runs: str) -> str:
    return "<w:p><w:pPr/>" + "".join(RUN.format(r) for r in runs) + "</w:p>"


BODY = (
    paragraph("Write to a.b@", "x.co", " &amp; wait")
    + '<w:p><w:r><w:t>tab</w:t><w:tab/><w:br w:type="page"/><w:t>c@d.co</w:t></w:r></w:p><w:p/><w:p><w:r/></w:p>'
    + '<w:p><w:hyperlink r:id="h"><w:r><w:t>e@f.co</w:t></w:r></w:hyperlink><w:sdt><w:r><w:t>g@h.co</w:t></w:r></w:sdt></w:p>'
    + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val=\"2\"/></w:tcPr>" + paragraph("+91 20 4505 3237") + "<w:tbl><w:tr><w:tc>" + paragraph("in@ner.co") + "</w:tc></w:tr></w:tbl></w:tc><w:tc>" + paragraph("plain") + "</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>" + paragraph("hid@den.co") + "</w:tc></w:tr></w:tbl>"
    + '<w:sectPr><w:headerReference w:type="default" r:id="rId9"/></w:sectPr>'
)
HEADER = {"word/header1.xml": f'<w:hdr {NS}>{paragraph("head@er.co")}</w:hdr>'}
RELS = '<Relationship Id="rId9" Target="header1.xml"/>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("word")
    (path / "one.docx").write_bytes(package(BODY, HEADER, RELS))
    (path / "two.docx").write_bytes(package(paragraph("nothing")))
    return path


def test_blocks_of_word_files(spark, folder):
    got = docx.blocks(docx.load(spark, str(folder))).orderBy("scope", "block_idx").collect()
    one = [(r.block_idx, r.location, r.text) for r in got if r.scope.endswith("one.docx")]
    assert one == [
        (0, "body", "Write to a.b@x.co & wait"),
        (1, "body", "tab\tc@d.co"),
        (2, "body", ""),
        (3, "body", "e@f.co"),
        (4, "body/table[0,0]", "+91 20 4505 3237"),
        (5, "body/table[0,0]/table[0,0]", "in@ner.co"),
        (6, "body/table[0,2]", "plain"),
        (7, "section[0]/header", "head@er.co"),
    ]
    assert docx.blocks(docx.load(spark, str(folder)), headers=False).filter("location like 'section%'").count() == 0


BOX = "<w:pict><w:txbxContent><w:p><w:r><w:t>in the box k@l.co</w:t></w:r></w:p></w:txbxContent></w:pict>"


def test_runs_with_a_text_box(spark):
    """A run inside a run does not end the edit of the outer one, wherever the box stands."""
    body = f'<w:p><w:r>{BOX}<w:t>mail a@b.co, </w:t></w:r><w:r><w:t>and c@</w:t></w:r><w:r><w:t>d.co</w:t>{BOX}<w:t> end e@f.co</w:t></w:r></w:p>'
    files = spark.createDataFrame([("x", bytearray(package(body)))], "doc_id string, content binary")
    done = redact.with_placeholders(redact.detected(docx.blocks(files), ["email"])).withColumn("new_runs", spans.splice_runs(F.col("runs"), F.col("landed")))
    saved = docx.save(files, done)
    assert [r.text for r in docx.blocks(saved).collect()] == ["mail [EMAIL], and [EMAIL] end [EMAIL]"]
    xml = zipfile.ZipFile(io.BytesIO(saved.first().content)).read("word/document.xml").decode()
    assert xml.count("in the box k@l.co") == 2 and not re.search("a@b|c@|d\\.co|e@f", xml)
    ElementTree.fromstring(xml)
    with pytest.raises(ValueError):
        docx.written(package("<w:p><w:r><w:pict/></w:r></w:p>"), {docx.BODY: {0: ["lost"]}})


def test_one_word_file_out(spark, folder, tmp_path, capsys):
    out, mapping = tmp_path / "clean.docx", tmp_path / "mapping.json"
    assert cli.main([str(folder / "one.docx"), "-o", str(out), "-p", "placeholder", "--mapping", str(mapping)], spark) == 0
    assert "a.b@" not in zipfile.ZipFile(out).read("word/document.xml").decode()
    rows = json.loads(mapping.read_text())
    assert {r["original"] for r in rows} >= {"a.b@x.co", "e@f.co"}
    assert cli.main([str(folder), "-o", str(out)], spark) == 1


def test_round_trip(spark, folder):
    files = docx.load(spark, str(folder))
    found = redact.with_placeholders(redact.detected(docx.blocks(files)))
    changed = found.withColumn("new_runs", spans.splice_runs(F.col("runs"), F.col("landed")))
    new = {r.doc_id: bytes(r.content) for r in docx.save(files, changed).collect()}
    old = {r.doc_id: bytes(r.content) for r in files.collect()}
    assert new.keys() == old.keys()
    for k in new:
        a, b = zipfile.ZipFile(io.BytesIO(old[k])), zipfile.ZipFile(io.BytesIO(new[k]))
        assert a.namelist() == b.namelist() and a.read("word/media/image1.png") == b.read("word/media/image1.png")
        for name in ("word/document.xml", *(["word/header1.xml"] if "one" in k else [])):
            before, after = ElementTree.fromstring(a.read(name)), ElementTree.fromstring(b.read(name))
            assert [e.tag for e in before.iter() if not e.tag.endswith(("}t", "}tab"))] == [e.tag for e in after.iter() if not e.tag.endswith(("}t", "}tab"))]
        if "two" in k:
            assert a.read("word/document.xml") == b.read("word/document.xml")
    one = next(v for k, v in new.items() if k.endswith("one.docx"))
    assert [(text, runs) for _, _, _, runs in docx.walk(one) for text in ["".join(runs)]] == [
        ("Write to [EMAIL] & wait", ["Write to [EMAIL]", "", " & wait"]), ("tab\t[EMAIL]", ["tab\t[EMAIL]"]), ("", [""]), ("[EMAIL]", ["[EMAIL]"]), ("[PHONE]", ["[PHONE]"]), ("[EMAIL]", ["[EMAIL]"]), ("plain", ["plain"]), ("[EMAIL]", ["[EMAIL]"]),
    ]
    assert b"g@h.co" in zipfile.ZipFile(io.BytesIO(one)).read("word/document.xml")


def test_command_line(spark, folder, tmp_path, capsys):
    out, mapping = str(tmp_path / "out"), str(tmp_path / "map")
    assert cli.main([str(folder), "-o", out, "--mapping", mapping, "-p", "numbered", "--exclude", "phone"], spark) == 0
    assert "EMAIL: 5" in capsys.readouterr().out
    rows = [json.loads(r.value) for r in spark.read.text(mapping).collect()]
    assert len(rows) == 5 and all(re.fullmatch(r"\[EMAIL_\d\]", r["replacement"]) and r.keys() == {"type", "original", "replacement"} for r in rows)
    assert spark.read.parquet(out).count() == 2
    assert cli.main([str(folder), "--dry-run", "--only", "email, ip", "--no-headers", "--single-pass"], spark) == 0
    assert cli.main([str(folder), "--dry-run", "-t", "passthrough"], spark) == 0 and " 0 replacements" in capsys.readouterr().out
    assert cli.main([str(folder / "missing.docx")], spark) == 1 and cli.main([str(folder), "--only", "nothing"], spark) == 1


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("1", "a@b.co"), ("2", "none")], uploads.TEXT).write.parquet(source)
    for _ in range(2):
        query = uploads.redacting(uploads.arriving(spark, source), str(tmp_path / "out"), str(tmp_path / "state"), "placeholder")
        query.awaitTermination(120)
        spark.createDataFrame([("3", "+91 20 4505 3237")], uploads.TEXT).write.mode("append").parquet(source)
    got = spark.read.parquet(str(tmp_path / "out/texts"))
    assert {r.doc_id: r.redacted_text for r in got.collect()} == {"1": "[EMAIL]", "2": "none", "3": "[PHONE]"}
    assert spark.read.parquet(str(tmp_path / "out/mappings")).count() == 2


def test_expiry(spark):
    jobs = spark.sql("select * from values (1, current_timestamp() - interval 2 hours), (2, current_timestamp()) as t(job_id, created)")
    assert [r.job_id for r in uploads.expired(jobs).collect()] == [1]


FILE = {"source": "s", "sample": "x", "scope": {"first_block": 1, "last_block": 3}, "conventions": {"a": "b"}, "annotations": [{"block": 1, "items": [["PERSON", "Ann"], ["PERSON", "Ann"], ["EMAIL", "zz"]]}, {"block": 3, "items": [["LOCATION", "Pune"]]}]}


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(FILE, indent=1))
    files = annotations.load(spark, str(tmp_path))
    rows = annotations.annotations(files)
    assert [(r.block_idx, r.ord, r.label, r.text) for r in rows.orderBy("block_idx", "ord").collect()] == [(1, 0, "PERSON", "Ann"), (1, 1, "PERSON", "Ann"), (1, 2, "EMAIL", "zz"), (3, 0, "LOCATION", "Pune")]
    name = files.first().set
    blocks = spark.createDataFrame([(name, 0, "out"), (name, 1, "Ann and Ann"), (name, 2, "  "), (name, 3, "Pune Pune")], "set string, block_idx int, text string")
    assert [r.block_idx for r in annotations.in_scope(blocks, files).orderBy("block_idx").collect()] == [1, 3]
    spans_ = {(r.block_idx, r.ord): (r.start, r.end) for r in scoring.expected_spans(rows, blocks).collect()}
    assert spans_ == {(1, 0): (0, 3), (1, 1): (8, 11), (1, 2): (-1, 1), (3, 0): (0, 4)}
    assert [tuple(r)[1:] for r in scoring.invalid(rows, blocks).collect()] == [(1, "zz", 1, 0)]


def plain_scores(expected, predicted, typed, strict):
    out = {}
    touch = lambda a, b: a[:2] == b[:2] and a[3] < b[4] and b[3] < a[4] and (not typed or a[5] == b[5])
    if strict:
        taken, covered = set(), set()
        for i, e in enumerate(expected):
            for j, p in enumerate(predicted):
                if j not in taken and touch(e, p):
                    taken.add(j)
                    covered.add(i)
                    break
    else:
        covered = {i for i, e in enumerate(expected) if any(touch(e, p) for p in predicted)}
        taken = {j for j, p in enumerate(predicted) if any(touch(e, p) for e in expected)}
    for label in {x[5] for x in expected + predicted} | {"ALL"}:
        mine = lambda x: label in ("ALL", x[5])  # noqa: E731, B023
        c, m = sum(mine(expected[i]) for i in covered), sum(mine(predicted[j]) for j in taken)
        e, p = sum(map(mine, expected)), sum(map(mine, predicted))
        P, R = m / p if p else 0.0, c / e if e else 0.0
        out[label] = (c, m, p - m, e - c, round(P, 4), round(R, 4), round(2 * P * R / (P + R), 4) if P + R else 0.0, round((c + m) / (e + p), 4) if e + p else 0.0)
    return out


@pytest.mark.parametrize("typed", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_scores(spark, typed, strict):
    rng = random.Random(6)

    def made():
        rows = []
        for block in range(12):
            for k in range(rng.randint(0, 5)):
                start = rng.randint(0, 25)
                rows.append(("s", block, k, start, start + rng.randint(1, 6), rng.choice(["A", "B", "C"])))
        return rows

    expected, predicted = made(), made()
    kind = "set string, block_idx int, ord int, start int, end int, label string"
    a, b = spark.createDataFrame(expected, kind), spark.createDataFrame(predicted, kind)
    got = {r.label: tuple(r)[1:] for r in scoring.scored(scoring.counted(a, b, typed, strict)).collect()}
    want = plain_scores(expected, predicted, typed, strict)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-4) for k in want)
    text = annotations.as_json(scoring.scored(scoring.counted(a, b, typed, strict))).first().json
    assert {r["label"] for r in json.loads(text)} == got.keys()


def test_runs_that_are_not_read_are_counted(spark):
    body = BODY + paragraph("kept") + "<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>"
    notes = {**HEADER, "word/footnotes.xml": f"<w:footnotes {NS}><w:footnote>{paragraph('note')}</w:footnote></w:footnotes>", "word/header7.xml": f"<w:hdr {NS}>{paragraph('unlinked')}</w:hdr>"}
    files = spark.createDataFrame([("a", bytearray(package(body, notes, RELS))), ("b", bytearray(b"no archive")), ("c", bytearray(package("<w:p>")))], "doc_id string, content binary")
    rows = docx.scanned(files).collect()
    counts = {r.reason: (r.runs, r.characters) for r in rows if r.doc_id == "a"}
    read = docx.blocks(files).collect()
    assert {r.scope for r in read} == {"a"} and counts["kept"] == (sum(len(r.runs) for r in read), sum(len(r.text) for r in read))
    assert {k: v for k, v in counts.items() if k != "kept"} == {"content control": (1, 6), "deletion": (1, 4), "insertion": (1, 3), "merged cell": (1, 10), "footnote": (1, 4), "unused part": (1, 8)}
    assert all(r.error and r.reason is None for r in rows if r.doc_id != "a") and {r.doc_id for r in rows} == {"a", "b", "c"}


def test_a_file_that_cannot_be_written_is_an_error_row(spark):
    files = spark.createDataFrame([("good", bytearray(package(paragraph("mail a@b.co")))), ("bad", bytearray(b"no archive"))], "doc_id string, content binary")
    done = redact.with_placeholders(redact.detected(docx.blocks(files), ["email"])).withColumn("new_runs", spans.splice_runs(F.col("runs"), F.col("landed")))
    got = {r.doc_id: r for r in docx.save(files, done).collect()}
    assert got["bad"].content is None and "BadZipFile" in got["bad"].error and got["good"].error is None
    assert b"[EMAIL]" in zipfile.ZipFile(io.BytesIO(bytes(got["good"].content))).read(docx.BODY)


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    sizes = [b.num_rows for b in docx.batched(((docx.BATCH // 3, (k,)) for k in range(10)), pa.schema([("k", pa.int64())]))]
    assert sizes == [3, 3, 3, 1] and [b.num_rows for b in docx.batched(iter([(docx.BATCH * 2, (1,)), (1, (2,))]), pa.schema([("k", pa.int64())]))] == [1, 1]

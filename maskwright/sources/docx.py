"""Word documents as blocks, and blocks written back into them.

A document is read as bytes by Spark and walked in the task that holds it. Text
is written by splicing the bytes of the text elements: everything else in the
package, prefixes and unknown parts included, stays as it was.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BODY = "word/document.xml"
#: Headers and footers of a section, in reading order, and how a location names them.
EDGES = {(kind, edge): f"{name}{edge}" for edge in ("header", "footer") for kind, name in (("default", ""), ("first", "first_page_"), ("even", "even_page_"))}
BLOCKS = "doc_id string, block_idx int, location string, runs array<string>, part string, paragraph int"
ONE_CHARACTER = {W + "tab": "\t", W + "ptab": "\t", W + "br": "\n", W + "cr": "\n", W + "noBreakHyphen": "-"}


def run_text(run) -> str:
    """The text of a run: breaks of a page or column are none."""
    shown = (c for c in run if c.get(W + "type", "textWrapping") == "textWrapping")
    return "".join(c.text or "" if c.tag == W + "t" else ONE_CHARACTER.get(c.tag, "") for c in shown)


def runs_of(paragraph) -> list:
    """The runs of a paragraph, and those of its hyperlinks, in order."""
    out = []
    for child in paragraph:
        if child.tag == W + "r":
            out.append(child)
        elif child.tag == W + "hyperlink":
            out += [c for c in child if c.tag == W + "r"]
    return out


def paragraphs(container, location: str, seen: set[int]) -> Iterator[tuple[str, object]]:
    """Paragraphs of a container and of its tables, each once, with where they stand."""
    for child in container:
        if child.tag == W + "p" and id(child) not in seen:
            seen.add(id(child))
            yield location, child
        elif child.tag == W + "tbl":
            for r, row in enumerate(c for c in child if c.tag == W + "tr"):
                column = 0
                for cell in (c for c in row if c.tag == W + "tc"):
                    span, merged = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
                    # A cell that goes on from the row above shows that cell again.
                    if merged is None or merged.get(W + "val") == "restart":
                        yield from paragraphs(cell, f"{location}/table[{r},{column}]", seen)
                    column += int(span.get(W + "val", 1)) if span is not None else 1


def walk(content: bytes) -> Iterator[tuple[str, str, int, list[str]]]:
    """``(location, part, paragraph, run texts)`` of a package: the body, then the sections' headers and footers."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        names = set(package.namelist())
        body = ElementTree.fromstring(package.read(BODY))
        links = {}
        if "word/_rels/document.xml.rels" in names:
            links = {e.get("Id"): "word/" + e.get("Target", "").lstrip("/").removeprefix("word/") for e in ElementTree.fromstring(package.read("word/_rels/document.xml.rels"))}
        parts = [("body", BODY, body.find(W + "body"), body)]
        done = set()
        for n, section in enumerate(body.iter(W + "sectPr")):
            edges = {(e.get(W + "type", "default"), e.tag.removeprefix(W).removesuffix("Reference")): links.get(e.get(R + "id")) for e in section if e.tag in (W + "headerReference", W + "footerReference")}
            for edge, name in EDGES.items():
                part = edges.get(edge)
                if part in names and part not in done:
                    done.add(part)
                    root = ElementTree.fromstring(package.read(part))
                    parts.append((f"section[{n}]/{name}", part, root, root))
        for location, part, container, root in parts:
            number = {id(p): k for k, p in enumerate(root.iter(W + "p"))}
            for where, p in paragraphs(container if container is not None else (), location, set()):
                if found := runs_of(p):
                    yield where, part, number[id(p)], [run_text(r) for r in found]


#: Bytes of a batch that goes back to Spark, about; a batch has a row at least.
BATCH = 4 << 20
#: What a file that is no Word file, or a broken one, raises.
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, NotImplementedError, EOFError, zlib.error)


def batched(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows ``(bytes, values)``, each bounded by BATCH."""
    held, size = [], 0
    for n, row in rows:
        if held and size + n > BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in BLOCKS.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32()]

    def rows() -> Iterator[tuple[int, tuple]]:
        for doc, content in _cells(batches):
            try:
                # A file counts whole or not at all.
                found = list(walk(content))
            except BROKEN:
                continue  # ``scanned`` and ``save`` name it
            for k, (where, part, p, runs) in enumerate(found):
                yield sum(map(len, runs)) + 100, (doc, k, where, runs, part, p)

    yield from batched(rows(), pa.schema(list(zip(names, kinds, strict=True))))


#: Where the reader does not look, by the element that holds a run, and how the report names it.
SKIPPED = {
    "sdt": "content control", "ins": "insertion", "moveTo": "insertion", "del": "deletion", "moveFrom": "deletion", "txbxContent": "text box",
    "smartTag": "smart tag", "customXml": "custom xml", "fldSimple": "field", "ruby": "ruby", "object": "object",
}
#: Parts with text beside body, headers and footers.
NOTES = {"word/footnotes.xml": "footnote", "word/endnotes.xml": "endnote", "word/comments.xml": "comment"}
SCAN = "doc_id string, reason string, runs bigint, characters bigint, error string"
INSIDE = frozenset(W + t for t in ("document", "body", "hdr", "ftr", "tbl", "tr", "tc", "p", "hyperlink"))


def scan(content: bytes) -> dict[str, list[int]]:
    """Runs and their characters by what becomes of them: ``kept``, or the reason why the reader leaves them out.

    Parts are parsed as a stream of events with the path of open elements as
    the only state, so a large part is never a tree.
    """
    found: dict[str, list[int]] = {}
    kept = {part for _, part, _, _ in walk(content)} | {BODY}
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        for name in package.namelist():
            if not re.fullmatch(r"word/[^/]+\.xml", name) or not (name in kept or name in NOTES or re.match(r"word/(?:header|footer)", name)):
                continue
            path: list[str] = []
            merged: list[bool] = []  # of each open cell whether it goes on from the row above
            for event, element in ElementTree.iterparse(package.open(name), ("start", "end")):
                tag = element.tag
                if event == "start":
                    path.append(tag)
                    if tag == W + "tc":
                        merged.append(False)
                    continue
                path.pop()
                if tag == W + "vMerge" and merged and element.get(W + "val") != "restart":
                    merged[-1] = True
                elif tag == W + "r":
                    holders = [t.removeprefix(W) for t in path if t not in INSIDE]
                    reason = NOTES.get(name) or next((SKIPPED[t] for t in reversed(holders) if t in SKIPPED), None)
                    reason = reason or ("merged cell" if any(merged) else "unused part" if name not in kept else "other" if holders else "kept")
                    count = found.setdefault(reason, [0, 0])
                    count[0] += 1
                    count[1] += len(run_text(element)) or sum(len(t.text or "") for t in element.iter(W + "delText"))
                if tag == W + "tc":
                    merged.pop()
                if tag == W + "p" and W + "p" not in path:
                    element.clear()
    return found


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.string()), ("reason", pa.string()), ("runs", pa.int64()), ("characters", pa.int64()), ("error", pa.string())])

    def rows() -> Iterator[tuple[int, tuple]]:
        for doc, content in _cells(batches):
            try:
                counts = scan(content)
            except BROKEN as wrong:
                yield 100, (doc, None, 0, 0, f"{type(wrong).__name__}: {wrong}")
                continue
            for reason, (n, characters) in sorted(counts.items()):
                yield 100, (doc, reason, n, characters, None)

    yield from batched(rows(), schema)


def scanned(files: DataFrame) -> DataFrame:
    """``(doc_id, reason, runs, characters, error)``: for each file the runs that ``blocks`` reads (``kept``) and those that it leaves out, by reason.

    A file that cannot be read has one row with its error; one without a run
    has none.
    """
    return files.select("doc_id", "content").mapInArrow(_scanned, SCAN)


def load(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, content)`` of the Word files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select(F.col("path").alias("doc_id"), "content")


def blocks(files: DataFrame, headers: bool = True) -> DataFrame:
    """Blocks of ``files(doc_id, content)``: one for each paragraph with a run, numbered in reading order."""
    found = files.select("doc_id", "content").mapInArrow(_blocks, BLOCKS)
    found = found if headers else found.filter(~F.startswith("location", F.lit("section[")))
    return found.select(F.col("doc_id").alias("scope"), "block_idx", "location", F.array_join("runs", "").alias("text"), "runs", "part", "paragraph")


def _spliced(xml: bytes, edits: dict[int, list[str]]) -> bytes:
    """A part with the runs of its n-th paragraphs holding other texts.

    The elements are followed by name; a run counts where the reader takes it:
    directly in a paragraph, or in a hyperlink that is. Runs inside a run (a
    text box) have edits of their own, so the new texts lie on a stack. An edit
    that finds no text element to land in is an error, not a silent leak.
    """
    named = re.search(rb'xmlns:?([\w.-]*)="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', xml)
    w = named[1] + b":" if named and named[1] else b""
    texts = {w + n for n in (b"t", b"tab", b"ptab", b"br", b"cr", b"noBreakHyphen")}
    out, at, seen, path, count = [], 0, -1, [], []
    news: list[tuple[int, int, str] | None] = []  # of each open run the text that it still takes, or null
    missing = {(p, k) for p, runs in edits.items() for k, run in enumerate(runs) if run}
    for m in re.finditer(rb"<(/?)([A-Za-z_][\w.:-]*)([^>]*?)(/?)>|<!--.*?-->", xml, re.DOTALL):
        name = m[2]
        if name is None or m.start() < at:
            continue
        if m[1]:
            if path and path[-1] == name:
                path.pop()
                if name == w + b"p":
                    count.pop()
                if name == w + b"r":
                    news.pop()
            continue
        if name == w + b"p":
            seen += 1
            if not m[4]:
                count.append([seen, 0])
        direct = path and (path[-1] == w + b"p" or path[-1] == w + b"hyperlink" and path[-2:-1] == [w + b"p"])
        if name == w + b"r":
            new = None
            if direct and count:
                paragraph, k = count[-1]
                new = (paragraph, k, edits[paragraph][k]) if paragraph in edits else None
                count[-1][1] += 1
            if not m[4]:
                news.append(new)
        elif name in texts and news and news[-1] is not None and path[-1:] == [w + b"r"] and not re.search(rb'type="(?:page|column)"', m[3]):
            # The first text element of the run takes the new text, the others go.
            end = m.end() if m[4] else xml.index(b"</" + name + b">", m.end()) + len(name) + 3
            paragraph, k, new = news[-1]
            out += [xml[at : m.start()], b"<" + w + b't xml:space="preserve">' + escape(new).encode() + b"</" + w + b"t>" if new else b""]
            missing.discard((paragraph, k))
            at, news[-1] = end, (paragraph, k, "")
            continue
        if not m[4]:
            path.append(name)
    if missing:
        raise ValueError(f"{len(missing)} edited runs have no text element")
    return b"".join([*out, xml[at:]])


def written(content: bytes, edits: dict[str, dict[int, list[str]]]) -> bytes:
    """A package in which, by part and paragraph, the runs hold other texts; all other members are copied."""
    made = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(made, "w") as new:
        for item in old.infolist():
            data = old.read(item.filename)
            new.writestr(item, _spliced(data, edits[item.filename]) if item.filename in edits else data)
    return made.getvalue()


def _saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple[int, tuple]]:
        for doc, content, listed in _cells(batches):
            edits: dict[str, dict[int, list[str]]] = {}
            for e in listed or []:
                edits.setdefault(e["part"], {})[e["paragraph"]] = e["runs"]
            try:
                made, error = written(content, edits), None
            except BROKEN as wrong:
                made, error = None, f"{type(wrong).__name__}: {wrong}"
            yield len(made or b""), (doc, made, error)

    yield from batched(rows(), pa.schema([("doc_id", pa.string()), ("content", pa.binary()), ("error", pa.string())]))


def _packed(rows: Iterator[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Small Word files of ``(doc_id, body)``."""
    head = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>'

    def files() -> Iterator[tuple[int, tuple]]:
        for doc, body in rows:
            made = io.BytesIO()
            with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as new:
                new.writestr(BODY, f"{head}{body}</w:body></w:document>")
            yield made.tell(), (doc, made.getvalue())

    yield from batched(files(), pa.schema([("doc_id", pa.string()), ("content", pa.binary())]))


def packaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, text)`` as small Word files with a paragraph for each line."""
    lines = lambda text: "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    yield from _packed((doc, lines(text)) for doc, text in _cells(batches))


def bodied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, body)``, the markup of a body, as small Word files."""
    yield from _packed(_cells(batches))


def save(files: DataFrame, redacted: DataFrame) -> DataFrame:
    """``(doc_id, content, error)`` with the blocks' ``new_runs`` written in; blocks without a replacement are left alone.

    A file that cannot be written, or in which an edit finds no place, has no
    content but an error: the others go on, and nothing unredacted comes out.
    """
    changed = redacted.filter(F.size("landed") > 0).groupBy(F.col("scope").alias("doc_id")).agg(F.collect_list(F.struct("part", "paragraph", F.col("new_runs").alias("runs"))).alias("edits"))
    return files.join(changed, "doc_id", "left").select("doc_id", "content", "edits").mapInArrow(_saved, "doc_id string, content binary, error string")

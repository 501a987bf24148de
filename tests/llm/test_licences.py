import math
import re
from collections import Counter

from pyspark.sql import functions as F

from maskwright.llm import licences
from tests.llm.cases import ROWS, empty


def plain(rows, share=1.0):
    """The definition, unit by unit, without the filter on heavy terms."""
    terms = lambda x: re.findall(licences.TERM, "".join(c.lower() for c in x))
    seen = Counter(t for _, _, text in rows for t in set(terms(text or "")))
    known = {t for _, x in licences.TEMPLATES for t in terms(x)}
    idf = lambda t: math.log((len(rows) + 1) / ((seen[t] if t in known else 0) + 1)) + 1
    vector = lambda x: {t: n * idf(t) for t, n in Counter(terms(x)).items()}
    norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
    templates = [(name, vector(x)) for name, x in licences.TEMPLATES]
    blank = re.compile(r"[^ \t\n\v\f\r]+")
    own, files = {}, {}
    for _, path, text in rows:
        text = text or ""
        named = bool(path and re.match(licences.FILE_NAME, path.split("/")[-1]))
        units = [*enumerate(text.split("\n")), *([(-1, text)] if named else [])]
        found, inside = [], 0
        for line, unit in units:
            v = vector(unit)
            if not v:
                continue
            score, k = max((round(sum(w * x.get(t, 0) for t, w in v.items()) / norm(v) / norm(x), 9), -k) for k, (_, x) in enumerate(templates))
            if score >= licences.THRESHOLD:
                found.append((score, -line, k))
                inside += len(blank.findall(unit)) if line >= 0 else 0
        if found:
            score, _, k = max(found)
            own[path, text] = templates[-k][0], score
            if path is not None and (named or inside >= share * len(blank.findall(text))):
                d = path.rpartition("/")[0]
                files[d] = min(files.get(d, (1, "")), (-score, path, templates[-k][0]))
    out = []
    for i, path, text in rows:
        if hit := own.get((path, text or "")):
            out.append((i, path, *hit, "own", path))
            continue
        d, row = path.rpartition("/")[0] if path is not None else None, (i, path, None, None, None, None)
        while d is not None:
            if d in files:
                row = (i, path, files[d][2], -files[d][0], "inherited", files[d][1])
                break
            d = d.rpartition("/")[0] if d else None
        out.append(row)
    return sorted(out, key=str)


def same(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [(*g[:3], *g[4:]) for g in got] == [(*w[:3], *w[4:]) for w in want]
    assert all(g[3] == w[3] or abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))


TREE = [
    (1, "LICENSE", "Released under the MIT License."),
    (2, "a/b/c.py", "no licence here"),
    (3, "a/COPYING.txt", "x\n" * 3 + "This work is licensed under the GNU General Public License, version 3.\nmore text here"),
    (4, "a/b/d/e.py", "code"),
    (5, "a/b/d/own.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    (6, "ab/x.py", "code that mentions a license and the version 2.0"),
    (7, "top.py", None),
    (8, None, "Licensed under CC BY-NC 4.0."),
    (9, None, "nothing"),
    (10, "a/NOTICE", "Licensed under CC BY 4.0."),
    (4, "a/b/d/e.py", "code"),
    (11, "z/notes.txt", "Licensed under CC BY-SA 4.0."),
    (12, "z/y/x/w.txt", "text " * 30_000),
    (13, "/abs/file", "code"),
]


def test_tree(spark):
    got = licences.scanned(spark.createDataFrame(TREE, "doc_id bigint, path string, text string")).collect()
    same(got, plain(TREE))
    by = {r.doc_id: r for r in got}
    assert by[2].licence == by[4].licence == "GPL-3.0" and by[5].licence == "Apache-2.0" and by[6].how == "inherited" and by[6].licence == "MIT"
    assert by[8].how == "own" and by[9].licence is None and by[12].licence == "CC-BY-SA-4.0"


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("path", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))))
    rows = [(r.doc_id, r.path, r.text) for r in docs.select("doc_id", "path", "text").collect()]
    for share in (0.1, 0.5):
        same(licences.scanned(docs, file_share=share).collect(), plain(rows, share))


def test_awkward_rows(spark):
    rows = [(i, None if i == 1 else f"p/{i}", t) for i, t in ROWS]
    docs = spark.createDataFrame([(*r, 1.0, "h") for r in rows], "doc_id bigint, path string, text string, score double, h string")
    same(licences.scanned(docs).collect(), plain(rows))
    assert licences.scanned(empty(spark).withColumn("path", F.lit("x"))).count() == 0


def test_every_template_finds_itself(spark):
    rows = [(k, f"d{k}/f.txt", f"{text}\nand then other words of the file") for k, (_, text) in enumerate(licences.TEMPLATES)]
    got = licences.scanned(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()
    assert {r.doc_id: r.licence for r in got} == {k: name for k, (name, _) in enumerate(licences.TEMPLATES)}


GPL_HEADER = """# tool.py
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful.
import os"""
APACHE_HEADER = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() {}"""
GPL_FILE = "\n                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy it.\n" + "the terms and conditions for copying follow\n" * 40


def wrapped(text, width=60):
    return "Copyright (c) 2024 A. Person\n\n" + "\n".join(re.findall(rf".{{1,{width}}}(?:\s+|$)", text))


def test_headers_tags_and_whole_files(spark):
    """Wrapped headers, SPDX tags and full licence texts count, and such a text speaks for its directory whatever its name."""
    texts = [
        ("GPL-3.0", "a/1.txt", GPL_HEADER), ("Apache-2.0", "b/1.txt", APACHE_HEADER), ("MIT", "c/1.txt", "// SPDX-License-Identifier: MIT\n" + "code of its own\n" * 20),
        ("GPL-3.0", "d/1.txt", "/* SPDX-License-Identifier: GPL-3.0-or-later */"), ("GPL-2.0", "e/1.txt", "SPDX-License-Identifier: GPL-2.0+"), ("EPL-2.0", "f/1.txt", "SPDX-License-Identifier: (EPL-2.0 OR MIT)\ncode"),
        ("GPL-3.0", "g/1.txt", GPL_FILE), ("MIT", "h/1.txt", wrapped(licences.MIT)), ("BSD-2-Clause", "i/1.txt", wrapped(licences.BSD_HEAD + licences.BSD_END)),
        ("BSD-3-Clause", "j/1.txt", wrapped(licences.BSD_HEAD + licences.BSD_THIRD + licences.BSD_END)), ("CC-BY-4.0", "k/1.txt", "words before\n" * 20 + "This work is licensed under a Creative Commons\nAttribution 4.0 International License."),
        ("Apache-2.0", "l/LICENSE", "\n      Apache License\n  Version 2.0, January 2004\n" + "terms of use and reproduction\n" * 30), ("ISC", "m/1.txt", wrapped(licences.ISC, 40)),
    ]
    rows = [(k, path, text) for k, (_, path, text) in enumerate(texts)] + [(100 + k, path[0] + "/under/x.txt", "nothing") for k, (_, path, _) in enumerate(texts)]
    rows += [(1000 + k, f"z/{k}.txt", "the mit und version of the software with a license and permission") for k in range(200)]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id bigint, path string, text string"), file_share=0.5).collect()}
    assert {k: got[k].licence for k in range(len(texts))} == {k: name for k, (name, _, _) in enumerate(texts)}
    assert {got[k].how for k in range(len(texts))} == {"own"}
    speaks = {path[0] for k, (_, path, _) in enumerate(texts) if got[100 + k].how == "inherited"}
    assert speaks >= set("ghijlm") and not speaks & set("ck") and all(got[1000 + k].licence is None for k in range(200))


def test_headers_wrapped_to_a_word_a_line(spark):
    """A notice is found at any wrapping, down to a word a line, and in the middle of a long file."""
    notice = next(t for n, t in licences.TEMPLATES if n == "AGPL-3.0" and "redistribute" in t)
    filler = [f"value_{k} = compute(alpha_{k}, beta_{k})" for k in range(400)]
    rows = []
    for k, width in enumerate((1, 2, 3, 5, 8, 40)):
        words = notice.split()
        wrapped = ["# " + " ".join(words[i : i + width]) for i in range(0, len(words), width)]
        if width == 2:
            wrapped = [x for line in wrapped for x in (line, "#", "")]
        rows.append((k, f"src/f{k}.py", "\n".join([*filler[:200], *wrapped, *filler[200:]])))
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id int, path string, text string")).collect()}
    assert {k: (r.licence, r.how) for k, r in got.items()} == dict.fromkeys(range(6), ("AGPL-3.0", "own"))


def test_stretches_are_those_near_a_mark():
    import numpy as np

    for marks in ("", "0", "1", "0100000001", "1000000001", "00010000000000010000", "11111"):
        got = {k for a, b in licences._stretches(np.array([m == "1" for m in marks], bool), 4) for k in range(a, b)}
        assert got == {k for k in range(len(marks)) if any(m == "1" and abs(j - k) < 4 for j, m in enumerate(marks))}, marks

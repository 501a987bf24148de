"""Licence scan: TF-IDF cosine to templates, then inheritance down the directories.

Units are the lines of each whole text, blocks of up to LINES consecutive lines
with a term (notices are wrapped, at the worst to a term a line), and the whole
text: of any file against the texts of
whole licence files, and of files that are named like a licence against every
template. A line with an SPDX tag says its licence itself. A unit's sparse TF-IDF vector is compared with every
template; document frequencies are counted over all documents. Before that,
units that cannot reach the threshold are left out without loss: by Cauchy and
Schwarz a cosine is at most the share of the template's norm that lies on
common terms, so a unit that has none of a template's heaviest terms is below
it. A file without a licence of its own takes that of the licence file in the
nearest directory above.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import salted_join, shared_checkpoint

THRESHOLD = 0.7
#: Share of a text's words in licence lines from which on the text is itself a licence file, whatever its name.
FILE_SHARE = 1.0
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FILE_NAME = r"(?i)^(?:un)?(?:licen[cs]e|copying|copyright|notice)(?:[-_.].*)?$"
#: Rows of a batch.
ROWS = 128
BLANK = r"\x20\x09-\x0D"

#: An SPDX tag; what it says of later versions is left out of the name, as in the templates.
SPDX = r"(?i)SPDX-License-Identifier:[\x20\t(]*([A-Za-z0-9][A-Za-z0-9.-]*?)(?:-only|-or-later)?\+?(?![A-Za-z0-9.+-])"

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."

# How works state common licences (public headers and notices).
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    # Standard file headers and further notices, which are mostly wrapped.
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", "The MIT License (MIT)"),
    # How the licence files begin.
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    # Texts of whole licence files.
    ("MIT", MIT),
    ("ISC", ISC),
    ("BSD-2-Clause", BSD_HEAD + BSD_END),
    ("BSD-3-Clause", BSD_HEAD + BSD_THIRD + BSD_END),
    ("Unlicense", UNLICENSE),
)

#: The last templates are whole licence files; before them are the first lines of such files.
WHOLE = len(TEMPLATES) - 5
TITLES = WHOLE - 10
#: Lines with a term of the longest block: as many as the longest notice has terms.
LINES = max(len(re.findall(TERM, text.lower())) for _, text in TEMPLATES[:WHOLE])


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weights(frequency: dict[str, int], rows: int) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies, that of any other term, and the unit vectors of the templates."""
    idf = {t: math.log((rows + 1) / (n + 1)) + 1 for t, n in frequency.items()}
    vectors = []
    for _, text in TEMPLATES:
        raw = {t: n * idf[t] for t, n in Counter(re.findall(TERM, text.lower())).items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        vectors.append({t: w / norm for t, w in raw.items()})
    return idf, math.log(rows + 1) + 1, vectors


def _anchors(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """For each template its heaviest terms, until the rest has less norm than the threshold."""
    found = set()
    for vector in vectors:
        rest = 1.0
        for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if math.sqrt(max(rest, 0)) < threshold - 1e-9:
                break
            found.add(term)
            rest -= w * w
    return sorted(found)


def _stretches(marks: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Ranges of the places that lie less than ``reach`` from a marked one."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    breaks = np.flatnonzero(np.diff(at) >= 2 * reach - 1)
    first, last = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]
    return [(max(0, a - reach + 1), min(len(marks), b + reach)) for a, b in zip(map(int, first), map(int, last), strict=True)]


def _scored(idf: dict[str, float], rare: float, vectors: list[dict[str, float]], threshold: float, anchors: list[str]):
    """Per row ``(path, h, named, all_words, head, text)``: its units that reach the threshold, with the best template of each.

    The product of a block with a template is the sum of those of its lines, and
    its squared norm is at least the sum of theirs: only blocks that this bound
    lets through are scored, without loss. A unit that reaches the threshold has
    an anchor, so only lines near one are looked at.
    """
    heavy = frozenset(anchors)
    axes = {t: np.array([v.get(t, 0.0) for v in vectors]) for t in idf}
    term, word = re.compile(TERM), re.compile(f"[^{BLANK}]+")

    def best(counts: Counter) -> tuple[float, int]:
        weights = {t: n * idf.get(t, rare) for t, n in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        scores = np.round(sum((w * axes[t] for t, w in weights.items() if t in axes), np.zeros(len(vectors))) / norm, 9)
        return float(scores.max()), int(scores.argmax())

    def blocks(lines: list[str], held: list[tuple[int, Counter]]) -> Iterator[tuple[int, int, int, float, int]]:
        """Blocks of neighbouring lines ``(number, counts)`` with terms: first line, lines, words, score, template."""
        dots, norms, marks = np.zeros((len(held) + 1, len(vectors))), np.zeros(len(held) + 1), np.zeros(len(held) + 1, int)
        for at, (_, each) in enumerate(held, 1):
            marks[at] = not heavy.isdisjoint(each)
            for t, n in each.items():
                w = n * idf.get(t, rare)
                norms[at] += w * w
                if t in axes:
                    dots[at] += w * axes[t]
        dots, norms, marks = dots.cumsum(axis=0), norms.cumsum(), marks.cumsum()
        for n in range(1, min(LINES, len(held)) + 1):
            some = np.flatnonzero(marks[n:] > marks[:-n])
            near = (dots[some + n] - dots[some]).max(axis=1, initial=0) >= threshold * np.sqrt(norms[some + n] - norms[some]) - 1e-6
            for at in map(int, some[near]):
                score, k = best(sum((c for _, c in held[at : at + n]), Counter()))
                if score >= threshold:
                    line, end = held[at][0], held[at + n - 1][0] + 1
                    yield line, end - line, sum(len(word.findall(x)) for x in lines[line:end]), score, -k

    def units(text: str, named: bool) -> Iterator[tuple[int, int, int, float, int]]:
        lines = text.split("\n")
        every = [term.findall(x) for x in lines]
        held = [k for k, found in enumerate(every) if found]  # a block begins and ends with a line that has terms
        if not held:
            return
        for first, end in _stretches(np.array([not heavy.isdisjoint(every[k]) for k in held]), LINES):
            yield from blocks(lines, [(k, Counter(every[k])) for k in held[first:end]])
        score, k = best(sum((Counter(found) for found in every if found), Counter()))
        if score >= threshold and (named or k >= WHOLE):
            yield -1, 0, len(word.findall(text)), score, -k

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                rows = part.slice(at, ROWS)
                found = [(r, *u) for r, (text, named) in enumerate(zip(rows.column(5).to_pylist(), rows.column(2).to_pylist(), strict=True)) for u in units(text, named)]
                of, *made = zip(*found, strict=True) if found else [()] * 6
                kept = [c.take(pa.array(of, pa.int64())) for c in rows.columns[:5]]
                made = [pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], ["path", "h", "named", "all_words", "head", "line", "n", "words", "score", "k"])

    return run


def own_licences(docs: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, file_share: float = FILE_SHARE) -> DataFrame:
    """``(path, h, licence, score, line, is_file)`` of the texts with a unit that reaches the threshold.

    ``h`` is the hash of the text, ``line`` counts from 0 and is -1 for a whole
    text. Of equal scores the earlier line, then the first template, wins. A
    null text is empty and has no unit; a null path is a path like any other;
    repeated rows give one row; an empty table gives an empty table; other
    columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(path_col).alias("path"), text.alias("t"))
    known = sorted({t for _, x in TEMPLATES for t in re.findall(TERM, x.lower())})
    # The empty term counts the rows.
    each = F.array_append(F.array_intersect(_terms(F.col("t")), F.array(*map(F.lit, known))), F.lit(""))
    counted = slim.select(F.explode(each).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    frequency = dict.fromkeys(["", *known], 0) | {r["term"]: r["n"] for r in counted.collect()}  # as many rows as template terms
    rows = frequency.pop("")
    idf, rare, vectors = _weights(frequency, rows)
    anchors = _anchors(vectors, threshold)
    near = lambda c: F.arrays_overlap(_terms(c), F.array(*map(F.lit, anchors)))
    words = lambda c: F.size(F.filter(F.split(c, f"[{BLANK}]+"), lambda w: w != ""))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    head = F.size(F.split(F.regexp_extract("t", "^[^A-Za-z0-9]*+", 0), "\n")) - 1  # the first line with a term
    some = slim.filter(near(F.col("t"))).select("path", F.xxhash64("t").alias("h"), named.alias("named"), words(F.col("t")).alias("all_words"), head.alias("head"), "t")
    kinds = f"path {slim.schema['path'].dataType.simpleString()}, h bigint, named boolean, all_words int, head int, line int, n int, words int, score double, k int"
    units = some.withColumn("t", F.lower("t")).mapInArrow(_scored(idf, rare, vectors, threshold, anchors), kinds).distinct()
    names = F.array(*(F.lit(n) for n, _ in TEMPLATES))
    units = units.withColumn("licence", F.element_at(names, 1 - F.col("k")))
    tags = slim.filter(F.col("t").rlike(SPDX)).select("path", F.xxhash64("t").alias("h"), named.alias("named"), words(F.col("t")).alias("all_words"), head.alias("head"), F.posexplode(F.split("t", "\n")).alias("line", "unit")).filter(F.col("unit").rlike(SPDX))
    tag = F.regexp_extract("unit", SPDX, 1)
    known_names = F.create_map(*(F.lit(x) for name in sorted({n for n, _ in TEMPLATES}) for x in (name.lower(), name)))
    tags = tags.select("path", "h", "named", "all_words", "head", "line", F.lit(1).alias("n"), words(F.col("unit")).alias("words"), F.lit(1.0).alias("score"), F.lit(1).alias("k"), F.coalesce(known_names[F.lower(tag)], tag).alias("licence")).distinct()
    found = shared_checkpoint(units.unionByName(tags))
    single = F.col("n") == 1
    # Lines of a block count where none of them is a unit of its own and no better block shares one with it.
    alone = found.filter(single).groupBy("path", "h").agg(F.collect_set("line").alias("alone"))
    alone = alone.withColumnsRenamed({"path": "of_path", "h": "of_h"})
    span = F.sequence("line", F.col("line") + F.col("n") - 1)
    wrapped = found.filter("n > 1").join(alone, F.col("path").eqNullSafe(F.col("of_path")) & (F.col("h") == F.col("of_h")), "left").filter(F.col("alone").isNull() | ~F.arrays_overlap(span, "alone"))
    rank = F.struct("score", (-F.col("n")).alias("short"), (-F.col("line")).alias("up"))
    each = wrapped.select("path", "h", "line", "n", "words", rank.alias("rank"), F.explode(span).alias("at"))
    top = each.withColumn("top", F.max("rank").over(Window.partitionBy("path", "h", "at")))
    taken = top.groupBy("path", "h", "line", "n", "words").agg(F.bool_and(F.col("rank") == F.col("top")).alias("first")).filter("first").groupBy("path", "h").agg(F.sum("words").alias("in_blocks"))
    taken = taken.withColumnsRenamed({"path": "of_path", "h": "of_h"})
    title = (F.col("k") <= -TITLES) & (F.col("k") > -WHOLE) & (F.col("line") == F.col("head"))
    lone = found.filter(single).select("path", "h", "line", "words").distinct().groupBy("path", "h").agg(F.sum("words").alias("in_lines"))
    lone = lone.withColumnsRenamed({"path": "at_path", "h": "at_h"})
    of = found.groupBy("path", "h", "named", "all_words", "head").agg(F.max(F.struct("score", (-F.col("line")).alias("up"), "k", "licence")).alias("b"), F.bool_or(title | (F.col("line") < 0)).alias("says"))
    of = of.join(lone, F.col("path").eqNullSafe(F.col("at_path")) & (F.col("h") == F.col("at_h")), "left")
    of = of.join(taken, F.col("path").eqNullSafe(F.col("of_path")) & (F.col("h") == F.col("of_h")), "left")
    inside = F.coalesce("in_lines", F.lit(0)) + F.coalesce("in_blocks", F.lit(0))
    is_file = F.col("named") | F.col("says") | (inside >= F.lit(file_share) * F.col("all_words"))
    return of.select("path", "h", F.col("b.licence").alias("licence"), F.col("b.score").alias("score"), (-F.col("b.up")).cast("int").alias("line"), is_file.alias("is_file"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scanned(docs: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", file_share: float = FILE_SHARE) -> DataFrame:
    """One row per input row: ``doc_id, path, licence, score, how, origin``.

    ``how`` is ``own`` or ``inherited``; then ``origin`` is the licence file,
    and the score is its. All four are null without a licence. Of several
    licence files in a directory the one with the highest score, then with the
    first path, counts. Null texts are empty, and a row with a null path
    neither gives nor takes an inherited licence. Repeated rows each get a row;
    an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    own = own_licences(docs, path_col, text_col, file_share=file_share)
    files = own.filter("is_file and path is not null").withColumn("dir", _directory(F.col("path")))
    given = files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), "licence")).alias("f"))
    given = given.select("dir", F.struct(F.col("f.licence").alias("licence"), (-F.col("f.s")).alias("score"), F.col("f.p").alias("origin")).alias("f"))
    # Directories, not files, look for their ancestors: a large directory asks once.
    dirs = rows.filter("path is not null").select(_directory(F.col("path")).alias("of")).distinct()
    parts = F.split("of", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    asked = dirs.select("of", F.posexplode(F.array_distinct(above)).alias("depth", "dir"))
    nearest = asked.join(given, "dir").groupBy("of").agg(F.max_by("f", "depth").alias("f"))
    own = own.select(F.col("path").alias("own_path"), F.col("h").alias("own_h"), F.col("licence").alias("own_licence"), F.col("score").alias("own_score"))
    joined = rows.join(own, F.col("path").eqNullSafe(F.col("own_path")) & (F.col("h") == F.col("own_h")), "left").withColumn("of", _directory(F.col("path")))
    joined = salted_join(joined, nearest, "of", F.col("path"), "left")
    has, takes = F.col("own_licence").isNotNull(), F.col("f").isNotNull()
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own_licence", "f.licence").alias("licence"),
        F.coalesce("own_score", "f.score").alias("score"),
        F.when(has, "own").when(takes, "inherited").alias("how"),
        F.when(has, F.col("path")).when(takes, F.col("f.origin")).alias("origin"),
    )

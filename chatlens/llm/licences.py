"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, white space, copyright
lines, equivalent spellings), and its digest is looked up among those of
known licences and notices. Whole texts are looked up, and so are whole lines, since
a notice usually stands on a line of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import pkgutil
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Licences whose text lies in ``licence_texts``, as published.
PUBLISHED = ("Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of {0} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    """THIS SOFTWARE IS PROVIDED BY THE {1} AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE {2} OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""")


def _published() -> list[tuple[str, str]]:
    """Texts in ``licence_texts``, with and without what follows their terms."""
    out = []
    for name in PUBLISHED:
        text = pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()
        terms, end, after = text.partition("END OF TERMS AND CONDITIONS")
        out += [(name, text), *([(name, terms), (name, terms + end)] if after else [])]
        if name == "CC0-1.0":
            out.append((name, text.replace("Creative Commons CC0 1.0", "Creative Commons Legal Code CC0 1.0", 1)))
    return out


def _bsd() -> list[tuple[str, str]]:
    """BSD with two and three clauses: titles, numbered or not, a line of rights reserved or not, names of the holders."""
    out = []
    for three, numbered, reserved, titled, (name, by, holder) in itertools.product(
            (False, True), (False, True), (False, True), (False, True),
            (("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("the copyright holder", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"),
             ("the copyright holders", "COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("the University", "REGENTS", "REGENTS"))):
        clauses = [(f"{n}. " if numbered else "") + line for n, line in enumerate(_BSD[1:4 if three else 3], 1)]
        title = [f"BSD {3 if three else 2}-Clause License"] * titled + ["All rights reserved."] * reserved
        out.append((f"BSD-{3 if three else 2}-Clause", "\n".join([*title, _BSD[0], *clauses, _BSD[4]]).format(name, by, holder)))
    return out


#: Known notices and licences, as published.
KNOWN = [
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("All-Rights-Reserved", "All rights reserved."),
    *_published(),
    *_bsd(),
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

# the last two without their titles, and MIT under its other one
KNOWN[-2:-2] = [(name, text.partition("\n")[2]) for name, text in KNOWN[-2:]] + [("MIT", "The MIT License (MIT)\n" + KNOWN[-2][1].partition("\n")[2])]

#: Spellings that mean the same, after punctuation is gone.
EQUIVALENT = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"),
    ("authorisation", "authorization"), ("authorised", "authorized"),
    ("favour", "favor"), ("honour", "honor"), ("neighbouring", "neighboring"), ("colour", "color"),
    ("whilst", "while"), ("noncommercial", "non commercial"), ("noninfringement", "non infringement"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("per cent", "percent"), ("https", "http"), ("v 2", "version 2"), ("v 3", "version 3"),
    ("v2", "version 2"), ("v3", "version 3"),
]

#: A line that only names a copyright holder and year.
COPYRIGHT_LINE = re.compile(r"[\W_]*(?:copyright\b|\(c\)|©)[\x20\t]*(?:(?:\(c\)|©|copyright\b)[\x20\t]*)*(?:[0-9<\[(]|by\b).*")
WORD = re.compile(r"[^\W_]+")


def line_words(line: str) -> list[str]:
    """Words of one line in lower case; none for a copyright line."""
    line = line.lower()
    if ("copyright" in line or "(c)" in line or "©" in line) and COPYRIGHT_LINE.fullmatch(line):
        return []
    return WORD.findall(line)


def canonical(words: list[str]) -> str:
    form = f" {' '.join(words)} "
    for spelling, same in EQUIVALENT:
        if spelling in form:
            form = form.replace(f" {spelling} ", f" {same} ")
    return form.strip()


def digest(words: list[str]) -> str | None:
    form = canonical(words)
    return hashlib.sha256(form.encode()).hexdigest() if form else None


def text_words(text: str) -> list[str]:
    return [w for line in text.split("\n") for w in line_words(line)]


#: Most known digests that are broadcast; each is a row of a digest and a name.
BROADCAST_ROWS = 100_000


def known_licences(spark: SparkSession, texts=None) -> DataFrame:
    """``digest, licence, words`` of ``texts`` (default ``KNOWN``), one row a digest."""
    rows: dict[str, tuple[str, int]] = {}
    for licence, text in KNOWN if texts is None else texts:
        words = text_words(text)
        if key := digest(words):
            rows[key] = min(rows.get(key, (licence, len(words))), (licence, len(words)))
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], "digest string, licence string, words long")


def _units(most: int):
    """Digests of texts and lines of at most ``most`` words."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, digests = [], [], []

            def add(doc_id, line, words):
                if 0 < len(words) <= most and (key := digest(words)):
                    ids.append(doc_id), lines.append(line), digests.append(key)

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole: list[str] = []
                parts = (text.as_py() or "").split("\n")
                for n, line in enumerate(parts, 1):
                    words = line_words(line)
                    if len(parts) > 1:
                        add(doc_id, n, words)
                    if len(whole) <= most:
                        whole += words
                add(doc_id, 0, whole)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(digests, pa.string())],
                                             ["doc_id", "line", "digest"])
    return run


def licence_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, scope, line, licence, n`` for each text or line whose digest is in ``known``.

    ``scope`` is ``text`` (``line`` 0) or ``line`` (its number from 1, split at
    newlines); ``n`` counts equal rows, so repeated documents stay visible.
    Null and empty texts and lines match nothing; a text of one line is reported as a
    text only. Rows with a null id are reported with it. Other columns are ignored.

    No equivalent spelling turns more than two words into one, so what has more
    than twice the words of the longest known text can't be equal to any and is not
    digested; that bound is read from ``known``. Digests are joined by hash: with up to
    ``BROADCAST_ROWS`` known digests (some 20 MB) these go to the corpus, which stays in place; a larger table is
    shuffled and merged with the corpus' digests. The corpus is never broadcast.
    """
    longest, size = known.agg(F.max("words"), F.count("*")).first()
    most = 2 * (longest or 0)
    side = known.select("digest", "licence")
    side = F.broadcast(side) if size <= BROADCAST_ROWS else side.hint("merge")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_units(most), "doc_id long, line long, digest string")
    return (found.join(side, "digest")
            .groupBy("doc_id", F.when(F.col("line") == 0, "text").otherwise("line").alias("scope"), "line", "licence")
            .agg(F.count("*").alias("n")))

"""Licences that texts state, by the Dice coefficient over word bigrams.

Templates are whole standard licence texts, their opening paragraphs and the notices by which
texts name a licence. Words are runs of ASCII letters and digits in lower case; repeated
bigrams count as often as they occur on both sides, so the number of words alone bounds the
coefficient.

Three kinds of units are compared. Lines and paragraphs are as long as they are: a template
is a candidate only for units of matching size. Windows have as many words as the template
and may begin at any word, so a licence that spans paragraphs or stands inside a sentence is
found as well. No window is built: an occurrence of a template's bigram counts for the windows
that begin after the occurrence it would be one too many with, and not behind itself, so each gives one
interval of beginnings, and a running sum over the ends of the intervals is the overlap.

A unit can reach the threshold only if it has one of some ``size - least overlap + 1`` bigrams
of a candidate; one pattern tests for these before any bigram is made. All of it is built-in
functions: a map for lines and paragraphs, and for windows two shuffles of the bigrams that
texts share with templates, by text and template.
"""

import json
import math
import re
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factsieve.llm.store import only, text_of

THRESHOLD = 0.8

# Standard texts and notices by which works state their licence.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
    'and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:"
)
_BSD_CONDITIONS = (
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        _MIT_GRANT,
        f"{_MIT_GRANT} {_MIT_REST}",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
        "file except in compliance with the License.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>.",
    ),
    # what all licences of the family begin with
    "BSD": (_BSD_GRANT,),
    "BSD-2-Clause": (f"{_BSD_GRANT} {_BSD_CONDITIONS} {_BSD_DISCLAIMER}",),
    "BSD-3-Clause": (f"{_BSD_GRANT} {_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        'in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being "
        "the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}


def bigrams_of(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))
    return [f"{a} {b}" for a, b in zip(words, words[1:])]  # noqa: B905


def _least_overlap(size: int, threshold: float) -> int:
    """Bigrams of a template that any unit at the threshold shares, whatever its size."""
    return math.ceil(threshold * size / (2 - threshold) - 1e-9)


def normalised(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def _any_of(grams: set[str]) -> str:
    """A pattern for any of the bigrams; they are grouped by letter and word, so few are tried at a place."""

    def one_of(parts: list[str]) -> str:
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    letters = []
    for letter, words in groupby(sorted(grams), lambda g: g[0]):
        by_word = [
            first[1:] + " " + one_of([g.split(" ")[1] for g in same])
            for first, same in groupby(words, lambda g: g.split(" ")[0])
        ]
        letters.append(letter + one_of(by_word))
    return r"\b" + one_of(letters) + r"\b"


def _constant(rows: list[dict], schema: str) -> Column:
    """A table of values as one constant; a column per value would take a minute to build."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def _in_windows(may: DataFrame, known: list[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """``doc_id, license, line, dice`` of the best window of each text and template.

    Of a row of equally good windows the last counts, which begins with a shared bigram;
    ``line`` is that bigram's. A text shorter than the template is one window.
    """
    rows = [
        {"nr": nr, "license": name, "size": len(grams), "low": _least_overlap(len(grams), threshold),
         "gram": gram, "most": grams.count(gram)}
        for nr, (name, grams) in enumerate(known)
        for gram in sorted(set(grams))
    ]
    table = may.sparkSession.range(1).select(
        F.inline(_constant(rows, "array<struct<nr int, license string, size int, low int, gram string, most int>>"))
    )

    in_lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.transform(
            F.filter(F.split(normalised(x), " "), lambda w: w != ""), lambda w: F.struct(i.alias("line"), w.alias("w"))
        ),
    )
    # rows alike in id and text are one text
    texts = may.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.flatten(in_lines).alias("words"))
    texts = texts.withColumn("n", F.size("words") - 1).where("n > 0")
    pairs = F.arrays_zip(F.slice("words", 1, F.col("n")).alias("a"), F.slice("words", 2, F.col("n")).alias("b"))
    places = texts.select("doc_id", "digest", "n", F.posexplode(pairs).alias("pos", "p")).select(
        "doc_id", "digest", "n", "pos", F.col("p.a.line").alias("line"),
        F.concat_ws(" ", "p.a.w", "p.b.w").alias("gram"),
    )
    text_and_template = ["doc_id", "digest", "nr", "license", "size", "low", "n"]
    hits = places.join(F.broadcast(table), "gram").where("n >= low")
    by_gram = hits.groupBy(*text_and_template, "gram", "most").agg(
        F.sort_array(F.collect_set(F.struct("pos", "line"))).alias("at")
    )
    # a text that has too few of a template's bigrams is no candidate for it
    one = Window.partitionBy("doc_id", "digest", "nr")
    by_gram = by_gram.withColumn("all", F.sum(F.least(F.size("at"), "most")).over(one)).where("all >= low")
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))

    def interval(p: Column, i: Column) -> Column:
        too_many = F.coalesce(F.get("at", i - F.col("most"))["pos"] + 1, F.lit(0))
        first = F.greatest(p["pos"] - F.col("size") + 1, too_many, F.lit(0))
        return F.struct(first.alias("a"), F.least(p["pos"], last).alias("b"), p["line"].alias("line"))

    intervals = by_gram.select(*text_and_template, F.inline(F.transform("at", interval))).where("a <= b")
    ends = intervals.select(
        *text_and_template,
        F.inline(
            F.array(
                F.struct(F.col("a").alias("s"), F.lit(1).alias("more"), F.lit(0).alias("less"), F.lit(None).cast("int").alias("line")),
                F.struct(F.col("b").alias("s"), F.lit(0).alias("more"), F.lit(1).alias("less"), "line"),
            )
        ),
    )
    along = one.orderBy("s")
    overlap = F.sum("more").over(along) - F.coalesce(
        F.sum("less").over(along.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    dice = F.lit(2.0) * overlap / (F.least("n", "size") + F.col("size"))
    found = ends.select("doc_id", "license", "line", dice.alias("dice"))
    return found.where((F.col("dice") >= threshold) & F.col("line").isNotNull())


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id, license, dice, line`` for each licence that a document states.

    ``dice`` is the best coefficient, at least ``threshold``, over the document's lines,
    paragraphs (runs of lines between blank ones) and windows of a template's length;
    ``line`` is the first such unit: the number of the line, of the paragraph's first line, or of
    the line where the first bigram that a window shares begins, from 0. Licences with much
    text in common (BSD with two and three clauses) may both be given; the larger ``dice``
    tells them apart. Null and empty texts state nothing. Rows that repeat an id are one
    document; null ids are one document too. Other columns are ignored. An empty table gives
    an empty result.
    """
    known = []
    for name, texts in (TEMPLATES if templates is None else templates).items():
        for text in texts:
            grams = bigrams_of(text)
            if grams:
                known.append((name, grams))
    n = {id(g): len(g) for _, g in known}
    gate = set()
    fixed = []
    for name, grams in known:
        size = n[id(grams)]
        least = _least_overlap(size, threshold)
        # the longest bigrams are the rarest, so they make the tightest test
        by_length = sorted(grams, key=lambda g: (-len(g), g))
        gate.update(by_length[: size - least + 1])
        fixed.append(
            {"license": name, "size": size, "low": least,
             "high": math.floor(size * (2 - threshold) / threshold + 1e-9),
             "grams": [{"gram": g, "n": grams.count(g)} for g in sorted(set(grams))]}
        )
    one = "struct<license string, size int, low int, high int, grams array<struct<gram string, n int>>>"
    constants = _constant(fixed, f"array<{one}>")
    low = min(_least_overlap(s, threshold) for s in n.values())
    high = max(math.floor(s * (2 - threshold) / threshold + 1e-9) for s in n.values())
    pattern = _any_of(gate)

    rows = only(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col))
    # texts without any of the gate's bigrams are done after one pass
    may = rows.where(normalised(F.col("text")).rlike(pattern))
    lines = may.select("doc_id", F.split("text", "\n").alias("lines"))
    blank = F.transform("lines", lambda x: F.trim(F.regexp_replace(x, r"[\x09-\x0D]", " ")) == "")
    starts = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: ~F.get("blank", i) & F.coalesce(F.get("blank", i - 1), F.lit(True)),
    )
    ends = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: ~F.get("blank", i) & F.coalesce(F.get("blank", i + 1), F.lit(True)),
    )
    parts = lines.withColumn("blank", blank).select(
        "doc_id", "lines", F.arrays_zip(starts.alias("a"), ends.alias("b")).alias("parts")
    )
    whole = F.transform(
        "parts",
        lambda p: F.struct(
            p["a"].alias("line"), F.array_join(F.slice("lines", p["a"] + 1, p["b"] - p["a"] + 1), " ").alias("unit")
        ),
    )
    single = F.transform("lines", lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
    units = parts.select("doc_id", F.explode(F.concat(single, whole)).alias("u")).select(
        "doc_id", "u.line", normalised(F.col("u.unit")).alias("unit")
    )
    units = units.where(F.col("unit").rlike(pattern)).withColumn("words", F.split("unit", " "))
    units = units.withColumn("size", F.size("words") - 1).where(F.col("size").between(low, high))
    grams = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)),
    )
    candidates = F.filter(constants, lambda t: (F.col("size") >= t["low"]) & (F.col("size") <= t["high"]))
    # the candidates depend on the size alone; each is compared on its own row
    fitting = units.select(
        "doc_id", "line", "size", grams.alias("grams"), F.explode(candidates).alias("t")
    )
    both = F.aggregate(
        "t.grams",
        F.lit(0),
        lambda sum_, g: sum_ + F.least(g["n"], F.size(F.filter("grams", lambda x: x == g["gram"]))),
    )
    scored = fitting.select(
        "doc_id", "line", F.col("t.license").alias("license"),
        (F.lit(2.0) * both / (F.col("size") + F.col("t.size"))).alias("dice"),
    ).where(F.col("dice") >= threshold)
    scored = scored.unionByName(_in_windows(may, known, threshold))
    best = scored.groupBy("doc_id", "license").agg(F.max(F.struct("dice", -F.col("line"))).alias("m"))
    return best.select("doc_id", "license", F.col("m.dice").alias("dice"), (-F.col("m.col2")).alias("line"))

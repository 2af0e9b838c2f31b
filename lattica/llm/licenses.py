"""License scan: normalised text against licence templates by the Dice coefficient over word bigrams, in DataFrame operations only.

A text's segments are its lines, its paragraphs (between blank lines), itself, and the stretches of words anywhere in it that match
better than the segments they overlap. Bigrams count as often as they
occur, so a segment of n words has n - 1, and a template of m bigrams can only reach a coefficient of t if
m * t / (2 - t) <= n - 1 <= m * (2 - t) / t. Most segments fall outside all templates' bounds by their word count and go no further.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import let

# Licence notices and whole short licences in their published wording.
_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _TWO_CLAUSES + _AS_IS],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT,
        _MIT + " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}


def template_bigrams(text: str) -> list[str]:
    """Bigrams, each with the number of its earlier occurrences, so that sets of them intersect as bags."""
    words, seen, out = re.findall(r"[a-z0-9]+", text.lower()), Counter(), []
    for pair in zip(words, words[1:], strict=False):
        out.append(f"{pair[0]} {pair[1]} {seen[pair]}")
        seen[pair] += 1
    return out


def _words(text: Column) -> Column:
    """Runs of letters and numbers, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda b, i: F.concat_ws(" ", F.get(words, i), b))
    return let(pairs, lambda ps: F.transform(ps, lambda p, i: F.concat_ws(" ", p, F.size(F.filter(F.slice(ps, F.lit(1), i), lambda q: q == p)).cast("string"))))


#: Words that most texts have: a template's rarer words tell sooner that a text has nothing of it.
FREQUENT = frozenset("a an and any are as at be by can for from if in is it may no not of on or other see that the this to under was with work you".split())


def _telling(bag: list[str], low: int) -> set[str]:
    """Words of which any window with `low` of the template's bigrams has one."""
    pairs, out, left = [b.split(" ")[:2] for b in bag], set(), len(bag)
    for w in sorted({w for p in pairs for w in p}, key=lambda w: (w in FREQUENT, -len(w), w)):
        if left < low:
            break
        out.add(w)
        left = sum(not out & set(p) for p in pairs)
    return out


def _windows(lines: Column, bags: list[tuple[str, list[str]]], high: dict[int, int], threshold: float) -> Column:
    """The best windows of a text: structs of dice, order and license, and words.

    lines: structs of a line's words (w) and the best coefficient of a segment that holds the line (dice, 0 if none). A window is a stretch
    of the text's words across lines; it begins and ends with bigrams of its template, as any other is worse than what it holds. Best
    first, windows stay that overlap no better one and no segment that is as good.
    """
    forms = F.array(
        *[
            F.struct(F.lit(-i).alias("order"), F.lit(lic).alias("license"), F.lit(len(b)).alias("m"), F.lit(high[i]).alias("high"), F.array(*[F.struct(F.lit(x).alias("b"), F.lit(k).alias("times")) for x, k in sorted(Counter(x.rsplit(" ", 1)[0] for x in b).items())]).alias("bag"))
            for i, (lic, b) in enumerate(bags)
        ]
    )
    known = F.array(*[F.lit(x) for x in sorted({x.rsplit(" ", 1)[0] for _, b in bags for x in b})])

    def of_words(words: Column, cover: Column) -> Column:
        pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda b, i: F.struct(i.alias("at"), F.concat_ws(" ", F.get(words, i), b).alias("b")))

        def of_pairs(met: Column) -> Column:
            def of_form(form: Column) -> Column:
                def count(p: Column) -> Column:
                    return F.get(F.filter(form["bag"], lambda x: x["b"] == p["b"]), 0)["times"]

                mine = F.filter(met, lambda p: F.exists(form["bag"], lambda x: x["b"] == p["b"]))

                # full: the place among them from which a window holds the template's number of a bigram before this one
                def of_mine(ps: Column) -> Column:
                    def full(p: Column, j: Column) -> Column:
                        first = F.greatest(j - form["high"], F.lit(0))
                        same = F.filter(F.transform(F.slice(ps, first + 1, j - first), lambda q, k: F.struct((k + first).alias("j"), q["b"].alias("b"))), lambda q: q["b"] == p["b"])
                        return let(same, lambda q: F.coalesce(F.get(q, F.greatest(F.size(q) - count(p), F.lit(-1)))["j"], F.lit(-1)))

                    marked = F.transform(ps, lambda p, j: F.struct(p["at"].alias("at"), full(p, j).alias("full")))

                    def of_marked(ms: Column) -> Column:
                        def from_(m: Column, a: Column) -> Column:
                            held = F.filter(F.slice(ms, a + 1, form["high"]), lambda x: (x["full"] < a) & (x["at"] < m["at"] + form["high"]))
                            every = F.transform(held, lambda x, k: F.struct((2.0 * (k + 1) / (x["at"] - m["at"] + 1 + form["m"])).alias("dice"), form["order"].alias("order"), form["license"].alias("license"), (-m["at"]).alias("from"), x["at"].alias("to")))
                            return F.filter(every, lambda x: (x["dice"] >= threshold) & (F.array_max(F.slice(cover, m["at"] + 1, x["to"] - m["at"] + 2)) < x["dice"]))

                        return F.flatten(F.transform(ms, from_))

                    return let(marked, of_marked)

                return let(mine, of_mine)

            return F.flatten(F.transform(forms, of_form))

        found = F.array_sort(let(F.filter(pairs, lambda p: F.array_contains(known, p["b"])), of_pairs))
        kind = "array<struct<dice:double,order:int,license:string,from:int,to:int>>"
        # a window's last bigram ends one word after it begins
        chosen = F.aggregate(F.reverse(found), F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: (x["to"] + 1 >= -y["from"]) & (y["to"] + 1 >= -x["from"])), acc).otherwise(F.concat(acc, F.array(x).cast(kind))))
        cut = F.transform(chosen, lambda x: F.struct(F.struct(x["dice"].alias("dice"), x["order"].alias("order"), x["license"].alias("license")).alias("best"), F.slice(words, 1 - x["from"], x["to"] + x["from"] + 2).alias("w")))
        return F.transform(F.array_distinct(cut), lambda x: x["best"])

    words, cover = F.flatten(F.transform(lines, lambda x: x["w"])), F.flatten(F.transform(lines, lambda x: F.array_repeat(x["dice"], F.size(x["w"]))))
    return let(F.struct(words.alias("w"), cover.alias("c")), lambda x: of_words(x["w"], x["c"]))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, license (of the best segment, null if none reaches the threshold), dice (its coefficient, 0 if none), licenses
    (all that any segment has as its best, sorted), n_segments (segments that reach the threshold).

    A segment's licence is its best template; ties go to the licence first in code-point order. Null and empty texts have no
    segments. A line that is the whole text or a whole paragraph counts once, and so do windows of equal words. No shuffle: a row's
    segments stay in it.
    """
    bags = sorted((lic, template_bigrams(t)) for lic, texts in (TEMPLATES if templates is None else templates).items() for t in texts)
    bags = [(lic, b) for lic, b in bags if b]
    low = {i: math.ceil(len(b) * threshold / (2 - threshold) - 1e-9) for i, (_, b) in enumerate(bags)}
    high = {i: math.floor(len(b) * (2 - threshold) / threshold + 1e-9) for i, (_, b) in enumerate(bags)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(text, "\n")
    blocks = F.when(text.rlike(r"\n[\x20\x09-\x0D]*\n"), F.split(text, r"\n[\x20\x09-\x0D]*\n")).otherwise(F.array().cast("array<string>"))
    split = docs.select(F.col(id_col), text.alias("_t"), F.array_distinct(F.concat(lines, blocks, F.array(text))).alias("_s"))
    split = split.withColumn("_w", F.transform("_s", _words)).drop("_s")

    def fits(words: Column) -> Column:
        n = F.size(words) - 1
        found = F.lit(False)
        for a, b in sorted({(low[i], high[i]) for i in low}):
            found = found | n.between(a, b)
        return found

    def best(words: Column) -> Column:
        def of(bag: Column) -> Column:
            scores = [
                F.when(F.size(bag).between(low[i], high[i]), F.struct((2.0 * F.size(F.array_intersect(bag, F.array(*map(F.lit, b)))) / (F.size(bag) + len(b))).alias("dice"), F.lit(-i).alias("order"), F.lit(lic).alias("license")))
                for i, (lic, b) in enumerate(bags)
            ]
            return F.array_max(F.array(*scores))

        return let(_bigrams(words), of)

    if bags:
        telling = F.array(*map(F.lit, sorted(set().union(*(_telling(b, low[i]) for i, (_, b) in enumerate(bags))))))
        # a segment without any of these words reaches no threshold, whatever its size
        hits = F.filter(F.transform(F.filter("_w", lambda w: fits(w) & F.arrays_overlap(w, telling)), lambda w: F.struct(best(w).alias("best"), w.alias("w"))), lambda x: x["best"]["dice"] >= threshold)
        split = split.withColumn("_h", hits)

        def covered(words: Column) -> Column:
            return F.coalesce(F.array_max(F.transform(F.filter("_h", lambda x: x["w"] == words), lambda x: x["best"]["dice"])), F.lit(0.0))

        def of_block(block: Column) -> Column:
            whole = F.greatest(covered(F.element_at("_w", -1)), covered(_words(block)))
            return let(whole, lambda c: F.transform(F.transform(F.split(block, "\n"), _words), lambda w: F.struct(w.alias("w"), F.greatest(c, covered(w)).alias("dice"))))

        some = F.arrays_overlap(F.element_at("_w", -1), telling)
        windows = _windows(F.flatten(F.transform(F.split("_t", r"\n[\x20\x09-\x0D]*\n"), of_block)), bags, high, threshold)
        hits = F.transform("_h", lambda x: x["best"])
        hits = F.when(some, F.concat(hits, windows)).otherwise(hits)
    else:
        hits = F.array().cast("array<struct<dice:double,order:int,license:string>>")
    out = split.select(id_col, hits.alias("_h"))
    top = F.array_max("_h")
    return out.select(
        id_col,
        top["license"].alias("license"),
        F.coalesce(top["dice"], F.lit(0.0)).alias("dice"),
        F.array_sort(F.array_distinct(F.transform("_h", lambda x: x["license"]))).alias("licenses"),
        F.size("_h").cast("long").alias("n_segments"),
    )

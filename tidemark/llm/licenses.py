"""Licence scans: normalised lines, blocks, texts and runs of phrases compared to templates by the Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dice coefficient from which a unit is a template.
THRESHOLD = 0.8

# Public licence texts and notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The bigram counts at which Dice with a template of ``size`` bigrams can reach the threshold."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def units(text: Column) -> Column:
    """Lines, blocks between blank lines, and the whole text, each distinct one once."""
    return F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n\s*\n"), F.array(text)))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    """Distinct pairs of neighbours; the words are computed once, not once for each pair."""

    def pairs(found: Column) -> Column:
        return F.transform(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(found, i + 1)))

    return F.array_distinct(_bound(words, pairs))


def _matches(grams: Column, templates: dict[str, tuple[str, ...]], threshold: float) -> Column:
    """(license, dice) of the templates that reach the threshold; those out of size bounds are not compared."""
    scores = []
    for name, texts in templates.items():
        for text in texts:
            own = template_bigrams(text)
            low, high = bounds(len(own), threshold)
            shared = F.size(F.array_intersect(grams, F.array(*[F.lit(x) for x in own])))
            dice = F.when(F.size(grams).between(low, high), shared * 2 / (F.size(grams) + len(own)))
            scores.append(F.struct(F.lit(name).alias("license"), dice.alias("dice")))
    return F.filter(F.array(*scores), lambda x: x["dice"] >= threshold)


def _wanted(templates: dict[str, tuple[str, ...]], threshold: float) -> tuple[Column, list[str], list[str]]:
    """A row per licence with its templates, the longest first; all their bigrams; and words of which a text has at least one if it holds enough bigrams of any."""
    rows, every, keys = [], set(), set()
    for name, texts in templates.items():
        own_rows, edges = [], ([], [])
        for text in sorted(texts, key=lambda x: -len(template_bigrams(x))):
            words = re.sub(r"[\W_]+", " ", text.lower()).split()
            own = template_bigrams(text)
            low, high = bounds(len(own), threshold)
            # Repeats count here: a run is at most as long as the upper bound of the template's own length.
            longest = max(high, bounds(len(words) - 1, threshold)[1]) + 1
            own_rows.append(F.struct(F.array(*[F.lit(x) for x in own]).alias("own"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(longest).alias("longest")))
            for edge, pair in zip(edges, (words[:2], words[-2:])):
                edge.append(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(pair) + r"(?![\p{L}\p{N}])")
            every.update(own)
            left = set(own)
            for word in sorted(set(words), key=lambda w: (-len(w), w)):
                if len(left) < low:
                    break
                keys.add(word)
                left = {x for x in left if word not in x.split()}
        rows.append(F.struct(F.lit(name).alias("license"), F.array(*own_rows).alias("templates"), F.lit("|".join(edges[0])).alias("first"), F.lit("|".join(edges[1])).alias("last")))
    return F.array(*rows), sorted(every), sorted(keys)


def _dice(grams: Column, t: Column) -> Column:
    """The coefficient, null out of size bounds."""
    return F.when(F.size(grams).between(t["low"], t["high"]), F.size(F.array_intersect(grams, t["own"])) * 2 / (F.size(grams) + F.size(t["own"])))


def _level(grams: Column, own: Column, threshold: float) -> Column:
    """The bigrams of the longest of a licence's templates that a unit is; 0 for none."""
    return F.array_max(F.transform(own["templates"], lambda t: F.when(_dice(grams, t) >= threshold, F.size(t["own"])).otherwise(0)))


def _unit_level(unit: Column, own: Column, threshold: float, needed: list[tuple[str, ...]]) -> Column:
    """``_level`` of a line or block, whose bigrams are built only if it has the words of some template."""
    return F.when(_could_hold(unit, needed), _bound(_bigrams(_words(unit)), lambda g: _level(g, own, threshold))).otherwise(0)


#: Stands for a line or block that is a template, where a run cannot go on.
_END = "\0"


def _has_room(text: Column, own: Column, t: Column, threshold: float, needed: list[tuple[str, ...]]) -> Column:
    """Whether some part of the text between lines and blocks that are the template or a longer one shares enough bigrams for a run.

    A run consists of consecutive phrases of such a part, so its bigrams are among those of the part.
    """

    def left(unit: Column, parts: Column) -> Column:
        return F.when(_unit_level(unit, own, threshold, needed) >= F.size(t["own"]), F.array(F.lit(_END))).otherwise(parts)

    lines = lambda block: F.flatten(F.transform(F.split(block, "\n"), lambda x: left(x, F.array(x))))
    blocks = F.transform(F.split(F.replace(text, F.lit(_END), F.lit(" ")), r"\n\s*\n"), lambda x: left(x, lines(x)))
    return F.exists(F.split(F.array_join(F.flatten(blocks), "\n"), r"\x00"), lambda part: F.size(F.array_intersect(_bigrams(_words(part)), t["own"])) >= t["low"])


def _phrases(text: Column, own: Column, threshold: float, needed: list[tuple[str, ...]]) -> Column:
    """(words, level) of each phrase in order, the level that of its line or block.

    Phrases end at line ends, at marks beside white space, before a template's
    first two words and after its last two.
    """

    def cut(line: Column) -> Column:
        marked = F.regexp_replace(F.regexp_replace(F.lower(line), own["first"], F.lit("\n$0")), own["last"], F.lit("$0\n"))
        return F.transform(F.split(marked, r"\n|(?<=[^\p{L}\p{N}\s])\s+|\s+(?=[^\p{L}\p{N}\s])"), _words)

    def levelled(unit: Column, above: Column, use) -> Column:
        return _bound(F.greatest(above, _unit_level(unit, own, threshold, needed)), use)

    def lines(block: Column, above: Column) -> Column:
        return F.flatten(F.transform(F.split(block, "\n"), lambda x: levelled(x, above, lambda n: F.transform(cut(x), lambda w: F.struct(w.alias("words"), n.alias("level"))))))

    blocks = F.transform(F.split(text, r"\n\s*\n"), lambda x: levelled(x, F.lit(0), lambda n: lines(x, n)))
    return F.filter(F.flatten(blocks), lambda p: F.get(p["words"], F.lit(0)) != "")


def _best_run(phrases: Column, start: Column, t: Column) -> Column:
    """(start, end, dice) of the best run of phrases from ``start``."""

    def state(grams, last, n, at, end, dice, going):
        return F.struct(grams.alias("grams"), last.alias("last"), n.alias("n"), at.alias("at"), end.alias("end"), dice.alias("dice"), going.alias("going"))

    def step(s: Column, phrase: Column) -> Column:
        words = phrase["words"]
        stopped = state(s["grams"], s["last"], s["n"], s["at"], s["end"], s["dice"], F.lit(False))

        def grown(grams: Column) -> Column:
            dice = F.coalesce(_dice(grams, t), F.lit(0.0))
            better = dice > s["dice"]
            return state(grams, F.element_at(words, -1), s["n"] + F.size(words), s["at"] + 1, F.when(better, s["at"]).otherwise(s["end"]), F.when(better, dice).otherwise(s["dice"]), F.size(grams) <= t["high"])

        fits = s["going"] & (phrase["level"] < F.size(t["own"])) & (s["n"] + F.size(words) <= t["longest"])
        joined = F.when(s["last"] == "", words).otherwise(F.concat(F.array(s["last"]), words))
        return F.when(fits, _bound(F.array_union(s["grams"], _bigrams(joined)), grown)).otherwise(stopped)

    none = state(F.array().cast("array<string>"), F.lit(""), F.lit(0), start, start, F.lit(0.0), F.lit(True))
    run = F.aggregate(F.slice(phrases, start, t["longest"]), none, step)
    return _bound(run, lambda r: F.struct((-F.size(t["own"])).alias("size"), (-r["dice"]).alias("minus"), start.alias("start"), r["end"].alias("end")))


def _runs(phrases: Column, templates: Column, own: Column, threshold: float) -> Column:
    """(license, dice) of the runs of phrases that reach the threshold: the longest template's best first, then those that overlap none before."""

    def begins(i: Column, t: Column) -> Column:
        phrase = F.get(phrases, i - 1)
        beyond = F.coalesce(F.slice(F.get(phrases, i)["words"], 1, 1), F.array().cast("array<string>"))
        return (phrase["level"] < F.size(t["own"])) & F.arrays_overlap(_bigrams(F.concat(phrase["words"], beyond)), t["own"])

    def of(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(phrases)), lambda i: begins(i, t))
        return F.filter(F.transform(starts, lambda i: _best_run(phrases, i, t)), lambda r: r["minus"] <= -threshold)

    ranked = F.array_sort(F.flatten(F.transform(templates, of)))
    chosen = F.aggregate(ranked, F.array().cast("array<struct<size:int,minus:double,start:int,end:int>>"), lambda kept, r: F.when(F.exists(kept, lambda k: (k["start"] <= r["end"]) & (r["start"] <= k["end"])), kept).otherwise(F.concat(kept, F.array(r))))
    distinct = F.array_distinct(F.transform(chosen, lambda r: F.struct(r["size"].alias("size"), (-r["minus"]).alias("dice"), F.array_join(F.flatten(F.transform(F.slice(phrases, r["start"], r["end"] - r["start"] + 1), lambda p: p["words"])), " ").alias("words"))))
    return F.transform(distinct, lambda r: F.struct(own["license"].alias("license"), r["dice"].alias("dice")))


def _passages(text: Column, templates: dict[str, tuple[str, ...]], threshold: float) -> Column:
    """(license, dice) of the runs of phrases that are a template and lie in no line, block or text that is it or a longer one of its licence.

    A run that reaches the threshold shares as many bigrams with its template
    as the lower size bound, so a text without as many is passed over, and so
    is one that has them only in lines and blocks that are the template.
    """
    rows, every, keys = _wanted(templates, threshold)
    needed = _needed(templates, threshold)
    none = F.array().cast("array<struct<license:string,dice:double>>")

    def search(grams: Column, hits: Column, own: Column) -> Column:
        def missing(level: Column) -> Column:
            return F.filter(own["templates"], lambda t: (F.size(t["own"]) > level) & (F.size(F.array_intersect(hits, t["own"])) >= t["low"]) & _has_room(text, own, t, threshold, needed))

        def run(left: Column) -> Column:
            return F.when(F.size(left) > 0, _bound(_phrases(text, own, threshold, needed), lambda p: F.when(F.size(p) > 0, _runs(p, left, own, threshold)).otherwise(none))).otherwise(none)

        return _bound(_bound(_level(grams, own, threshold), missing), run)

    def judged(grams: Column) -> Column:
        hits = F.array_intersect(grams, F.array(*[F.lit(x) for x in every]))
        return _bound(hits, lambda h: F.flatten(F.transform(rows, lambda own: search(grams, h, own))))

    return _bound(_words(text), lambda w: F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in keys])), _bound(_bigrams(w), judged)).otherwise(none))


def _needed(templates: dict[str, tuple[str, ...]], threshold: float) -> list[tuple[str, ...]]:
    """Words of which every text that holds a template has those of at least one row.

    What reaches the threshold shares as many bigrams with a template as the
    lower size bound, so it holds at least one of any that number less one
    leaves out: those of the longest words are asked for, and of a bigram
    with a long word that word alone.
    """
    rows = set()
    for texts in templates.values():
        for text in texts:
            own = sorted((x.split() for x in template_bigrams(text)), key=lambda x: (-len(x[0]) - len(x[1]), x))
            for pair in own[: len(own) - bounds(len(own), threshold)[0] + 1]:
                long, short = sorted(pair, key=lambda w: (-len(w), w))
                rows.add((long,) if len(long) > 8 else (long, short))
    return sorted(row for row in rows if len(row) == 1 or (row[0],) not in rows)


def _could_hold(unit: Column, needed: list[tuple[str, ...]]) -> Column:
    """Whether a text has the words of one row."""
    array = lambda words: F.array(*[F.lit(w) for w in sorted(words)])
    alone, pairs = {row[0] for row in needed if len(row) == 1}, [row for row in needed if len(row) == 2]

    def has(words: Column) -> Column:
        found = F.arrays_overlap(words, array(alone)) if alone else F.lit(False)
        if not pairs:
            return found
        # Few texts have the longer word of a pair, and only they are asked for each.
        each = reduce(lambda a, b: a | b, [F.array_contains(words, x) & F.array_contains(words, y) for x, y in pairs])
        return found | (F.arrays_overlap(words, array({x for x, _ in pairs})) & each)

    return _bound(F.split(F.lower(unit), r"[^\p{L}\p{N}]+"), has)


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_matches, licenses, best_license, best_dice) per row.

    ``n_matches`` counts pairs of a distinct unit of the text and a template: a
    line, a block, the whole text, or a run of phrases (a template in several
    paragraphs, or a notice within a longer line) outside those that match it;
    ``licenses`` lists names in order; the best has the highest coefficient,
    the first name among equals; none is null and an empty list.  Null and
    empty texts match nothing; rows repeat as given; no rows give none.  A row
    is judged on its own, without a shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    smallest = min(bounds(len(template_bigrams(t)), threshold)[0] for texts in templates.values() for t in texts)
    # A unit of n bigrams has at least n + 1 words, so 2 n + 1 characters.
    needed = _needed(templates, threshold)
    likely = F.filter(units(text), lambda u: (F.length(u) >= 2 * smallest + 1) & _could_hold(u, needed))
    found = F.flatten(F.transform(likely, lambda u: _bound(_words(u), lambda w: _bound(_bigrams(w), lambda g: _matches(g, templates, threshold)))))
    found = F.concat(found, _passages(text, templates, threshold))
    # Most texts have none of the words and are not cut into units at all.
    found = F.when(_could_hold(text, needed), found).otherwise(F.array().cast("array<struct<license:string,dice:double>>"))
    best = F.element_at(F.array_sort(F.transform("found", lambda x: F.struct((-x["dice"]).alias("minus"), x["license"].alias("license")))), 1)
    scanned = docs.select(F.col(id_col).alias("doc_id"), found.alias("found"))
    return scanned.select("doc_id", F.size("found").cast("long").alias("n_matches"), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))).alias("licenses"), F.when(F.size("found") > 0, best["license"]).alias("best_license"), F.when(F.size("found") > 0, -best["minus"]).alias("best_dice"))


def _oracle() -> str:
    rows = []
    for name, texts in TEMPLATES.items():
        for text in texts:
            own = ", ".join("'" + x.replace("'", "''") + "'" for x in template_bigrams(text))
            rows.append(f"('{name}', [{own}])")
    return rf"""
WITH t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS t(license, own)),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\n\s*\n')), [coalesce(text, '')]))) AS unit FROM documents),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(unit), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u WHERE length(unit) >= 5),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w),
m AS (SELECT doc_id, license, 2 * len(list_intersect(grams, own)) / (len(grams) + len(own)) AS dice FROM g, t WHERE len(grams) BETWEEN ceil(len(own) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9) AND floor(len(own) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)),
b AS (SELECT doc_id, count(*) AS n, list_sort(list(DISTINCT license)) AS licenses, min(struct_pack(minus := -dice, license := license)) AS best FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, CAST([] AS VARCHAR[])) AS licenses, best.license AS best_license, -best.minus AS best_dice FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id
"""


ORACLE = _oracle()

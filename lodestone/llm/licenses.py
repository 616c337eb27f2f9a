"""Licence scan in DataFrame functions only: Dice coefficient over word bigrams against templates.

A unit of comparison is one line, the whole text, or any run of words in it, so that a notice wrapped
over lines or embedded in a longer one is found.  A unit and a template are compared only when
their bigram counts allow the threshold (size bounds); and a text is looked at closely only when it
shares a bigram with the part of some template that every match has to touch (prefix bound), and run by
run only for templates of which it holds enough bigrams.  The bounds are exact: they never lose a match.
A run is as long as the size bound of the template's words, repeats counted, at most.

Defined results: null and empty texts match nothing; of equal scores a line or the whole text comes before
a run, of runs the one of the larger template, and then the template named last in alphabetical order;
repeated rows are scanned one by one; extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import plain

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_MIT_WARRANTY = """The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to
the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright
holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out
of or in connection with the Software or the use or other dealings in the Software."""
_BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """This software is provided by the copyright holders and contributors "as is" and any express or implied
warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are
disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special,
exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data,
or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort
(including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such
damage."""
_ISC_WARRANTY = """The software is provided "as is" and the author disclaims all warranties with regard to this software including
all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or
consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract,
negligence or other tortious action, arising out of or in connection with the use or performance of this software."""
_GPL3_COPY = "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: (template, licence, text): whole notices, and the parts and short forms that stand alone.
TEMPLATES: list[tuple[str, str, str]] = [
    ("apache-header", "Apache-2.0", _APACHE),
    ("apache-short", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-2-full", "BSD-2-Clause", f"{_BSD_BODY} {_BSD_WARRANTY}"),
    ("bsd-3-full", "BSD-3-Clause", f"{_BSD_BODY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("bsd-head", "BSD", _BSD),
    ("cc-by-nc-short", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-long", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-short", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-long", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl3-header", "GPL-3.0", f"{_GPL3} {_GPL3_COPY}"),
    ("gpl3-short", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc-full", "ISC", f"{_ISC} {_ISC_WARRANTY}"),
    ("isc-grant", "ISC", _ISC),
    ("mit-full", "MIT", f"{_MIT} {_MIT_WARRANTY}"),
    ("mit-grant", "MIT", _MIT),
    ("mit-short", "MIT", "Released under the MIT License."),
    ("mpl-header", "MPL-2.0", _MPL),
]

_OTHER = "[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return re.sub(_OTHER, " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, sorted."""
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _prefixes(templates: list[tuple[str, str, str]], threshold: float) -> list[str]:
    # A match shares at least t/(2-t) of a template's bigrams, so it touches any set that is larger than the rest.
    sets = [bigrams_of(text) for _, _, text in templates]
    often = Counter(b for s in sets for b in s)
    out: set[str] = set()
    for s in sets:
        need = math.ceil(threshold / (2 - threshold) * len(s) - 1e-9)
        # Prefer bigrams of telling words: long ones are rare in other text.
        out.update(sorted(s, key=lambda b: (-len(b), often[b], b))[: len(s) - need + 1])
    return sorted(out)


def _bigrams(text: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(text), _OTHER, " ")), " ", -1)
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(words), pairs))


def _best(unit: Column, templates: list[tuple[str, str, str]], threshold: float) -> Column:
    """The best (dice, unit, size, template, license) of a unit given as its distinct bigrams, or null."""
    scores = []
    for name, license_id, text in sorted(templates):
        own = bigrams_of(text)
        low, high = math.ceil(threshold / (2 - threshold) * len(own) - 1e-9), math.floor((2 - threshold) / threshold * len(own) + 1e-9)
        size = F.size(unit)
        dice = F.lit(2.0) * F.size(F.array_intersect(unit, F.array(*map(F.lit, own)))) / (size + len(own))
        scores.append(F.when(size.between(low, high), F.when(dice >= threshold, _match(dice, 1, 0, name, license_id))))
    return F.greatest(*scores)


def _match(dice: Column, unit: int, size: int, name: str, license_id: str) -> Column:
    # Compared from left to right.
    return F.struct(F.round(dice, 6).alias("dice"), F.lit(unit).alias("unit"), F.lit(size).alias("size"), F.lit(name).alias("template"), F.lit(license_id).alias("license"))


def _best_run(grams: Column, whole: Column, templates: list[tuple[str, str, str]], threshold: float) -> Column:
    """The best match of any run of words, given the bigrams of a text in order and once each, or null."""
    scores = []
    for name, license_id, text in sorted(templates):
        own = bigrams_of(text)
        need, longest = math.ceil(threshold / (2 - threshold) * len(own) - 1e-9), math.floor((2 - threshold) / threshold * (len(_words(text)) - 1) + 1e-9)
        scores.append(F.when(F.size(F.array_intersect(whole, F.array(*map(F.lit, own)))) >= need, _run_of(grams, own, need, longest, threshold, name, license_id)))
    return F.greatest(*scores)


def _run_of(grams: Column, own: list[str], need: int, longest: int, threshold: float, name: str, license_id: str) -> Column:
    held = F.array(*map(F.lit, own))
    # Without leading bigrams that are not of the template a run scores no less, so only runs that begin with one are tried.
    starts = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(held, F.get(grams, i - 1)))
    runs = F.filter(F.transform(starts, lambda i: F.array_distinct(F.slice(grams, i, F.lit(longest)))), lambda r: F.size(F.array_intersect(r, held)) >= need)

    def longer(a: Column, gram: Column) -> Column:
        n, shared = a["n"] + 1, a["shared"] + F.array_contains(held, gram).cast("int")
        return F.struct(n.alias("n"), shared.alias("shared"), F.greatest(a["dice"], F.lit(2.0) * shared / (n + len(own))).alias("dice"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"))
    dice = F.array_max(F.transform(runs, lambda r: F.aggregate(r, zero, longer, lambda a: a["dice"])))
    return F.when(dice >= threshold, _match(dice, 0, len(own), name, license_id))


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its best match (license, template, dice; null if none) and its number of matching lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    near = F.arrays_overlap(_bigrams(text), F.array(*map(F.lit, _prefixes(templates, threshold))))
    step = plain(docs, "doc_id", "text").select("doc_id", text.alias("text"), near.alias("near"))
    units = F.when(F.col("near"), F.transform(F.split("text", "\n", -1), lambda x: F.array_distinct(_bigrams(x))))
    step = step.select("doc_id", units.alias("units"), F.when(F.col("near"), _bigrams(F.col("text"))).alias("grams"))
    step = step.select("doc_id", "units", "grams", F.array_distinct("grams").alias("whole"))
    lines = F.filter(F.transform("units", lambda u: _best(u, templates, threshold)), lambda x: x.isNotNull())
    step = step.select("doc_id", F.coalesce(lines, F.array()).alias("lines"), F.when(F.size("whole") > 0, _best(F.col("whole"), templates, threshold)).alias("all"), F.when(F.size("whole") > 0, _best_run(F.col("grams"), F.col("whole"), templates, threshold)).alias("run"))
    best = F.greatest(F.array_max("lines"), F.col("all"), F.col("run"))
    return step.select("doc_id", best.alias("best"), F.size("lines").cast("long").alias("n_lines")).select("doc_id", F.col("best.license").alias("license"), F.col("best.template").alias("template"), F.col("best.dice").alias("dice"), "n_lines")

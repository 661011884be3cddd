"""Licence scan in Spark expressions only: Dice coefficient over word bigrams against templates.

A text is normalised (small letters, everything but letters, digits and line ends as one space, so comment signs go) and compared
in three ways: line by line, as a whole, and by runs of lines. For sets of n and m bigrams the coefficient is
at most 2 min(n, m) / (n + m), so a table by set size lists the few templates that can reach the threshold,
and only those are intersected.

Runs find a notice or a whole licence inside a longer file, however its lines are wrapped. A text is a candidate for a
template only if it has so many of the template's bigrams that the threshold can be reached at all; then from each line on, the
longest run of lines with no more words than the template, and that with one line more, are compared. Runs with too few bigrams
of any template are left out before sets are made. Nothing is shuffled; the templates are constants of the plan.

Defined cases: a null or empty text, and one without two words, matches nothing; of equal scores the first
template by name wins; repeated rows match alike; a very long text is scanned whole, in time of the order of its length;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Bigrams of the shortest template that is looked for in runs of lines: shorter ones are declarations of a line.
RUN_BIGRAMS = 24
#: Whole licences, as their stewards publish them.
FOLDER = Path(__file__).parent / "licenses"

# Licence names as they are written in declarations, and the texts of short licences and notices.
NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License, Version 2.0",
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-2.0": "GNU General Public License, version 2",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSD-2-Clause": "BSD 2-Clause License",
    "ISC": "ISC License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
}
FORMS = ("Licensed under {the} {name}.", "Released under {the} {name}.", "This work is licensed under {the} {name}.", "This file is distributed under {the} {name}.", "SPDX-License-Identifier: {id}")
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
TEXTS["BSD-3-Clause"] = TEXTS["BSD-2-Clause"].replace("THIS SOFTWARE", BSD_THIRD + "THIS SOFTWARE", 1)
# The AGPL's text is that of the GPL under its own name, with another section 13.
AGPL_13 = """Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License."""


def whole_licences() -> list[tuple[str, str]]:
    """(licence, text) of the folder's files, and the AGPL."""
    texts = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(FOLDER.glob("*.txt"))]
    gpl = dict(texts)["GPL-3.0"]
    before, rest = re.split(r"\n\s*13\. Use with[^\n]*\n", gpl, maxsplit=1)
    after = rest[re.search(r"\n\s*14\. ", rest).start() :]
    named = lambda t: re.sub(r"(?i)GNU General Public License", "GNU Affero General Public License", t)
    return [*texts, ("AGPL-3.0", f"{named(before)}\n13. Remote Network Interaction; Use with the GNU General Public License.\n{AGPL_13}\n{named(after)}")]


def normalised(text: str) -> str:
    """Of an ASCII template."""
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).strip()


def templates() -> list[tuple[str, str]]:
    """(licence, normalised text), without repeats, by licence and text."""
    forms = [(i, normalised(f.format(the="" if i.startswith("CC") else "the", name=n, id=i))) for i, n in NAMES.items() for f in FORMS]
    return sorted({*forms, *((i, normalised(t)) for i, t in [*TEXTS.items(), *whole_licences()])})


def _bigrams(text: str) -> list[int]:
    words = text.split(" ")
    hashes = {xxhash.xxh64_intdigest(f"{a} {b}".encode(), 42) for a, b in zip(words, words[1:], strict=False)}
    return sorted(h - (1 << 64) if h >> 63 else h for h in hashes)


def within_bounds(n: int, m: int, threshold: float) -> bool:
    return 2 * min(n, m) >= threshold * (n + m)


def needed(m: int, threshold: float) -> int:
    """How many bigrams of a template of m a text must have to reach the threshold."""
    return max(1, int(-(-m * threshold // (2 - threshold))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _bigram_hashes(words: Column) -> Column:
    """Of an array of words, in order."""
    return _let(words, lambda w: F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.xxhash64(F.concat(x, F.lit(" "), w[i + 1])))))


def _running(counts: Column) -> Column:
    """Sums up to each element, by doubling."""
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(counts), F.lit(1)))).cast("int")), counts,
                       lambda x, k: F.transform(x, lambda v, i: v + F.coalesce(F.get(x, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license (null if none reaches the threshold), dice of its best unit, n_matches: how many lines, whole texts and templates' best runs reach it."""
    known = known if known is not None else templates()
    sets = [_bigrams(t) for _, t in known]
    largest = max((m for s in sets for m in (len(s), int(len(s) * (2 - threshold) / threshold) + 1)), default=0)
    by_size = [[k for k, s in enumerate(sets) if n and within_bounds(n, len(s), threshold)] for n in range(largest + 1)]
    least = min((n for n, c in enumerate(by_size) if c), default=1)
    table = F.from_json(F.lit(json.dumps([{"id": i, "set": s, "words": t.count(" ") + 1, "need": needed(len(s), threshold)} for (i, t), s in zip(known, sets, strict=True)])), "array<struct<id:string,set:array<bigint>,words:int,need:int>>")
    sizes = F.from_json(F.lit(json.dumps(by_size)), "array<array<int>>")
    long = [k for k, s in enumerate(sets) if len(s) >= RUN_BIGRAMS]
    any_of = sorted({h for k in long for h in sets[k]}) or [0]
    fewest = min((needed(len(sets[k]), threshold) for k in long), default=1 << 30)

    score = lambda s, t: F.struct((2.0 * F.size(F.array_intersect(s, t["set"])) / (F.size(s) + F.size(t["set"]))).alias("dice"), t["id"].alias("id"))
    reach = lambda s: F.filter(F.transform(F.coalesce(F.get(sizes, F.size(s)), F.array().cast("array<int>")), lambda k: score(s, table[k])), lambda x: x["dice"] >= threshold)
    spaces = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))

    clean = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.filter(F.transform(F.split(clean, "\n"), lambda x: F.btrim(x)), lambda x: x != "").alias("lines"))
    rows = rows.select("doc_id", "lines", F.flatten(F.transform("lines", lambda x: F.split(x, " "))).alias("words"))
    rows = rows.select("doc_id", "lines", _bigram_hashes(F.col("words")).alias("grams"))
    rows = rows.select("doc_id", "lines", "grams", F.expr(f"transform(grams, g -> g IN ({','.join(f'{h}L' for h in any_of)}))").alias("marks"))

    by_line = F.filter(F.transform(F.filter("lines", lambda u: spaces(u) >= least), lambda u: _let(F.array_distinct(_bigram_hashes(F.split(u, " "))), reach)), lambda b: F.size(b) > 0)
    several = F.size("lines") > 1
    # the whole text, and the long templates of which it has enough
    nothing = F.array().cast("array<struct<dice:double,id:string>>")
    whole = F.when(several & (F.size("grams") >= least), _let(F.array_distinct("grams"), reach)).otherwise(nothing)
    has = lambda hits: F.filter(F.array(*[F.lit(k) for k in long]).cast("array<int>"), lambda k: F.size(F.array_intersect(hits, table[k]["set"])) >= table[k]["need"])
    marked = F.filter("grams", lambda g, i: F.col("marks")[i])
    candidates = F.when(several, _let(F.array_distinct(marked), lambda hits: F.when(F.size(hits) >= fewest, has(hits)))).otherwise(F.lit(None))
    rows = rows.select("doc_id", "lines", "grams", "marks", by_line.alias("by_line"), whole.alias("whole"), F.coalesce(candidates, F.array().cast("array<int>")).alias("candidates"))

    def runs(ends: Column, hits: Column) -> Column:
        """The best run of each candidate; ends: words up to each line's end, hits: marked bigrams up to each."""

        def run(k: Column, first: Column, more: int) -> Column:
            begin = F.coalesce(F.get(ends, first - 1), F.lit(0))
            fit = F.size(F.filter(F.slice(ends, first + 1, table[k]["words"] + 1), lambda e: e - begin <= table[k]["words"]))
            last = F.least(first + F.greatest(fit - 1, F.lit(0)) + more, F.size(ends) - 1)
            to = ends[last] - 1  # bigrams begin + 1 to this one are the run's
            enough = (last > first) & (hits[F.greatest(to - 1, F.lit(0))] - F.coalesce(F.get(hits, begin - 1), F.lit(0)) >= table[k]["need"])
            own = F.array_distinct(F.slice(F.col("grams"), begin + 1, F.greatest(to - begin, F.lit(0))))
            return F.when(enough, _let(own, lambda s: score(s, table[k])))

        of = lambda k: F.array_max(F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda first: F.array(run(k, first, 0), run(k, first, 1)))))
        return F.filter(F.transform("candidates", of), lambda x: x["dice"] >= threshold)

    ends = _running(F.transform("lines", lambda x: spaces(x) + 1))
    hits = _running(F.transform("marks", lambda m: m.cast("int")))
    best_runs = F.when(F.size("candidates") > 0, _let(ends, lambda e: _let(hits, lambda h: runs(e, h)))).otherwise(nothing)
    found = rows.select("doc_id", "by_line", "whole", best_runs.alias("runs"))
    top = F.array_min(F.transform(F.concat(F.flatten("by_line"), F.col("whole"), F.col("runs")), lambda x: F.struct((-x["dice"]).alias("d"), x["id"].alias("id"))))
    n = F.size("by_line") + (F.size("whole") > 0).cast("int") + F.size("runs")
    return found.select("doc_id", top.alias("top"), n.cast("long").alias("n_matches")).select("doc_id", F.col("top.id").alias("license"), F.round(-F.col("top.d"), 6).alias("dice"), "n_matches")


def scan_sql(threshold: float = THRESHOLD) -> str:
    rows = ", ".join(f"({k}, '{i}', '{t}', {needed(len(_bigrams(t)), threshold)})" for k, (i, t) in enumerate(templates()))
    grams = lambda w: f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])"
    return f"""
WITH templates AS (SELECT k, id, need, len(w) AS words, list_distinct({grams("w")}) AS s FROM (SELECT k, id, need, string_split(t, ' ') AS w FROM (VALUES {rows}) AS v(k, id, t, need))),
long AS (SELECT * FROM templates WHERE len(s) >= {RUN_BIGRAMS}),
clean AS (SELECT row_number() OVER () AS row, doc_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
texts AS (SELECT *, {grams("w")} AS g FROM (SELECT *, flatten(list_transform(lines, lambda x: string_split(x, ' '))) AS w FROM clean)),
units AS (SELECT row, unnest(list_transform(lines, lambda x: string_split(x, ' '))) AS w FROM texts UNION ALL SELECT row, w FROM texts WHERE len(lines) > 1),
sets AS (SELECT row, row_number() OVER () AS unit, list_distinct({grams("w")}) AS s FROM units WHERE len(w) > 1),
hits AS (SELECT row, unit, id, 2.0 * len(list_intersect(sets.s, templates.s)) / (len(sets.s) + len(templates.s)) AS dice
         FROM sets JOIN templates ON 2 * least(len(sets.s), len(templates.s)) >= {threshold} * (len(sets.s) + len(templates.s))),
candidates AS (SELECT row, k, id, words, s, need, g, lines FROM (SELECT *, list_distinct(g) AS dg FROM texts WHERE len(lines) > 1) JOIN long ON len(dg) >= need AND len(list_intersect(dg, s)) >= need),
ends AS (SELECT row, list(e ORDER BY n) AS ends FROM (SELECT row, n, sum(c) OVER (PARTITION BY row ORDER BY n)::BIGINT AS e
         FROM (SELECT row, unnest(list_transform(lines, lambda x: len(string_split(x, ' ')))) AS c, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT DISTINCT row, lines FROM candidates))) GROUP BY row),
firsts AS (SELECT c.*, ends, f, CASE WHEN f > 1 THEN ends[f - 1] ELSE 0 END AS b FROM candidates c JOIN ends USING (row), unnest(range(1, len(ends) + 1)) AS u(f)),
lasts AS (SELECT *, least(greatest(f, len(list_filter(ends, lambda e: e <= b + words))) + m, len(ends)) AS l FROM firsts, (VALUES (0), (1)) AS v(m)),
runs AS (SELECT row, k, id, s, list_distinct(g[b + 1:ends[l] - 1]) AS own FROM lasts WHERE l > f),
best_runs AS (SELECT row, -1 - k AS unit, id, max(2.0 * len(list_intersect(own, s)) / (len(own) + len(s))) AS dice FROM runs GROUP BY row, k, id),
reached AS (SELECT * FROM hits WHERE dice >= {threshold} UNION ALL SELECT * FROM best_runs WHERE dice >= {threshold}),
best AS (SELECT row, arg_min(id, (-dice, id)) AS license, max(dice) AS dice, count(DISTINCT unit) AS n FROM reached GROUP BY row)
SELECT doc_id, license, round(dice, 6) AS dice, coalesce(n, 0) AS n_matches FROM clean LEFT JOIN best USING (row)
"""

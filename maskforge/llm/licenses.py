"""Licence scan by the Dice coefficient over word bigrams; DataFrame functions only.

Texts and templates are normalised alike: lower case, runs of other characters than ASCII
letters and digits become one space.  Passages are the whole text, every line of a text that
has several, and windows of words.  A passage matches a template when twice their common
distinct bigrams are at least ``threshold`` of both their bigrams together.  Sizes bound what
can match: with threshold t a template of b bigrams needs b * t / (2 - t) to b * (2 - t) / t in
the passage, so passages outside every bound are dropped before bigrams are compared, and
pairs outside their own bound are never counted.

Windows find licences inside longer texts, wrapped or in the middle of a line.  Each bigram
that a text shares with a template says where in the text the template's first word would
stand.  A place on which at least one in ``VOTE_SHARE`` of the template's bigrams agree begins
a window of as many words as the template has.  All windows of a template together hold at
most ``VOTE_SHARE`` times as many bigrams as the text shares with it, give or take the
template's own repeats, so their cost is linear; a licence shows in them unless words were
added or left out in so many places that no two parts of it are that long.  Only texts that
hold b * t / (2 - t) of a template's bigrams at all are read a second time for windows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskforge.llm.common import sized_join, staged
from maskforge.llm.license_texts import WHOLE

THRESHOLD = 0.8
#: a window begins where at least one in so many of a template's bigrams agree
VOTE_SHARE = 8
#: template bigrams up to which they are broadcast
BROADCAST_BIGRAMS = 500_000
#: template bigrams up to which texts without any needed word are left out first; a text
#: left out cannot match, so the result does not depend on this
PREFILTER_BIGRAMS = 20_000

_BSD_OPENING = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.")
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _gnu_header(name: str, version: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as "
            f"published by the Free Software Foundation, {version}, or (at your option) any later version. This program "
            "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You "
            f"should have received a copy of the {name} along with this program. If not, see "
            "<https://www.gnu.org/licenses/>.")


# fixed values: short licence notices and texts in common use
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT notice": "Licensed under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MIT notice (released)": "Released under the MIT License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "ISC opening": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "BSD-2-Clause": _BSD_OPENING + " " + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_OPENING + " " + _BSD_THIRD + " " + _BSD_DISCLAIMER,
    "BSD-2-Clause opening": _BSD_OPENING,
    "GPL-2.0 header": _gnu_header("GNU General Public License", "either version 2 of the License"),
    "GPL-3.0 header": _gnu_header("GNU General Public License", "either version 3 of the License"),
    "LGPL-2.1 header": _gnu_header("GNU Lesser General Public License", "either version 2.1 of the License"),
    "LGPL-3.0 header": _gnu_header("GNU Lesser General Public License", "either version 3 of the License"),
    "AGPL-3.0 header": _gnu_header("GNU Affero General Public License", "either version 3 of the License"),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 notice (released)": "Released under the Apache License, Version 2.0.",
    "BSD notice": "Licensed under the BSD License.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "GPL-3.0 header opening": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
    "All rights reserved, no reproduction": "All rights reserved. No part of this text may be reproduced without permission.",
    **WHOLE,
}


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(TEMPLATES.items()), "license string, text string")


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _pairs(words: Column) -> Column:
    """Word bigrams in text order; none for fewer than two words."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def _bigrams(words: Column) -> Column:
    """Distinct word bigrams; none for fewer than two words."""
    return F.array_distinct(_pairs(words))


def template_bigrams(known: DataFrame) -> DataFrame:
    """``(license, words, b, bigram, q)``: distinct bigrams of each template with the place of
    the first word, their count, and the template's words.  Templates without a bigram never
    match; a repeated name keeps its first text."""
    known = known.groupBy("license").agg(F.min("text").alias("text"))
    rows = known.select("license", _words(F.coalesce("text", F.lit(""))).alias("w"))
    rows = rows.select("license", F.size("w").alias("words"), _pairs(F.col("w")).alias("pairs"))
    grams = rows.withColumn("g", F.array_distinct("pairs"))
    each = grams.select("license", "words", "pairs", F.size("g").alias("b"), F.explode("g").alias("bigram"))
    return each.select("license", "words", "b", "bigram",
                       (F.array_position("pairs", F.col("bigram")) - 1).cast("int").alias("q"))


def needed_words(bigrams: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every passage that matches some template holds at least one.

    A match shares at least ``b * threshold / (2 - threshold)`` of a template's ``b`` bigrams,
    so if fewer bigrams than that stand without a chosen word, the match has one with.
    Long words are chosen first, for they are rarer in prose.
    """
    chosen: set[str] = set()
    spread = Counter(w for grams in bigrams.values() for w in {x for g in grams for x in g.split(" ")})
    for name in sorted(bigrams):
        grams = [set(g.split(" ")) for g in bigrams[name]]
        least = math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        held = Counter(w for g in grams for w in g)
        words = sorted(held, key=lambda w: (len(w) < 5, -held[w] if len(w) > 4 else spread[w], w))
        free = [g for g in grams if not g & chosen]
        for word in words:
            if len(free) < least:
                break
            chosen.add(word)
            free = [g for g in free if word not in g]
    return sorted(chosen)


def word_pattern(words: list[str]) -> str:
    """Pattern of any of the words, tried by first letter at word starts only."""
    by = {w[0]: [x[1:] for x in words if x[0] == w[0]] for w in words}
    tails = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items()))
    return f"(?<![a-z0-9])(?:{tails})(?![a-z0-9])" if by else "(?!)"


def _windows(rows: DataFrame, asked: DataFrame, grams: DataFrame, low: float, high: float) -> DataFrame:
    """``(id, passage, a, license, b, common)`` of the windows of texts that hold enough bigrams
    of a template at all; ``asked`` names them as ``(id, license)``."""
    asked = asked.groupBy(F.struct("id").alias("key")).agg(F.collect_set("license").alias("asked"))
    # a row of the texts that are asked for has its number from here on
    held = rows.withColumn("key", F.struct("id")).join(asked, "key").select("id", "text", "asked")
    held = staged(held.select(F.monotonically_increasing_id().alias("row"), "id", _words(F.col("text")).alias("w"), "asked"),
                  "license-texts")
    each = held.select("row", "asked", F.posexplode(_pairs(F.col("w"))).alias("p", "bigram"))
    hits = sized_join(each, grams, "bigram", "inner", BROADCAST_BIGRAMS).where(F.array_contains("asked", F.col("license")))
    votes = hits.groupBy("row", "license", "b", "words", (F.col("p") - F.col("q")).alias("s")).agg(
        F.count(F.lit(1)).alias("n")).where(VOTE_SHARE * F.col("n") >= F.col("b"))
    at = votes.groupBy("row").agg(F.collect_list(F.struct("license", "words", "s")).alias("at"))
    begin = lambda x: F.greatest(x["s"], F.lit(0))
    cut = F.transform("at", lambda x: F.struct(x["license"].alias("license"), x["s"].alias("s"), _bigrams(
        F.slice("w", begin(x) + 1, x["s"] + x["words"] - begin(x))).alias("g")))
    each = held.join(at, "row").select("row", "id", F.explode(cut).alias("x")).select(
        "row", "id", "x.license", (-2 - F.col("x.s")).alias("passage"), F.size("x.g").alias("a"), F.explode("x.g").alias("bigram"))
    hit = sized_join(each, grams.select("license", "bigram", "b"), ["license", "bigram"], "inner", BROADCAST_BIGRAMS)
    hit = hit.where((F.col("a") >= low * F.col("b")) & (F.col("a") <= high * F.col("b")))
    return hit.groupBy("row", "id", "passage", "a", "license", "b").agg(F.count(F.lit(1)).alias("common")).drop("row")


def license_matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(id, passage, license, dice, common)`` of every match; passage -1 is the whole text,
    others from 0 are lines, and -2 - s is the window that begins at word s (before the text's
    first word where a licence lacks its beginning)."""
    grams = template_bigrams(known)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    # the templates' size bounds, as one row: the smallest and largest passage that can match
    bound = grams.agg(F.min("b").alias("least"), F.max("b").alias("most"), F.count(F.lit(1)).alias("size")).first()
    if bound["least"] is None:
        bound = {"least": 1 << 30, "most": 0, "size": 0}
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(F.col("text"), "\n")
    passages = F.concat(F.array(F.struct(F.lit(-1).alias("passage"), F.col("text").alias("text"))),
                        F.when(F.size(lines) > 1, F.transform(lines, lambda s, i: F.struct(
                            i.alias("passage"), s.alias("text"))))
                        .otherwise(F.array().cast("array<struct<passage:int,text:string>>")))
    texts = docs
    if bound["size"] <= PREFILTER_BIGRAMS:
        held = {r["license"]: r["g"] for r in grams.groupBy("license").agg(F.collect_list("bigram").alias("g")).collect()}
        texts = texts.where(F.lower(text).rlike(word_pattern(needed_words(held, threshold))))
    texts = texts.select(F.col(id_col).alias("id"), text.alias("text"))
    # rows that repeat an id are counted apart
    rows = texts.select("id", F.monotonically_increasing_id().alias("row"), F.explode(passages).alias("p"))
    # n words have at most n - 1 distinct bigrams, and the text has at least 2n - 1 characters
    rows = rows.where(F.length("p.text") >= 2 * low * bound["least"])
    rows = rows.select("id", "row", "p.passage", _words(F.col("p.text")).alias("w"))
    rows = rows.where(F.size("w") - 1 >= low * bound["least"]).select("id", "row", "passage", _bigrams(F.col("w")).alias("g"))
    whole = F.col("passage") == -1
    rows = rows.withColumn("a", F.size("g")).where((F.col("a") >= low * bound["least"])
                                                   & (whole | (F.col("a") <= high * bound["most"])))
    each = rows.select("id", "row", "passage", "a", F.explode("g").alias("bigram"))
    hit = sized_join(each, grams.drop("words", "q"), "bigram", "inner", BROADCAST_BIGRAMS)
    fits = (F.col("a") >= low * F.col("b")) & (F.col("a") <= high * F.col("b"))
    # a passage's own bigrams meet here: at most as many rows as the template has bigrams
    both = hit.where(whole | fits).groupBy("id", "row", "passage", "a", "license", "b").agg(
        F.count(F.lit(1)).alias("common"))
    # what shares fewer bigrams than these cannot match, nor can any part of it
    both = staged(both.where(F.col("common") >= low * F.col("b") - 1e-9).drop("row"), "license-shared")
    found = both.where(fits).unionByName(_windows(texts, both.where(whole).select("id", "license"), grams, low, high))
    dice = 2.0 * F.col("common") / (F.col("a") + F.col("b"))
    return found.select("id", "passage", "license", dice.alias("dice"), "common").where(F.col("dice") >= threshold)


def license_scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Best licence of every row: ``(<id_col>, license, dice, n_matches)``.

    Of the matches the one with the most common bigrams wins, so a whole licence goes before
    a notice that is part of it, then the highest Dice coefficient, then the name.  Rows
    without a match have null licence, null coefficient and 0 matches, so null and empty texts
    do; ``n_matches`` counts passages, and a notice on a line of its own is a line and a window;
    rows that repeat an id are one document and share its matches, equal ones counting once; a
    null id is an id; an empty table gives an empty result.
    """
    found = license_matches(docs, known, id_col, text_col, threshold)
    best = found.distinct().groupBy("id").agg(
        F.min_by(F.struct("license", "dice"), F.struct(-F.col("common"), -F.col("dice"), F.col("license"))).alias("m"),
        F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.col(id_col).alias("__id"))
    return rows.join(best, rows["__id"].eqNullSafe(best["id"]), "left").select(
        F.col("__id").alias(id_col), F.col("m.license").alias("license"), F.round("m.dice", 6).alias("dice"),
        F.coalesce("n", F.lit(0)).alias("n_matches"))


_SQL_WORDS = "string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')"
_SQL_BIGRAMS = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"


def oracle(threshold: float = THRESHOLD) -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
WITH templates(license, text) AS (VALUES {values}),
tw AS (SELECT license, {_SQL_WORDS.format("text")} AS w FROM templates),
tp AS (SELECT license, len(w) AS words, unnest(range(0, len(w) - 1)) AS q,
              unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM tw),
tb AS (SELECT license, words, bigram, min(q) AS q, count(*) OVER (PARTITION BY license) AS b
       FROM tp GROUP BY license, words, bigram),
lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, coalesce(text, '') AS text FROM documents),
parts AS (SELECT doc_id, unnest(range(0, len(ls))) AS passage, unnest(ls) AS t FROM lines WHERE len(ls) > 1
          UNION ALL SELECT doc_id, -1, text FROM lines),
pg AS (SELECT doc_id, passage, {_SQL_BIGRAMS} AS g
       FROM (SELECT doc_id, passage, {_SQL_WORDS.format("t")} AS w FROM parts)),
pb AS (SELECT doc_id, passage, len(g) AS a, unnest(g) AS bigram FROM pg),
shared AS (SELECT doc_id, passage, license, a, b, count(*) AS common FROM pb JOIN tb USING (bigram)
           GROUP BY doc_id, passage, license, a, b HAVING count(*) >= {low!r} * b - 1e-9),
dw AS (SELECT doc_id, {_SQL_WORDS.format("text")} AS w FROM lines),
dp AS (SELECT doc_id, unnest(range(0, len(w) - 1)) AS p,
              unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram
       FROM dw WHERE doc_id IN (SELECT doc_id FROM shared)),
votes AS (SELECT doc_id, license, words, p - q AS s FROM dp JOIN tb USING (bigram)
          JOIN (SELECT doc_id, license FROM shared WHERE passage = -1) USING (doc_id, license)
          GROUP BY doc_id, license, words, b, p - q HAVING {VOTE_SHARE} * count(*) >= b),
vg AS (SELECT doc_id, license, s, {_SQL_BIGRAMS} AS g
       FROM (SELECT doc_id, license, s, w[greatest(s, 0) + 1 : s + words] AS w FROM votes JOIN dw USING (doc_id))),
vb AS (SELECT doc_id, license, s, len(g) AS a, unnest(g) AS bigram FROM vg),
hits AS (SELECT doc_id, passage, license, a, b, common FROM shared
         UNION ALL SELECT doc_id, -2 - s, license, a, b, count(*) FROM vb JOIN tb USING (license, bigram)
         GROUP BY doc_id, s, license, a, b),
kept AS (SELECT DISTINCT doc_id, passage, license, common, 2.0 * common / (a + b) AS dice FROM hits
         WHERE a >= {low!r} * b AND a <= {high!r} * b AND 2.0 * common / (a + b) >= {threshold!r}),
ranked AS (SELECT doc_id, license, dice, count(*) OVER (PARTITION BY doc_id) AS n,
                  row_number() OVER (PARTITION BY doc_id ORDER BY common DESC, dice DESC, license) AS r FROM kept)
SELECT d.doc_id, r.license, round(CAST(r.dice AS DOUBLE), 6) AS dice, coalesce(r.n, 0) AS n_matches
FROM documents d LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r ON d.doc_id = r.doc_id
"""

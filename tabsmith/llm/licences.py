"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is normalised (case, punctuation, copyright notices, equivalent spellings), hashed as a whole and
looked up among the digests of known licence texts; so is each of its lines, for one-line notices.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, the first being replaced by the second.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"),
    ("authorised", "authorized"), ("favour", "favor"), ("judgement", "judgment"), ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"), ("http", "https"), ("noncommercial", "non commercial"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known licence texts and one-line notices.
KNOWN = (
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Whole licence texts beside this file, by their names.
TEXTS = Path(__file__).parent / "licence_texts"
#: Titles that a licence text may or may not carry.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "The ISC License (ISC)", "ISC License (ISC)", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License",
                     "BSD 2-Clause \"Simplified\" License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License",
                     "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the whole licences, with each title and, where they have one, without the appendix."""
    bodies = [("MIT", _MIT), ("ISC", _ISC)]
    bodies += [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    bsd = dict(bodies)["BSD-3-Clause"]
    bodies.append(("BSD-2-Clause", re.sub(r"(?s)3\. Neither.*?\n\n", "", bsd)))
    for old, new in (("the copyright holder nor", "the University nor"), ("the copyright holder nor", "the <organization> nor")):
        bodies.append(("BSD-3-Clause", bsd.replace(old, new)))
    for name, by in (("BSD-3-Clause", "THE REGENTS"), ("BSD-3-Clause", "THE AUTHOR"), ("BSD-2-Clause", "THE AUTHOR")):
        # the older wording, which names who disclaims
        body = next(t for n, t in reversed(bodies) if n == name).replace("the <organization> nor", "the University nor")
        bodies.append((name, body.replace("THE COPYRIGHT HOLDERS AND", f"{by} AND").replace("THE COPYRIGHT HOLDER OR", f"{by} OR")))
    bodies += [(n, re.sub(r"(?m)^\d\. ", "* ", t)) for n, t in bodies if n.startswith("BSD")]
    # public domain texts end in a pointer to their home page, which copies leave out
    bodies += [(n, re.sub(r"\n[^\n]*unlicense\.org[^\n]*", "", t)) for n, t in bodies if n == "Unlicense"]
    ends = r"(?s)(END OF TERMS AND CONDITIONS).*"
    bodies += [(n, short) for n, t in bodies for keep in (r"\1", "") if (short := re.sub(ends, keep, t)) != t]
    return bodies + [(n, f"{title}\n\n{t}") for n, t in bodies for title in TITLES.get(n, ())]


#: Where a notice ends that is not alone on its line: what licence texts go on with.
_OPENING = (
    r"\b(?:permission\s+(?:is\s+hereby|to\s+use)|redistribution\s+and\s+use|(?:re)?licen[sc]ed\s+under|released\s+under|distributed\s+under"
    r"|everyone\s+is\s+permitted|this\s+(?:program|library|software|file|work)\b|gnomovision\s+comes|spdx-license-identifier)"
)
_YEAR = r"(?:\(c\)|©|(?:19|20)\d\d\b|<year>|\[yyyy\])"
#: A notice up to the licence text behind it, on one line or wrapped, and one that has its line to itself: the
#: sign, a year or a name after the word. ``copyright holders`` and the like are words of the licence.
NOTICES = (
    rf"(?is)(?:\bcopyright[\s:]+{_YEAR}|©)(?:(?!\n[ \t]*\n[ \t]*\n).){{0,400}}?(?={_OPENING})",
    rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?i:copyright[ \t:]+(?:by[ \t]+)?{_YEAR}|©|\(c\)[ \t]*(?:19|20)\d\d\b|all rights reserved"
    r"|copyright[ \t:]+(?:by[ \t]+)?(?!(?:holders?|owners?|notices?|laws?|licen[sc]\w*|and|or|of|in|on|is|to|for|as|by|statements?|rights?|treaty|"
    r"interests?|infringements?|claims?|the\s+(?:software|library|program))\b)(?-i:\p{Lu}))"
    rf"[^\n]*?(?=$|(?i:{_OPENING}))",
)

#: Every notice holds one of these, in any case.
SIGNS = ("copyright", "©", "(c)", "all rights reserved")

#: Lines that the SQL of the query leaves out; as ``NOTICES`` on lines that hold only a notice.
COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$"


#: First words of the known texts that lines are looked up by; with more of them every line is normalised.
HEADS = 1000


def _signed(low: Column) -> Column:
    """Whether a text in lower case can hold a notice at all."""
    return reduce(Column.__or__, [F.contains(low, F.lit(s)) for s in SIGNS])


def _one_spelling(words: Column) -> Column:
    """Words parted by blanks, a blank at both ends, with equivalent spellings made one."""
    out = words
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(out)


def canonical(text: Column) -> Column:
    """Lower case, without copyright notices and punctuation, blanks and equivalent spellings made one."""
    out = text
    for notice in NOTICES:
        out = F.regexp_replace(out, F.lit(notice), F.lit(""))
    out = F.when(_signed(F.lower(text)), out).otherwise(text)
    return _one_spelling(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " ")), F.lit(" ")))


def head(text: Column) -> Column:
    """The first word of ``canonical(text)``; where there can be no notice only that word is normalised."""
    low = F.lower(text)
    word = _one_spelling(F.concat(F.lit(" "), F.regexp_extract(low, r"[\p{L}\p{N}]+", 0), F.lit(" ")))
    return F.substring_index(F.when(_signed(low), canonical(text)).otherwise(word), " ", 1)


def known_licences(spark: SparkSession, texts=None) -> DataFrame:
    """(licence, text) table of the built-in texts, whole ones and notices; callers add their own rows."""
    rows = [*KNOWN, *whole_texts()] if texts is None else list(texts)
    return spark.createDataFrame(rows, "licence string, text string")


def digests(known: DataFrame) -> DataFrame:
    """(digest, licence): the first name by order where several share a text; empty texts are ignored."""
    rows = known.where("licence IS NOT NULL AND text IS NOT NULL").select("licence", canonical(F.col("text")).alias("body"))
    return rows.where("body <> ''").groupBy(F.sha2("body", 256).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, digest, licence, notices, n_notice_lines) of every row of ``documents(doc_id, text, ...)``.

    ``licence`` names the known text that the whole text equals after normalising, ``notices`` the
    sorted names whose text equals one of its lines, ``n_notice_lines`` how many lines do. Null, empty
    and all-punctuation texts match nothing and have a null digest. Repeated rows give repeated results
    (their notice lines are those of one text); a null doc_id is passed on; other columns are ignored.
    Lines are normalised where their first word is that of a known text (up to ``HEADS`` such words).
    Known digests are joined by hash: Spark broadcasts them where they are few, else shuffles.
    """
    names = digests(known)
    firsts = known.where("licence IS NOT NULL").select(head(F.col("text")).alias("head")).where("head <> ''").distinct()
    heads = [r["head"] for r in firsts.limit(HEADS + 1).collect()]
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    whole = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), canonical(F.col("text")).alias("body")).select(
        "doc_id", "text_hash", F.when(F.col("body") != "", F.sha2("body", 256)).alias("digest")
    )
    lines = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    # a line that equals a known text begins with its first word
    lines = lines.where(head(F.col("line")).isin(heads) if len(heads) <= HEADS else F.lit(True))
    lines = lines.withColumn("body", canonical(F.col("line")))
    lines = lines if len(heads) <= HEADS else lines.where("body <> ''")
    hits = lines.select("doc_id", "text_hash", "at", F.sha2("body", 256).alias("digest")).join(names, "digest")
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set("licence")).alias("notices"), F.count_distinct("at").alias("n_notice_lines")
    ).toDF("_doc", "_hash", "notices", "n_notice_lines")
    out = whole.join(names, "digest", "left")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    return out.join(found, same, "left").select(
        "doc_id", "digest", "licence", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
        F.coalesce("n_notice_lines", F.lit(0)).alias("n_notice_lines"),
    )

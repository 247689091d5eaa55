"""License scans by canonical digest lookup (native).

A text is canonicalised (ASCII letters lower-cased, copyright lines and
the marks of list items dropped, punctuation and white space reduced to single spaces, equivalent spellings
made one) and its SHA-256 is joined to the digests of known licence texts. The
lines of a document that speak of a licence are looked up in the same way among
the digests of known one-line notices.

The known texts are constants of this module and the files of ``license_texts``
(a folder a licence, a file for each edition of its text), so the tables that
are broadcast have a fixed size. Texts that are not there, such as AGPL-3.0 and
the Creative Commons licences but CC0 and CC BY-SA, can be given as a table.

Defined results: a null text counts as empty, an empty canonical text matches
nothing; repeated rows are looked up each; a null doc_id is kept; an empty table
gives an empty table; very long texts are digested whole; of known texts with
one digest the licence of the least name counts; other columns are not read.
"""

from __future__ import annotations

from itertools import product
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Words with two usual spellings in licence texts, and the one kept here.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze",
    "artefact": "artifact", "artefacts": "artifacts", "authorisation": "authorization", "authorised": "authorized",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "customised": "customized", "defence": "defense",
    "emphasised": "emphasized", "favour": "favor", "fulfil": "fulfill", "fulfilment": "fulfillment", "honour": "honor",
    "initialise": "initialize", "judgement": "judgment", "labelled": "labeled", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "minimise": "minimize", "modelled": "modeled", "offence": "offense", "optimisation": "optimization",
    "organisation": "organization", "organisations": "organizations", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "recognised": "recognized", "signalling": "signaling", "sublicence": "sublicense", "utilise": "utilize",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}

# The texts of short licences, without their copyright lines.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

""" + _WARRANTY,
    "ISC": f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": f"BSD 2-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_WARRANTY}",
    "BSD-3-Clause": f"BSD 3-Clause License\n\n{_BSD_GRANT}\n\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """The Unlicense

This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the
public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication
to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and
to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be
included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in
the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES
OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
}
#: A licence's title line is often left out.
BARE = {name: text.split("\n\n", 1)[1] for name, text in TEXTS.items()}
#: Where the texts of long licences lie, and the line after which some say how to apply them, which is often left out.
LONG, TERMS_END = Path(__file__).with_name("license_texts"), "END OF TERMS AND CONDITIONS"

# Names under which notices speak of licences.
NAMES = {
    "MIT": ("MIT License",), "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GPLv2"), "LGPL-3.0-only": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3",), "MPL-2.0": ("Mozilla Public License, Version 2.0",),
    "BSD-3-Clause": ("BSD 3-Clause License",), "BSD-2-Clause": ("BSD 2-Clause License",), "ISC": ("ISC License",),
    "CC-BY-4.0": ("CC BY 4.0",), "CC-BY-SA-4.0": ("CC BY-SA 4.0",), "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC0-1.0": ("CC0 1.0",),
}
OPENINGS = ("Licensed under", "Released under a license:", "Released under", "This work is licensed under", "This software is licensed under", "Distributed under a license:")
#: Every known notice has the first and one of the others in its text, so other lines need no digest.
KEYWORDS = ("under", "licen", "released")
#: The SQL knows only those notices that have this in their text.
KEYWORD = "licen"

#: A copyright line begins with the sign, or with the word and has a year, the sign or a blank to fill in; "copyright notice" in running text has none.
_COPYRIGHT = r"(^|\n)[ \t]*(copyright[^\n]*(\(c\)|©|[12][0-9]{3}|[\[<{]|[ \t]by[ \t])|\(c\)|©)[^\n]*"
#: Marks of list items, all spelt alike: as nothing.
_MARKER = r"(^|\n)[ \t]*([*+•-]|\(?[0-9]{1,2}[.)]|\(?[a-z][.)])[ \t]+"
_PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ“”‘’–—•… ", "abcdefghijklmnopqrstuvwxyz         "


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def canonical(lower: Column) -> Column:
    """Canonical form of a text that ``lowered`` has been applied to."""
    plain = F.regexp_replace(F.regexp_replace(lower, _COPYRIGHT, "\n"), _MARKER, "\n")
    words = F.split(F.regexp_replace(plain, _PUNCTUATION, " "), " ")
    spell = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    return F.array_join(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.coalesce(F.try_element_at(spell, w), w)), " ")


def digest(lower: Column) -> Column:
    return F.sha2(canonical(lower).cast("binary"), 256)


def notices() -> dict[str, str]:
    """Known one-line notices and the licences they name."""
    return {f"{o} {a}{n}": i for o, a, (i, names) in product(OPENINGS, ("", "the "), NAMES.items()) for n in names}


def long_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the files of ``LONG``, whole and up to the end of the terms."""
    texts = [(f.parent.name, f.read_text(encoding="utf-8")) for f in sorted(LONG.glob("*/*.txt"))]
    return texts + [(i, t[: t.index(TERMS_END) + len(TERMS_END)]) for i, t in texts if TERMS_END in t]


def speaks(lower: Column) -> Column:
    """Whether a text that ``lowered`` has been applied to may hold a known notice."""
    first, *others = (F.contains(lower, F.lit(w)) for w in KEYWORDS)
    return first & (others[0] | others[1])


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(digest, license_id) of known texts; one licence per digest."""
    rows = spark.createDataFrame([(t, i) for i, t in texts], "text string, license_id string")
    return rows.select(digest(lowered(F.col("text"))).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scanned(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notices) of documents (doc_id, text). ``more``: further known texts (text, license_id)."""
    spark = docs.sparkSession
    whole = F.broadcast(known_digests(spark, [*TEXTS.items(), *BARE.items(), *long_texts()]))
    if more is not None:
        more = more.where("license_id is not null").select(digest(lowered(F.coalesce("text", F.lit("")))).alias("digest"), "license_id")
        whole = whole.unionByName(more.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256))).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    lines = {r["digest"]: r["license_id"] for r in known_digests(spark, [(i, t) for t, i in notices().items()]).collect()}  # constants
    of_line = F.create_map(*[F.lit(x) for pair in sorted(lines.items()) for x in pair])
    low = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("low"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(F.split("low", "\n"), speaks), lambda x: F.try_element_at(of_line, digest(x))), lambda x: x.isNotNull())))
    rows = low.select("doc_id", digest(F.col("low")).alias("digest"), F.when(speaks(F.col("low")), F.array_join(found, ",")).otherwise(F.lit("")).alias("notices"))
    return rows.join(whole, "digest", "left").select("doc_id", F.col("digest").alias("canonical_sha256"), "license_id", "notices")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """SQL for texts whose licences are short and whose notices hold ``KEYWORD``: it knows no others."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    spell = "MAP {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in SPELLINGS.items()) + "}"
    low = lambda x: f"translate({x}, {quote(_UPPER)}, {quote(_LOWER)})"
    words = lambda x: f"string_split(regexp_replace(regexp_replace(regexp_replace({x}, {quote(_COPYRIGHT)}, chr(10), 'g'), {quote(_MARKER)}, chr(10), 'g'), {quote(_PUNCTUATION)}, ' ', 'g'), ' ')"
    form = lambda x: f"sha256(coalesce(array_to_string(list_transform(list_filter({words(x)}, lambda w: w <> ''), lambda w: coalesce({spell}[w], w)), ' '), ''))"
    values = lambda rows: ", ".join(f"({quote(t)}, {quote(i)})" for t, i in rows)
    texts = [(t, i) for d in (TEXTS, BARE) for i, t in d.items()]
    known = [(t, i) for t, i in notices().items() if KEYWORD in t.lower()]
    return f"""
WITH known AS (SELECT {form(low('t'))} AS d, min(i) AS license_id FROM (VALUES {values(texts)}) k(t, i) GROUP BY 1),
lines AS (SELECT {form(low('t'))} AS d, min(i) AS license_id FROM (VALUES {values(known)}) k(t, i) GROUP BY 1),
docs AS (SELECT row_number() OVER () AS r, doc_id, {low("coalesce(text, '')")} AS l FROM documents),
spoken AS (SELECT r, unnest(string_split(l, chr(10))) AS x FROM docs),
found AS (
  SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT r, {form('x')} AS d FROM spoken WHERE contains(x, '{KEYWORD}')) s JOIN lines USING (d) GROUP BY r),
digests AS (SELECT r, doc_id, {form('l')} AS d FROM docs)
SELECT doc_id, digests.d AS canonical_sha256, license_id, coalesce(notices, '') AS notices
FROM digests LEFT JOIN known ON known.d = digests.d LEFT JOIN found ON found.r = digests.r
"""


OP3_SQL = _sql()

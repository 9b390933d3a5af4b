"""Operator 6 (native): license scan by canonical digest lookup.

A text is normalised (case, copyright lines, punctuation, equivalent spellings, white space), digested with SHA-256, and
hash-joined, entire, to the digests of known licence texts. All of it is Spark SQL expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that licence-matching guidelines hold to be equal, and the form that is kept.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Public licence texts in full, by SPDX identifier, with the titles that they are found under.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT_TERMS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TERMS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TERMS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"
TEXTS = [
    ("ISC", ("ISC License", "The ISC License"), [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_TERMS}"]),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD"), [f"{_ISC_GRANT}. {_ISC_TERMS}"]),
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), [f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_TERMS}"]),
    ("MIT-0", ("MIT No Attribution",), [f"{_MIT_GRANT}. {_MIT_TERMS}"]),
    ("BSD-1-Clause", ("BSD 1-Clause License",), [f"{_BSD_HEAD} {n}{_BSD_SOURCE} {_BSD_TERMS}" for n in ("", "1. ")]),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The 2-Clause BSD License"), [f"{_BSD_HEAD} {a}{_BSD_SOURCE} {b}{_BSD_BINARY} {_BSD_TERMS}" for a, b in (("", ""), ("1. ", "2. "))]),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The 3-Clause BSD License"), [f"{_BSD_HEAD} {a}{_BSD_SOURCE} {b}{_BSD_BINARY} {c}{_BSD_NAMES} {_BSD_TERMS}" for a, b, c in (("", "", ""), ("1. ", "2. ", "3. "))]),
    ("Zlib", ("zlib License", "The zlib/libpng License"), [_ZLIB]),
    ("Unlicense", ("The Unlicense",), [_UNLICENSE, _UNLICENSE.replace("https://unlicense.org", "http://unlicense.org/")]),
]
# One-line notices.
NOTICES = [
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-notice", "Licensed under the GNU General Public License v3.0."),
]
#: Every text with none and with each of its titles.
KNOWN = [(i, f"{title} {body}".strip()) for i, titles, bodies in TEXTS for body in bodies for title in ("", *titles)] + NOTICES

#: A line of up to 200 characters that states a copyright (a sign, a year or "by" behind the word), or that all rights are
#: reserved. Body text that merely wraps before "copyright notice" or "copyright holder" is none.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;%-]*((copyright[ \t]*)?(\(c\)|©)|copyright[ \t]+([0-9]|by[ \t])|all rights reserved)[^\n]{0,200}(\n|$)"
#: What is no letter, digit or byte of a longer character.
BREAKS = r"[^a-z0-9\x{0080}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """A text without differences of case (A-Z), copyright lines, punctuation, white space and spelling; null: empty."""
    t = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n")
    t = F.regexp_replace(F.replace(t, F.lit("\n"), F.lit("\n\n")), COPYRIGHT_LINE, "\n")  # lines are apart by two, so that each has its own
    t = F.concat(F.lit(" "), F.regexp_replace(t, BREAKS, " "), F.lit(" "))
    t = F.regexp_replace(t, " +", "  ")  # so that a word's spaces are its own
    for other, kept in SPELLINGS:
        t = F.replace(t, F.lit(f" {other.replace(' ', '  ')} "), F.lit(f" {kept.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, digest) of licence texts, one row a digest; of texts that are equal once normalised, the least id."""
    body = json.dumps([{"license_id": i, "text": t} for i, t in (KNOWN if texts is None else texts)])
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(body), "array<struct<license_id: string, text: string>>")))
    return rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license_id (null: none known) of every row of docs, which are not shuffled if known is small.

    A null text counts as empty; a text with nothing left has the digest of the empty string and no licence unless known
    says so. Null ids stay; repeated rows give repeated rows; ties between licences go to the least id; empty tables give
    no rows, or no licences; very long texts are read whole; other columns are not read. Spark broadcasts known only below its own size threshold."""
    own = docs.select("doc_id", F.sha2(canonical(F.col("text").cast("string")), 256).alias("digest"))
    return own.join(known.select("digest", "license_id"), "digest", "left").select("doc_id", "digest", "license_id")


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """canonical() in the SQL of DuckDB."""
    t = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10))"
    t = f"regexp_replace(replace({t}, chr(10), chr(10) || chr(10)), {sql_literal(COPYRIGHT_LINE)}, chr(10), 'g')"
    t = f"' ' || regexp_replace({t}, {sql_literal(BREAKS)}, ' ', 'g') || ' '"
    t = f"regexp_replace({t}, ' +', '  ', 'g')"
    for other, kept in SPELLINGS:
        t = f"replace({t}, {sql_literal(f' {other.replace(' ', '  ')} ')}, {sql_literal(f' {kept.replace(' ', '  ')} ')})"
    return f"trim(regexp_replace({t}, ' +', ' ', 'g'))"


def scan_sql() -> str:
    values = ", ".join(f"({sql_literal(i)}, {sql_literal(t)})" for i, t in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({canonical_sql('body')}) AS digest, min(spdx) AS license_id FROM (VALUES {values}) AS v(spdx, body) GROUP BY 1),
    own AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents)
    SELECT own.doc_id, own.digest, known.license_id FROM own LEFT JOIN known ON own.digest = known.digest"""

"""License scans: canonical digests of whole texts, and of lines, joined to those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .urlfilter import LOWER, UPPER

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_APACHE_HEADER = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
    "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
    "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
    "permissions and limitations under the License."
)
# Short public licence texts and notices by their usual identifiers.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
             + _ISC_AS_IS),
    ("Apache-2.0", _APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, Version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. ",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution. ",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. ",
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _bsd(conditions: int, numbered: bool) -> str:
    return _BSD_GRANT + "".join(f"{k}. {c}" if numbered else c for k, c in enumerate(_BSD_CONDITIONS[:conditions], 1)) + _BSD_AS_IS


# Whole texts beside those of the SQL's list; conditions by number or by mark.
WHOLE = (
    *(("BSD-2-Clause", _bsd(2, numbered)) for numbered in (True, False)),
    *(("BSD-3-Clause", _bsd(3, numbered)) for numbered in (True, False)),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
              "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
              "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
              "Software is furnished to do so. " + _AS_IS),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for "
             "any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
             "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
             "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
             "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
             "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
             "3. This notice may not be removed or altered from any source distribution."),
)
# Canonical digests of long public licences: of the whole text, and where terms end before an
# appendix on how to apply them, of the text up to "END OF TERMS AND CONDITIONS".
DIGESTS = (
    ("Apache-2.0", "93651fc3b3c9c21033cf07999bdb593e0138192678d4743ddf7ee126fefab052"),
    ("Apache-2.0", "09ad3868555dada25cbf24199409a8c1e39fe8ef08d164adc6e98c1d02767793"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3-only", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0-only", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354"),
    ("MPL-2.0", "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9"),
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
    "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
    "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    "under copyright law. "
)
_UNLICENSE_AS_IS = _AS_IS.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS")
WHOLE += tuple(("Unlicense", _UNLICENSE + _UNLICENSE_AS_IS + more) for more in ("", " For more information, please refer to <https://unlicense.org>", " For more information, please refer to <http://unlicense.org/>"))
# Spellings that licences use for each other.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("centre", "center"), ("favour", "favor"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("organisation", "organization"),
    ("recognised", "recognized"), ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"),
)
#: A line that names a holder: a wrapped sentence may also begin with the word alone.
COPYRIGHT_LINE = r"(^|\n)[\x20\x09>#*/;-]*(?:copyright[\x20\x09:]*(?:\(c\)|©|by\b|[0-9]{4})|\(c\)[\x20\x09]|©|all rights reserved)[^\n]*"
#: A line that is a licence's title alone, or names a holder without year or mark: upper case follows the word, as in no sentence.
HEAD_LINE = (
    r"(?m)^[\x20\x09>#*/;=-]*(?:(?i:(?:the[\x20])?(?:\(?(?:mit(?:-0|[\x20]no[\x20]attribution)?|expat|isc|zlib|0bsd|(?:bsd[\x20])?zero[-\x20]clause(?:[\x20]bsd)?"
    r"|free[\x20]public[\x20]license[\x20]1\.0\.0|(?:new[\x20]|modified[\x20]|revised[\x20]|simplified[\x20])?bsd(?:[-\x20][23](?:[-\x20]clause)?)?|[23]-clause[\x20]bsd)\)?[\x20]*)"
    r"(?:licen[sc]e)?[\x20]*(?:\([^()\n]{1,40}\))?)|Copyright[\x20\x09:]+[\p{Lu}<\[{][^\n]*)[\x20\x09\r:.*/=-]*$"
)
#: Runs of controls, space, ASCII punctuation and typographic marks.
MARKS = r"[\x00-/:-@\[-`{-\x7f\x{a0}\x{a9}\x{2010}-\x{201f}\x{2022}\x{2026}]+"
_VARIANT = r"\b(?:" + "|".join(v for v, _ in SPELLINGS) + r")\b"
_NOTICE = "licen|copyright|spdx|public domain"


def canonical(text: Column) -> Column:
    """The text in a form that equal licences share: A-Z lower-cased, copyright lines dropped, runs
    of marks and white space made one space, spellings unified, ends trimmed."""
    text = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    text = F.when(text.rlike("copyright|all rights reserved|©|\\(c\\)"), F.regexp_replace(text, COPYRIGHT_LINE, "$1")).otherwise(text)
    text = F.trim(F.regexp_replace(text, MARKS, " "))
    unified = text
    for variant, spelling in SPELLINGS:
        unified = F.regexp_replace(unified, rf"\b{variant}\b", spelling)
    return F.when(text.rlike(_VARIANT), unified).otherwise(text)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known=KNOWN + WHOLE, digests=DIGESTS) -> DataFrame:
    """license_id, known_digest of bounded lists of (id, text) and (id, digest); equal digests keep the first id by name."""
    pair = lambda i, x: F.struct(F.lit(i).alias("license_id"), x.alias("known_digest"))
    rows = F.array(*[pair(i, digest(F.lit(t))) for i, t in known], *[pair(i, F.lit(d)) for i, d in digests])
    return spark.range(1).select(F.inline(rows)).groupBy("known_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text; other columns are ignored): doc_id, digest (of the
    whole canonical text), license_id (of the known licence with that digest or, if there is none,
    with that of the text without HEAD_LINEs: titles and holders without year; or null), notices
    (ids of the known texts that a line of the text equals or, where the whole is no known licence, a block
    between blank lines; sorted, comma-joined; empty if none).

    Whole texts are normalised where they are read and only digests meet the known ones; that list
    is a constant of a few rows, so it is broadcast. A table given as known (license_id, known_digest) is
    joined as Spark sees fit. Null and empty texts, and texts of marks alone, have the digest of the empty
    text and match nothing. Lines and blocks are looked up only if they have a word that notices have.
    Rows that share an id are told apart by text; repeated rows have equal results, a row each. Texts of
    any length are read whole. Empty table: no rows.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_digests(spark)) if known is None else known
    known = known.where(F.col("known_digest") != F.sha2(F.lit("").cast("binary"), 256))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))
    bare = F.when(text.rlike(HEAD_LINE), digest(F.regexp_replace(text, HEAD_LINE, "")))
    rows = docs.select("doc_id", key.alias("key"), digest(text).alias("digest"), bare.alias("bare"))

    # a block of one line is that line; texts without a notice's word are not cut at all
    noted = docs.where(F.translate(text, UPPER, LOWER).rlike(_NOTICE))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("line"), x.alias("text"))
    lines, blocks = F.split(text, "\n"), F.filter(F.split(text, r"\n[\x20\t\r]*\n"), lambda x: x.contains("\n"))
    parts = F.filter(F.concat(F.transform(lines, named(True)), F.transform(blocks, named(False))), lambda x: F.translate(x["text"], UPPER, LOWER).rlike(_NOTICE))
    # the parts first, once a text; an outer explode, for an inner one makes the optimizer cut texts once more
    noted = noted.select("doc_id", key.alias("key"), parts.alias("parts")).select("doc_id", "key", F.explode_outer("parts").alias("part")).where("part IS NOT NULL")
    joined = lambda ids: F.array_join(F.array_sort(F.collect_set(ids)), ",")
    noted = (
        noted.select("doc_id", "key", "part.line", digest(F.col("part.text")).alias("known_digest"))
        .join(known, "known_digest")
        .groupBy("doc_id", "key")
        .agg(joined(F.when(F.col("line"), F.col("license_id"))).alias("of_lines"), joined("license_id").alias("of_all"))
    )
    same = F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.key") == F.col("n.key"))
    return (
        rows.alias("r")
        .join(known.alias("k"), F.col("r.digest") == F.col("k.known_digest"), "left")
        .join(known.alias("b"), F.col("r.bare") == F.col("b.known_digest"), "left")
        .join(noted.alias("n"), same, "left")
        .withColumn("id", F.coalesce("k.license_id", "b.license_id"))
        .select("r.doc_id", "r.digest", F.col("id").alias("license_id"), F.coalesce(F.when(F.col("id").isNull(), F.col("of_all")).otherwise(F.col("of_lines")), F.lit("")).alias("notices"))
    )


def _canonical_sql(x: str) -> str:
    text = f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"
    text = f"regexp_replace({text}, '{COPYRIGHT_LINE}', '\\1', 'g')"
    text = f"trim(regexp_replace({text}, '{MARKS}', ' ', 'g'))"
    for variant, spelling in SPELLINGS:
        text = f"regexp_replace({text}, '\\b{variant}\\b', '{spelling}', 'g')"
    return text


def _oracle() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    texts = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN + WHOLE)
    digests = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, d in DIGESTS)
    noted = lambda x: f"regexp_matches(translate({x}, '{UPPER}', '{LOWER}'), '{_NOTICE}')"
    return rf"""
        WITH every AS (
            SELECT id, sha256({_canonical_sql("t")}) AS d FROM (VALUES {texts}) AS v(id, t) UNION ALL SELECT id, d FROM (VALUES {digests}) AS v(id, d)),
        known AS (SELECT min(id) AS license_id, d AS known_digest FROM every WHERE d <> sha256('') GROUP BY d),
        documents_ AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS number FROM documents),
        hashed AS (
            SELECT number, doc_id, sha256({_canonical_sql("text")}) AS digest,
                   CASE WHEN regexp_matches(text, {quoted(HEAD_LINE)}) THEN sha256({_canonical_sql(f"regexp_replace(text, {quoted(HEAD_LINE)}, '', 'g')")}) END AS bare
            FROM documents_),
        whole AS (
            SELECT number, doc_id, digest, coalesce(k.license_id, b.license_id) AS license_id
            FROM hashed LEFT JOIN known k ON digest = k.known_digest LEFT JOIN known b ON bare = b.known_digest),
        parts AS (
            SELECT number, true AS line, unnest(string_split(text, chr(10))) AS part FROM documents_ WHERE {noted("text")} UNION ALL
            SELECT number, false, unnest(string_split_regex(text, '\n[\x20\t\r]*\n')) FROM documents_ WHERE {noted("text")}),
        notes AS (
            SELECT number, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS notices
            FROM (SELECT number, line, sha256({_canonical_sql("part")}) AS d FROM parts WHERE {noted("part")} AND (line OR contains(part, chr(10)))) p
            JOIN known k ON d = known_digest JOIN whole USING (number) WHERE line OR whole.license_id IS NULL GROUP BY number)
        SELECT doc_id, digest, license_id, coalesce(notices, '') AS notices FROM whole LEFT JOIN notes USING (number)"""


ORACLE_SQL = _oracle()

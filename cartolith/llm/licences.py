"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines and equivalent spellings do not count), and its
digest is joined with the digests of known licences. Whole documents are looked up, and each line of a document as a text of
its own, so that a notice inside other prose is found.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Public licence texts and notices, by SPDX identifier.
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
          '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
          "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
          "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or "
          "substantial portions of the Software.\n")
_AS_IS = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
          "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
          "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
          "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.\n")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
          "this software without specific prior written permission.\n")
_BSD_END = ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
            "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
            "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
            "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
            "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
            "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.\n")
_ISC_END = ('THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
            "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
            "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
            "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
KNOWN = (
    ("MIT", _GRANT + _AS_IS),
    ("MIT", "MIT License\n" + _GRANT + _AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", _ISC + _ISC_END),
    ("0BSD", _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "") + _ISC_END),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Proprietary", "All rights reserved."),
)
# Spellings that licence matching treats as equal.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"),
    ("centre", "center"), ("copyright holder", "copyright owner"), ("favour", "favor"), ("fulfil ", "fulfill "), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("non-commercial", "noncommercial"), ("organisation", "organization"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub-license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
_COPYRIGHT = r"(?im)^[^\S\n]*(?:copyright\b|\(c\)|©)[^\n]*$"
_SIGNS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words of letters and digits with single spaces."""
    kept = F.regexp_replace(text, _COPYRIGHT, "")
    plain = F.lower(kept)
    for one, other in SPELLINGS:
        plain = F.replace(plain, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(plain, _SIGNS, " "))


def canonical_text(text: str) -> str:
    """The same for one text on the driver."""
    plain = re.sub(_COPYRIGHT, "", text).lower()
    for one, other in SPELLINGS:
        plain = plain.replace(one, other)
    return re.sub(r"[^\w]+|_+", " ", plain).strip()


def catalogue(known: tuple[tuple[str, str], ...] = KNOWN) -> dict[str, str]:
    """Digest to licence."""
    return {hashlib.md5(canonical_text(text).encode()).hexdigest(): name for name, text in known}


def _digests(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(n).alias("license")) for d, n in sorted(known.items())])
    return spark.range(1).select(F.explode(rows).alias("k")).select("k.*")


def license_scan(docs: DataFrame, known: dict[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, digest, license, notices): licence of the whole text, if known, and the licences of its lines, sorted, by commas.

    * digest is the md5 of the canonical whole text; rows with equal id and digest give one row
    * null texts and texts without a letter or digit are the empty text, which is never a licence; null ids are kept
    * texts and lines of any length are compared whole; extra columns are ignored; an empty table gives an empty result
    """
    known = catalogue() if known is None else known
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    own = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text")).withColumn("digest", F.md5(canonical(F.col("text")).cast("binary")))
    lines = own.select("id", "digest", F.posexplode(F.concat(F.array("text"), F.split("text", "\n"))).alias("at", "unit"))
    keyed = lines.select("id", "digest", "at", F.when(F.col("at") == 0, F.col("digest")).otherwise(F.md5(canonical(F.col("unit")).cast("binary"))).alias("own"))
    table = _digests(docs.sparkSession, known or {"": ""})
    met = keyed.join(F.broadcast(table.withColumnRenamed("digest", "own")), "own", "left")  # as many rows as licences are known
    notices = F.array_join(F.array_sort(F.collect_set(F.when(F.col("at") > 0, F.col("license")))), ",")
    return met.groupBy("id", "digest").agg(F.max(F.when(F.col("at") == 0, F.col("license"))).alias("license"), notices.alias("notices"))


def op6_license_scans(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "digest", "license", "notices")


def _sql_canonical(text: str) -> str:
    plain = f"lower(regexp_replace({text}, '(?im)^[^\\S\\n]*(?:copyright\\b|\\(c\\)|©)[^\\n]*$', '', 'g'))"
    for one, other in SPELLINGS:
        plain = f"replace({plain}, '{one}', '{other}')"
    return f"trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


OP6_SQL = f"""
WITH known(own, license) AS (VALUES {", ".join(f"('{d}', '{n}')" for d, n in sorted(catalogue().items()))}),
w AS (SELECT doc_id, coalesce(text, '') AS text, md5({_sql_canonical("coalesce(text, '')")}) AS digest FROM documents),
l AS (SELECT doc_id, digest, unnest(string_split(text, chr(10))) AS line FROM w),
n AS (SELECT doc_id, digest, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
    FROM (SELECT doc_id, digest, md5({_sql_canonical("line")}) AS own FROM l) x JOIN known USING (own) GROUP BY doc_id, digest)
SELECT DISTINCT w.doc_id, w.digest, known.license, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN known ON w.digest = known.own LEFT JOIN n ON w.doc_id = n.doc_id AND w.digest = n.digest
"""

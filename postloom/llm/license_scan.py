"""License scans by canonical digest: whole texts are brought to one form, hashed, and hash-joined to known digests.

The form: lower case, copyright lines dropped, equivalent spellings made one, everything but letters and digits a space.
Notices are found the same way: each line that is not blank is hashed in its form and looked up among known notices.

Defined results: null, empty and unknown texts have a null license; repeated rows and null ids are looked up one by one;
other columns are not read. Known texts with one digest keep the first name by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import cut, sized_broadcast, table

#: Spellings that license matching holds to be equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized",
    "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center", "copyright holder": "copyright owner", "copyright holders": "copyright owners",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "non commercial": "noncommercial", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "per cent": "percent", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling", "sub license": "sublicense", "sub licence": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
#: Whole license texts of the public domain of license lists, by their short names.
TEXTS = {
    "0BSD": f"{_ISC_GRANT}.\n{_ISC_END}", "BSD-2-Clause": _BSD_HEAD + _BSD_END, "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_END, "ISC": f"{_ISC_GRANT}{_ISC_KEEP}.\n{_ISC_END}",
    "MIT": _MIT, "MIT License, headed": f"MIT License\n{_MIT}", "Unlicense": _UNLICENSE,
}
#: One-line notices, by name: Creative Commons in one wording, the others in four.
_TITLES = {"Apache-2.0": "the Apache License, Version 2.0", "GPL-2.0": "the GNU General Public License, version 2", "GPL-3.0": "the GNU General Public License, version 3", "MIT": "the MIT License"}
_VERBS = ("Licensed", "Released", "Distributed", "This work is licensed")
NOTICES = [(f"CC-{x}-4.0", f"Licensed under CC {x} 4.0.") for x in ("BY", "BY-NC", "BY-SA")] + [(name, f"{verb} under {title}.") for name, title in _TITLES.items() for verb in _VERBS]
_COPYRIGHT = "(?m)^[^\\n]{0,20}(copyright (\\(c\\)|[0-9]|by )|\\(c\\) ?[0-9]|all rights reserved)[^\\n]*$"
#: A whole line that begins, after comment marks, as a copyright line: the word or sign, then a sign, year or name.
_COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n\\x{0080}-\\x{10FFFF}(]*(\\(c\\)[^\\n]*[0-9]{4}|\\x{00A9}|copyright( *[(\\[<{\\x{00A9}]| *[0-9]| [^\\n]*[0-9]{4}| *:| by ))[^\\n]*$"


def canonical(text: Column) -> Column:
    """The form in which equal licenses are equal; null for null."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, ""), _COPYRIGHT, ""), "&", " and ")
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, "[^a-z0-9\\x{0080}-\\x{10FFFF}]+", " ")), F.lit(" "))
    for a, b in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """license_id and digest of named texts; in a list, a name may have several."""
    rows = spark.createDataFrame(sorted(texts.items() if isinstance(texts, dict) else texts), "license_id string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("license_id").alias("license_id"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)


def scan(docs: DataFrame, texts: DataFrame, notices: DataFrame, most_known: int = 1000) -> DataFrame:
    """doc_id, digest, license_id (of the whole text) and notices (sorted names of the known notices in its lines).

    texts and notices: license_id and digest. Whole texts are joined, and broadcast up to `most_known` rows. Up to as many
    notices become a map in the plan; more are joined by the digests of lines.
    """
    names = {r["digest"]: r["license_id"] for r in notices.limit(most_known + 1).collect()}
    docs = docs.select("doc_id", "text", F.when(F.length(F.trim("text")) > 0, digest(F.col("text"))).alias("digest"))
    if len(names) <= most_known:
        lookup = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]) if names else F.create_map().cast("map<string,string>")
        found = F.filter(F.transform(_lines(F.col("text")), lambda x: F.try_element_at(lookup, digest(x))), lambda x: x.isNotNull())
        out = docs.withColumn("found", found)
    else:
        key = F.xxhash64("text").alias("key")  # rows with equal texts have equal notices
        lines = docs.select(key, F.explode(F.array_distinct(F.transform(_lines(F.col("text")), digest))).alias("line")).distinct()
        found = lines.join(notices.select(F.col("digest").alias("line"), "license_id"), "line").groupBy("key").agg(F.collect_set("license_id").alias("found"))
        out = docs.withColumn("key", key).join(cut(found), "key", "left")
    out = out.select("doc_id", "digest", F.coalesce(F.array_join(F.array_sort(F.array_distinct("found")), ","), F.lit("")).alias("notices"))
    return out.join(sized_broadcast(texts, most_known), "digest", "left").select("doc_id", "digest", "license_id", "notices")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark, TEXTS), known_digests(spark, NOTICES))


def _sql(x: str) -> str:
    """canonical() in SQL."""
    x = f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '{_COPYRIGHT_LINE}', '', 'g'), '{_COPYRIGHT}', '', 'g'), '&', ' and ', 'g')"
    x = f"' ' || trim(regexp_replace({x}, '[^a-z0-9\\x{{0080}}-\\x{{10FFFF}}]+', ' ', 'g')) || ' '"
    for a, b in SPELLINGS.items():
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return f"trim({x})"


def _values(texts: list[tuple[str, str]]) -> str:
    return ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in texts)


ORACLE_SQL = {
    "op7_license_scan": f"""
WITH t AS (SELECT min(id) AS license_id, digest FROM (SELECT id, sha256({_sql("x")}) AS digest FROM (VALUES {_values([*TEXTS.items()])}) AS v(id, x)) GROUP BY digest),
n AS (SELECT min(id) AS name, digest FROM (SELECT id, sha256({_sql("x")}) AS digest FROM (VALUES {_values(NOTICES)}) AS v(id, x)) GROUP BY digest),
l AS (SELECT doc_id, {_sql("x")} AS form FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE len(trim(x)) > 0),
f AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM l JOIN n ON sha256(l.form) = n.digest GROUP BY 1),
d AS (SELECT doc_id, CASE WHEN len(trim(text)) > 0 THEN sha256({_sql("text")}) END AS digest FROM documents)
SELECT d.doc_id, d.digest, t.license_id, coalesce(f.names, '') AS notices FROM d LEFT JOIN t ON d.digest = t.digest LEFT JOIN f ON d.doc_id = f.doc_id"""
}
QUERIES = {"op7_license_scan": op7_license_scan}

"""Licence scans by lookup of canonical digests.

A text's canonical form: lower case; lines that state a copyright dropped; equivalent spellings made one; everything but
letters and digits as single spaces. Its SHA-256 is hash-joined to the digests of known licences. The same is done for each
line, which finds notices inside other text. The known digests come from a small table of texts (a parameter).
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licences use alike, each with the one that stands for it.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("judgement", "judgment"), ("https", "http"),
    ("sublicences", "sublicenses"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("organisations", "organizations"), ("authorise", "authorize"), ("authorisation", "authorization"), ("unauthorised", "unauthorized"), ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"),
    ("centre", "center"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("labour", "labor"), ("offence", "offense"), ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"))

#: Fixed values: (license_id, text) of short licences and notices.
SHORT = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
)

#: Titles that the text of a licence often stands under.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License", "New BSD License", "BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
#: Whole texts in licenses/, one file each.
WHOLE = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
TERMS_END = "END OF TERMS AND CONDITIONS"


def forms(license_id: str, body: str) -> list[tuple[str, str]]:
    """The texts that count as a licence: as it is, with a line for each paragraph, without numbers of clauses (BSD), up to the
    end of the terms, and each of these under a title, and after `All rights reserved.`; copyright lines are no part of any."""
    bodies = [body, body[: body.index(TERMS_END) + len(TERMS_END)]] if TERMS_END in body else [body]
    bodies += [re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", x) for x in bodies]
    bodies += [re.sub(r"(?m)^\d\. ", "", x) for x in bodies] if license_id.startswith("BSD") else []
    titles = TITLES.get(license_id, ())
    heads = ["", *(f"{t}\n" for t in titles), *(f"{t}\nAll rights reserved.\n" for t in ("", *titles) if titles)]
    return [(license_id, head + x) for x in dict.fromkeys(bodies) for head in heads]


#: (license_id, text): SHORT, then the forms of all whole licences.
KNOWN = SHORT + tuple(
    pair for license_id, body in (*SHORT[:2], *((w, files("tonemill.llm").joinpath("licenses", f"{w}.txt").read_text(encoding="utf-8")) for w in WHOLE)) for pair in forms(license_id, body) if pair not in SHORT
)


def canonical(text: Column) -> Column:
    """The canonical form; null as empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$", "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form, in lower-case hex."""
    return F.sha2(canonical(text).cast("binary"), 256)


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """known (a digest), license_id: one row per known text; of equal ones the first id by name."""
    rows = spark.createDataFrame(list(known), "license_id string, body string")
    return rows.select(digest(F.col("body")).alias("known"), "license_id").groupBy("known").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known=KNOWN, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_digest, text_license, line_licenses (names in order), n_license_lines: one row per row of docs.

    known: (license_id, text) pairs, a table of a fixed size that the caller states (at most some thousands). text_license:
    the licence that the entire text is, else null. Null and empty texts have the digest of nothing and no licence; repeated
    rows get the same; null ids are kept; extra columns are not read; an empty table gives an empty result.
    """
    table = known_digests(docs.sparkSession, known)
    names = {r["known"]: r["license_id"] for r in table.collect()}
    lookup = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    lines = F.filter(F.split(F.coalesce("body", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    hits = F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, digest(x))), lambda x: x.isNotNull())
    own = own.select("doc_id", digest(F.col("body")).alias("text_digest"), hits.alias("hits"))
    out = own.join(F.broadcast(table), F.col("text_digest") == F.col("known"), "left")
    return out.select("doc_id", "text_digest", F.col("license_id").alias("text_license"), F.array_sort(F.array_distinct("hits")).alias("line_licenses"), F.size("hits").cast("long").alias("n_license_lines"))


def canonical_sql(text: str) -> str:
    """DuckDB's expression of canonical()."""
    out = rf"regexp_replace(lower(coalesce({text}, '')), '(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', '', 'g')"
    out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' '"
    for one, other in SPELLINGS:
        out = f"replace({out}, ' {one} ', ' {other} ')"
    return f"trim({out})"


def oracle_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canonical_sql('body')}) AS known, min(license_id) AS license_id FROM (VALUES {quoted}) t(license_id, body) GROUP BY 1),
own AS (SELECT doc_id, text, sha256({canonical_sql('text')}) AS text_digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, list_sort(list(DISTINCT license_id)) AS line_licenses, count(*) AS n
  FROM lines JOIN known ON sha256({canonical_sql('line')}) = known WHERE trim(line) <> '' GROUP BY doc_id)
SELECT own.doc_id, text_digest, known.license_id AS text_license, coalesce(line_licenses, CAST([] AS VARCHAR[])) AS line_licenses,
       coalesce(n, 0) AS n_license_lines
FROM own LEFT JOIN known ON text_digest = known LEFT JOIN hits ON own.doc_id = hits.doc_id
"""

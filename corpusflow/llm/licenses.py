"""Licence scan by canonical digests.

A text's canonical form has lower case, no punctuation, no copyright notices, single spaces
and one spelling of equivalent words; its SHA-256 is looked up among the digests of known
licences. Whole texts and, for notices inside other texts, single lines are looked up.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from importlib.resources import files

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from corpusflow.llm.common import broadcast_bounded, stored, text_key

# fixed values: spellings that licence matching treats as equal
EQUIVALENT = {
    "licence": "license", "licenced": "licensed", "licences": "licenses", "acknowledgement": "acknowledgment",
    "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations",
    "catalogue": "catalog", "categorise": "categorize", "centre": "center", "emphasised": "emphasized",
    "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non commercial",
    "sublicence": "sublicense", "https": "http",
}

MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = ISC.replace("ISC License", "Zero-Clause BSD").replace(
    ", provided that the above copyright notice and this permission notice appear in all copies", "")

BSD_2 = """Copyright (c) <year> <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_3 = BSD_2.replace(
    "\n\nTHIS SOFTWARE",
    "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")

# short licence texts and one-line notices; ``known_texts`` adds the long ones
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT), ("MIT", MIT.split("\n\n", 1)[1]),
    ("ISC", ISC), ("ISC", ISC.split("\n\n", 1)[1]),
    ("0BSD", ZERO_BSD), ("0BSD", ZERO_BSD.split("\n\n", 1)[1]),
    ("BSD-2-Clause", BSD_2), ("BSD-3-Clause", BSD_3),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
]

# a copyright line is a notice: a year, a placeholder, a sign or a holder's name follows the word
_COPYRIGHT = re.compile(
    r"\s*(?:(?i:all\s+rights\s+reserved\b)"
    r"|(?:(?i:portions)\s+)?(?:(?i:copyright\W*(?:\(c\)|©|\d|<|\[|yyyy|year\b|by\b))|©|(?i:\(c\)\W*copyright)|\([cC]\).*\b(?:19|20)\d\d\b"
    r"|Copyright:?\s+(?!(?i:notice|holder|owner|licen[sc]e|law|act|statement|right|and)s?\b)(?:[Tt]he\s+)?[A-Z]))")
_END = re.compile(r"^[ ]*(?:END OF TERMS AND CONDITIONS|ADDENDUM: How to use)", re.M)
_WORD = re.compile(r"[^\W_]+")


def canonical(text: str | None) -> str:
    """The canonical form (empty if nothing but copyright lines and punctuation is there)."""
    text = text or ""
    low = text.lower()
    if "copyright" in low or "(c)" in low or "©" in low or "all rights reserved" in low:
        low = "\n".join(x for x in text.split("\n") if not _COPYRIGHT.match(x)).lower()
    return " ".join([EQUIVALENT.get(w, w) for w in _WORD.findall(low)])


def digest(text: str | None) -> bytes | None:
    form = canonical(text)
    return hashlib.sha256(form.encode("utf-8", "surrogatepass")).digest() if form else None


@lru_cache
def known_texts() -> list[tuple[str, str]]:
    """``KNOWN`` and the full texts in ``license_texts``, each with and without its title and the
    instructions after its terms, and their SPDX lines."""
    out = list(KNOWN)
    for file in sorted(files("corpusflow.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        name, text = file.name.removesuffix(".txt"), file.read_text("utf-8").strip("\n")
        forms = [text]
        if end := _END.search(text):
            forms += [text[:end.start()], text[:text.index("\n", end.start())]]
        out += [(name, x) for form in forms for x in (form, form.split("\n\n", 1)[1])]
        out += [(name, f"SPDX-License-Identifier: {name}{x}") for x in ("", "-only", "-or-later", "+")]
    return out


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the known texts; of two ids with one form the smaller stays."""
    if known is None or isinstance(known, list):
        known = spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")
    udf = F.pandas_udf(lambda s: s.map(digest), "binary")
    return known.select(udf("text").alias("digest"), "license_id").filter("digest is not null").groupBy("digest").agg(
        F.min("license_id").alias("license_id"))


@F.pandas_udf(ArrayType(BinaryType()))
def _digests(texts: pd.Series) -> pd.Series:
    """The whole text's digest, then the distinct digests of its lines that have one."""

    def one(t: str | None) -> list[bytes | None]:
        lines = t.split("\n") if t else []
        found = {d for x in set(lines) if (d := digest(x))}
        return [digest(t), *sorted(found)]

    return texts.map(one)


def scan(docs: DataFrame, known: DataFrame | list[tuple[str, str]] | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per input row: id, license_id (the whole text is that licence, else null),
    notices (sorted ids of licences whose text is one whole line).

    Null, empty and copyright-only texts have no digest and match nothing. Rows that repeat
    each get their row; extra columns are not read. Only digests take part in the join; the
    known side is a parameter, broadcast up to ``BROADCAST_ROWS`` rows and shuffled beyond.
    """
    digests = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), _digests(F.col(text_col)).alias("ds"))
    rows = digests.select("id", "tk", F.posexplode("ds").alias("pos", "digest"))
    ids = broadcast_bounded(stored(known_digests(docs.sparkSession, known), 1))
    hits = rows.join(ids, "digest", "left").filter("pos = 0 or license_id is not null")
    per = hits.groupBy("id", "tk").agg(
        F.max(F.when(F.col("pos") == 0, F.col("license_id"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(F.col("pos") > 0, F.col("license_id")))).alias("notices"),
        F.sum((F.col("pos") == 0).cast("long")).alias("copies"))
    return per.select(F.col("id").alias(id_col), "license_id", "notices",
                      F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")

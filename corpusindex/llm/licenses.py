"""Licence scan: the digest of a canonical form of each whole text, looked up among those of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and standard notices, by short name.
KNOWN_TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a
source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "notice:MIT": "Released under the MIT License.",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}
# Spellings that count as equal, left as right.
EQUAL_SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "organisation": "organization",
    "favour": "favor",
    "behaviour": "behavior",
    "acknowledgement": "acknowledgment",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "merchantibility": "merchantability",
    "noninfringement": "non infringement",
    "owner": "holder",
    "owners": "holders",
    "per cent": "percent",
    "whilst": "while",
    "https": "http",
}
COPYRIGHT_LINES = r"(?m)^[^\p{L}\p{N}\n]*(copyright[^\p{L}\p{N}\n]*(\(c\)|©|[0-9]|by )|\(c\) |©)[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
#: Numbers, letters and bullets before the items of a list.
LIST_MARKS = r"(?m)^[ \t]*(\(?[0-9][0-9]?[.)]|\(?[a-z][.)]|[*•-])[ \t]+"
# The titles that may stand before a licence's text, in canonical form.
TITLES = (
    "mit license mit", "mit license", "expat license", "mit expat license", "isc license", "isc license isc", "bsd zero clause license", "zero clause bsd license",
    "bsd 2 clause license", "bsd 2 clause simplified license", "simplified bsd license", "bsd 3 clause license", "bsd 3 clause new or revised license",
    "new bsd license", "modified bsd license", "zlib license", "boost software license version 1 0 august 17th 2003", "boost software license version 1 0",
    "unlicense", "apache license version 2 0 january 2004 http www apache org licenses", "gnu general public license", "gnu lesser general public license",
    "gnu library general public license", "mozilla public license version 2 0", "mozilla public license version 1 1", "creative commons legal code cc0 1 0 universal",
    "cc0 1 0 universal", "artistic license", "gnu free documentation license",
)
TITLE = f"^(the )?({'|'.join(sorted(TITLES, key=len, reverse=True))})( |$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Digests of the canonical form of the published texts of longer licences; where a text ends with notes on how
# to apply it, two more digests are those of the terms alone, with and without their closing line.
KNOWN_DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "552e7ab2ee485f2313915f4f97a5f0d1cdf82c625afef09cb27f34f15d5176b1",
        "7859bf082ddeb1583b60fc839d33ded1760c164ce376dc4f07626983f1ff77c1",
        "c1e5e8dbf874a5ed203b127191f443b7a7e0dede573774a52fd0255af4399dff",
    ),
    "Artistic-1.0-Perl": (
        "538e2e59281ba267abc1d1844748259521b4d2f0e90e9cca0ee2b8a86ffbe6fa",
    ),
    "CC0-1.0": (
        "7bafc0f757e1fa0e5d610d8ea72097b867b9c6e5de9c725b49123b32271c744f",
    ),
    "GFDL-1.2": (
        "8c5ad7c8aabb9db6e0c8b0f17a42302bd4f1ae1e177fb7d07be8a39b24692ecb",
    ),
    "GFDL-1.3": (
        "4535febd1992d48cf58c30b98b1b8276270248059dbb9686530fda1a11c5a4e8",
    ),
    "GPL-1.0": (
        "ccb759ed9f97b19013bbb75be2c230355e8b3993d435c1885559ea0b715b8cca",
        "b20b3400deed704ae0c50c928e65696fde43e7241653a85a10b68d5738ecc9dc",
        "56e7ac4f77f5a6fd00564e33cd7fb62a8c7208e1b5c7da3f200f9258df1337a6",
    ),
    "GPL-2.0": (
        "5ef1f5f0461a54997a170af5c87102900e651106207b80558de731fd1db30832",
        "aa280a5f4d3c1d5204ecef8bb48e74c0b275c98788f5596001a0801dff4f5042",
        "82622ece9274df820a4bf2660799088e526913044650336e5d85bb78500da8f8",
    ),
    "GPL-3.0": (
        "e625dabe077d0db98f64e03d412721706f2820142716a54a88c302e2f67ca53f",
        "9cc451110eb36d5a5309a55664c88e014da02bb21360c77e6e32c6ada8511d9b",
        "bb78866f03c739fdcbb3ac192baffacca54ae9c880efb663694b151739f8e746",
    ),
    "LGPL-2.0": (
        "ffd8730789ab0fc5853425d608bf29d213379ce803c8549814e85648681ef32a",
        "4658bdd6101102dff355dc896f8841f55e13624d29a7603a0910a945995144ad",
        "347b0741d4d1d9edfb3ccaa592aed77e26de0fb444222e92bf5998127677fc66",
    ),
    "LGPL-2.1": (
        "0af47c8da0e16365147be761910b2af02249ed8ea2f5dbed0a027d6f7639058a",
        "affa875b69d174bd7ff301ad69b35855f32944fe11c4350456f5a8d655d22e4a",
        "d0eb3b85d5950e57dcf723d810a4192fd293190f12de6ccbfaae7acc8c10bdd6",
    ),
    "LGPL-3.0": (
        "26aeb5d3e16e4dee74aba841e3bb744f36eef8e902c291b36439a8a02441cb95",
    ),
    "MPL-1.1": (
        "94cbca6428a7ed6e10d84d9cfeb8b46333459a913e5afa7a363e6e7ed45b2797",
    ),
    "MPL-2.0": (
        "d7fbfc052cff80cd4b7fac1ee2676014505cdeda5c49ea518929672857f61fcd",
    ),
}


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, list marks or title, words parted by single spaces and equal spellings made one."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT_LINES, "")
    out = F.regexp_replace(out, LIST_MARKS, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in EQUAL_SPELLINGS.items():
        old, new = (w.replace(" ", "  ") for w in (old, new))
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.regexp_replace(F.trim(F.regexp_replace(out, " +", " ")), TITLE, "")


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(license_id, digest) of known licences: of `texts` by name, else of KNOWN_TEXTS and KNOWN_DIGESTS, and of the table
    `known` (license_id, text) where given. Of texts that become equal the first name by code point stays."""
    rows = spark.createDataFrame(sorted((KNOWN_TEXTS if texts is None else texts).items()), "license_id string, text string")
    if known is not None:
        rows = rows.unionByName(known.select(F.col("license_id").cast("string"), F.col("text").cast("string")))
    named = rows.where(F.length(canonical(F.col("text"))) > 0).select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if texts is None:
        longer = [(name, digest) for name, digests in sorted(KNOWN_DIGESTS.items()) for digest in digests]
        named = named.unionByName(spark.createDataFrame(longer, "license_id string, digest string"))
    return named.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(
    docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None
) -> DataFrame:
    """One row per row of `docs`: the id, `digest` of the canonical whole text and `license_id`, null if none is known.

    A text without a word (null, empty, punctuation or only copyright lines) has a null digest and no licence. A null id
    stays null; repeated rows each give a row; other columns are not read. `texts` or the table `known` (license_id, text)
    name other licences. The fixed list of digests, some 40 of them, is sent to every task; with a table of unknown size
    Spark chooses the join. Texts are never shuffled.
    """
    form = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("form"))
    digests = form.select("id", F.when(F.length("form") > 0, F.sha2("form", 256)).alias("digest"))
    listed = known_digests(docs.sparkSession, texts, known)
    return digests.join(F.broadcast(listed) if known is None else listed, "digest", "left").select(F.col("id").alias(id_col), "digest", "license_id")


def license_sql() -> str:
    """DuckDB SQL for scan_licenses over `documents`."""

    def form(column: str) -> str:
        out = f"regexp_replace(translate({column}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINES}', '', 'g')"
        out = f"regexp_replace({out}, '{LIST_MARKS}', '', 'g')"
        out = rf"' ' || regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g') || ' '"
        for old, new in EQUAL_SPELLINGS.items():
            old, new = (w.replace(" ", "  ") for w in (old, new))
            out = f"replace({out}, ' {old} ', ' {new} ')"
        return f"regexp_replace(trim(regexp_replace({out}, ' +', ' ', 'g')), '{TITLE}', '')"

    longer = ", ".join(f"('{name}', '{digest}')" for name, digests in sorted(KNOWN_DIGESTS.items()) for digest in digests)
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN_TEXTS.items()))
    return f"""
    WITH texts(license_id, t) AS (VALUES {values}),
    longer(license_id, digest) AS (VALUES {longer}),
    known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256({form("t")}) AS digest, license_id FROM texts UNION ALL SELECT digest, license_id FROM longer) GROUP BY 1),
    forms AS (SELECT doc_id, {form("text")} AS form FROM documents),
    digests AS (SELECT doc_id, CASE WHEN length(form) > 0 THEN sha256(form) END AS digest FROM forms)
    SELECT d.doc_id, d.digest, k.license_id FROM digests d LEFT JOIN known k ON d.digest = k.digest
    """

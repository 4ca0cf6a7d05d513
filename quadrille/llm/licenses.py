"""Licence scans: canonical digests of whole texts joined to the digests of known licences.

Built from DataFrame functions only. A text is canonicalised (copyright lines go, case and
punctuation are normalised, equivalent spellings become one), digested, and looked up.
The known digests are a fixed list of this module, so their side of the join is bounded
and no row of the corpus is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and licence texts that are looked up whole.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
}
# Lines that usually stand above these texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "(The MIT License)", "MIT/Expat License", "Expat License", "License: MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC", "License: ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License", "The Zero-Clause BSD License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License", "BSD License", "The BSD License", "(The BSD License)"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "The BSD License", "(The BSD License)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Other usual wordings of one text, each replaced by itself or by another.
WORDINGS = {
    "MIT": (("this permission notice shall", "this permission notice (including the next paragraph) shall"),),
    "ISC": (("modify, and/or distribute", "modify, and distribute"), ("modify, and/or distribute", "modify and distribute")),
    "0BSD": (("modify, and/or distribute", "modify, and distribute"),),
    "Unlicense": (("unlicense.org/", "unlicense.org"), ("https://unlicense.org/", "http://unlicense.org/")),
}
#: How items of a list are marked; marks that are no letters or digits do not count.
LISTS = ("123", ("", "", ""), "abc", ("i", "ii", "iii"))


def variants(license: str) -> list[str]:
    """The known text with its usual titles, list marks and wordings, itself included."""
    body = KNOWN[license]
    bodies = [body, *(body.replace(old, new) for old, new in WORDINGS.get(license, ()))]
    marked = [re.sub(r"(?m)^([123])\. ", lambda m: f"{marks[int(m[1]) - 1]} ", b) for b in bodies for marks in LISTS]
    return [f"{title}\n\n{b}" for b in dict.fromkeys([*bodies, *marked]) for title in ("", *TITLES.get(license, ()))]


# SHA-256 of the canonical forms of full licence texts, with and without what follows their
# terms, with http and https links. Taken from the texts that Debian ships in /usr/share/common-licenses.
FULL_TEXTS = {
    "Apache-2.0": (
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809",
        "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
        "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93",
        "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25",
    ),
    "Artistic-1.0-Perl": (
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ),
    "CC0-1.0": (
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ),
    "GFDL-1.2": (
        "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
        "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    ),
    "GFDL-1.3": (
        "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
        "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    ),
    "GPL-1.0": (
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ),
    "GPL-2.0": (
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ),
    "GPL-3.0": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.0": (
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    ),
    "LGPL-2.1": (
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6",
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
    ),
}
# Spellings that licence matching treats as equal, applied in this order.
EQUIVALENT = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("authorise", "authorize"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("wilful", "willful"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
)
#: Lines that claim copyright: marks before the word do not matter, but a year, (c) or "by" must follow it.
COPYRIGHT_LINE = r"(?im)^[^\p{L}\p{N}\n]*((copyright[ \t]*(\([c]\)|©|:|by\b|[0-9]{4}))|\([c]\)[ \t]*(copyright|[0-9]{4})|©|all rights reserved)[^\n]*$"
MARKS = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null for null, empty for one without letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "")), MARKS, " "))
    for old, new in EQUIVALENT:
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return plain


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(digest, license) of the known texts, through the same canonical form; by default with variants and full texts."""
    listed = [(k, v) for k in KNOWN for v in variants(k)] if known is None else list(known.items())
    texts = spark.createDataFrame(listed, "license string, body string")
    digests = texts.select(F.sha2(canonical(F.col("body")), 256).alias("digest"), "license")
    if known is None:
        digests = digests.unionByName(spark.createDataFrame([(d, k) for k, v in FULL_TEXTS.items() for d in v], "digest string, license string"))
    return digests.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """(id, digest, license) of every row; license is null where the whole text is not a known one.

    A null text has a null digest. Empty texts and texts of marks alone have the digest of
    the empty string, which no licence has. Null and repeated ids and repeated rows pass
    through; other columns are not read; an empty table gives an empty result.
    """
    digests = F.broadcast(known_digests(df.sparkSession, known))
    rows = df.select(F.col(id_col), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return rows.join(digests, "digest", "left").select(id_col, "digest", "license")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    plain = f"trim(regexp_replace(lower(regexp_replace({text}, {_sql_text(COPYRIGHT_LINE)}, '', 'g')), {_sql_text(MARKS)}, ' ', 'g'))"
    for old, new in EQUIVALENT:
        plain = f"replace({plain}, {_sql_text(old)}, {_sql_text(new)})"
    return plain


#: Texts that license_hits deals to the documents in turn; the last is nobody's.
DEALT = [*KNOWN.values(), "Not a licence at all."]
#: How license_hits dresses them, in turn.
DRESSES = 4


def license_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan over one known text for each document, as it is, in capitals, under a copyright line, and with other marks; every seventh goes on after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    k = F.col("doc_id")
    body = F.element_at(F.array(*[F.lit(t) for t in DEALT]), (F.pmod(k, F.lit(len(DEALT))) + 1).cast("int"))
    turn = F.pmod(F.floor(k / len(DEALT)), F.lit(DRESSES))
    claim = F.concat(F.lit("Copyright (c) "), (F.pmod(k, F.lit(30)) + 1990).cast("string"), F.lit(" Some Body\n\n"), body)
    dressed = F.when(turn == 0, body).when(turn == 1, F.upper(body)).when(turn == 2, claim).otherwise(F.replace(F.replace(body, F.lit("."), F.lit(" ;\n")), F.lit(","), F.lit(" -")))
    return scan_licenses(docs.select("doc_id", F.concat(dressed, F.when(k % 7 == 0, F.lit(" and more")).otherwise("")).alias("text")))


QUERIES = {"license_hits": license_hits}


def _hits_sql() -> str:
    n, claim = len(DEALT), "'Copyright (c) ' || (doc_id % 30 + 1990)::varchar || ' Some Body' || chr(10) || chr(10) || body"
    marks = "replace(replace(body, '.', ' ;' || chr(10)), ',', ' -')"
    return f"""
with known(license, body) as (values {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in KNOWN.items())}),
digests as (select sha256({_sql_canonical("body")}) as digest, min(license) as license from known group by 1),
dealt as (select doc_id, list_extract([{", ".join(map(_sql_text, DEALT))}], (doc_id % {n} + 1)::int) as body, (doc_id // {n}) % {DRESSES} as turn from documents),
dressed as (select doc_id, (case turn when 0 then body when 1 then upper(body) when 2 then {claim} else {marks} end) || (case when doc_id % 7 = 0 then ' and more' else '' end) as text from dealt),
docs as (select doc_id, sha256({_sql_canonical("text")}) as digest from dressed)
select docs.doc_id, docs.digest, digests.license from docs left join digests on docs.digest = digests.digest"""


ORACLES = {
    "op3_license_scan": f"""
with known(license, body) as (values {", ".join(f"({_sql_text(k)}, {_sql_text(v)})" for k, v in KNOWN.items())}),
digests as (select sha256({_sql_canonical("body")}) as digest, min(license) as license from known group by 1),
docs as (select doc_id, sha256({_sql_canonical("text")}) as digest from documents)
select docs.doc_id, docs.digest, digests.license from docs left join digests on docs.digest = digests.digest""",
    "license_hits": _hits_sql(),
}

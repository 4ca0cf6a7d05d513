import pathlib
import re

from quadrille.llm.licenses import FULL_TEXTS, KNOWN, scan_licenses

SHIPPED = pathlib.Path("/usr/share/common-licenses")


def test_whole_texts_after_normalisation(spark):
    mit = KNOWN["MIT"]
    rows = [
        (0, None),
        (1, ""),
        (2, "--- !!! ..."),
        (3, "Copyright (c) 2020 Someone\n\n" + mit.upper()),
        (4, "/* © 1999 by Ünal\n * All Rights Reserved.\n */\n" + mit.replace("sublicense", "sub-license").replace(" ", "\n * ")),
        (5, "prefix " + mit),
        (6, "Licenced Under the Apache licence; version 2.0"),
        (7, KNOWN["BSD-3-Clause"]),
        (7, KNOWN["BSD-3-Clause"]),
        (None, KNOWN["ISC"]),
        (8, "word " * 200000),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, license string, digest string")
    got = sorted(((r.doc_id, r.license) for r in scan_licenses(df).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert got == [(0, None), (1, None), (2, None), (3, "MIT"), (4, "MIT"), (5, None), (6, "Apache-2.0 notice"), (7, "BSD-3-Clause"), (7, "BSD-3-Clause"), (8, None), (None, "ISC")]
    assert scan_licenses(df.limit(0)).count() == 0


def test_titles_lists_and_full_texts(spark):
    claim = "\n\nCopyright (c) 2021 Someone\n\n"
    bullets = re.sub(r"(?m)^[123]\\. ", "* ", KNOWN["BSD-3-Clause"])
    rows = [
        ("MIT License" + claim + KNOWN["MIT"], "MIT"),
        ("The MIT License (MIT)" + claim + KNOWN["MIT"], "MIT"),
        ("BSD 3-Clause License" + claim + KNOWN["BSD-3-Clause"], "BSD-3-Clause"),
        ("BSD 3-Clause License" + claim + bullets, "BSD-3-Clause"),
        ("ISC License" + claim + KNOWN["ISC"].replace("and/or", "and"), "ISC"),
        ("Some License" + claim + KNOWN["MIT"], None),
        ("MIT License" + claim + KNOWN["ISC"], None),
    ]
    rows += [((SHIPPED / f).read_text(), k) for f, k in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")) if (SHIPPED / f).exists()]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan_licenses(df).collect()}
    assert [got[i] for i in range(len(rows))] == [k for _, k in rows]
    digests = [d for v in FULL_TEXTS.values() for d in v]
    assert len(digests) == len(set(digests)) and all(re.fullmatch("[0-9a-f]{64}", d) for d in digests)

from syncohort.llm import licenses


def test_canonical_forms(odd_docs, spark):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, None), (2, ""), (3, notice), (3, notice), (4, "  licenced UNDER the  Apache-licence version 2 0\n"),
        (5, "Copyright 2020 Someone\n" + notice + "\n(c) all mine"), (6, "Text.\n" + notice + "\nReleased under the MIT License."),
        (None, notice), (7, "Copyright by me"), (8, "Licensed under the Apache License, Version 2.0 or later."), (9, "!!!"),
        (10, "Copyright (c) 2001 X\n\n" + licenses.KNOWN["MIT-text"].replace("\n", " ").upper()), (11, notice + "é"),
        (12, "x " * 100000),
    ]
    got = licenses.license_scan(odd_docs(rows)).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id, r.license_id, r.notices, r.n_notices) for r in got}
    assert found == {
        (1, None, "", 0), (2, None, "", 0), (3, "Apache-2.0", "Apache-2.0", 1), (4, "Apache-2.0", "Apache-2.0", 1),
        (5, "Apache-2.0", "Apache-2.0", 1), (6, None, "Apache-2.0,MIT", 2), (None, "Apache-2.0", "Apache-2.0", 1),
        (7, None, "", 0), (8, None, "", 0), (9, None, "", 0), (10, "MIT-text", "MIT-text", 1), (11, None, "", 0), (12, None, "", 0),
    }
    by_id = {r.doc_id: r.digest for r in got}
    assert by_id[1] is None and by_id[7] is None and by_id[9] is None
    assert by_id[3] == by_id[4] == by_id[5] == by_id[None]


def test_empty(odd_docs, spark):
    assert licenses.license_scan(odd_docs([])).collect() == []
    none = spark.createDataFrame([], "license_id string, text string")
    got = licenses.license_scan(odd_docs([(1, "Released under the MIT License.")]), none).first()
    assert got.license_id is None and got.n_notices == 0


def test_spellings_side_by_side(odd_docs, spark):
    known = spark.createDataFrame(
        [("a", "licence licence whilst licence"), ("b", "license license while license"), ("c", None)],
        "license_id string, text string",
    )
    got = licenses.license_scan(odd_docs([(1, "License LICENCE: while licence")]), known).first()
    assert got.license_id == "a"


def test_standard_files(odd_docs):
    """Whole files with and without title, in comments; notices wrapped inside a longer file."""
    body = licenses.KNOWN["MIT-text"]
    standard = [k for k in licenses.KNOWN if k.endswith("-text")]
    assert {"Apache-2.0-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "GPL-3.0-text", "LGPL-2.1-text",
            "MPL-2.0-text", "Unlicense-text", "CC0-1.0-text"} <= set(standard)
    wrapped = "Intro words.\n\n// Licensed under the\n// Apache License,\n// Version 2.0.\n//\n// More words.\nint x;"
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Someone\n\n" + body),
        (2, "ISC License\n\nCopyright 2020 Someone\n\n" + licenses.KNOWN["ISC-text"]),
        (3, "# Copyright (c) 2020 Someone\n#\n" + "".join(f"# {x}\n" for x in body.split("\n"))),
        (4, "// Copyright 2020 Someone\n// " + body.replace("\n", "\n// ")),
        (5, wrapped), (6, "Some code\n\n" + body + "\n\nmore code"),
        *[(100 + k, licenses.KNOWN[name]) for k, name in enumerate(standard)],
    ]
    got = {r.doc_id: r for r in licenses.license_scan(odd_docs(rows)).collect()}
    assert [got[k].license_id for k in range(1, 7)] == ["MIT-text-titled", "ISC-text-titled", "MIT-text", "MIT-text", None, None]
    assert got[5].notices == "Apache-2.0" and got[6].notices == "MIT-text"
    assert [got[100 + k].license_id for k in range(len(standard))] == standard

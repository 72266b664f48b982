"""Licence scans of titles, headers, wrapped and embedded notices and full texts."""

import textwrap

import pytest

from quoin.llm.license_forms import HEADERS, TEXTS, forms
from quoin.llm.licenses import inherited, scan
from quoin.llm.url_queries import TEMPLATES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    """Row of each path: cases among the given documents, whose words give the frequencies."""
    all_forms = forms(TEMPLATES)
    given = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    filler = [t.replace("\n", " \n") for t in given if t and not any(n in t for n in TEMPLATES.values()) and "rights" not in t][:60]
    text = {n: all_forms[n][-1] for n in TEXTS}
    apache, gnu = HEADERS["Apache-2.0"][5], HEADERS["GPL-3.0"][1]
    cases = {
        "title/a.py": "MIT License\nimport this",
        "title/b.txt": "GNU GENERAL PUBLIC LICENSE",
        "title/c.txt": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n",
        "sentence/a.py": "Copyright 2020 Example Authors. Released under the MIT License. No more",
        "sentence/b.py": "# Copyright 2020 Example Authors. Released under\n# the MIT License.\nimport this",
        "spdx/a.c": "// Example of one line\n/* SPDX-License-Identifier: GPL-2.0-only */\nint main;",
        "header/apache.py": "#!/usr/bin/env python\n# Copyright 2020 Example Authors\n#\n" + textwrap.indent(textwrap.fill(apache, 60), "# ") + "\n\nimport this\n" + filler[0],
        "header/gpl.c": "/* example.c: examples of things\n" + textwrap.indent(textwrap.fill(gnu, 50), " * ") + "\n */\n" + filler[1],
        "header/asf.c": "/*\n" + textwrap.indent(textwrap.fill(HEADERS["Apache-2.0"][6], 70), " * ") + "\n */\n" + filler[2],
        "embedded/mit.txt": filler[3] + "\n\nCopyright 2020 Example Authors\n\n" + text["MIT"] + "\n" + filler[4],
        "embedded/wrapped.js": filler[5] + "\n" + textwrap.indent(textwrap.fill(text["BSD-3-Clause"], 40), "// ") + "\n" + filler[6],
        "embedded/gpl.txt": filler[7] + "\n" + text["GPL-3.0"] + "\n" + filler[8],
        "cut/mit.txt": filler[9] + "\nPermission is hereby granted, free of charge, to any person obtaining a copy\n" + filler[10],
        "none/university.txt": "MIT\nThe license of this is not known\n" + filler[11],
        "none/null.txt": None,
    } | {f"full/{n}.txt": t for n, t in text.items()} | {f"named/{n}/LICENSE": f"Copyright 2020 Example Authors\n\n{t}" for n, t in text.items()} | {f"filler/{k}": t for k, t in enumerate(filler)}
    files = spark.createDataFrame([(p, t) for p, t in cases.items()], "path string, text string").repartition(3)
    return {r["path"]: r for r in scan(files, all_forms).collect()}, files, cases, all_forms


def test_titles_notices_and_headers(found):
    rows = found[0]
    want = {
        "title/a.py": "MIT", "title/b.txt": "GPL-1.0-or-later", "title/c.txt": "GPL-3.0", "sentence/a.py": "MIT", "sentence/b.py": "MIT", "spdx/a.c": "GPL-2.0",
        "header/apache.py": "Apache-2.0", "header/gpl.c": "GPL-3.0", "header/asf.c": "Apache-2.0", "cut/mit.txt": "MIT",
    }
    assert {p: rows[p]["license"] for p in want} == want
    assert (rows["sentence/b.py"]["line"], rows["spdx/a.c"]["line"], rows["title/c.txt"]["line"]) == (1, 2, 0)
    assert rows["header/apache.py"]["score"] > 0.99 and rows["header/apache.py"]["line"] == 4


def test_embedded_and_full_texts(found):
    rows, _, cases, _ = found
    assert {p: rows[p]["license"] for p in rows if p.startswith("embedded")} == {"embedded/mit.txt": "MIT", "embedded/wrapped.js": "BSD-3-Clause", "embedded/gpl.txt": "GPL-3.0"}
    for p in ("embedded/mit.txt", "embedded/wrapped.js", "embedded/gpl.txt"):
        assert rows[p]["score"] > 0.999
    assert rows["embedded/mit.txt"]["line"] == cases["embedded/mit.txt"].split("\n").index("Permission is hereby granted, free of charge, to any person obtaining a copy") + 1
    for n in TEXTS:
        assert (rows[f"full/{n}.txt"]["license"], rows[f"named/{n}/LICENSE"]["license"]) == (n, n)
        assert rows[f"full/{n}.txt"]["score"] > 0.999 and rows[f"full/{n}.txt"]["line"] == 0


def test_prose_has_no_licence(found):
    rows = found[0]
    assert [p for p in rows if p.startswith(("filler", "none")) and rows[p]["license"]] == []
    assert (rows["none/null.txt"]["score"], rows["none/null.txt"]["line"]) == (0.0, 0)


def test_scores_do_not_depend_on_the_batches(spark, found):
    rows, files, _, all_forms = found
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        again = {r["path"]: r for r in inherited(scan(files.coalesce(1), all_forms)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for p, r in rows.items():
        assert (again[p]["line"], round(again[p]["score"], 9)) == (r["line"], round(r["score"], 9))
        assert r["license"] is None or again[p]["license"] == r["license"]

"""Licences as they are published: wrapped, with bullets, names and years."""

from quillcount.llm import licenses

ISC = """ISC License

Copyright (c) 2004-2010 by Some Consortium, Inc. ("SC")
Copyright 1995-2003 A. Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""


def ids(spark, texts, extra=None):
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    return {r.doc_id: r.license_id for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, license_id string"), extra).collect()}


def test_published_wrapping(spark):
    bsd = licenses.TEXTS["BSD-3-Clause"]
    bullets = bsd.replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * ").replace("License\n\n", "License\n\n  Copyright <year> <owner>\n\n", 1)
    assert bullets != bsd
    got = ids(spark, [ISC, bullets, ISC.replace("\n", "\r\n"), licenses.TEXTS["Unlicense"].replace("https", "http"), bsd.replace("2. ", "(b) "), bsd + "x" * 1_000_000, "", None, ISC, ISC])
    assert got == {0: "ISC", 1: "BSD-3-Clause", 2: "ISC", 3: "Unlicense", 4: "BSD-3-Clause", 5: None, 6: None, 7: None, 8: "ISC", 9: "ISC"}


def test_null_ids_are_kept(spark):
    df = spark.createDataFrame([(None, ISC), (None, ISC), (1, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license_id or "") for r in licenses.scanned(df).collect()) == [(0, "ISC"), (0, "ISC"), (1, "")]

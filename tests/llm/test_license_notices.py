"""Every known notice and every text of a long licence is found."""

from quillcount.llm import licenses


def test_every_known_notice(spark):
    for name in ("CC BY 4.0", "CC0 1.0", "GPLv2", "GPLv3"):
        assert f"Released under {name}" in licenses.notices()
    rows = [(k, form(text), i) for k, (text, i) in enumerate(licenses.notices().items()) for form in (str, lambda t: f"x\n# {t.upper()}.\r\ny")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {(r.doc_id, r.notices) for r in licenses.scanned(df).collect()} == {(k, i) for k, _, i in rows}


def test_texts_of_long_licenses(spark):
    texts = licenses.long_texts()
    assert {i for i, _ in texts} == {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"}
    rows = [(k, t.replace("\n", "\r\n"), i) for k, (i, t) in enumerate(texts)] + [(100, "My  own licence", "own"), (101, "", None), (102, texts[0][1][:-20], None)]
    more = spark.createDataFrame([("MY OWN LICENSE", "own"), ("", "none"), (None, "none")], "text string, license_id string")
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licenses.scanned(df, more).collect()} == {k: i for k, _, i in rows}

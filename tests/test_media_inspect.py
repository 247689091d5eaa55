"""The query media_inspect reads whole pages as each of its forms."""

from quillcount.plans import queries


def test_whole_pages_in_every_form(spark, tmp_path):
    html = {1: "<p>é(x)\\ny</p>" * 90, 2: "a" * 255, 3: "b" * 511, 4: "", 5: None, 6: "plain \\( page"}
    spark.createDataFrame(list(html.items()), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.form): r for r in queries.media_inspect(spark, str(tmp_path)).collect()}
    assert len(got) == 24 and all(r.error is None for r in got.values())
    for k, text in html.items():
        n = len((text or "").encode())
        pdf, wav, gif, plain = (got[k, form] for form in ("pdf", "wav", "gif", "plain"))
        assert (pdf.mime, pdf.pages, pdf.extracted_bytes) == ("application/pdf", 1, len("[page 1]\n\n") + n)
        assert (wav.mime, wav.duration_ms) == ("audio/wav", n * 1000 // 8000)
        assert (gif.mime, gif.width, gif.frames) == ("image/gif", k + 1, 1)
        assert (plain.mime, plain.source_kind) == ("", "")

"""Copies of a page are no evidence that its article is boilerplate."""

from quillcount.llm import html_text

ARTICLE = '<title>{t}</title><nav>menu</nav><div class="{c}"><div class="part"><p>First of the story.</p></div><section><p>Rest of it.</p></section></div>'


def test_articles_of_copied_pages_stay(spark):
    schema = "page_id long, url string, html string"
    rows = [(k, "http://a/", ARTICLE.format(t="x", c="content")) for k in range(30)] + [(30, "http://a/", "<p>another</p>")]
    rows += [(100 + k, "http://b/", ARTICLE.format(t=k, c="x")) for k in range(30)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, schema).repartition(7)).collect()}
    assert got.pop(30) == "another" and set(got.values()) == {"First of the story.\n\nRest of it."} and len(got) == 60


def test_boilerplate_of_different_pages_still_goes(spark):
    rows = [(k, "http://a/", f"<article><p>Story {k}</p><div class='box'>same</div></article>") for k in range(9) for _ in range(5)]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 45 and all(r.text == f"Story {r.page_id}" for r in got)

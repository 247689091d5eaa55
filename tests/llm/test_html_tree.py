"""The style tree by itself: importances recounted by brute force, boilerplate without telling names, depth."""

import math
from collections import defaultdict

import numpy as np
import pytest

from quillcount.llm import html_text

PAGES = "page_id long, url string, html string, host int, text string"


def page(k, rng):
    words = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    story, more = words(40), words(25 + k % 7)
    html = (
        f"<html><body><div><div>Home Products Prices About us</div><div>We value what you read here, join our letter today</div></div>"
        f"<div><p>{story}</p><div>{more}</div></div><div>Copyright of the house, all rights kept, page {k}</div><div><a href=x>Imprint</a> <a href=y>Terms</a></div></body></html>"
    )
    return html, f"{story}\n\n{more}"


@pytest.mark.parametrize("most", [2_000, 3])
def test_tree_alone_removes_boilerplate(spark, monkeypatch, most):
    """No class, id or element speaks of boilerplate: entropies must. Large hosts look up their nodes by a join."""
    monkeypatch.setattr(html_text, "HOST_NODES", most)
    rng = np.random.default_rng(8)
    made = [page(k, rng) for k in range(40)]
    rows = [(k, "https://site.example/" + str(k), h, 1, None) for k, (h, _) in enumerate(made)] + [(99, "https://lone.example/", made[0][0], 1, "url clash")]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    assert all(got[k] == text for k, (_, text) in enumerate(made))
    assert got[99].startswith("Home Products") and got[99].endswith("Imprint Terms")  # one page is no evidence


def test_importances_recounted(spark):
    rng = np.random.default_rng(4)
    words = ["w%d" % i for i in range(12)]
    htmls = [f"<body><div>{' '.join(rng.choice(words, 9))}</div><ul>{'<li>x</li>' * int(rng.integers(1, 3))}</ul><p>{k}</p></body>" for k in range(30)]
    htmls += htmls[:5] + [None, ""]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(h,) for h in htmls], "html string").select(F.lit("h").alias("host"), "html")
    got = {r.node: (r.pages, r.presentation, r.content) for r in html_text.style_trees(df).collect()}
    # brute force: by distinct page, walk the nodes and count arrangements and phrases
    pages, styles, texts = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for k, html in enumerate(dict.fromkeys(h or "" for h in htmls)):
        for node in html_text.parsed(html, "h"):
            key = node.key - (1 << 63)
            pages[key].add(k)
            styles[key][tuple("#" if isinstance(p, str) else p.step for p in node.parts)].add(k)
            for phrase in html_text.phrases(html_text.own_text(node)):
                texts[key][phrase].add(k)
    assert set(got) == set(pages)
    for key, (m, presentation, content) in got.items():
        entropy = lambda kinds: 1 - sum(len(c) * math.log(len(c), m) for c in kinds.values()) / sum(len(c) for c in kinds.values()) if kinds and m > 1 else 1.0
        assert m == len(pages[key]) and presentation == pytest.approx(entropy(styles[key]), abs=1e-9) and content == pytest.approx(entropy(texts[key]), abs=1e-9)
    assert min(p for _, p, _ in got.values()) == 0.0


def test_depth_is_no_cut():
    inner = 'x<div class="ad">BUY</div><p>one</p><p>two</p>'
    assert html_text.main_text(inner) == "x\n\none\n\ntwo"
    for depth in (420, 20_000):
        assert html_text.main_text("<div>" * depth + inner + "</div>" * depth) == "x\n\none\n\ntwo"
    assert html_text.main_text("<b>" * 5_000 + "<p>a</p>" + "</i>" * 5_000 + "b") == "a\n\nb"
    assert html_text.main_text("<p>" + "long " * 200_000 + "</p>").count("long") == 200_000


def test_repeated_rows_ties_and_clashing_columns(spark):
    rows = [(1, "http://x/", "<p>a</p>", 1, "t")] * 3 + [(None, None, None, None, None), (2, "http://x/", " ", 0, "")]
    got = html_text.extracted(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1), (1, "a", 1), (2, "", 0)]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}

"""Contents are counted over whole texts, and what is not counted is never read."""

import math
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcount.llm import html_text

PAGES = "page_id long, url string, html string"


def recounted(htmls, host):
    """(presentation, content) of all nodes of at least ``MIN_PAGES`` pages, from all pairs of words."""
    pages, styles, pairs = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for k, html in enumerate(htmls):
        for node in html_text.parsed(html, host):
            pages[node.key].add(k)
            styles[node.key][tuple("#" if isinstance(p, str) else p.step for p in node.parts)].add(k)
            words = html_text.own_text(node).split()
            for pair in pairwise(words) if len(words) > 1 else words:
                pairs[node.key][pair].add(k)
    alike = lambda kinds, m: max(0.0, 1 - sum(len(c) * math.log(len(c), m) for c in kinds.values()) / sum(len(c) for c in kinds.values())) if kinds else 1.0
    return {n: (alike(styles[n], len(p)), alike(pairs[n], len(p))) for n, p in pages.items() if len(p) >= html_text.MIN_PAGES}


def test_all_phrases_are_counted(spark):
    same = [f"w{i}" for i in range(400)]
    htmls = ["<div>" + " ".join([*same[:200], f"x{k}", *same[200:]]) + "</div>" for k in range(10)]
    df = spark.createDataFrame([(h,) for h in htmls], "html string").select(F.lit("h").alias("host"), "html")
    got = {r.node + (1 << 63): r.content for r in html_text.style_trees(df).collect()}
    # of 400 pairs, the two around the word that changes differ on every page
    assert got[html_text.parsed(htmls[0], "h")[1].key] == pytest.approx(2 / 400, abs=1e-9)


@pytest.mark.parametrize("most", [2_000, 2])
def test_texts_are_those_of_all_counts(spark, monkeypatch, most):
    """Boxes of shared and changing words at all shares; on half of the hosts no article has a box."""
    monkeypatch.setattr(html_text, "HOST_NODES", most)
    rng = np.random.default_rng(3)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(n))
    shared = [words(1) for _ in range(30)]
    made = {}
    for host in range(4):
        for k in range(12):
            boxes = "".join(f"<div>{' '.join(shared[: 30 - c])} {words(c)}</div>" for c in (0, 1, 3, 5, 6, 7, 9, 20, 30)) if host % 2 else "<ul><li>same</li></ul>"
            made[f"http://h{host}/{k}"] = f"<body><div>Menu of all</div><article><p>{words(30)}</p>{boxes if k else ''}</article></body>"
    df = spark.createDataFrame([(k, url, h) for k, (url, h) in enumerate(made.items())], PAGES).repartition(5)
    got = {r.url: r.text for r in html_text.extracted(df).collect()}
    gone = 0
    for host in range(4):
        own = {u: h for u, h in made.items() if u.startswith(f"http://h{host}/")}
        evidence = recounted(own.values(), f"h{host}")
        for url, html in own.items():
            assert got[url] == html_text.main_text(html, f"h{host}", evidence)
            gone += got[url] != html_text.main_text(html, f"h{host}")
    assert gone == 22
    assert {r.host for r in html_text.doubtful_nodes(html_text.with_host(df)).collect()} == {"h1", "h3"}


@pytest.mark.parametrize("held, chars", [(1 << 20, 4_000_000), (40, 90)])
def test_counts_in_parts_and_of_copies(spark, monkeypatch, held, chars):
    """Groups of a node in parts, sent many times, and pages that several rows show, count as one whole would."""
    monkeypatch.setattr(html_text, "HELD", held)
    monkeypatch.setattr(html_text, "PART_CHARS", chars)
    rng = np.random.default_rng(6)
    htmls = [f"<div>{' '.join(rng.choice(['a', 'b', 'c', 'd'], 12))}</div><p>{k}</p>" for k in range(20)]
    copies = htmls + htmls[:7] * 3 + [f"<script>{k}</script>{h}" for k, h in enumerate(htmls[5:9])] * 2
    df = spark.createDataFrame([(h,) for h in copies], "html string").select(F.lit("h").alias("host"), "html").repartition(6)
    got = {r.node + (1 << 63): (r.pages, r.presentation, r.content) for r in html_text.style_trees(df).collect()}
    different = htmls + copies[-4:]
    nodes = {n.key for h in htmls for n in html_text.parsed(h, "h")}
    for key, (presentation, content) in recounted(different, "h").items():
        if key in nodes:
            assert got[key][1:] == (pytest.approx(presentation, abs=1e-9), pytest.approx(content, abs=1e-9))
    assert got[html_text.parsed("<div>", "h")[1].key][0] == 24

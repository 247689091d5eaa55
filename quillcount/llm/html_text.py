"""HTML extraction with a site style tree.

The DOMs of one host's pages are merged: elements at the same path of tags,
classes, ids and places among like siblings are one node of the host's tree,
menus, footers and adverts included. For each node the tree counts the pages
that show it, the arrangements of its children (presentation) and the phrases
of its own text (content). Phrases are all pairs of neighbouring words of the
text on that page, each once, so a changed word changes little. With m pages and a phrase on c of them, the phrase's importance is
1 - log c / log m; a node's content importance is the mean over the occurrences
of its phrases, and its presentation importance the same of its arrangements.

On each page, importance is then composed bottom-up: a branch's content is the
mean of its own text's and its children's importance, weighed by words, and
its presentation makes up for a share ``PRESENTATION`` of what that lacks.
Markup is a prior: what it declares to be no article (menus, forms, scripts and
the like) counts nothing, what is named like something beside the article a
tenth. A branch whose importance, by that of the important part of its article,
stays below ``LEAST_IMPORTANCE`` is removed, and the blocks of what is left are
the text.

Importance decides only on branches with a name or a box's element within an
article. Where the articles of no page that shows a node have one, its counts
are never read, and ``deciding`` leaves them out: the texts are the same.
All phrases of the other nodes are counted.

Pages of a host on which all open nodes are the same, as copies are, count as
one page: that an article was copied does not make it boilerplate. As branches
are measured by their article, near copies keep what they share. All counts are
partial sums by hashed node, so a host with a third of all pages is never
gathered. Hosts with at most ``HOST_NODES`` nodes in doubt send them all to
each of their pages; pages of larger hosts look up their own nodes by a join.

Defined results: a null or empty page has an empty text; a node is in doubt
only from ``MIN_PAGES`` different pages of its host on; a null url belongs to
the host ''; very long and very deep pages are read whole; repeated rows are
pages each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import configured, discard, staged, table

#: Importance below which a branch is removed, and different pages a host must show it on.
LEAST_IMPORTANCE, MIN_PAGES = 0.2, 8
#: Share of what its content lacks that a branch's presentation can make up for.
PRESENTATION = 0.15
#: Prior of what names itself something beside the article.
BESIDE_PRIOR = 0.1
#: Hashes of phrases within a node, and bytes of one.
HASH, HASH_BYTES = 1 << 48, 6
#: Phrases that a task holds before it sends them, and characters of a node's texts to a group that counts them.
HELD, PART_CHARS = 1 << 20, 4_000_000
#: Nodes in doubt of a host that are sent to each of its pages; beyond it, pages look up theirs.
HOST_NODES = 2_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture".split()
)
#: Elements without text of their own to show; they are no part of the tree.
_MACHINE = frozenset("script style noscript template svg math iframe object embed applet canvas audio video head title".split())
#: Elements that are never part of an article's text.
_NEVER = _MACHINE | frozenset("form button select option textarea input label fieldset nav footer aside menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
#: Parts of class names and ids that name something beside the article.
_BESIDE = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion promoted
    cookie cookies consent gdpr notice notices alert disclaimer popup popover modal overlay newsletter subscribe subscription signup paywall
    share sharing social sidebar sidebars aside menu menus nav navs navbar navigation topbar breadcrumb breadcrumbs pagination pager toolbar
    footer masthead comment comments commentlist discussion disqus reply replies respond related recommended recommendations widget widgets
    login search skip tags teaser teasers outbrain taboola tracking""".split()
)
#: Parts of names that an article's container has where there is no element for it.
_ARTICLE = frozenset("article content post entry story main".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Opening one of these ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_P, _P_WITHIN = frozenset(["p"]), _NEVER | {"table", "td", "th", "article", "section", "div", "li", "blockquote", "main", "body"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Branches that a low importance removes even without a class or an id; bare paragraphs, lists and
#: headings of an article stay, though copies of one article may make them look alike.
_BOXES = frozenset("div section header address figure center".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An open element. Inline elements are transparent: their text and children belong to ``block``."""

    __slots__ = ("tag", "names", "prior", "parent", "block", "parts", "like", "step", "key", "words", "importance", "usual")

    def __init__(self, tag: str, names: str, prior: float, parent: Node | None):
        self.tag, self.names, self.prior, self.parent = tag, names, prior, parent
        self.block: Node = self
        self.parts: list = []  # strings and blocks
        self.like: dict[str, int] = {}  # children by step
        self.step, self.key, self.words, self.importance, self.usual = "", 0, 0, 1.0, 1.0


@lru_cache(maxsize=65_536)
def _prior(tag: str, names: str, hidden: bool) -> float:
    """How much markup alone leaves of a node's importance."""
    if hidden or tag in _NEVER:
        return 0.0
    beside = names and tag not in ("html", "body", "article", "main") and not _BESIDE.isdisjoint(_SPLIT.split(_CAMEL.sub("-", names).lower()))
    return BESIDE_PRIOR if beside else 1.0


class _Builder(HTMLParser):
    def __init__(self, host: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", 1.0, None)
        self.root.key = xxhash.xxh3_64_intdigest(host)
        self.blocks = [self.root]  # parents before children
        self.open: Counter = Counter()

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            if self.open["p"]:
                self._end(_P, _P_WITHIN)
        elif tag in _SIBLINGS:
            tags, within = _SIBLINGS[tag]
            if any(self.open[t] for t in tags):
                self._end(tags, within)
        names, hidden = "", False
        for k, v in attrs:
            if k == "class" or k == "id":
                names += ("." if k == "class" else "#") + " ".join((v or "").split())
            elif k == "role":
                hidden |= (v or "").strip().lower() in _ROLES
            elif k == "hidden" or k == "aria-hidden" and (v or "").strip().lower() == "true" or k == "style" and re.search(r"display\s*:\s*none", v or "", re.I):
                hidden = True
        prior, block = _prior(tag, names, hidden), self.at.block
        if tag in _INLINE and prior == 1.0:
            if tag == "br":
                block.parts.append(" ")
            if tag in _VOID:
                return
            node = Node(tag, names, prior, self.at)
            node.block = block
        else:
            node = Node(tag, names, prior, self.at)
            node.step = "/" + tag + names
            nth = block.like.get(node.step, 0)
            node.key = xxhash.xxh3_64_intdigest(f"{node.step}:{nth}", seed=block.key)
            block.like[node.step] = nth + 1
            block.parts.append(node)
            self.blocks.append(node)
        if tag not in _VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.at.tag == tag and tag in ("svg", "path", "use", "iframe"):
            self._close(self.at)

    def handle_endtag(self, tag):
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._close(node)

    def handle_data(self, data):
        self.at.block.parts.append(data)

    def _close(self, upto: Node):
        while True:
            node = self.at
            self.open[node.tag] -= 1
            self.at = node.parent
            if node is upto:
                return

    def _end(self, tags, within):
        node = self.at
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self._close(node)
                return
            node = node.parent


def parsed(html: str, host: str = "") -> list[Node]:
    """The blocks of a page, parents before children, the first being the root."""
    builder = _Builder(host)
    builder.feed(html)
    builder.close()
    return builder.blocks


def own_text(node: Node) -> str:
    return "\n".join(p for p in node.parts if isinstance(p, str))


def phrases(text: str) -> set[int]:
    """Hashes of the phrases of a text."""
    words = text.split()
    return set(map(xxhash.xxh3_64_intdigest, map(" ".join, pairwise(words)) if len(words) > 1 else words))


def _shown(blocks: list[Node]) -> tuple[list[tuple[Node, str, str]], int]:
    """The nodes that show something, with their arrangement and text, and a digest of what the open ones show."""
    seen: list[tuple[Node, str, str]] = []
    shown: list[str] = []
    machine: set[int] = set()
    closed: set[int] = set()
    for node in blocks:
        own, above = id(node), id(node.parent.block) if node.parent is not None else 0
        if node.tag in _MACHINE or above in machine:
            machine.add(own)
            continue
        style = "".join(["#" if isinstance(p, str) else p.step for p in node.parts if not isinstance(p, str) or p.strip()])
        text = own_text(node)
        seen.append((node, style, text))
        if node.prior < 1.0 or above in closed:
            closed.add(own)
        else:
            shown.append(f"{node.key}|{style}|{' '.join(text.split())}|")
    return seen, xxhash.xxh3_64_intdigest("".join(shown))


def arrangements(html: str, host: str) -> tuple[list[tuple[int, int, int, bool]], int]:
    """(node, hash, characters, whether it may decide) of a page's arrangements, one for each node, and its digest."""
    blocks = parsed(html, host)
    seen, page = _shown(blocks)
    read = deciding(blocks)
    return [(n.key, xxhash.xxh3_64_intdigest(style), len(text), n.key in read) for n, style, text in seen], page


def weigh(blocks: list[Node], evidence: dict[int, tuple[float, float]]) -> None:
    """Words and composed importance of every block, and ``usual``, the importance that the
    important part of its words has (their mean, weighed by importance). ``evidence``:
    (presentation, content) importance of nodes in doubt; other nodes are important."""
    squares: dict[int, float] = {}
    for node in reversed(blocks):
        presentation, content = evidence.get(node.key, (1.0, 1.0))
        words = sum(len(p.split()) for p in node.parts if isinstance(p, str))
        total, square = words * content, words * content * content
        for p in node.parts:
            if not isinstance(p, str) and p.prior >= LEAST_IMPORTANCE:
                words += p.words
                total += p.words * p.importance
                square += squares[id(p)]
        content = total / words if words else 1.0
        squares[id(node)] = square
        node.words, node.usual = words, square / total if total else 0.0
        node.importance = 1 - (1 - content) * (1 - PRESENTATION * presentation) if node.key in evidence else content


def _named_article(node: Node) -> bool:
    return bool(node.names) and node.tag in ("div", "section", "td") and not _ARTICLE.isdisjoint(_SPLIT.split(_CAMEL.sub("-", node.names).lower()))


def _articles(blocks: list[Node]) -> list[Node]:
    """Where the article is: its elements, else main, else what is named so, else the body or all."""
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", _named_article, lambda n: n.tag == "body"):
        found: list[Node] = []
        skipped: set[int] = set()  # below what markup closes or what is found already
        for node in blocks:
            if node.parent is None:
                continue
            if id(node.parent.block) in skipped or node.prior < LEAST_IMPORTANCE:
                skipped.add(id(node))
            elif test(node):
                found.append(node)
                skipped.add(id(node))
        if found:
            return found
    return blocks[:1]


def _removed(node: Node, article: Node) -> bool:
    if node.prior < LEAST_IMPORTANCE:
        return True
    share = min(1.0, node.importance / article.usual) if article.usual else 1.0
    return node.prior * share < LEAST_IMPORTANCE and bool(node.names or node.tag in _BOXES)


def deciding(blocks: list[Node]) -> set[int]:
    """Keys of the nodes whose importance is read when the page's text is taken: the open ones
    of articles that have a branch which a low importance could remove."""
    keys: set[int] = set()
    for article in _articles(blocks):
        branch, doubt, at = [article], False, 0
        while at < len(branch):
            for part in branch[at].parts:
                if not isinstance(part, str) and part.prior >= LEAST_IMPORTANCE:
                    branch.append(part)
                    doubt |= bool(part.names or part.tag in _BOXES)
            at += 1
        if doubt:
            keys.update([node.key for node in branch])
    return keys


def main_text(html: str | None, host: str = "", evidence: dict[int, tuple[float, float]] | None = None) -> str:
    """The article's blocks, joined by empty lines."""
    if not html:
        return ""
    blocks = parsed(html, host)
    if evidence:  # else all are of importance 1
        weigh(blocks, evidence)
    out: list[str] = []
    line: list[str] = []

    def flush():
        if line:
            if text := " ".join("".join(line).split()):
                out.append(text)
            line.clear()

    for article in _articles(blocks):
        # (node, next part, whether only its headings count)
        stack = [(article, 0, False)]
        while stack:
            node, at, headings = stack.pop()
            for k in range(at, len(node.parts)):
                part = node.parts[k]
                if isinstance(part, str):
                    if not headings:
                        line.append(part)
                elif part.tag in _INLINE:  # named like something beside the article
                    continue
                elif not _removed(part, article):
                    flush()
                    stack += [(node, k + 1, headings), (part, 0, (headings or part.tag == "header") and part.tag not in _HEADING)]
                    break
                elif part.prior >= LEAST_IMPORTANCE:
                    flush()
            else:
                flush()
    return "\n\n".join(out)


def with_host(pages: DataFrame) -> DataFrame:
    """``pages`` with the lower-case host of their url, '' where there is none."""
    named = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.withColumn("host", named)


class _Evidence:
    """Nodes of evidence arrays with their other fields; what pages of a host share is decoded once for many of them."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, host: str, found: pa.ListScalar) -> dict[int, tuple]:
        if not found.is_valid:
            return {}
        values = found.values
        key = host, xxhash.xxh3_128_digest(values.field(0).to_numpy().tobytes())
        if key not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            node, *more = (values.field(k).to_pylist() for k in range(values.type.num_fields))
            self.known[key] = {n + (1 << 63): v for n, *v in zip(node, *more, strict=True)}
        return self.known[key]


def _signed(hashes) -> np.ndarray:
    return (np.array(hashes, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _styles(pages: DataFrame) -> DataFrame:
    """By node (a hash of its host and path) its host, ``pages`` that show it, the sum of n log n of the pages of its
    arrangements, its characters and whether it may decide. A page that several rows show counts once, and
    has a row of its own here, its digest being the node and the number of these rows ``copies``."""
    configured(pages.sparkSession)

    def run(batches):
        known: dict = {}  # page of each html of a host that this task has read
        sent: set = set()
        for batch in batches:
            rows: Counter = Counter()
            seen: dict = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                html = html.as_py() or ""
                copy = host, xxhash.xxh3_128_digest(html)
                if copy not in known:
                    shown, digest = arrangements(html, host)
                    page = known[copy] = host, digest
                    if page not in sent:
                        sent.add(page)
                        seen[page] = shown
                rows[known[copy]] += 1
            node, style, chars, decides = zip(*chain.from_iterable(seen.values()), strict=True) if seen else [()] * 4
            fields = [pa.array(_signed(node)), pa.array(_signed(style)), pa.array(chars, pa.int64()), pa.array(decides, pa.bool_())]
            # seen and rows have their pages in one order
            ends = np.cumsum([0, *(len(seen.get(p, ())) for p in rows)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, ["node", "hash", "chars", "decides"]))
            columns = [pa.array([h for h, _ in rows], pa.string()), pa.array(_signed([d for _, d in rows])), pa.array(list(rows.values()), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "rows", "seen"])

    sent = pages.select("host", "html").mapInArrow(run, "host string, page long, rows long, seen array<struct<node:bigint,hash:bigint,chars:bigint,decides:boolean>>")
    different = sent.groupBy("host", "page").agg(F.sum("rows").alias("copies"), F.first(F.when(F.size("seen") > 0, F.col("seen")), True).alias("seen"))
    itself = F.struct(F.col("page").alias("node"), F.lit(0).cast("long").alias("hash"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("decides"))
    seen = F.when(F.col("copies") > 1, F.array_append("seen", itself)).otherwise(F.col("seen"))
    shown = different.select("host", "page", "copies", F.inline(seen)).withColumn("copies", F.when(F.col("node") == F.col("page"), F.col("copies")))
    more = F.sum("chars").alias("chars"), F.min("host").alias("host"), F.max("decides").alias("decides"), F.max("copies").alias("copies")
    kinds = shown.groupBy("node", "hash").agg(F.count("*").alias("n"), *more)
    return kinds.groupBy("node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("styles"), *more)


def _sent(node: int, parts: int, found: list[tuple[np.ndarray, int]]):
    """(node, part, hashes, counts) of phrases on pages with numbers of copies; no counts where all are 1."""
    hashes = np.concatenate([h for h, _ in found]) & np.uint64(HASH - 1)
    if all(copies == 1 for _, copies in found):
        hashes, counts = np.unique(hashes, return_counts=True)
    else:  # each copy counts as its share of a page
        hashes, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.full(len(h), 1 / copies) for h, copies in found]))
    of = hashes % np.uint64(parts)
    for part in np.unique(of):
        for once in (True, False):
            own = (of == part) & ((counts == 1) == once)
            if own.any():
                narrow = np.ascontiguousarray(hashes[own].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                yield node - (1 << 63), int(part), narrow.tobytes(), None if once else counts[own].astype("<f8").tobytes()


def _spread(key, found):
    """The pages of all phrases of a part of a node, and the sum of n log n of them."""
    hashes, counts = [], []
    for h, n in zip(found.column("hashes").to_pylist(), found.column("counts").to_pylist(), strict=True):
        wide = np.zeros((len(h) // HASH_BYTES, 8), np.uint8)
        wide[:, :HASH_BYTES] = np.frombuffer(h, np.uint8).reshape(-1, HASH_BYTES)
        hashes.append(wide.view("<u8").ravel())
        counts.append(np.ones(len(wide)) if n is None else np.frombuffer(n, "<f8"))
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.maximum(1, np.rint(np.bincount(at, np.concatenate(counts))))
    return pa.table({"node": [key[0].as_py()], "phrases": [int(n.sum())], "texts": [float((n * np.log(n)).sum())]})


def _weighed(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content) of the staged ``nodes`` (as of ``_styles``), whose phrases are
    counted on ``pages`` (host, html)."""

    def run(batches):
        evidence = _Evidence()
        held: dict = defaultdict(list)
        size = 0

        def flushed():
            columns = list(zip(*(row for (node, parts), found in held.items() for row in _sent(node, parts, found)), strict=True)) or [[]] * 4
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["node", "part", "hashes", "counts"])

        for batch in batches:
            for host, html, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                wanted = evidence(host, found)
                seen, page = _shown(parsed(html.as_py() or "", host))
                copies = wanted[page][0] if page in wanted else 1
                for node, _, text in seen:
                    if node.key in wanted and (of := phrases(text)):
                        held[node.key, wanted[node.key][1]].append((np.fromiter(of, np.uint64, len(of)), copies))
                        size += len(of)
                        if size >= HELD:
                            yield flushed()
                            size = 0
        yield flushed()

    parts = nodes.withColumn("parts", (1 + F.col("chars") / PART_CHARS).cast("int"))
    shown = _attached(pages.select("host", "html"), parts, "node", "copies", "parts").where("evidence IS NOT NULL")
    sent = shown.select("host", "html", "evidence").mapInArrow(run, "node long, part int, hashes binary, counts binary")
    texts = sent.groupBy("node", "part").applyInArrow(_spread, "node long, phrases long, texts double").groupBy("node").agg(F.sum("phrases").alias("phrases"), F.sum("texts").alias("texts"))
    # entropies to the base of the number of pages: 0 if all are alike, 1 if all differ
    alike = lambda total, n: F.greatest(F.lit(0.0), F.when((F.col("pages") > 1) & (F.col(n) > 0), 1 - F.col(total) / (F.col(n) * F.log("pages"))).otherwise(F.lit(1.0)))
    known = nodes.where("copies IS NULL").join(texts, "node", "left")
    return known.select("host", "node", "pages", alike("styles", "pages").alias("presentation"), alike("texts", "phrases").alias("content"))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content) of the merged trees of pages (host, html)."""
    return _weighed(staged(_styles(pages), "html-styles"), pages)


def doubtful_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, presentation, content) of the nodes whose importance may be low and is read on some page."""
    nodes = staged(_styles(pages).where(((F.col("pages") >= MIN_PAGES) & F.col("decides")) | F.col("copies").isNotNull()), "html-styles")
    hosts = nodes.where("copies IS NULL").select("host").distinct()
    if hosts.isEmpty():
        known = nodes.select("host", "node", F.lit(1.0).alias("presentation"), F.lit(1.0).alias("content"))
    else:
        known = _weighed(nodes.join(hosts, "host", "left_semi"), pages.join(hosts, "host", "left_semi"))
    return known.where("presentation < 1 OR content < 1").select("host", "node", F.col("presentation").cast("float"), F.col("content").cast("float"))


def _own_nodes(batches):
    """The nodes of pages (host, h1, h2, html), and their digests."""
    for batch in batches:
        pages = [parsed(html.as_py() or "", host) for host, html in zip(batch.column(0).to_pylist(), batch.column(3), strict=True)]
        nodes = [_signed([_shown(blocks)[1], *(n.key for n in blocks)]) for blocks in pages]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(nodes, pa.list_(pa.int64()))], names=["host", "h1", "h2", "nodes"])


def _attached(pages: DataFrame, nodes: DataFrame, *fields: str) -> DataFrame:
    """``pages`` (host, html and others) with ``evidence``, the ``fields`` of the staged ``nodes`` that they may have."""
    gathered = F.collect_list(F.struct(*fields)).alias("evidence")
    sizes = staged(nodes.groupBy("host").agg(F.count("*").alias("size")), "html-hosts")
    small = nodes.join(sizes.where(F.col("size") <= HOST_NODES), "host").groupBy("host").agg(gathered)
    small = staged(small, "html-evidence")
    large = sizes.where(F.col("size") > HOST_NODES).select("host")
    if large.isEmpty():
        return pages.join(small, "host", "left")
    # pages of large hosts: each different page looks up its own nodes
    digests = [F.xxhash64(F.coalesce("html", F.lit(""))).alias("h1"), F.xxhash64(F.lit(7), F.coalesce("html", F.lit(""))).alias("h2")]
    many = pages.join(large, "host", "left_semi").select("*", *digests)
    distinct = many.groupBy("host", "h1", "h2").agg(F.min("html").alias("html"))
    own = distinct.mapInArrow(_own_nodes, "host string, h1 long, h2 long, nodes array<bigint>")
    own = own.select("host", "h1", "h2", F.explode(F.array_distinct("nodes")).alias("node"))
    found = staged(own.join(nodes.drop("host"), "node").groupBy("host", "h1", "h2").agg(gathered), "html-page-evidence")
    of_many = many.join(found, ["host", "h1", "h2"], "left").drop("h1", "h2")
    return pages.join(large, "host", "left_anti").join(small, "host", "left").unionByName(of_many)


def with_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, host, html) with ``evidence``, the nodes in doubt that they may have."""
    nodes = staged(doubtful_nodes(pages), "html-nodes")
    if nodes.isEmpty():
        return pages.withColumn("evidence", F.lit(None).cast("array<struct<node:bigint,presentation:float,content:float>>"))
    out = _attached(pages, nodes, "node", "presentation", "content")
    discard(nodes)
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of pages (page_id, url, html)."""
    configured(pages.sparkSession)
    pages = with_host(pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    rows = with_evidence(pages).select("page_id", "url", "host", "html", "evidence")

    def run(batches):
        evidence = _Evidence()
        for batch in batches:
            texts = [main_text(html.as_py(), host, evidence(host, found)) for host, html, found in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))

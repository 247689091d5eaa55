"""Substring dedup: suffix automata of reference shards, matching statistics, spans removed.

A window of ``min_words`` words that starts at two places of the corpus is
repeated; every word inside a repeated window is removed. The work is exact:

1. Each window is given an anchor, the k-gram in it with the least hash (the
   leftmost of equals), so equal windows have equal anchors at equal places.
   Consecutive windows with one anchor form a segment. Only anchors that occur
   in two texts, or twice in one, can belong to a repeated window.
2. Segments of one anchor with equal words are one kind, with a count: partial
   sums by digest, so a passage that a third of all documents share is one row
   from here on. A kind that occurs twice is repeated as a whole.
3. A reference shard is what lies around one repeated anchor: its kinds. Their
   weighted suffix automaton counts the occurrences of each word sequence; every
   kind that occurs once is streamed through it, and the matching statistic at a
   word is the longest sequence ending there that occurs twice. Spans of at
   least ``min_words`` are maximal repeated spans.
4. A shard of more than ``SHARD_WORDS`` words is split by a longer anchor: the
   windows of a kind that hold the anchor at nearby places share a longer core,
   and what has one core is a shard of its own, its kinds counted once more. The
   last cores are whole windows, of which only counts are needed.
5. Spans are found per kind and joined back to the kind's places.

The reference of a whole corpus grows with it, so its automata are not
broadcast: shard and documents meet by anchor. A reference beside the corpus,
such as benchmark texts, is cut into automata of bounded size, each broadcast
(``remove_reference_spans``).

Texts with equal copies are represented by one of them; a text of at least
``min_words`` words that has a copy loses all its words.

Defined results: null or empty texts have no words; texts shorter than a window
lose nothing; very long texts are worked on whole; repeated rows are copies of
each other; null ids are kept; an empty table gives an empty table; other
columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import configured, discard, shuffle_partitions, staged, table

MIN_WORDS = 35
#: Words of an anchor.
ANCHOR_WORDS = 12
#: Words of the kinds around one anchor that one automaton holds; beyond it, the shard is split.
SHARD_WORDS = 100_000
#: Windows of a kind that stay together in the first and the second split.
SPLITS = (6, 1)
#: Words that an automaton which is broadcast may hold.
BROADCAST_WORDS = 200_000

_PLACE = np.uint64((1 << 24) - 1)
_OTHER = np.uint64(0xA5A5A5A55A5A5A5A)


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with occurrence counts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.repeated: list[int] | None = None

    def add(self, words, times: int = 1) -> None:
        """Add one sequence that occurs so many times; sequences never match across their ends."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            found = nxt[last].get(w)
            if found is not None and length[found] == length[last] + 1:
                last = found
                count[last] += times
                continue
            if found is not None:
                last = self._clone(last, w, found)
                count[last] += times
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(times)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
            last = new
        self.repeated = None

    def _clone(self, p: int, w, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.count.append(0)
        self.link[q] = new
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def finish(self, times: int = 1) -> SuffixAutomaton:
        """Sum the counts; from here on, matches are of sequences that occur at least ``times`` times."""
        total = list(self.count)
        order = sorted(range(1, len(total)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0:
                total[self.link[s]] += total[s]
        repeated = [0] * len(total)
        for s in order:
            repeated[s] = self.length[s] if total[s] >= times else repeated[self.link[s]]
        self.repeated = repeated
        return self

    def matching_statistics(self, words):
        """For each word, the length of the longest known sequence that ends there."""
        nxt, link, length, repeated = self.next, self.link, self.length, self.repeated
        state = at = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                at = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                at += 1
            # all sequences of a state occur equally often; a shorter one may be in a linked state
            yield min(at, repeated[state])


def spans(statistics, least: int) -> list[tuple[int, int]]:
    """Maximal (start, words) covered by matches of at least ``least`` words."""
    out: list[list[int]] = []
    for i, n in enumerate(statistics):
        if n >= least:
            lo = i - n + 1
            while out and lo <= out[-1][1]:
                lo = min(lo, out.pop()[0])
            out.append([lo, i + 1])
    return [(a, b - a) for a, b in out]


def _segments(n: int, w: tb.Words, min_words: int):
    """(text, anchor, digest, start, windows, lead, times) of the segments of n texts; ``lead`` is the
    anchor's place in the first window. Of equal segments of one text, which are repeated whatever
    other texts hold, the first one stands for all; what they cover follows as (text, start, words)."""
    total = len(w.hash)
    if total < min_words:
        return None
    k = min(ANCHOR_WORDS, min_words)
    grams = tb.gram_hashes(w.hash, k)
    text = np.repeat(np.arange(n), np.diff(w.first))
    place = np.arange(len(grams)) - w.first[text[: len(grams)]]
    low = (grams & ~_PLACE) | (place.astype(np.uint64) & _PLACE)
    wide, width = low, 1
    span = min_words - k + 1
    while width * 2 <= span:
        wide = np.minimum(wide[:-width], wide[width:])
        width *= 2
    if width < span:
        wide = np.minimum(wide[: len(wide) - (span - width)], wide[span - width :])
    starts = np.flatnonzero(np.arange(len(wide)) + min_words <= w.first[text[: len(wide)] + 1])
    if not len(starts):
        return None
    own = text[starts]
    place = starts - w.first[own]
    anchor = place + ((wide[starts] & _PLACE).astype(np.int64) - place) % (int(_PLACE) + 1)
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(starts)))
    at, own, anchor = starts[first], own[first], anchor[first]
    digest = tb.range_hashes(w.hash, at, windows + (min_words - 1))
    start = at - w.first[own]
    columns = [own, grams[w.first[own] + anchor].view(np.int64), digest.view(np.int64), start, windows, anchor - start, np.ones(len(own), np.int64)]
    same = tb.mix64(digest ^ tb.mix64(columns[1].view(np.uint64))) + own.astype(np.uint64) * _OTHER
    order = np.argsort(same, kind="stable")
    change = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
    times = np.diff(np.append(change, len(order)))
    if len(times) == len(own):
        return columns, [np.empty(0, np.int64)] * 3
    stands = order[change]
    columns[-1][stands] = times
    several = np.repeat(times > 1, times)
    covered = np.sort(order[several])
    # spans that touch are one
    a, b = at[covered], at[covered] + windows[covered] + (min_words - 1)
    upto = np.maximum.accumulate(b)
    new = np.append(True, (a[1:] > upto[:-1]) | (own[covered][1:] != own[covered][:-1]))
    first = np.flatnonzero(new)
    ends = upto[np.append(first[1:] - 1, len(upto) - 1)]
    stands = np.sort(stands)
    return [c[stands] for c in columns], [own[covered][first], start[covered][first], ends - a[first]]


def anchors(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(anchor, d, k1, k2, start, windows, lead, n) of every segment, d digesting its words and n its
    number in the text; ``docs`` has k1, k2 and text. Rows with n = 0 are spans of ``windows`` words
    that are repeated within their text."""
    configured(docs.sparkSession)

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for row, n, w in tb.chunks(batch.column(2)):
                if got := _segments(n, w, min_words):
                    none = np.zeros(len(got[1][0]), np.int64)
                    for text, anchor, digest, *places in (got[0], [got[1][0], none, none, *got[1][1:], none, none]):
                        columns = [pa.array(anchor), pa.array(digest), pa.array(k1[row + text]), pa.array(k2[row + text]), *[pa.array(c.astype(np.int32)) for c in places]]
                        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "d", "k1", "k2", "start", "windows", "lead", "n"])

    return docs.select("k1", "k2", "text").mapInArrow(run, "anchor long, d long, k1 long, k2 long, start int, windows int, lead int, n int")


#: Kinds of a shard: c1 and c2 name its core, d the kind, n how often it occurs; ``lead`` is the place
#: of the anchor in its first window.
KINDS = "c1 long, c2 long, d long, n long, lead int, words binary"
_SPANS = "array<struct<start:int,n:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))


def _kinds_with_words(batches, min_words: int):
    """Words of the kinds of which places lie in a text."""
    for batch in batches:
        column = batch.column(1)
        places = column.flatten()
        anchor, d, n, start, windows, lead = (places.field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "d", "n", "start", "windows", "lead"))
        owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())
        for row, m, w in tb.chunks(batch.column(0)):
            own = np.flatnonzero((owner >= row) & (owner < row + m))
            if len(own):
                first = w.first[owner[own] - row] + start[own]
                words = [w.hash[a : a + k + min_words - 1].tobytes() for a, k in zip(first.tolist(), windows[own].tolist(), strict=True)]
                kinds = [pa.array(anchor[own]), pa.array(np.zeros(len(own), np.int64)), pa.array(d[own]), pa.array(n[own]), pa.array(lead[own].astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(kinds, names=["c1", "c2", "d", "n", "lead", "words"])


def _shards(batches, min_words: int):
    """Repeated spans of the kinds that occur once, of shards that come sorted by core."""

    def settle(core, shard, out):
        automaton = SuffixAutomaton()
        for _, n, words in shard:
            automaton.add(words.tolist(), n)
        automaton.finish(times=2)
        for d, n, words in shard:
            if n == 1 and (found := spans(automaton.matching_statistics(words.tolist()), min_words)):
                out.append((*core, d, [{"start": a, "n": k} for a, k in found]))

    held, core = [], None
    for batch in batches:
        out: list = []
        for c1, c2, d, n, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (c1, c2) != core:
                if len(held) > 1:
                    settle(core, held, out)
                held, core = [], (c1, c2)
            held.append((d, n, np.frombuffer(words, np.uint64)))
        yield _span_batch(out)
    out = []
    if len(held) > 1:
        settle(core, held, out)
    yield _span_batch(out)


def _span_batch(rows):
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), _SPAN), strict=True)], names=["c1", "c2", "d", "spans"])


def _split(batches, min_words: int, together: int):
    """Parts of kinds whose windows hold the anchor at nearby places, under their longer core."""
    for batch in batches:
        out: list = []
        for c1, c2, d, n, lead, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = np.frombuffer(words, np.uint64)
            windows = len(w) - min_words + 1
            for part in range((lead - windows + 1) // together, lead // together + 1):
                # windows t with the anchor at lead - t, part * together <= lead - t < (part + 1) * together
                lo, hi = max(0, lead - (part + 1) * together + 1), min(windows - 1, lead - part * together)
                core = w[lead - part * together : lead - (part + 1) * together + 1 + min_words]
                own = w[lo : hi + min_words]
                e1, e2 = (tb.range_hashes(x, np.zeros(1, np.int64), np.full(1, len(core)))[0].view(np.int64) for x in (core, core ^ _OTHER))
                d2 = tb.range_hashes(own, np.zeros(1, np.int64), np.full(1, len(own)))[0].view(np.int64)
                out.append((int(e1), int(e2), int(d2), n, lead - lo, own.tobytes(), c1, c2, d, lo))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        columns = list(zip(*out, strict=True)) or [[]] * 10
        names = ["c1", "c2", "d", "n", "lead", "words", "p1", "p2", "pd", "at"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _settled(kinds: DataFrame, min_words: int, splits=SPLITS) -> DataFrame:
    """(c1, c2, d, spans) of the kinds (KINDS, staged) that hold a repeated window."""
    parts = shuffle_partitions(kinds.sparkSession)
    whole = kinds.where("n > 1").select("c1", "c2", "d", F.array(F.struct(F.lit(0).alias("start"), (F.length("words") / 8).cast("int").alias("n"))).alias("spans"))
    sizes = kinds.groupBy("c1", "c2").agg((F.sum(F.length("words")) / 8).alias("size"), F.count("*").alias("kinds"), F.min("n").alias("least"))
    # where every kind occurs twice, nothing is left to find
    sizes = staged(sizes.where("kinds > 1 AND least = 1").select("c1", "c2", (F.col("size") > SHARD_WORDS).alias("large")), "substring-shards")
    shards = kinds.join(sizes, ["c1", "c2"])
    small = shards.where("NOT large").select("c1", "c2", "d", "n", "words")
    found = small.repartition(parts, "c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(lambda b: _shards(b, min_words), f"c1 long, c2 long, d long, spans {_SPANS}")
    out = whole.unionByName(found)
    if sizes.where("large").isEmpty():
        return staged(out, "substring-settled")
    together, further = splits[0], splits[1:]
    large = shards.where("large").select("c1", "c2", "d", "n", "lead", "words")
    pieces = staged(large.mapInArrow(lambda b: _split(b, min_words, together), KINDS + ", p1 long, p2 long, pd long, at int"), "substring-pieces")
    again = pieces.groupBy("c1", "c2", "d").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"), F.min("words").alias("words"))
    if further:
        again = staged(again, "substring-kinds")
        inner = _settled(again, min_words, further)
    else:
        # a core that is a whole window has one kind, and its count says all
        inner = again.where("n > 1").select("c1", "c2", "d", F.array(F.struct(F.lit(0).alias("start"), F.lit(min_words).alias("n"))).alias("spans"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["n"].alias("n")))
    back = pieces.join(inner, ["c1", "c2", "d"]).select(F.col("p1").alias("c1"), F.col("p2").alias("c2"), F.col("pd").alias("d"), moved.alias("spans"))
    # of a kind that is split, the spans of its parts; of one that occurs twice, the whole
    back = back.groupBy("c1", "c2", "d").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return staged(out.unionByName(back.join(whole.select("c1", "c2", "d"), ["c1", "c2", "d"], "left_anti")), "substring-settled")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, copies, spans array<struct<start, n>>) of the texts (k1, k2, text) that lose words."""
    groups = staged(docs.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("row").alias("row")), "substring-texts")
    copied = groups.where("copies > 1").select("k1", "k2", "copies")
    segments = staged(anchors(docs, min_words), "substring-segments")
    several = [F.min(c) != F.max(c) for c in ("k1", "k2", "start")]
    repeated = segments.where("n > 0").groupBy("anchor").agg((several[0] | several[1] | several[2] | (F.max("n") > 1)).alias("several")).where("several").select("anchor")
    candidates = staged(segments.where("n > 0").join(staged(repeated, "substring-anchors"), "anchor"), "substring-candidates")
    kinds = staged(candidates.groupBy("anchor", "d").agg(F.sum("n").alias("n"), F.min("windows").alias("windows")), "substring-kinds")
    # an anchor with one kind has no automaton, and where all kinds occur twice nothing is left to find
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1").select("anchor")
    place = F.struct("k1", "k2", "start", "windows", "lead")
    wanted = candidates.join(staged(open_, "substring-open"), "anchor").groupBy("anchor", "d").agg(F.sum("n").alias("n"), F.min(place).alias("place")).select("anchor", "d", "n", "place.*")
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "d", "n", "start", "windows", "lead")).alias("places"))
    wanted = staged(wanted.join(groups, ["k1", "k2"]).select("k1", "k2", "row", "places"), "substring-wanted")
    # of equal texts the one of least row; repeated rows of it give the same kinds once more, dropped below
    texts = docs.join(wanted, ["k1", "k2", "row"]).select("text", "places")
    known = staged(texts.mapInArrow(lambda b: _kinds_with_words(b, min_words), KINDS).dropDuplicates(["c1", "c2", "d"]), "substring-words")
    found = _settled(known, min_words).select(F.col("c1").alias("anchor"), "d", "spans")
    # kinds that occur twice are repeated as a whole, with or without an automaton
    whole = kinds.where("n > 1").select("anchor", "d", F.array(F.struct(F.lit(0).alias("start"), (F.col("windows") + F.lit(min_words - 1)).alias("n"))).alias("spans"))
    kinds_spans = staged(whole.unionByName(found.join(whole, ["anchor", "d"], "left_anti")), "substring-kind-spans")
    # a text with a copy loses all its words, so its own spans need not be gathered
    placed = candidates.select("k1", "k2", "anchor", "d", "start").join(copied, ["k1", "k2"], "left_anti").join(kinds_spans, ["anchor", "d"])
    placed = placed.select("k1", "k2", F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), s["n"].alias("n"))).alias("spans"))
    inside = segments.where("n = 0").join(copied, ["k1", "k2"], "left_anti").select("k1", "k2", F.array(F.struct("start", F.col("windows").alias("n"))).alias("spans"))
    placed = placed.unionByName(inside).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = staged(copied.withColumn("spans", F.lit(None).cast(_SPANS)).unionByName(placed.withColumn("copies", F.lit(None).cast("long"))), "substring-spans")
    discard(groups, segments, candidates, kinds, wanted, known, kinds_spans)
    return out


def _removed(n_words: int, copies, found, min_words: int) -> np.ndarray:
    """Which of a text's words go."""
    gone = np.zeros(n_words + 1, np.int64)
    if copies and copies > 1 and n_words >= min_words:
        return np.ones(n_words, bool)
    for s in found or ():
        gone[s["start"]] += 1
        gone[s["start"] + s["n"]] -= 1
    return np.cumsum(gone)[:-1] > 0


def with_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row struct, text, copies, spans) of every row of ``docs`` (doc_id, text, ...), ``row`` being the row as it is."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"))
    keyed = keyed.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    found = repeated_spans(keyed.select("k1", "k2", "text", F.col("id").alias("row")), min_words)
    return keyed.join(found, ["k1", "k2"], "left").select("row", "text", "copies", "spans")


def op8_substring_dedup(spark, sf_dir: str, min_words: int = MIN_WORDS) -> DataFrame:
    configured(spark)
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words).select("row.doc_id", "text", "copies", "spans")

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = []
            for text, copies, found in zip(columns["text"], columns["copies"].to_pylist(), columns["spans"], strict=True):
                words = text.as_py().encode().split()
                gone = _removed(len(words), copies, found.as_py(), min_words)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, r, h = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([columns["doc_id"], pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans cut out of their texts and n_chars renewed; white space
    between kept words stays. Texts that lose every word are dropped, others all stay."""
    configured(docs.sparkSession)
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def cut_out(text: str, copies, found) -> tuple[str | None, bool]:
        data = text.encode()
        places = [m.span() for m in word.finditer(data)]
        gone = _removed(len(places), copies, found, min_words)
        if not len(gone) or not gone.any():
            return None, True
        out, cut = [], 0
        for (start, _), g, following in zip(places, gone.tolist(), [p[0] for p in places[1:]] + [len(data)], strict=True):
            if g:
                out.append(data[cut:start])
                cut = following
        out.append(data[cut:])
        return b"".join(out).decode(), not gone.all()

    def run(batches):
        for batch in batches:
            # the new text, or null where it stays as it is
            out = [cut_out(t.as_py(), c, f.as_py()) if c or f.is_valid else (None, True) for t, c, f in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True)]
            texts, keep = zip(*out, strict=True) if out else ((), ())
            arrays = [batch.column(0), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "cut"]).filter(pa.array(keep, pa.bool_()))

    rows = with_spans(docs, min_words)
    rows = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, cut string")
    of = {c: F.col("row").getField(c) for c in docs.columns}
    of["text"] = F.coalesce("cut", of["text"].cast("string"))
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("cut").isNotNull(), F.char_length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(of["n_chars"])
    return rows.select(*[v.alias(c) for c, v in of.items()])


def _automata(reference: DataFrame):
    """Automata of at most ``BROADCAST_WORDS`` words each (more only for a longer single text) of a column of texts."""
    automaton, total = SuffixAutomaton(), 0
    for (text,) in reference.toLocalIterator():
        for _, _, w in tb.chunks(pa.array([text])):
            if total and total + len(w.hash) > BROADCAST_WORDS:
                yield automaton.finish()
                automaton, total = SuffixAutomaton(), 0
            automaton.add(w.hash.tolist())
            total += len(w.hash)
    yield automaton.finish()


def remove_reference_spans(docs: DataFrame, reference: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, spans) of the documents that share ``min_words`` words with a text of ``reference``
    (a column of texts): automata of shards of bounded size, one after the other built on the
    driver, broadcast and let go, and documents streamed past each. For references beside the
    corpus, such as benchmarks; a corpus is compared with itself by ``repeated_spans``."""
    spark, found = configured(docs.sparkSession), []
    kind = f"doc_id long, spans {_SPANS}"
    for automaton in _automata(reference):
        held = spark.sparkContext.broadcast(automaton)

        def run(batches, held=held):
            for batch in batches:
                ids, out = [], []
                for row, n, w in tb.chunks(batch.column(1)):
                    for i in range(n):
                        if got := spans(held.value.matching_statistics(w.hash[w.first[i] : w.first[i + 1]].tolist()), min_words):
                            ids.append(batch.column(0)[row + i].as_py())
                            out.append([{"start": a, "n": b} for a, b in got])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, _SPAN)], names=["doc_id", "spans"])

        found.append(staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kind), "reference-spans"))
        held.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


OP8_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         row_number() OVER () AS r
  FROM documents),
windows AS (
  SELECT r, s, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS s FROM docs WHERE len(w) >= 35)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, s + k AS p FROM windows JOIN often USING (h), (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM docs),
kept AS (
  SELECT words.r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.r = docs.r
"""

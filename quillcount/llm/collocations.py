"""Phrase collocations: SPAM-style compressed position bitmaps, extended depth-first in shards of the corpus.

A shard is at most ``SHARD_BYTES`` of one language's texts. Its words get
positions, with one position left free between pieces, and each word a bitmap
of its positions: the 16-bit blocks that are not empty, as (block, bits). A
phrase's bitmap (the places of its last word) grows by a word when it is
shifted by one and ANDed with the bitmaps of the words in the blocks that it
touches; set bits are its occurrences, and the free positions keep it within
its piece. Phrases are extended depth-first by groups of first words.

Counts are summed over shards: words first, so that only words that are
frequent in the whole corpus keep a bitmap; then pairs; then, in shards, only
phrases whose every pair is frequent grow to three and four words. Nothing that
could be a candidate is lost, as a phrase is never more frequent than its parts.
Words are joined by ids that are unique, not by hashes, so counts are exact.

A word or pair that is everywhere has one row for each shard, not for each
occurrence, when it is shuffled; a language that holds most rows is cut into
shards; no table is broadcast by hint.

Defined results: null and empty texts have no words; a null language is
``und``; languages without words have no rows; very long texts are cut between
pieces; a piece is never cut; repeated rows count each; ids are not read, so
they may be null or repeated; other columns are not read; equal scores and
counts are in the order of phrases; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import configured, discard, staged, table

#: Least occurrences of a candidate, most words, share in hundredths that drops a part, phrases for each language.
LEAST, LONGEST, ABSORBED, PHRASES = 30, 4, 80, 2000
#: Bytes of text in a shard, unless a single piece is longer.
SHARD_BYTES = 8 << 20
#: Bitmap entries that are extended at once.
GROUP = 1 << 16
WIDTH = 16
#: Bits of a shard's number within its task, and of a count that is sent beside it.
SHARD_BITS, COUNT_BITS = 23, 20
#: Parts of a language that are ranked apart before they are ranked together.
PARTS = 64

_OTHER, _SPACE, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
UNKNOWN = "und"


@dataclass
class Bitmaps:
    """Bitmaps of a shard's words: entries in the order of blocks, ``first[b]:first[b + 1]`` are those of block b."""

    block: np.ndarray  # int32
    word: np.ndarray  # int32, a number within the shard
    bits: np.ndarray  # uint32, the lower 16 bits
    first: np.ndarray

    @classmethod
    def of(cls, block, word, bits) -> Bitmaps:
        return cls(block, word, bits.astype(np.uint32), np.searchsorted(block, np.arange((int(block[-1]) if len(block) else 0) + 3)))

    @classmethod
    def at(cls, position: np.ndarray, word: np.ndarray, words: int) -> Bitmaps:
        """From the positions of words."""
        key = (position // WIDTH).astype(np.int64) * words + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        bit = np.left_shift(np.uint32(1), (position % WIDTH).astype(np.uint32))[order]
        bits = np.bitwise_or.reduceat(bit, start) if len(start) else np.empty(0, np.uint32)
        return cls.of((key[start] // max(words, 1)).astype(np.int32), (key[start] % max(words, 1)).astype(np.int32), bits)

    def only(self, keep: np.ndarray, number: np.ndarray) -> Bitmaps:
        """The words that ``keep`` marks, renumbered."""
        own = keep[self.word]
        return Bitmaps.of(self.block[own], number[self.word[own]], self.bits[own])

    def extended(self, owner: np.ndarray, block: np.ndarray, bits: np.ndarray):
        """Shift and AND: (owner, word, block, bits) of every phrase that goes on by one word."""
        moved = bits << np.uint32(1)
        stay, over = moved & np.uint32((1 << WIDTH) - 1), moved >> np.uint32(WIDTH)
        a, b = np.flatnonzero(stay), np.flatnonzero(over)
        source = np.concatenate((a, b))
        block = np.concatenate((block[a], block[b] + 1))
        bits = np.concatenate((stay[a], over[b]))
        low = self.first[block]
        n = self.first[block + 1] - low
        total = int(n.sum())
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
        row = np.repeat(np.arange(len(block)), n)
        both = bits[row] & self.bits[place]
        hit = np.flatnonzero(both)
        row, place = row[hit], place[hit]
        return owner[source[row]], self.word[place], block[row], both[hit]

    def packed(self) -> bytes:
        step = np.diff(self.block, prepend=np.int32(0)).astype(np.uint32)
        return zstandard.ZstdCompressor(level=3).compress(np.array([len(step)], np.int64).tobytes() + step.tobytes() + self.word.tobytes() + self.bits.astype(np.uint16).tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Bitmaps:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        block = np.cumsum(np.frombuffer(raw, np.uint32, n, 8)).astype(np.int32)
        return cls.of(block, np.frombuffer(raw, np.int32, n, 8 + 4 * n), np.frombuffer(raw, np.uint16, n, 8 + 8 * n))


def _popcounts(key: np.ndarray, bits: np.ndarray):
    """Distinct keys, occurrences of each, and each entry's place among them."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
    start = np.flatnonzero(new)
    n = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), start) if len(start) else np.empty(0, np.int64)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[start], n, place


def phrases(maps: Bitmaps, words: int, longest: int, pairs: np.ndarray | None = None, group: int = GROUP):
    """(words as rows, occurrences) of phrases of 2, or else of 3 up to ``longest`` words, by groups of first words.

    ``pairs``: sorted numbers first * words + second of the pairs of which longer phrases may consist.
    """
    order = np.argsort(maps.word, kind="stable")
    word, block, bits = maps.word[order], maps.block[order], maps.bits[order]
    ends = np.concatenate((np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)])) if len(word) else np.empty(0, np.int64)
    at = 0
    while at < len(word):
        stop = int(ends[max(np.searchsorted(ends, at + group, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        owner, b, m = word[at:stop].astype(np.int64), block[at:stop], bits[at:stop]
        known, last = np.arange(words)[:, None], np.arange(words)
        at = stop
        for size in range(2, longest + 1):
            owner, then, b, m = maps.extended(owner, b, m)
            if pairs is not None:
                pair = last[owner] * words + then
                place = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
                on = np.flatnonzero(pairs[place] == pair) if len(pairs) else np.empty(0, np.int64)
                owner, then, b, m = owner[on], then[on], b[on], m[on]
            if not len(owner):
                break
            key, n, place = _popcounts(owner * words + then, m)
            known, last, owner = np.column_stack((known[key // words], key % words)), key % words, place
            if size > 2 or pairs is None:
                yield known, n


def _cut(text: bytes, limit: int):
    """Parts of a text of at most ``limit`` bytes that end between pieces, or longer ones where a piece is."""
    if len(text) <= limit:
        return [text]
    data = np.frombuffer(text, np.uint8)
    ends, out, at = np.append(np.flatnonzero(_KIND[data] == _CUT) + 1, len(text)), [], 0
    while at < len(text):
        stop = int(ends[max(np.searchsorted(ends, at + limit, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        out.append(text[at:stop])
        at = stop
    return out


def shard_of(texts: list[bytes]):
    """(distinct words, occurrences of each, bitmaps) of texts."""
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[data]
    inside = kind == _OTHER
    edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == _CUT, dtype=np.int32)[start]
    position = np.arange(len(start)) + (np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1]))) if len(start) else 0)
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    code = found.indices.to_numpy()
    names = found.dictionary.cast(pa.large_string()).cast(pa.string())
    return names, np.bincount(code, minlength=len(names)), Bitmaps.at(position, code.astype(np.int64), len(names))


_SHARD = "shard long, lang string, words array<string>, occurrences array<long>, bitmaps binary"


def shards(docs: DataFrame, lang: str = "lang", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard: its language, distinct words with their occurrences, and packed bitmaps."""
    configured(docs.sparkSession)

    def run(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, {}

        def flush(name):
            nonlocal made
            words, n, maps = shard_of(held.pop(name))
            size.pop(name)
            made += 1
            one = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << SHARD_BITS) + made]), pa.array([name]), pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(n, pa.int64())), pa.array([maps.packed()], pa.binary())],
                names=["shard", "lang", "words", "occurrences", "bitmaps"],
            )

        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                for part in _cut(value.as_py(), limit):
                    if name in held and size[name] + len(part) > limit:
                        yield from flush(name)
                    held.setdefault(name, []).append(part)
                    size[name] = size.get(name, 0) + len(part) + 1
        for name in list(held):
            yield from flush(name)

    some = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).where("text <> ''")
    return some.mapInArrow(run, _SHARD)


_KEPT = "shard long, words array<long>, bitmaps binary"


def _kept_bitmaps(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's bitmaps with only the words of ``right`` (place, id), renumbered in the order of ids."""
    rows = []
    if left.num_rows and right.num_rows:
        place, ids = right.column("place").to_numpy(), right.column("id").to_numpy()
        order = np.argsort(ids)
        place, ids = place[order], ids[order]
        maps = Bitmaps.unpacked(left.column("bitmaps")[0].as_py())
        keep, number = np.zeros(int(max(place.max(), maps.word.max(initial=0))) + 1, bool), np.zeros(int(max(place.max(), maps.word.max(initial=0))) + 1, np.int32)
        keep[place], number[place] = True, np.arange(len(place), dtype=np.int32)
        rows = [{"shard": left.column("shard")[0].as_py(), "words": ids.tolist(), "bitmaps": maps.only(keep, number).packed()}]
    return pa.Table.from_pylist(rows, schema=pa.schema([("shard", pa.int64()), ("words", pa.list_(pa.int64())), ("bitmaps", pa.binary())]))


def _pairs_of(batches):
    most = (1 << COUNT_BITS) - 1
    for batch in batches:
        for shard, ids, data in zip(*[batch.column(i) for i in range(3)], strict=True):
            words = ids.values.to_numpy()
            for known, n in phrases(Bitmaps.unpacked(data.as_py()), len(words), 2):
                # a count that does not fit is sent in several rows
                times = -(-n // most)
                row = np.repeat(np.arange(len(n)), times)
                part = np.minimum(n[row] - most * (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)), most)
                yield pa.RecordBatch.from_arrays([*[pa.array(words[known[row, i]]) for i in (0, 1)], pa.array((shard.as_py() << COUNT_BITS) + part)], names=["w1", "w2", "shard_n"])


def _longer(longest: int):
    schema = pa.schema([*[(f"w{i}", pa.int64()) for i in range(1, longest + 1)], ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            words = left.column("words")[0].values.to_numpy()
            place = [np.searchsorted(words, right.column(w).to_numpy()) for w in ("w1", "w2")]
            pairs = np.unique(place[0] * len(words) + place[1])
            for known, n in phrases(Bitmaps.unpacked(left.column("bitmaps")[0].as_py()), len(words), longest, pairs):
                ids = words[known]
                ids = np.column_stack([ids, np.zeros((len(n), longest - ids.shape[1]), np.int64)])
                out.append(pa.RecordBatch.from_arrays([*[pa.array(ids[:, i]) for i in range(longest)], pa.array(n)], schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run, ", ".join(f"w{i} long" for i in range(1, longest + 1)) + ", n long"


@dataclass
class Counted:
    """Staged counts: words (lang, word, id, f), phrases of at least two words (w1.., size, f), sizes of languages (lang, n)."""

    words: DataFrame
    phrases: DataFrame
    totals: DataFrame


def counted(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, limit: int = SHARD_BYTES) -> Counted:
    """Exact counts, by language, of all phrases of up to ``longest`` words with ``least`` occurrences or more."""
    made = staged(shards(docs, lang, text, limit), "collocation-shards")
    totals = staged(made.select("lang", F.aggregate("occurrences", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "collocation-totals")
    # a word has a row for each shard; the least of their numbers is its id, so sums and ids are one shuffle
    thin = made.select("shard", "lang", F.posexplode(F.arrays_zip("words", "occurrences")).alias("place", "x")).select("shard", "lang", "place", F.col("x.words").alias("word"), F.col("x.occurrences").alias("n"))
    own = Window.partitionBy("lang", "word")
    known = thin.withColumn("row", F.monotonically_increasing_id() + 1).withColumns({"f": F.sum("n").over(own), "id": F.min("row").over(own)}).where(F.col("f") >= least)
    known = staged(known.select(F.col("shard").alias("of"), "place", "lang", "word", "f", "id"), "collocation-known")
    words = staged(known.groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.first("f").alias("f")), "collocation-words")
    kept = made.select("shard", "bitmaps").groupBy("shard").cogroup(known.select("of", "place", "id").groupBy("of"))
    kept = staged(kept.applyInArrow(_kept_bitmaps, _KEPT), "collocation-bitmaps")
    discard(made, known)

    # a pair has a row for each shard, so the sum over all shards and the way back to them are one shuffle
    pairs = kept.mapInArrow(_pairs_of, "w1 long, w2 long, shard_n long")
    pairs = pairs.withColumn("f", F.sum(F.col("shard_n").bitwiseAND((1 << COUNT_BITS) - 1)).over(Window.partitionBy("w1", "w2"))).where(F.col("f") >= least)
    pairs = staged(pairs.select(F.shiftright("shard_n", COUNT_BITS).alias("shard"), "w1", "w2", "f"), "collocation-pairs")
    zero = [F.lit(0).cast("long").alias(f"w{i}") for i in range(3, longest + 1)]
    found = pairs.groupBy("w1", "w2").agg(F.first("f").alias("f")).select("w1", "w2", *zero, F.lit(2).alias("size"), "f")
    if longest > 2:
        run, schema = _longer(longest)
        more = kept.groupBy("shard").cogroup(pairs.select("shard", "w1", "w2").groupBy("shard")).applyInArrow(run, schema)
        names = [f"w{i}" for i in range(1, longest + 1)]
        more = more.groupBy(*names).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        size = sum(((F.col(w) > 0).cast("int") for w in names[1:]), F.lit(1))
        found = found.unionByName(more.select(*names, size.alias("size"), "f"))
    found = staged(found, "collocation-phrases")
    discard(kept, pairs)
    return Counted(words, found, totals)


def _part(names: list[str], start: int, length: int) -> Column:
    """Key of ``length`` words from ``start`` on, filled up with zeros."""
    return F.array(*[F.col(names[start + i]) if i < length else F.lit(0).cast("long") for i in range(len(names))])


def collocations(c: Counted, phrases: int = PHRASES, absorbed: int = ABSORBED) -> DataFrame:
    """The first phrases of each language by score: lang, rank, phrase, a, l, r, n, score."""
    names = [x for x in c.phrases.columns if x.startswith("w")]
    longest = len(names)
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    whole = c.phrases.withColumn("key", F.array(*names))
    single = F.array(F.col("id"), *[F.lit(0).cast("long")] * (longest - 1))
    counts = whole.where(F.col("size") < longest).select("key", "f").unionByName(c.words.select(single.alias("key"), "f"))

    def cuts(size: int) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), _part(names, 0, k).alias("left"), _part(names, k, size - k).alias("right")) for k in range(1, size)])

    def inner(size: int) -> Column:
        return F.array(*[_part(names, i, n) for n in range(2, size) for i in range(size - n + 1)])

    def by_size(of, low: int) -> Column:
        out = F.when(F.col("size") == low, of(low))
        for size in range(low + 1, longest + 1):
            out = out.when(F.col("size") == size, of(size))
        return out

    kept = whole
    if longest > 2:
        longer = whole.where(F.col("size") > 2).select(F.explode(by_size(inner, 3)).alias("key"), F.col("f").alias("within")).groupBy("key").agg(F.max("within").alias("within"))
        kept = whole.join(longer, "key", "left").where(F.col("within").isNull() | (wide("within") * 100 < wide("f") * absorbed))
    parts = kept.select("key", F.col("f").alias("a"), F.explode(by_size(cuts, 2)).alias("x")).select("key", "a", "x.*")
    parts = parts.join(counts.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(counts.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.call_function("div", wide("a") * F.lit(2_000_000).cast("decimal(10,0)"), wide("l") + wide("r")).cast("long")
    least = parts.withColumn("score", score).groupBy("key").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("key", "x.*")
    named = least.join(c.words.select(F.col("id").alias("first"), "lang"), F.col("key")[0] == F.col("first")).drop("first")
    # first within parts of a language, so that what one task puts in order is bounded; ties at the last place stay until phrases are spelled out
    first = named.withColumn("part", F.abs(F.hash("key")) % PARTS)
    for by in (["lang", "part"], ["lang"]):
        first = first.withColumn("place", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= phrases)
    spelled = first.select("*", F.posexplode("key").alias("i", "id")).join(c.words.select("id", "word"), "id")
    spelled = spelled.groupBy("key", "lang", "score", "a", "l", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return spelled.withColumn("rank", rank.cast("long")).where(F.col("rank") <= phrases).join(c.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(counted(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
counts AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS size) s WHERE i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f FROM counts WHERE size > 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i : i + part - 1], ' ') AS phrase, max(f) AS within
  FROM candidates, (SELECT unnest([2, 3]) AS part) p, (SELECT unnest([1, 2, 3]) AS i) s WHERE part < size AND i + part - 1 <= size GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, phrase) WHERE within IS NULL OR 100 * within::HUGEINT < 80 * f::HUGEINT),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * c.f // (l.f + r.f) AS BIGINT) AS score
  FROM kept c, (SELECT unnest([1, 2, 3]) AS k) s, counts l, counts r
  WHERE k < c.size AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(w[1 : k], ' ') AND r.phrase = array_to_string(w[k + 1 : c.size], ' ')),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

"""Collocations against a count in plain Python, bitmaps against positions, and defined results."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcount.llm import collocations as co


def brute(rows, least, phrases, longest=4):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows, by the definition."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[(lang, tuple(words[i : i + k]))] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                if 100 * a >= 80 * candidates[part]:
                    gone.add(part)
    out = []
    for lang in sorted(n):
        scored = []
        for (own, words), a in candidates.items():
            if own == lang and (own, words) not in gone:
                cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(words).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:phrases], 1)]
    return out


def drawn(seed, texts, words=12, marks=". , ; \n \t ! ? : \x0b"):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "OF", "öl", "x y", "ß", "a-b", "7", "zu", "ein", "Été", "z"][:words]
    out = []
    for _ in range(texts):
        lang = rng.choice(["en", "en", "en", "de", None, "und"])
        text = "".join(rng.choice([w for k, w in enumerate(vocabulary) for _ in range(words - k)]) + rng.choice([" "] * 12 + ["  ", *marks.split(" ")]) for _ in range(rng.randint(0, 60)))
        out.append((lang, text + rng.choice([" once upon a TIME", "", " ein zu", " upon", " time"])))
    return out


def rows_of(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


def test_bitmaps_shift_over_block_ends():
    rng = np.random.default_rng(5)
    word = rng.integers(0, 5, 400)
    position = np.arange(400) + np.cumsum(rng.random(400) < 0.2)
    maps = co.Bitmaps.unpacked(co.Bitmaps.at(position, word, 5).packed())
    at = dict(zip(position.tolist(), word.tolist(), strict=True))
    for group in (1, 30, 10_000):
        got = Counter()
        for known, n in co.phrases(maps, 5, 4, np.arange(25), group):
            for k, c in zip(known.tolist(), n.tolist(), strict=True):
                got[tuple(k)] += c
        want = Counter()
        for p in at:
            for size in (3, 4):
                run = [at.get(p + i) for i in range(size)]
                if None not in run:
                    want[tuple(run)] += 1
        assert got == want


@pytest.mark.parametrize(("limit", "parts"), [(1 << 22, 3), (200, 7), (1, 2)])
def test_against_brute_force(spark, limit, parts):
    data = drawn(limit, 400)
    df = spark.createDataFrame(data, "lang string, text string").repartition(parts)
    got = rows_of(co.collocations(co.counted(df, least=6, limit=limit), phrases=40))
    assert got == brute(data, 6, 40) and len({r[0] for r in got}) == 3 and any(r[2].count(" ") == 3 for r in got)


def test_longest_of_two_and_three(spark):
    data = drawn(9, 200)
    df = spark.createDataFrame(data, "lang string, text string")
    for longest in (2, 3):
        assert rows_of(co.collocations(co.counted(df, least=5, longest=longest), phrases=30)) == brute(data, 5, 30, longest)


def test_defined_results(spark):
    # one phrase in a third of all rows, one piece without an end, ties, nulls, repeated rows, clashing names
    long = "up and down " * 20_000
    data = [("en", "good morning to you. " * 3)] * 30 + [(None, "b a, b a; c a. c a")] * 20 + [("de", None), ("de", ""), ("fr", " \t\n"), ("en", long)]
    df = spark.createDataFrame(data, "lang string, text string").withColumn("n", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("word", F.lit(2))
    got = rows_of(co.collocations(co.counted(df, limit=1000)))
    assert got == brute(data, 30, 2000)
    assert [r[:3] for r in got if r[0] == "und"] == [("und", 1, "b a"), ("und", 2, "c a")]
    assert ("en", "good morning to you", 90) in {(r[0], r[2], r[3]) for r in got}
    assert co.collocations(co.counted(df.limit(0))).collect() == []
    assert co.collocations(co.counted(df.where("lang = 'fr'"))).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 5 * 10**12
    words = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 2, 2 * big + 1)], "lang string, word string, id long, f long")
    phrases = spark.createDataFrame([(1, 2, 0, 0, 2, big - 1)], "w1 long, w2 long, w3 long, w4 long, size int, f long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    row = co.collocations(co.Counted(words, phrases, totals)).collect()[0]
    assert row["score"] == 2_000_000 * (big - 1) // (3 * big + 1) and 2_000_000 * (big - 1) > 2**63


def test_counts_that_do_not_fit_are_sent_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(co, "COUNT_BITS", 3)
    _, n, maps = co.shard_of([b"a b " * 20 + b". c a b"])
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([[10, 20, 30]]), pa.array([maps.packed()])], names=["shard", "words", "bitmaps"])
    got = Counter()
    rows = 0
    for out in co._pairs_of([batch]):
        for r in out.to_pylist():
            assert r["shard_n"] >> 3 == 5 and 0 < r["shard_n"] & 7 <= 7
            got[r["w1"], r["w2"]] += r["shard_n"] & 7
            rows += 1
    assert got == {(10, 20): 21, (20, 10): 19, (30, 10): 1} and rows == 3 + 3 + 1 and n.tolist() == [21, 21, 1]

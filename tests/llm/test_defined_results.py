"""Nulls, very long texts, ties, repeated rows, empty tables and clashing names, operator by operator and stage by stage."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillcount.llm import fingerprint, mixing, near_dup, packing, quality, substring, vectors, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k}" for k in range(60_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use or add themselves.
CLASHES = ("target", "_key", "key", "part", "size", "spans", "copies", "k1", "k2", "row", "block", "host", "digest", "component_id", "kept", "stats", "words", "cut", "name", "none", "n")


def documents(spark, texts, ids=None):
    rows = [((ids or range(len(texts)))[k], t, None, ["a", None][k % 2], len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES])


def untouched(rows):
    return all(r[c] == f"{c}-{r.doc_id if r.doc_id is not None else 'null'}" for r in rows for c in CLASHES)


TEXTS = [None, "", "one two", LONG, LONG, "a b c d e f g h", "a b c d e f g h", " ".join(f"q{k}" for k in range(50)), "z " * 40]


def test_clashing_names_are_carried(spark):
    docs = clashing(documents(spark, TEXTS, [0, 1, 2, 3, 4, 5, 5, None, 8]))
    cut = substring.without_repeats(docs)
    assert cut.columns == docs.columns and untouched(cut.collect())
    near = near_dup.without_near_copies(docs)
    assert near.columns == docs.columns and untouched(near.collect())
    mix = mixing.materialised(docs)
    assert mix.columns == docs.columns and untouched(mix.collect())
    plan = mixing.mixed(docs).collect()
    assert all(r["target_"].startswith("target-") and r["part_"].startswith("part-") and r["size_"].startswith("size-") and isinstance(r["target"], float) for r in plan)
    model = quality.Discriminant((), (), (), ())
    kept = quality.kept_by_quality(docs, model)
    assert kept.columns == docs.columns and untouched(kept.collect()) and kept.count() == len(TEXTS)
    assert packing.pieces(docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert quality.with_statistics(docs).count() == len(TEXTS)
    assert fingerprint.with_next(docs.select("doc_id", "text", *[c for c in CLASHES]), ["text"]).count() == len(TEXTS)


def test_near_dedup_null_ids_and_long_texts(spark):
    docs = documents(spark, [LONG, LONG + " end", None, "", "x y", "X Y", "a"], [7, 3, None, 4, 9, 8, None])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in near_dup.near_groups(docs).collect())
    assert got == [(-1, 0, None), (-1, 1, None), (3, 59_997, 3), (4, 0, 4), (7, 59_996, 3), (8, 1, 8), (9, 1, 8)]


def test_substring_null_ids_and_repeated_rows(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [f"a {passage} b", f"c {passage} d", None, f"{passage} {passage}", "same text", "same text", LONG, "lone " + " ".join(f"l{k}" for k in range(36))]
    docs = documents(spark, texts, [None, 1, 2, 3, 4, 4, 6, None])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in substring.without_repeats(docs).collect())
    assert got == sorted([(-1, "a b"), (1, "c d"), (2, ""), (4, "same text"), (4, "same text"), (6, LONG), (-1, texts[-1])])


def test_substring_of_periodic_texts(spark):
    """The same anchors over and over, in a text and among texts, on every level of splitting."""
    texts = ["ab cd " * 200, "ab cd " * 150 + "end", "ab cd ef " * 100, "x " * 35, "x " * 34, "x " * 36 + "y"] + [f"u{k} " + "ab cd " * 17 + f"v{k}" for k in range(30)]
    for most in (100_000, 200, 10):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(substring, "SHARD_WORDS", most)
            docs = documents(spark, texts)
            got = {r.doc_id: " ".join(WORD.findall(r.text)) for r in substring.without_repeats(docs).collect()}
        words = [WORD.findall(t) for t in texts]
        seen = {}
        for w in words:
            for i in range(len(w) - 34):
                seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
        want = {}
        for k, w in enumerate(words):
            gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
            if kept := [x for i, x in enumerate(w) if i not in gone]:
                want[k] = " ".join(kept)
        assert got == want


def test_fingerprints_recounted(spark, tmp_path):
    """Sketches, likenesses and successors by brute force, with hashes that Spark gives for single shingles."""
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("abcd"), 3)) for _ in range(n))
    texts = ["the cat sat", "a dog ran", "blue", "green", None, "", prose(60), prose(61), prose(300), LONG, "É B\x0bC d e F g", "same same", "same same"]
    ids = [5, 3, 40, 41, 2**40, -7, 9, 10, 11, 12, 13, 1_000, 1_001]
    documents(spark, texts, ids).withColumn("_cuts", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in fingerprint.op7_document_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(WORD.findall(t.lower()))
    edited = {}
    for at, (k, t) in enumerate(order):
        half, following = len(t) // 2, order[(at + 1) % len(order)][1]
        edited[k] = t[: len(t) - half] + following[:half]
    known = sorted({s for t in [*dict(order).values(), *edited.values()] for s in shingles(t)})
    hashes = [r.h for r in spark.createDataFrame([(i, list(s)) for i, s in enumerate(known)], "i int, s array<string>").select("i", F.xxhash64("s").alias("h")).orderBy("i").collect()]
    of = dict(zip(known, hashes, strict=True))

    def sketch(t):
        h = {of[s] for s in shingles(t)}
        low = {x for x in h if x < -(2**63) + 2**62}
        return low or ({min(h)} if h else set())

    def alike(a, b):
        x, y = sketch(a), sketch(b)
        return 1.0 if not x and not y else len(x & y) / len(x | y)

    def printed(t):
        n = max(0, max(1, len(w) - 4)) if (w := WORD.findall(t.lower())) else 0
        return f"{n}:" + "".join(f"{x % 2**64:016X}" for x in sorted(sketch(t)))

    for at, (k, t) in enumerate(order):
        r, following = got[k], order[(at + 1) % len(order)][1]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited[k].encode()).hexdigest()
        assert r.fingerprint == printed(t) and r.edited_fingerprint == printed(edited[k])
        assert r.near_edited == pytest.approx(alike(t, edited[k])) and r.near_next == pytest.approx(alike(t, following))


def test_ranges_of_ids_follow_the_texts(spark, monkeypatch):
    for bytes_, each in ((1, 16), (1 << 20, 1)):
        monkeypatch.setattr(fingerprint, "RANGE_BYTES", bytes_)
        monkeypatch.setattr(fingerprint, "RANGES_EACH", each)
        docs = spark.range(300).select((F.col("id") * F.col("id") - 40_000).alias("doc_id"), F.lit("xy").alias("text"))
        got = {r.doc_id: r.n for r in fingerprint.with_next(docs.withColumn("own", F.col("doc_id")), ["own"]).select("doc_id", F.col("next_own").alias("n")).collect()}
        ids = [k * k - 40_000 for k in range(300)]
        assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_statistics_recounted():
    """The fifteen statistics of each text by plain loops."""
    rng = np.random.default_rng(3)
    texts = [None, "", "One two, two!! TWO? 3 $5 a-b (c)", "é世 ÀB\n\nx\ty\x0b", "go go go now go go go", "#### ---- ....", LONG[:100_000]] + ["".join(rng.choice(list("aB1 .!\né$"), 80)) for _ in range(20)]
    got = quality.statistics(pa.array(texts))
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    ratio = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5) * (1 / (1 + 1 / (whole + 1.0))))
    for row, text in zip(got, texts, strict=True):
        data = (text or "").encode()
        words = data.split()
        n, size = len(words), len(data)
        lengths = [len(w) for w in words]
        mean = sum(lengths) / max(n, 1)
        spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
        letters = sum(map(letter, data))
        marks, shouts = b".,;:'\"()-", b"!?"
        symbols = sum(33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127 for b in data if b not in marks + shouts)
        triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
        want = [
            math.log1p(n), math.log1p(mean), math.log1p(spread), ratio(sum(65 <= b <= 90 for b in data), letters), ratio(sum(48 <= b < 58 for b in data), size), ratio(sum(b in marks for b in data), size),
            ratio(sum(b in shouts for b in data), size), ratio(symbols, size), ratio(sum(not any(map(letter, w)) for w in words), n), ratio(sum(not letter(w[-1]) and not 48 <= w[-1] < 58 for w in words), n),
            ratio(data.count(b"\n"), n), ratio(sum(b >= 0xC0 for b in data), letters), math.log1p(len(set(words))) - math.log1p(n), ratio(sum(a == b for a, b in zip(words, words[1:])), n), ratio(len(triples) - len(set(triples)), len(triples)),
        ]
        assert row == pytest.approx(want, abs=1e-9), text


def test_warc_clashing_names_and_long_payloads(spark, tmp_path):
    rows = [(1, "http://a/", LONG, "t"), (1, "http://a/", LONG, "u"), (None, None, None, None), (5, "http://b/", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, type string").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit(1))
    warc.write_archives(df, str(tmp_path / "w"))
    got = sorted((r.page_id or 0, r.type, r.payload_bytes, r.problem) for r in warc.read_archives(spark, str(tmp_path / "w")).collect())
    assert got == [(0, "revisit", 0, None), (1, "response", len(LONG), None), (1, "revisit", len(LONG), None), (5, "response", 0, None)]


def test_mixing_ties_nulls_and_deep_ranges(spark, monkeypatch):
    """Equal keys and sizes, null ids, ranges cut again: the target is met and no document exceeds its clamp."""
    texts = ["w " * (k % 7) for k in range(400)] + [None]
    docs = documents(spark, texts, [k % 50 for k in range(400)] + [None])
    for words in (1 << 20, 20):
        monkeypatch.setattr(mixing, "RANGE_WORDS", words)
        rows = mixing.mixed(docs).collect()
        assert len(rows) == 401 and all(0 <= r.taken <= 2 * r.size for r in rows)
        for s in ("a", None):
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_many_sources_are_ranked_by_ranges(spark):
    names = sorted(f"s{k * 7919 % 1000:03d}é" for k in range(200)) + [None]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "source string")
    got = {r.source: r.weight for r in mixing.with_cyclic_weights(df).collect()}
    assert got == {n: (3.0, 1.0, 2.0)[k % 3] for k, n in enumerate(names)}


def test_packing_ties_are_stable(spark):
    rows = [(k % 3, k, 0, 700, k) for k in range(30)]
    df = lambda part: spark.createDataFrame(rows, packing.PIECES).repartition(part)
    out = [sorted((r.doc_id, r.piece, r.sequence_id, r.offset) for r in packing.packed(df(n)).collect()) for n in (1, 3)]
    assert out[0] == out[1]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "piece", "start"]


def test_pipeline_stages_with_nulls_repeats_and_clashes(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing(documents(spark, TEXTS, [0, 1, 2, 3, 4, 5, 5, None, 8]))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "best-fit packing":
            assert out.where("piece = 0").count() == len(TEXTS)
        else:
            assert out.columns == cp.COLUMNS and out.count() >= 5, name


def test_vectors_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5, "x"), (2, [1.0, 0.01], 1, 6, "y")], "vec_id long, embedding array<float>, label int, cid long, block string")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.linked(df).collect()) == [(1, 1, 1), (2, 1, 1)]

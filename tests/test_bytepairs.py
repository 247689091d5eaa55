"""Byte-pair counts by dictionary against the encoder, text by text."""

import random

import pytest
from pyspark.sql import functions as F

from quillcount.functions import counters as cn
from quillcount.operators import bytepairs as bp

P = pytest.importorskip("public_tokenizers")
VOCABULARY = cn.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
#: The pattern of a later vocabulary: contractions of any case, numbers of three digits, line ends after marks.
LATER = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"


def drawn(rng, most):
    parts = ["the", " the", "The", " caf", "é", "ß", "漢字", " 12345", "don't", "'S", "'ll", "\n", "\n\n", "  ", "\t", " ", " ", "...", " !?", "\r\n", "\U0001f600", "é", "_", "<|endoftext|>", "x" * 40, "ab" * 90]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, most)))


def test_merges_are_those_of_the_encoder():
    ranks, encoder = bp.ranks_of(VOCABULARY.rank_file), cn._encoding(VOCABULARY.rank_file, VOCABULARY.pattern)
    rng = random.Random(2)
    pieces = [rng.randbytes(rng.randint(1, 40)) for _ in range(2000)] + [bytes(rng.choice(b"aab n") for _ in range(rng.randint(1, 300))) for _ in range(500)] + [b"a" * 1000, b"\x00", b" internationalization"]
    assert all(bp.merged(p, ranks) == encoder._encode_single_piece(p) for p in pieces)


@pytest.mark.parametrize("pattern", [P.PATTERN, LATER])
def test_corpus_against_the_encoder(spark, pattern):
    rng = random.Random(len(pattern))
    v = cn.Vocabulary(VOCABULARY.rank_file, pattern)
    rows = [(i, drawn(rng, 40)) for i in range(400)] + [(900, None), (901, ""), (902, " "), (903, drawn(rng, 9000)), (None, "one"), (None, "two words"), (904, "end\n\n"), (905, "x" * 70_000)]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("piece", F.lit("clash")).repartition(5)
    want = {}
    for k, t in rows:
        want[k] = want.get(k, 0) + len(cn.byte_pair_ids(v, t or ""))
    assert {r["k"]: r["tokens"] for r in bp.counted(df, ["k"], "t", v).collect()} == want
    assert bp.counted(df.limit(0), ["k"], "t", v).collect() == []


def test_cuts_of_long_texts_change_nothing(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(drawn(rng, 300),) for _ in range(100)], "t string")
    for pattern in (P.PATTERN, LATER):
        parts = F.flatten(F.transform(bp.stretches(F.col("t"), 7), lambda p: bp.pre_tokens(p, pattern)))
        r = df.select(F.count_if(parts != bp.pre_tokens(F.col("t"), pattern)).alias("other"), F.count_if(F.array_join(bp.stretches(F.col("t"), 7), "") != F.col("t")).alias("lost"), F.max(F.size(bp.stretches(F.col("t"), 7))).alias("most")).first()
        assert r["other"] == 0 and r["lost"] == 0 and r["most"] > 10


def test_whole_tables_against_the_encoder(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = {r["doc_id"]: len(cn.byte_pair_ids(VOCABULARY, r["text"] or "")) for r in df.collect()}
    assert {r["doc_id"]: r["tokens"] for r in bp.counted(df, ["doc_id"], "text", VOCABULARY).collect()} == want


def requests_of(spark, seed, pieces, most):
    rng = random.Random(seed)
    rows = [(f"r{i}", "file", f"{rng.randint(0, 9)}-{j}" + rng.choice(["", '"', " é"]), rng.choice([drawn(rng, 6), rng.choice(pieces)])) for i in range(8) for j in range(rng.randint(0, most))]
    return spark.createDataFrame(rows + [("same", "file", "x", "b b"), ("same", "file", "x", "a"), ("none", "file", "x", "")], "request_id string, kind string, label string, text string").repartition(3)


@pytest.mark.parametrize("pattern", [P.PATTERN, LATER])
def test_requests_without_assembly(spark, pattern):
    from quillcount.operators import analyze as an

    v = cn.Vocabulary(VOCABULARY.rank_file, pattern)
    sources = requests_of(spark, 5, ["a", " ", "\n", "\n\n", "...", "end.\n", " x", "x ", "12", "word word", "!\n \n", "\t", "a b.", "'s"], 30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["request_id"]: (r["raw"], r["wrapped"]) for r in bp.request_counts(sources, v).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r["request_id"]: tuple(len(cn.byte_pair_ids(v, r[p])) for p in ("raw", "wrapped")) for r in an.assembled(sources).collect()}
    assert got == want and len(want) >= 8


def test_analysis_by_a_vocabulary(spark, monkeypatch):
    from quillcount.operators import analyze as an
    from quillcount.sources import catalog as cat

    sources = requests_of(spark, 11, ["a", "word\n", "..."], 9)
    sources = an.text_sources(sources, F.col("request_id"), F.col("label"), F.col("text"))
    models = cat.models(spark, cat.default_catalog(), ["gpt"])
    counters = cn.Counters(vocabularies={models.first()["tokenizer"]: VOCABULARY})
    want = {r["request_id"]: tuple(len(cn.byte_pair_ids(VOCABULARY, r[p])) for p in ("raw", "wrapped")) for r in an.assembled(sources).collect()}
    monkeypatch.setattr(an, "assembled", None)
    rows = an.analyze(sources, models, an.Options(), counters, with_media=False).models.collect()
    assert {r["request_id"] for r in rows} == set(want) | {"none"}
    for r in rows:
        raw, wrapped = want.get(r["request_id"], (0, 0))
        assert r["wrapper_tokens"] == max(0, wrapped - raw) and r["input_tokens"] == raw + r["wrapper_tokens"] and r["confidence"] == 1.0

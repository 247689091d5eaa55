"""Goldens of features and heuristic counts, and a per-character comparison."""

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillcount.functions import counters as cn
from quillcount.functions.text import CLASSES, COUNTERS, features, is_binary, is_generated, normalized, with_classes

SPACE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def feature_row(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in features(F.col("t")).items()]).first()


def counts(spark, text):
    df = with_classes(spark.createDataFrame([(text,)], "t string"), "t")
    sums = {k: F.col(k) for k in CLASSES}
    r = df.select(*[cn.heuristic(f, sums).alias(f) for f in cn.HEURISTICS]).first()
    return {f: (r[f]["tokens"], r[f]["low"], r[f]["high"]) for f in cn.HEURISTICS}


def test_feature_golden(spark):
    r = feature_row(spark, "Go_42!\n世界 é 🚀".replace("é", "é"))
    want = {"byte_count": 22, "rune_count": 14, "ascii_letters": 3, "ascii_digits": 2, "ascii_underscores": 1, "ascii_punctuation_symbols": 1, "han": 2, "combining_marks": 1, "emoji_symbols": 1, "newlines": 1, "lines": 2, "words": 3, "max_alphanumeric_run": 5}
    assert {k: r[k] for k in want} == want


@pytest.mark.parametrize(("text", "gemini", "legacy", "new"), [
    ("Hello, 世界 👋\nfunc example() { return 42 }", (14, 11, 17), (14, 11, 17), (18, 13, 23)),
    ("hello world " * 100, (259, 212, 306), (259, 220, 298), (336, 252, 420)),
    ("Token estimation needs representative text. " * 100, (1039, 851, 1227), (1039, 883, 1195), (1350, 1012, 1688)),
    ("", (0, 0, 0), (0, 0, 0), (0, 0, 0)),
])
def test_heuristic_goldens(spark, text, gemini, legacy, new):
    assert counts(spark, text) == {"gemini": gemini, "legacy": legacy, "new": new}


def slow_features(text):
    """The same counters, one character at a time."""
    out = dict.fromkeys(COUNTERS, 0)
    alnum = space = 0
    out["byte_count"], out["rune_count"], out["lines"] = len(text.encode()), len(text), 1 if text else 0
    for ch in text:
        kind, ascii_, sp = unicodedata.category(ch), ord(ch) < 128, ch in SPACE
        an = kind.startswith("L") or kind == "Nd" or ch == "_"
        out["words"] += an and not alnum
        out["whitespace_runs"] += sp and not space
        alnum, space = (alnum + 1) * an, (space + 1) * sp
        out["alphanumeric_runes"] += an
        out["max_alphanumeric_run"], out["max_whitespace_run"] = max(alnum, out["max_alphanumeric_run"]), max(space, out["max_whitespace_run"])
        out["ascii_letters"] += ascii_ and ch.isalpha()
        out["ascii_digits"] += ascii_ and ch.isdigit()
        out["ascii_underscores"] += ch == "_"
        out["whitespace"] += sp
        out["newlines"] += ch == "\n"
        out["lines"] += ch == "\n"
        out["punctuation"] += kind.startswith("P") and ch != "_"
        out["symbols"] += kind.startswith("S")
        if ascii_ and not an and not sp:
            out["ascii_punctuation_symbols" if kind[0] in "PS" else "ascii_controls_other"] += 1
        out["non_ascii"] += not ascii_
        out["combining_marks"] += kind.startswith("M")
        out["emoji_symbols"] += kind == "So" and not ascii_
        out["structured_signals"] += ch in "{}[]:,<>="
        out["code_signals"] += ch in "{}[]();:=<>"
    out["alphanumeric_runs"] = out["words"]
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aZ09_ \t\n\r\x00\x7f.,;{}[]()<>=!$^`~é世́🚀\xa0　٣Жش€", max_size=60))
def test_features_match_a_character_loop(spark, text):
    r, want = feature_row(spark, text), slow_features(text)
    skip = {"latin", "han", "cyrillic", "arabic"}
    assert {k: r[k] for k in COUNTERS if k not in skip} == {k: v for k, v in want.items() if k not in skip}
    for n, lo, hi in counts(spark, text).values():
        assert lo <= n <= hi


def test_keywords_have_ascii_bounds(spark):
    assert feature_row(spark, "éfunc func xfunc func_ (").code_signals == 3


def artifact(**more):
    return cn.Artifact("t", "f", "v1", 0.0, {"byte_count": 0.25}, -0.1, 0.2, 0.95, {"byte_count": 10.0}, 2.0, 0.1, **more)


def test_calibrated_counts(spark):
    texts = ["abcd", "a" * 40, "", "abcdefgh"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c = cn.calibrated(artifact(), cn.vector(features(F.col("t"))))
    rows = [r["c"] for r in df.orderBy("i").select(c.alias("c")).collect()]
    assert [r["tokens"] for r in rows] == [1, 10, 0, 2]
    assert rows[1]["high"] >= 14 and rows[1]["confidence"] < rows[0]["confidence"]


def test_artifact_gates():
    with pytest.raises(ValueError):
        artifact().validate(require_accepted=True)
    good = {"samples": 9, "improvement": 0.3, "bias": 0.0, "coverage": 0.96, "above_high": 0.01, "mape": 0.04, "p95": 0.1}
    ok = artifact(status="accepted", digests={"a": "1", "b": "2", "c": "3"}, metrics={"blind-test": good, "stratum:x": good})
    ok.validate(require_accepted=True)
    assert cn.gate_failures(artifact(metrics={"blind-test": good | {"mape": 0.06}})) == ["MAPE"]
    assert cn.gate_failures(artifact(metrics={"blind-test": good, "stratum:x": good | {"coverage": 0.5}})) == ["stratum:x"]


def test_missing_vocabulary_is_an_error():
    with pytest.raises(KeyError):
        cn.Counters().of_text("o200k_base", None)


def test_byte_pairs(spark):
    import base64

    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["hello world", "", 'func main() { println("hello") }', "é世 🚀"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    v = cn.Vocabulary(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = [r["c"]["tokens"] for r in df.select(cn.Counters(vocabularies={"x": v}).of_text("x", F.col("t")).alias("c")).collect()]
    assert sorted(got) == sorted(len(encoding.encode_ordinary(t)) for t in texts)


def test_predicates(spark):
    rows = [("a.txt", b"plain"), ("b.bin", b"a\x00b"), ("c.bin", b"\xff\xfe"), ("d.min.js", b"x"), ("e.go", b"// Code generated by y. DO NOT EDIT."), ("f", b"x" * 8191 + "é".encode()), ("g", b"see @Generated")]
    df = spark.createDataFrame(rows, "p string, b binary")
    got = {r.p: (r.x, r.y) for r in df.select("p", is_binary(F.col("b")).alias("x"), is_generated(F.col("p"), F.col("b").cast("string")).alias("y")).collect()}
    assert [p for p, (x, _) in got.items() if x] == ["b.bin", "c.bin", "f"]
    assert sorted(p for p, (_, y) in got.items() if y) == ["d.min.js", "e.go", "g"]
    t = spark.createDataFrame([("﻿a\r\nb\rc\n\r",)], "t string").select(normalized(F.col("t")).alias("t")).first().t
    assert t == "a\nb\nc\n\n"

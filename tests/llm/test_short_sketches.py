"""Short texts have sketches of their own."""

from itertools import combinations

from pyspark.sql import functions as F

from quillcount.llm import fingerprint


def test_short_texts_keep_a_hash(spark):
    texts = [f"short text number w{k}" for k in range(12)]
    pairs = [*combinations(texts, 2), (texts[0], texts[0].upper()), ("", None)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", fingerprint.sketch(F.col("a")).alias("x"), fingerprint.sketch(F.col("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    got = df.select("x", "y", fingerprint.likeness(x, y).alias("l"), fingerprint.containment(x, y).alias("c"), fingerprint.fingerprint(x).alias("p"), fingerprint.fingerprint(y).alias("q")).collect()
    for r in got[:-2]:
        assert (r.l, r.c, r.x.n, len(r.x.kept), len(r.y.kept)) == (0, 0, 1, 1, 1) and r.p != r.q
    assert (got[-2].l, got[-2].c) == (1, 1) and got[-2].p == got[-2].q
    assert (got[-1].l, got[-1].c, got[-1].p, got[-1].x.kept) == (1, 1, "0:", [])


def test_merging_equals_the_sketch_of_both(spark):
    """Disjoint shingles: those of the joined set are the union's, whichever of the two has a hash below the fraction."""
    words = [f"v{k}" for k in range(40)]
    df = spark.createDataFrame([(a, b) for a, b in combinations(words, 2)] + [("", "v1")], "a string, b string")
    one = lambda t: fingerprint.sketch(t, k=1)
    got = df.select(fingerprint.merged(one(F.col("a")), one(F.col("b"))).alias("m"), one(F.concat_ws(" ", "a", "b")).alias("w")).collect()
    assert all(r.m == r.w.kept for r in got)

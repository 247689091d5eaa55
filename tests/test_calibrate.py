import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcount.functions import counters as cn
from quillcount.functions.text import CLASSES, COUNTERS, features, with_classes
from quillcount.operators import calibrate as cal
from quillcount.operators import quantiles

BASE = cn.Artifact("t", "linear", "c1", 0.0, {"byte_count": 1.0}, 0.0, 0.0, 0.95)


@pytest.fixture(scope="module")
def rows(spark):
    parts = ["train"] * 12 + ["validation"] * 4 + ["blind-test"] * 2
    data = [(str(i), "a" * (4 * i), "text" if i % 2 else "code", "short", f"g{i}", p, i) for i, p in enumerate(parts, 1)]
    df = spark.createDataFrame(data, "id string, t string, kind string, length_bucket string, grp string, split string, y long")
    df = with_classes(df, "t").withColumn("heuristic", cn.heuristic("legacy", {k: F.col(k) for k in CLASSES})).withColumn("sha256", F.sha2("t", 256))
    return df.drop(*CLASSES).select("*", *[c.alias(n) for n, c in features(F.col("t")).items()])


def vector():
    return cn.vector({n: F.col(n) for n in COUNTERS})


def test_fit_evaluate_verify(spark, rows):
    best, scores = cal.fit(rows, ["byte_count", "words"], BASE, vector(), F.col("heuristic"))
    assert best.digests.keys() == {"train", "validation", "blind-test"} and best.ood_maximums["byte_count"] == 48.0 and scores
    with pytest.raises(ValueError):
        cal.evaluate(rows, best, vector(), F.col("heuristic"))
    found = cal.evaluate(rows, best, vector(), F.col("heuristic"), allow_blind=True)
    assert found["blind-test"]["mape"] < 0.05 and found["blind-test"]["samples"] == 2
    assert "mape" in cal.markdown_report(found) and cal.from_json(cal.to_json(best)).version == best.version


def test_guards(spark, rows):
    with pytest.raises(ValueError, match="spans"):
        cal.check_manifest(rows.withColumn("grp", F.lit("g")))
    with pytest.raises(ValueError, match="unique"):
        cal.check_manifest(rows.unionByName(rows))
    with pytest.raises(ValueError):
        cal.candidates(rows, ["nothing"], "y", BASE)


def test_solver():
    a = np.array([[0.0, 2.0], [1.0, 1.0]])
    assert np.allclose(cal.solve(a, np.array([2.0, 3.0])), [2.0, 1.0]) and cal.solve(np.zeros((2, 2)), np.ones(2)) is None


def test_groups_share_a_split(spark):
    df = spark.createDataFrame([("a", "g"), ("b", "g")], "id string, grp string").withColumn("s", cal.split_of("x", F.col("grp")))
    assert df.select("s").distinct().count() == 1


def test_nearest_rank_is_exact(spark):
    """Against percentile_disc: ties, small groups, null values, many rows."""
    df = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 3 == 1, F.col("id") % 5).otherwise((F.col("id") * 7919) % 60_013)).cast("double").alias("v"))
    df = df.unionByName(spark.createDataFrame([("few", 1.0), ("few", 3.0), ("one", 9.0), ("none", None)], "k string, v double"))
    for q in (0.025, 0.5, 0.95, 1.0):
        want = {r.k: r.v for r in df.groupBy("k").agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v)").alias("v")).collect() if r.v is not None}
        assert {r.k: r.p for r in cal.nearest_rank(df, ["k"], "v", q, "p").collect()} == want
    assert cal.nearest_rank(df.where("k = 'few'"), [], "v", 0.5, "p").first().p == 1.0


def test_gram_of_all_features_gives_each_fit(spark):
    rows = spark.createDataFrame([(float(k), float(k * k % 7), 3.0 * k + 2) for k in range(40)], "a double, b double, y double")
    m = cal.gram(rows, ["a", "b"], "y")
    for own in (["a"], ["b"], ["a", "b"]):
        assert cal.fit_features(m, ["a", "b"], own)[0] == pytest.approx(cal.fit_linear(rows, own, "y")[0], rel=1e-9)
    assert cal.fit_features(m, ["a", "b"], ["a"])[1]["a"] == pytest.approx(3.0)


def test_sortable_numbers_keep_their_order(spark):
    import math
    import random
    import struct

    rng = random.Random(4)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(4000)] + [s * 2.0**e for e in range(-1074, 1024, 3) for s in (1, -1)]
    values += [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, float("inf"), float("-inf"), 0.1, 1 / 3, 1.7976931348623157e308, math.nextafter(1, 2), math.nextafter(1, 0), math.nextafter(1024, 0)]
    values = [v for v in values if not math.isnan(v)] + [float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.sortable(F.col("v")).alias("b")).select("v", "b", quantiles.double_of(F.col("b")).alias("back")).collect()
    for r in rows:
        if not math.isnan(r["v"]):
            bits = struct.unpack("<q", struct.pack("<d", abs(r["v"])))[0]
            assert r["b"] == (bits if r["v"] > 0 else -bits) and r["back"] == r["v"]
    nan = [r for r in rows if math.isnan(r["v"])][0]
    assert math.isnan(nan["back"]) and nan["b"] > max(r["b"] for r in rows if not math.isnan(r["v"]))


def test_quantiles_of_several_columns_and_null_keys(spark):
    import random

    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, rng.gauss(0, 3), rng.randint(-3, 3) * 1.0, 1e-300 * rng.random(), -1e200]), rng.random() * 10**6) for _ in range(3000)] + [("only", None, 2.0)]
    df = spark.createDataFrame(data, "k string, v double, w double").repartition(5)
    asked = {"lo": ("v", 0.025), "mid": ("w", 0.5), "hi": ("v", 0.975), "first": ("v", 0.0), "last": ("w", 1.0)}
    got = {r["k"]: r.asDict() for r in quantiles.nearest_ranks(df, ["k"], asked).collect()}
    for k in ("a", "b", None, "only"):
        for name, (c, q) in asked.items():
            own = sorted(r["vw".index(c) + 1] for r in data if r[0] == k and r["vw".index(c) + 1] is not None)
            assert got[k][name] == (own[max(1, math_ceil(q, len(own))) - 1] if own else None), (k, name)
    assert quantiles.nearest_ranks(df.limit(0), ["k"], asked).collect() == []
    assert quantiles.nearest_ranks(df.limit(0), [], asked).collect()[0].asDict() == dict.fromkeys(asked)


def math_ceil(q, n):
    """ceil(q n) as a double product gives it."""
    import math

    return math.ceil(q * n)


def test_metrics_of_null_keys_and_groups_of_several_kinds(spark):
    rows = [(None, "x", "g1", 10, 12, 9, 13), (None, "y", "g1", 10, 8, 9, 9), ("s", "x", "g2", 0, 1, 1, 1), ("s", "x", "g3", 4, 4, 4, 4)]
    df = spark.createDataFrame(rows, "split string, kind string, grp string, y long, tokens long, low long, high long")
    got = {r["split"]: r.asDict() for r in cal.metrics(df, ["split"]).collect()}
    assert got[None] == {"split": None, "samples": 2, "groups": 1, "mape": pytest.approx(0.2), "macro_mape": pytest.approx(0.2), "p95": pytest.approx(0.2), "bias": pytest.approx(0.0), "coverage": 0.5, "above_high": 0.5}
    assert got["s"]["groups"] == 2 and got["s"]["p95"] == 1.0 and got["s"]["coverage"] == 0.5
    assert cal.metrics(df, []).first()["samples"] == 4 and cal.metrics(df.limit(0), []).first()["samples"] == 0 and cal.metrics(df.limit(0), ["split"]).collect() == []

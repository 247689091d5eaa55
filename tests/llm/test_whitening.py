"""Whitening against numpy on whole tables, its parts against closed forms, and its defined results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcount.llm import whitening as wh


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_qr_against_a_dense_solver(n):
    x = np.random.default_rng(n).normal(size=(3 * n, n))
    a = x.T @ x
    values, vectors = wh.symmetric_qr(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * values[0])


@pytest.mark.parametrize("a", [np.zeros((4, 4)), np.eye(5), np.ones((6, 6)), np.array([[0, 1.0], [1, 0]]), np.diag([1.0, 3, 2, 2])])
def test_qr_with_equal_eigenvalues(a):
    values, vectors = wh.symmetric_qr(a)
    assert (np.diff(values) <= 1e-15).all() and np.allclose(a @ vectors, vectors * values, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-12)


def test_states_merge_in_any_order_and_sums_are_exact():
    x = np.random.default_rng(3).integers(-300, 300, (500, 6))
    x[0] = 2**61
    whole, parts = wh.Moments(6), wh.Moments(6)
    whole.add_exactly(x)
    for cut in np.array_split(x[::-1], 7):
        own = wh.Moments(6)
        own.add_exactly(cut)
        parts.merge(wh.Moments.of(own.batch().to_pylist()[0]))
    assert whole.sums == parts.sums == [sum(int(v) for v in c) for c in x.T] and whole.n == parts.n == 500
    assert np.allclose(whole.scatter, parts.scatter, rtol=1e-9) and np.allclose(whole.scatter / 500, np.cov(x.T.astype(float), bias=True), rtol=1e-9)


def _expected(vectors: dict):
    """By numpy and Python integers: x, n, S, eigenvalues and eigenvectors."""
    x = {k: [math.floor(256 * float(c)) for c in v] for k, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    s = [sum(int(v) for v in c) for c in fit.T]
    values, eigen = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return x, fit, s, values[::-1], eigen[:, ::-1]


def test_op11_against_numpy(spark):
    from quillcount.llm.queries import queries

    where = "/root/testdata/sf0.01"
    rows = queries()["op11_embedding_whitening"](spark, where).collect()
    source = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()}
    x, fit, s, values, eigen = _expected(source)
    n = len(fit)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert set(got) == set(source) and all(set(v) == {1, 2, 3, 4} for v in got.values()) and len(rows) == 4 * len(source)
    sign = {}
    for key, parts in got.items():
        off = [n * a - b for a, b in zip(x[key], s)]
        for k, r in parts.items():
            assert r["n"] == n and r["deviation"] == sum(o * o for o in off)
            assert math.isclose(r["explained"], values[k - 1] / values.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9
            want = float(np.array(off, float) / n @ eigen[:, k - 1] / math.sqrt(values[k - 1]))
            if abs(want) > 1e-3:
                assert sign.setdefault(k, math.copysign(1, want * r["whitened"])) == math.copysign(1, want * r["whitened"])
            assert math.isclose(abs(r["whitened"]), abs(want), abs_tol=1e-8)


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (None, [3.0, -1.0], "c"), (4, None, "d"), (5, [1.0, None], "e"), (6, [nan, 1.0], "f"), (7, [inf, 1.0], "g"), (8, [1e300, 1.0], "h"), (9, [], "i"), (10, [1.0], "j"), (11, [0.0, 0.5], "k")]
    df = spark.createDataFrame(rows, "id long, v array<double>, x string").withColumn("component", F.lit("clash")).repartition(5)
    out = wh.whitened(df, "v").collect()
    assert sorted((r["x"], r["component"]) for r in out) == [(k, c) for k in "abck" for c in (1, 2)] and {r["n"] for r in out} == {3}
    assert {r["id"] for r in out} == {1, None, 11} and all(math.isfinite(r["whitened"]) and r["identity_error"] < 1e-9 for r in out)
    assert math.isclose(sum(r["explained"] for r in out if r["x"] == "a"), 1.0)
    assert wh.whitened(df.limit(0), "v").collect() == [] and wh.whitened(df.where("v is null"), "v").columns == ["id", "x", *wh.ADDED]
    single = wh.whitened(df.where("id = 1"), "v").collect()
    assert len(single) == 4 and all((r["whitened"], r["explained"], r["deviation"], r["identity_error"]) == (0.0, 0.0, 0, 0.0) for r in single)
    wide = spark.createDataFrame([(1, [2.0**52, 0.0]), (2, [-(2.0**52), 1.0]), (3, [0.0, 5.0])], "id long, v array<double>")
    assert {r["id"]: r["deviation"] for r in wh.whitened(wide, "v", 1).collect()} == {1: None, 2: None, 3: (3 * 1280 - 1536) ** 2}


def test_many_partitions_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    df = spark.range(300).select(F.array(F.col("id") % 7, F.col("id") % 11, F.col("id") / 3).alias("v"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(wh, "FAN_IN", 64)
        once = wh.fit(df.select(F.transform("v", lambda c: c.cast("long")).alias("x")).repartition(1), 3)
    often = wh.fit(df.select(F.transform("v", lambda c: c.cast("long")).alias("x")).repartition(9), 3)
    assert once.sums == often.sums and np.allclose(once.values, often.values, rtol=1e-12)

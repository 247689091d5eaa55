"""Collision counting over sorted projections: windows, recall over many cells and blocks, growth."""

import numpy as np
import pytest

from quillcount.llm import vectors


def clustered(n, rng, length=32, noise=0.06):
    """n vectors, three to a cluster of near copies, and one very common vector and its near copies."""
    centre = rng.normal(size=(n // 3 + 1, length))
    x = centre[np.arange(n) // 3] + rng.normal(size=(n, length)) * rng.uniform(0.5, 5, size=(n, 1)) * noise
    x[: n // 10] = centre[0]
    x[n // 10 : n // 5] = centre[0] + rng.normal(size=(n // 5 - n // 10, length)) * noise
    return x.astype(np.float32)


def test_collisions_are_windows():
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(40, 5)).astype(np.float32), rng.normal(size=(70, 5)).astype(np.float32)
    want = (np.abs(q[:, None, :].astype(np.float64) - v[None, :, :]) <= 0.5).sum(axis=2)
    assert np.abs(vectors.collisions(q, v, np.float32(0.5)) - want).sum() <= 1


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_over_cells_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CELL", 40)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(7)
    x = clustered(1_200, rng)
    label = np.where(np.arange(1_200) % 7 == 0, 2, 1)  # one label has most rows
    rows = [(k, [float(c) for c in v], int(g), "clash") for k, (v, g) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, home string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.linked(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    true, found = links.sum(), sum(n for n, _ in got.values())
    assert all(n <= links[k].sum() for k, (n, _) in got.items()) and found >= 0.97 * true
    root = np.arange(1_200)
    for _ in range(60):
        root = np.minimum(root, np.where(links, root[None, :], 1_200).min(axis=1))
    assert np.mean([got[k][1] == root[k] for k in range(1_200)]) >= 0.98


def test_comparisons_grow_below_the_square(spark):
    """Vectors met in cells, summed over vectors: four times the vectors, far less than sixteen times the meetings."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    met = []
    for n in (8_192, 32_768):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        df = spark.createDataFrame([(k, 1, 1, v.tolist(), 64) for k, v in enumerate(x)], "cid long, g long, mult long, embedding array<float>, length long")
        cells = vectors.visited_cells(df, 0.93).groupBy("cell").agg(F.sum((F.col("home") == F.col("cell")).cast("long")).alias("own"), F.count("*").alias("all"))
        met.append(cells.agg(F.sum(F.col("own") * F.col("all"))).first()[0])
    assert met[1] <= 9 * met[0] and met[1] < 0.25 * 32_768**2


def test_repeated_rows_null_ids_and_ties(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (1, v, 0), (None, v, 0), (2, [2.0, 4.0], 0), (3, [-1.0, 2.0], 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got[3:] == [(2, 3, 1), (3, 0, 3)] and [g[0] for g in got] == [0, 1, 1, 2, 3] and all(g[2] == 1 for g in got[1:3])

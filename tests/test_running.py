"""Running sums in two levels and the streamed limit fold, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillcount.operators import running
from quillcount.operators.pricing import priced_components
from quillcount.sources import catalog as cat
from quillcount.sources import collect as co


@pytest.fixture
def apart(spark):
    """Small ranges stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_before(spark, apart):
    rng = random.Random(3)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, rng.randint(-5, 9)])) for i in range(2000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, i long, v long").repartition(3)
    rows = running.with_before(running.ranged(df, ["k"], ["i"]), ["k"], ["i"], {"s": F.col("v"), "n": F.lit(1)})
    want, sums = {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        want[k, i] = sums.get(k, (0, 0))
        sums[k] = (want[k, i][0] + (v or 0), want[k, i][1] + 1)
    got = rows.collect()
    assert {(r["k"], r["i"]): (r["s"], r["n"]) for r in got} == want and len(got) == 2000 and len({r["_range"] for r in got if r["k"] == "a"}) > 1
    assert running.with_before(running.ranged(df.limit(0), ["k"], ["i"]), ["k"], ["i"], {"s": F.col("v")}).collect() == []


def test_a_large_request_is_priced_as_a_small_one(spark, apart):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 17).alias("n"), F.when(F.col("id") % 3 == 0, "audio").otherwise("text").alias("modality"))
    df = df.crossJoin(cat.models(spark, cat.default_catalog(), ["gemini-2.5-flash"]).select("tiers", "modality_tiers"))
    a, b = [priced_components(df, ["k"], ["id"], "n", F.lit(7_003).cast("long"), F.lit(1).cast("long"), large=x) for x in (False, True)]
    a = a.drop("tiers", "modality_tiers")
    assert set(a.columns) == set(b.columns) and sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def loop(files, limits):
    """(total, media) before each file, by the definition."""
    total, media, out = 0, 0, []
    for size, added, is_media, free in files:
        out.append((total, media))
        if free and total + size <= limits.total and not (is_media and media >= limits.media_count):
            total, media = total + added, media + is_media
    return out


@pytest.mark.parametrize("composed", [1, 3, 50, 1024])
def test_totals_by_composition(monkeypatch, composed):
    monkeypatch.setattr(co, "COMPOSED", composed)
    rng = random.Random(composed)
    for _ in range(200):
        limits = co.Limits(total=rng.choice([0, 50, 300, 10**6]), media_count=rng.choice([0, 2, 10**6]))
        files = [(s, max(0, s - rng.choice([0, 0, 1, 5, -3])), rng.random() < 0.3, rng.random() < 0.8) for s in (rng.choice([0, 1, rng.randint(0, 20), rng.randint(0, 90)]) for _ in range(rng.randint(0, 120)))]
        columns = [np.array([f[i] for f in files], t) for i, t in enumerate((np.int64, np.int64, bool, bool))]
        half = len(files) // 2
        t1, c1, total, media = co.running_totals(*[x[:half] for x in columns], 0, 0, limits)
        t2, c2, _, _ = co.running_totals(*[x[half:] for x in columns], total, media, limits)
        assert list(zip([*t1, *t2], [*c1, *c2], strict=True)) == loop(files, limits)


def test_a_request_of_many_files_is_streamed(spark):
    n = 300_000
    df = spark.range(n).select(
        F.lit("r").alias("request_id"), "id", F.col("id").alias("sequence"), F.col("id").cast("string").alias("label"), (F.col("id") % 97).alias("size"), (F.col("id") % 97).alias("text_size"), F.lit(False).alias("is_media"),
        F.lit(None).cast("string").alias("bad"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("drop"), F.lit("x").alias("total"),
    ).repartition(5)
    r = co.fold_limits(df, co.Limits(total=1_000_003)).agg(F.count("*").alias("n"), F.sum(F.when(F.col("taken"), F.col("size"))).alias("bytes"), F.count_if("taken").alias("taken")).first()
    total = taken = 0
    for size in (i % 97 for i in range(n)):
        if total + size <= 1_000_003:
            total, taken = total + size, taken + 1
    assert (r["n"], r["bytes"], r["taken"]) == (n, total, taken)

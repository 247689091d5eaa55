"""Run ids, unknown runs, uploads, reports that are whole, and invalid bytes of single sources."""

import os
import re

import pytest
from pyspark.sql import functions as F

from quillcount.functions import counters as cn
from quillcount.operators import analyze as an
from quillcount.operators import calibrate as cal
from quillcount.operators import history as hs
from quillcount.sources import catalog as cat


def runs(spark, **kinds):
    df = spark.createDataFrame([("a", "x", "some words"), ("b", "y", "more")], "r string, l string, t string")
    src = an.text_sources(df, F.col("r"), F.col("l"), F.col("t"))
    return hs.runs_of(an.analyze(src, cat.models(spark, cat.default_catalog(), ["sonnet"])), src, F.lit("2026-03-04 05:06:07"), "v1", **kinds)


def test_ids_of_runs(spark):
    assert sorted(r["id"] for r in runs(spark).collect()) == ["a", "b"]
    fresh = runs(spark, fresh_ids=True)
    ids = [r["id"] for r in fresh.collect()]
    assert sorted(ids) == sorted(r["id"] for r in fresh.collect()) and len(set(ids)) == 2
    assert all(re.fullmatch(r"20260304T050607Z-[0-9a-f]{8}", i) for i in ids)
    assert not set(ids) & {r["id"] for r in runs(spark, fresh_ids=True).collect()}


def test_an_unknown_run_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    hs.save(runs(spark), path)
    stored = hs.load(spark, path)
    assert hs.get(stored, "a").first()["run"]["results"][0]["model"]
    with pytest.raises(KeyError, match="'c' not found"):
        hs.get(stored, "c")


def test_uploads_need_a_verification():
    assert an.Options(allow_file_upload=True, require_verify=True)
    with pytest.raises(ValueError, match="verification"):
        an.Options(allow_file_upload=True)


def test_reports_are_written_whole(tmp_path):
    artifact = cn.Artifact("t", "linear", "c1:ols", 0.0, {"byte_count": 1.0}, 0.0, 0.0, 0.95)
    m = dict.fromkeys(("samples", "mape", "macro_mape", "p95", "bias", "coverage", "above_high", "improvement"), 1)
    cal.write_reports(str(tmp_path), artifact, {"blind-test": m})
    assert sorted(os.listdir(tmp_path)) == ["c1-ols.json", "c1-ols.md"]
    assert cal.from_json((tmp_path / "c1-ols.json").read_text()) == artifact and "blind-test" in (tmp_path / "c1-ols.md").read_text()


def test_invalid_bytes_of_a_source_count_as_in_its_request(spark):
    df = spark.createDataFrame([("a", "x", bytearray(b"ab\xff cd" * 20))], "r string, l string, b binary").withColumn("t", F.col("b").cast("string"))
    src = an.text_sources(df, F.col("r"), F.col("l"), F.col("t"))
    r = an.analyze(src, cat.models(spark, cat.default_catalog(), ["sonnet"]))
    assert r.sources.first()["tokens"] == r.models.first()["input_tokens"] - r.models.first()["overhead_tokens"] == 40

"""Requests as keyed state: a replay equals the batch analysis, repeats and late sources are as defined."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillcount.operators import analyze as an
from quillcount.sources import catalog as cat

pytest.importorskip("google.protobuf")
from quillcount.streaming import requests as rq  # noqa: E402

AT = dt.datetime(2026, 1, 1, 12)


@pytest.fixture
def rocks(spark):
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, rq.PROVIDER)
    yield spark
    spark.conf.set(name, before)


def played(spark, tmp_path, batches, limit=50, **kinds):
    """Events of batches of (request, label, text, minute), one micro-batch each."""
    schema = "request string, label string, text string, minute int"
    where = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)
    stream = stream.withColumn("ts", F.timestamp_add("MINUTE", F.col("minute"), F.lit(AT)))
    sources = an.text_sources(stream, F.col("request"), F.col("label"), F.col("text"), keep=("ts",))
    out = rq.running_estimates(sources, limit, **kinds)
    query = out.writeStream.format("memory").queryName("events").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return [r.asDict() for r in spark.table("events").collect()]


def batch(spark, rows):
    df = spark.createDataFrame(rows, "request string, label string, text string")
    src = an.text_sources(df, F.col("request"), F.col("label"), F.col("text"))
    r = an.analyze(src, cat.models(spark, cat.default_catalog(), ["sonnet"]), an.Options(), with_media=False).models
    return {x["request_id"]: (x["n_sources"], x["total_bytes"], x["input_tokens"], x["input_low"], x["input_high"]) for x in r.collect()}


def test_a_replay_equals_the_batch(rocks, tmp_path):
    docs = rocks.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(90).collect()
    rows = [(r["source"], str(r["doc_id"]), r["text"], 0) for r in docs]
    last = [("end", "z", "x", 10_000)]
    events = played(rocks, tmp_path, [rows[:40], rows[30:70] + rows[:5], rows[70:], last, [("end", "y", "x", 10_001)]], limit=400)
    want = batch(rocks, [r[:3] for r in rows])
    final = {e["request_id"]: (e["n_sources"], e["total_bytes"], e["tokens"], e["low"], e["high"]) for e in events if e["event"] == "final"}
    assert final == want and len(final) == 20
    over = [e["request_id"] for e in events if e["event"] == "over"]
    assert sorted(over) == sorted(k for k, v in want.items() if v[2] > 400) and 0 < len(over)


def test_repeats_changes_and_late_sources(rocks, tmp_path):
    batches = [
        [("a", "1", "one two", 0), ("b", "1", "b " * 100, 0), ("c", "1", "", 0), ("c", "2", None, 0)],
        [("a", "1", "one two", 1), ("a", "2", "three;", 1)],
        [("a", "1", "another text", 2)],
        [("d", "1", "moves time", 100)],
        [("d", "1", "moves time", 101)],
        [("a", "9", "too late", 3), ("a", "5", "anew", 102), ("d", "2", "x", 300)],
        [("e", "1", "x", 300)],
    ]
    events = played(rocks, tmp_path, batches, limit=35)
    final = [(e["request_id"], e["n_sources"], e["tokens"]) for e in events if e["event"] == "final"]
    want = batch(rocks, [("a", "1", "another text"), ("a", "2", "three;"), ("b", "1", "b " * 100), ("c", "1", ""), ("c", "2", None)])
    assert sorted(final)[:2] == sorted([("a", *want["a"][::2][:2]), ("a", 1, batch(rocks, [("a", "5", "anew")])["a"][2])])
    assert ("b", 1, want["b"][2]) in final and ("c", 2, 0) in final
    assert [e["request_id"] for e in events if e["event"] == "over"] == ["b"]

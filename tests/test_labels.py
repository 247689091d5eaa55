"""Manifests, labels and the labelling loop with an injected counter."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from quillcount.functions.text import FEATURE_SCHEMA
from quillcount.operators import labels as lb

SAMPLE = {"id": "a", "group": "g", "kind": "prose", "license": "CC0-1.0", "provenance": "own", "length_bucket": "short", "content": "text a"}


def manifest(tmp_path, *samples, version="1"):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"version": version, "samples": [SAMPLE | s for s in samples]}, indent=1))
    return str(path)


def test_manifest_is_checked(spark, tmp_path):
    (tmp_path / "b.txt").write_text("from a file")
    good = lb.read_manifest(spark, manifest(tmp_path, {}, {"id": "b", "content": "", "path": "b.txt"}, {"id": "c", "track": "structured-request", "system": "be short"}))
    assert {r.id: (r.content, r.track) for r in good.collect()} == {"a": ("text a", "text-component"), "b": ("from a file", "text-component"), "c": ("text a", "structured-request")}
    for bad, said in (
        (({}, {}), "twice"), (({"kind": ""},), "lacks its kind"), (({"path": "x"},), "exactly one"), (({"content": ""},), "exactly one"), (({"track": "other"},), "unknown track"), (({"system": "s"},), "system or tools"),
        (({"split": "train"}, {"id": "b", "split": "validation"}), "spans splits"), (({"split": "test"},), "unknown split"),
    ):
        with pytest.raises(ValueError, match=said):
            lb.read_manifest(spark, manifest(tmp_path, *bad))
    with pytest.raises(ValueError, match="version"):
        lb.read_manifest(spark, manifest(tmp_path, {}, version=""))


class Answers:
    """Counts the words of a message; the first tries of some texts fail."""

    def __init__(self, failures=()):
        self.failures, self.seen = dict(failures), []

    def __call__(self, method, url, headers, body):
        content = json.loads(body)["messages"][0]["content"]
        if self.failures.get(content, 0) > 0:
            self.failures[content] -= 1
            if content == "lost":
                raise OSError("lost")
            return (429, {"Retry-After": "7"}, b"") if content == "busy" else (503, {}, b"")
        if content == "wrong":
            return 400, {}, b""
        return 200, {}, json.dumps({"input_tokens": 5 + len(content.split())}).encode()


def test_retries():
    waits = []
    assert lb.counted(Answers({"busy": 2}), "u", {}, lb.request_body("m", "busy"), 5, waits.append) == (6, 2) and waits == [7.0, 7.0]
    waits.clear()
    assert lb.counted(Answers({"x y": 7}), "u", {}, lb.request_body("m", "x y"), 9, waits.append)[1] == 7 and waits == [1, 2, 4, 8, 16, 30, 30]
    assert lb.counted(Answers({"lost": 1}), "u", {}, lb.request_body("m", "lost"), 1, waits.append) == (6, 1)
    with pytest.raises(ValueError, match="HTTP 400"):
        lb.counted(Answers(), "u", {}, lb.request_body("m", "wrong"), 5, waits.append)
    with pytest.raises(ValueError, match="HTTP 503"):
        lb.counted(Answers({"z": 9}), "u", {}, lb.request_body("m", "z"), 2, waits.append)
    assert json.loads(lb.request_body("m", "c", "s", "[1]")) == {"model": "m", "messages": [{"role": "user", "content": "c"}], "system": "s", "tools": [1]}


def test_label_resumes(spark, tmp_path):
    samples = lb.read_manifest(spark, manifest(tmp_path, {"split": "train"}, {"id": "b", "content": "one two three", "split": "train"}, {"id": "c", "content": "wrong", "group": "h", "split": "blind-test"}))

    def words(method, url, headers, body):  # a function of this test, so that workers get it whole
        content = json.loads(body)["messages"][0]["content"]
        return (400, {}, b"") if content == "wrong" else (200, {}, json.dumps({"input_tokens": 5 + len(content.split())}).encode())

    ask = dict(transport=words, model="m-20260101", api_version="v1", url="u")
    for wrong in ({}, {"consent": True, "model": "m-latest"}):
        with pytest.raises(ValueError):
            lb.label(samples, f"{tmp_path}/none", **(ask | wrong))
    first = lb.label(samples, f"{tmp_path}/first", **ask, consent=True)
    got = {r.id: r for r in first.collect()}
    assert (got["a"].input_tokens, got["a"].baseline_tokens, got["a"].adjusted_tokens) == (7, 5, 2) and got["b"].adjusted_tokens == 3 and "HTTP 400" in got["c"].error
    path = f"{tmp_path}/labels"
    first.where("error IS NULL").drop("error").write.json(path)
    known = lb.read_labels(spark, path)
    again = lb.label(samples, f"{tmp_path}/again", **ask, consent=True, existing=known)
    assert [r.id for r in again.collect()] == ["c"]
    with pytest.raises(ValueError, match="another model"):
        lb.label(samples, f"{tmp_path}/other", **(ask | {"model": "other-1"}), consent=True, existing=known)
    with pytest.raises(ValueError, match="changed"):
        lb.label(samples.withColumn("content", F.lit("new")), f"{tmp_path}/new", **ask, consent=True, existing=known)
    for bad, said in (
        (known.where("false"), "no labels"), (known.unionByName(known), "twice"), (known.withColumn("feature_schema", F.lit("x")), "feature schema"), (known.withColumn("adjusted_tokens", F.lit(-1).cast("long")), "negative"),
        (known.withColumn("split", F.when(F.col("id") == "a", "validation").otherwise("train")), "spans"), (known.withColumn("pinned_model", F.lit(None).cast("string")), "pinned_model"),
    ):
        with pytest.raises(ValueError, match=said):
            lb.check_labels(bad)
    assert known.where(F.col("feature_schema") == FEATURE_SCHEMA).count() == 2


def test_run_ids_and_atomic_reports(tmp_path):
    at = dt.datetime(2026, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc)
    a, b = lb.new_run_id(at), lb.new_run_id(at)
    assert re.fullmatch(r"20260102T030405Z-[0-9a-f]{8}", a) and a != b
    path = tmp_path / "r.md"
    lb.write_atomic(str(path), "one")
    lb.write_atomic(str(path), "two é")
    assert path.read_text() == "two é" and [p.name for p in tmp_path.iterdir()] == ["r.md"]
    with pytest.raises(UnicodeEncodeError):
        lb.write_atomic(str(path), "\ud800")
    assert path.read_text() == "two é" and [p.name for p in tmp_path.iterdir()] == ["r.md"]

"""Manifests and labels of a calibration: read, checked, and labelled by an injected counter.

A manifest is a JSON object with a version and samples; labels are JSON records.
Both are checked as tables, so that any number of samples is one aggregate. The
library opens no connection: ``transport(method, url, headers, body)`` returns
(status, headers, bytes), and labelling sends texts only after explicit consent
and to a pinned model.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import secrets
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import write_atomic  # noqa: F401  (reports of labels are written by it)
from ..functions.text import FEATURE_SCHEMA
from .calibrate import adjusted, sample_digest

Transport = Callable[[str, str, dict, bytes], tuple[int, dict, bytes]]
# The tracks and splits of samples, and the version of a labelled request's shape.
TRACKS, SPLITS, SHAPE = ("text-component", "structured-request"), ("train", "validation", "blind-test"), "messages-v1"
SAMPLE = "id string, `group` string, kind string, language string, license string, provenance string, length_bucket string, split string, track string, path string, content string, system string, tools string"
LABEL = (
    "id string, sha256 string, kind string, track string, language string, length_bucket string, `group` string, split string, feature_schema string, shape string, pinned_model string, "
    "api_version string, collected_at timestamp, input_tokens long, baseline_tokens long, adjusted_tokens long, retries int"
)
#: Longest wait between two tries, and bytes of an answer that are read.
LONGEST_WAIT, ANSWER_BYTES = 30.0, 1 << 20


def _unset(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _first_problem(rows: DataFrame, problems: dict[str, Column]) -> None:
    """An error that names the first row, by id, that has a problem, and the problem."""
    said = F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in problems.items()])
    bad = rows.select(F.coalesce("id", F.lit("")).alias("id"), said.alias("problem")).where("problem IS NOT NULL").orderBy("id", "problem").take(1)
    if bad:
        raise ValueError(f"record {bad[0]['id']!r} {bad[0]['problem']}")
    twice = rows.groupBy("id").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"record {twice[0]['id']!r} is there twice")


def _no_leak(rows: DataFrame) -> None:
    leak = rows.where(~_unset("split")).groupBy("group").agg(F.count_distinct("split").alias("n")).where("n > 1").take(1)
    if leak:
        raise ValueError(f"group {leak[0]['group']!r} spans splits")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Samples (SAMPLE) of a manifest, each with its text in ``content``; anything incomplete is an error."""
    found = spark.read.schema(f"version string, samples array<struct<{SAMPLE.replace(' string', ':string')}>>").json(path, multiLine=True)
    if found.where((F.coalesce("version", F.lit("")) != "") & (F.size("samples") > 0)).isEmpty():
        raise ValueError("a manifest needs a version and a sample")
    rows = found.select(F.inline("samples")).withColumn("track", F.when(_unset("track"), F.lit(TRACKS[0])).otherwise(F.col("track")))
    lacking = [f"lacks its {n}" for n in ("id", "group", "kind", "license", "provenance", "length_bucket")]
    problems = {said: _unset(said.rpartition(" ")[2]) for said in lacking} | {
        "has not exactly one of path and content": _unset("path") == _unset("content"),
        "has an unknown track": ~F.col("track").isin(*TRACKS),
        "is a text component with system or tools": (F.col("track") == TRACKS[0]) & ~(_unset("system") & _unset("tools")),
        "has an unknown split": ~_unset("split") & ~F.col("split").isin(*SPLITS),
    }
    _first_problem(rows, problems)
    _no_leak(rows)
    base = os.path.dirname(path)
    files = rows.where(~_unset("path")).select("id", F.concat(F.lit(base.rstrip("/") + "/"), "path").alias("file"))
    names = [r["file"] for r in files.select("file").distinct().collect()]  # as many as samples that are files
    if not names:
        return rows
    texts = spark.read.format("binaryFile").load(names).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.col("content").cast("string").alias("_text"))
    rows = rows.join(files.withColumn("file", F.regexp_replace("file", "^file:/*", "/")).join(texts, "file").select("id", "_text"), "id", "left")
    if not rows.where(_unset("content") & F.col("_text").isNull()).isEmpty():
        raise FileNotFoundError("a sample's file is missing")
    return rows.withColumn("content", F.coalesce("_text", "content")).drop("_text")


def check_labels(labels: DataFrame) -> DataFrame:
    """``labels`` (LABEL), or an error that names the first invalid record."""
    if labels.isEmpty():
        raise ValueError("there are no labels")
    problems = {f"lacks its {n}": _unset(n) for n in ("id", "sha256", "pinned_model", "kind", "group")} | {
        "is of another feature schema": F.col("feature_schema") != FEATURE_SCHEMA, "is of another request shape": F.col("shape") != SHAPE,
        "has an unknown track": ~F.col("track").isin(*TRACKS), "has an unknown split": ~F.col("split").isin(*SPLITS),
        "has a negative count": F.least("input_tokens", "baseline_tokens", "adjusted_tokens") < 0, "has no time": F.col("collected_at").isNull(),
    }
    _first_problem(labels, problems)
    _no_leak(labels)
    return labels


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Checked labels of JSON records, one to a line or an array."""
    return check_labels(spark.read.schema(LABEL).json(path, multiLine=path.endswith(".json")))


def request_body(model: str, content: str, system: str | None = None, tools: str | None = None) -> bytes:
    body = {"model": model, "messages": [{"role": "user", "content": content}]}
    return json.dumps(body | ({"system": system} if system else {}) | ({"tools": json.loads(tools)} if tools else {}), ensure_ascii=False).encode()


def counted(transport: Transport, url: str, headers: dict, body: bytes, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[int, int]:
    """(tokens, tries that failed). Rate limits, server errors and lost connections are tried again,
    after as long as the answer asks for, or else twice as long each time."""
    for attempt in range(retries + 1):
        try:
            status, answered, data = transport("POST", url, headers, body)
        except OSError as error:
            if attempt == retries:
                raise
            status, answered, data, said = 0, {}, b"", str(error)
        else:
            said = f"HTTP {status}"
        if 200 <= status < 300:
            tokens = json.loads(data[:ANSWER_BYTES])["input_tokens"]
            if tokens < 0:
                raise ValueError("the counter returned a negative count")
            return tokens, attempt
        if status and status != 429 and status < 500 or attempt == retries:
            raise ValueError(f"the counter returned {said}")
        asked = next((v for k, v in answered.items() if k.lower() == "retry-after"), "")
        sleep(min(LONGEST_WAIT, float(asked) if asked.isdigit() and int(asked) > 0 else 2.0 ** min(attempt, 5)))
    raise AssertionError


def label(samples: DataFrame, out: str, transport: Transport, model: str, api_version: str, url: str, headers: dict | None = None, consent: bool = False, existing: DataFrame | None = None, retries: int = 5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(LABEL, error) of the samples that ``existing`` labels do not cover yet, written to ``out`` as
    JSON records, so that no text is sent twice, and read again; rows with an error have no count.

    Texts leave the cluster only with ``consent``. Partitions of samples are labelled side by side,
    so their number bounds the requests under way.
    """
    if not consent:
        raise ValueError("labelling sends the samples' texts out; it needs consent=True")
    if not model or "latest" in model:
        raise ValueError("labels need a pinned model, not an alias")
    text = F.col("content")
    rows = samples.withColumn("sha256", F.when(F.col("track") == TRACKS[0], sample_digest(text)).otherwise(sample_digest(text, F.col("system"), F.col("tools"))))
    if existing is not None:
        if not existing.where((F.col("pinned_model") != model) | (F.col("api_version") != api_version)).isEmpty():
            raise ValueError("the labels there are were collected for another model or API version")
        known = existing.select("id", F.col("sha256").alias("_sha"))
        if not rows.join(known, "id").where("sha256 <> _sha").isEmpty():
            raise ValueError("a sample has changed since it was labelled")
        rows = rows.join(known, "id", "left_anti")
    sent = {"content-type": "application/json", "version": api_version} | (headers or {})
    baseline, _ = counted(transport, url, sent, request_body(model, ""), retries, sleep)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    tokens, tries = counted(transport, url, sent, request_body(model, r["content"], r["system"], r["tools"]), retries, sleep)
                    out.append((r["id"], tokens, tries, None))
                except (OSError, ValueError, KeyError, TypeError) as error:
                    out.append((r["id"], None, None, str(error)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["id", "input_tokens", "retries", "error"])

    counts = rows.select("id", "content", "system", "tools").mapInArrow(run, "id string, input_tokens long, retries int, error string")
    base = F.lit(baseline).cast("long")
    labels = rows.join(counts, "id").select(
        "id", "sha256", "kind", "track", "language", "length_bucket", "group", "split", F.lit(FEATURE_SCHEMA).alias("feature_schema"), F.lit(SHAPE).alias("shape"), F.lit(model).alias("pinned_model"),
        F.lit(api_version).alias("api_version"), F.current_timestamp().alias("collected_at"), "input_tokens", base.alias("baseline_tokens"), adjusted(F.col("input_tokens"), base).alias("adjusted_tokens"), "retries", "error",
    )
    labels.write.json(out)
    return samples.sparkSession.read.schema(LABEL + ", error string").json(out)


def new_run_id(now: dt.datetime | None = None) -> str:
    """A run's id where none is given: the UTC time and four random bytes."""
    now = now or dt.datetime.now(dt.timezone.utc)
    return f"{now.astimezone(dt.timezone.utc):%Y%m%dT%H%M%SZ}-{secrets.token_hex(4)}"

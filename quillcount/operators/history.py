"""Run history: runs are saved without any content, listed, fetched and compared.

The store is a Parquet table partitioned by a digest of the id and by day of
creation; a run's results travel as one JSON payload built from whitelisted
columns.
"""

from __future__ import annotations

import secrets
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = "quillcount.run.v2"
#: The only source fields that are ever stored.
SOURCE_FIELDS = ("label", "path", "kind", "sha256", "bytes", "asset_id", "detected_mime")
_SOURCES = "array<struct<label:string,path:string,kind:string,sha256:string,bytes:bigint,asset_id:string,detected_mime:string>>"
_SCENARIOS = "array<struct<name:string,cost_micros:bigint>>"
_COMPONENTS = "array<struct<modality:string,unit:string,expected:bigint>>"
PAYLOAD = f"struct<schema:string,catalog_version:string,sources:{_SOURCES},results:array<struct<model:string,input_tokens:bigint,scenarios:{_SCENARIOS},components:{_COMPONENTS}>>>"
RUNS = "id string, created_at timestamp, catalog_version string, models array<string>, total_bytes bigint, incomplete boolean, payload string"


def private(sources: DataFrame) -> DataFrame:
    """Sources by whitelist: content and text never get past it."""
    mime = F.col("detected_mime") if "detected_mime" in sources.columns else F.col("mime")
    return sources.select("request_id", *SOURCE_FIELDS[:-1], mime.alias("detected_mime"))


def new_ids(created_at: Column, request_id: Column) -> Column:
    """Ids of runs: the UTC time and four bytes that are drawn anew for each call and request, and stay when rows are computed again."""
    time = F.date_format(F.to_utc_timestamp(created_at.cast("timestamp"), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    return F.concat(time, F.lit("-"), F.substring(F.sha2(F.concat(F.lit(secrets.token_hex(16)), request_id).cast("binary"), 256), 1, 8))


def runs_of(results, sources: DataFrame, created_at: Column, catalog_version: str, fresh_ids: bool = False) -> DataFrame:
    """One run (RUNS) per request of an analysis; its id is the request's, or a new one where ``fresh_ids`` are asked for."""
    scenario = results.scenarios.groupBy("request_id", "model").agg(F.sort_array(F.collect_list(F.struct("scenario_no", F.col("scenario").alias("name"), "cost_micros"))).alias("s"))
    part = results.components.groupBy("request_id", "model", "modality", "unit").agg(F.sum("expected").alias("expected")).groupBy("request_id", "model").agg(F.sort_array(F.collect_list(F.struct("modality", "unit", "expected"))).alias("components"))
    per = results.models.join(scenario, ["request_id", "model"], "left").join(part, ["request_id", "model"], "left")
    result = F.struct("model", "input_tokens", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["cost_micros"].alias("cost_micros"))).alias("scenarios"), "components")
    per = per.groupBy("request_id").agg(F.sort_array(F.collect_list(result)).alias("results"), F.sort_array(F.collect_set("model")).alias("models"), F.bool_or("incomplete").alias("incomplete"))
    own = private(sources).groupBy("request_id").agg(F.sum("bytes").alias("total_bytes"), F.sort_array(F.collect_list(F.struct(*SOURCE_FIELDS))).alias("sources"))
    rows = per.join(own, "request_id")
    payload = F.to_json(F.struct(F.lit(RUN_SCHEMA).alias("schema"), F.lit(catalog_version).alias("catalog_version"), "sources", "results"))
    own = new_ids(created_at, F.col("request_id")) if fresh_ids else F.col("request_id")
    return rows.select(own.alias("id"), created_at.cast("timestamp").alias("created_at"), F.lit(catalog_version).alias("catalog_version"), "models", "total_bytes", "incomplete", payload.alias("payload"))


def leaks(runs: DataFrame) -> DataFrame:
    """Runs whose payload has a key that only content would have."""
    key = lambda k: F.contains("payload", F.lit(f'"{k}":'))
    return runs.where(key("content") | key("text") | key("extracted_text"))


#: Parts of the store by a digest of the id; a lookup by id reads one of them.
BUCKETS = 64
#: Seconds that a writer waits for others before it gives up.
PATIENCE = 60


def bucket_of(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def save(runs: DataFrame, path: str) -> None:
    """Add runs; an id that is stored already, or twice among the new ones, is an error, and then nothing is added.

    Runs are written beside the store first. Then the buckets that they fall
    into are locked, in order, so that of two writers of one id the second sees
    the first one's; if no id is stored there, the files are moved to their
    places. Readers see whole files only.
    """
    spark = runs.sparkSession
    if {"content", "text"} & set(runs.columns):
        raise ValueError("a run must not carry content")
    if not runs.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a run of that id is stored already")
    if not leaks(runs).isEmpty():
        raise ValueError("a payload holds content")
    files, mark = _files(spark, path), uuid.uuid4().hex
    beside = f"{path}/_staged/{mark}"
    # a store that began without buckets goes on without
    old = bool(files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day=*")))
    dated = runs.withColumn("day", F.to_date("created_at"))
    (dated.write.partitionBy("day") if old else dated.withColumn("bucket", bucket_of(F.col("id"))).write.partitionBy("bucket", "day")).parquet(beside)
    held = []
    try:
        new = spark.read.schema(_STORED).parquet(beside)
        buckets = sorted(r["b"] for r in new.select(bucket_of(F.col("id")).alias("b")).distinct().collect())  # BUCKETS at most
        for b in buckets:
            _lock(spark, f"{path}/_locks/{b}")
            held.append(f"{path}/_locks/{b}")
        stored = spark.read.schema(_STORED).parquet(path).where(F.col("bucket").isin(buckets) | F.col("bucket").isNull())
        if not new.select("id").join(stored.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("a run of that id is stored already")
        for folder, name in _parts(spark, files, beside):
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
            files.mkdirs(target)
            files.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{beside}/{folder}/{name}"), spark._jvm.org.apache.hadoop.fs.Path(target, f"{mark}-{name}"))
    finally:
        for lock in held:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(lock), False)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(beside), True)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _parts(spark: SparkSession, files, where: str) -> list[tuple[str, str]]:
    """(folder from there, file name) of the data files below a folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(where)
    found, walk = [], files.listFiles(root, True)
    while walk.hasNext():
        at = walk.next().getPath()
        if at.getName().endswith(".parquet"):
            found.append((at.getParent().toUri().getPath()[len(root.toUri().getPath()) + 1 :], at.getName()))
    return found


def _lock(spark: SparkSession, path: str) -> None:
    """Create a file that must not be there yet, waiting while another writer has it."""
    files, there = _files(spark, path), spark._jvm.org.apache.hadoop.fs.Path(path)
    files.mkdirs(there.getParent())
    local = files.getUri().getScheme() == "file"
    for _ in range(int(PATIENCE * 10)):
        try:
            # the local file system of Hadoop looks before it creates; Java's own creates or fails
            if spark._jvm.java.io.File(there.toUri().getPath()).createNewFile() if local else files.create(there, False).close() is None:
                return
        except Py4JJavaError as error:
            if not files.exists(there):
                raise error
        time.sleep(0.1)
    raise TimeoutError(f"{path} is locked; if no writer is running, it was left by one that died and may be deleted")


_STORED = RUNS + ", bucket int, day date"


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(path).drop("bucket", "day")


def lookup(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """``get`` from a store, reading the bucket of the id only (and what older stores keep without buckets)."""
    rows = spark.read.schema(_STORED).parquet(path)
    own = spark.range(1).select(bucket_of(F.lit(run_id)).alias("b")).first()["b"]
    return get(rows.where((F.col("bucket") == own) | F.col("bucket").isNull()).drop("bucket", "day"), run_id)


def get(runs: DataFrame, run_id: str) -> DataFrame:
    """The run with its payload parsed; fields that older payloads lack are null. An unknown id is an error."""
    found = runs.where(F.col("id") == run_id)
    if found.isEmpty():
        raise KeyError(f"run {run_id!r} not found")
    return found.withColumn("run", F.from_json("payload", PAYLOAD))


def latest(runs: DataFrame, n: int = 20) -> DataFrame:
    """The n newest runs by time of creation, then id; n below 1 means 20."""
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n if n > 0 else 20)


def expected_cost(scenarios: Column) -> Column:
    """Cost of the scenario named expected, else of the middle one, else 0."""
    named = F.try_element_at(F.filter(scenarios, lambda s: s["name"] == "expected"), F.lit(1))["cost_micros"]
    middle = F.try_element_at(scenarios, F.floor(F.size(scenarios) / 2).cast("int") + 1)["cost_micros"]
    return F.coalesce(named, middle, F.lit(0).cast("long"))


def _sides(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Full outer join with both sides' values, 0 where a side is missing."""
    x = a.select(*key, *[F.col(v).alias(f"{v}_a") for v in values])
    y = b.select(*key, *[F.col(v).alias(f"{v}_b") for v in values])
    zero = {f"{v}_{s}": 0 for v in values for s in "ab"}
    return x.join(y, key, "full_outer").na.fill(zero)


def diff_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tokens and expected cost (model, tokens, cost) of two runs, and what they differ by. A model named twice counts once, as last seen."""
    if "ordinal" in a.columns and "ordinal" in b.columns:
        last = lambda df: df.groupBy("model").agg(F.max_by("tokens", "ordinal").alias("tokens"), F.max_by("cost", "ordinal").alias("cost"))
        a, b = last(a), last(b)
    rows = _sides(a, b, ["model"], ["tokens", "cost"])
    return rows.withColumns({"token_delta": F.col("tokens_b") - F.col("tokens_a"), "cost_delta": F.col("cost_b") - F.col("cost_a")})


def diff_components(a: DataFrame, b: DataFrame) -> DataFrame:
    """(modality, unit) totals that differ."""
    total = lambda df: df.groupBy("modality", "unit").agg(F.sum("expected").alias("expected"))
    rows = _sides(total(a), total(b), ["modality", "unit"], ["expected"])
    return rows.where("expected_a <> expected_b").withColumn("delta", F.col("expected_b") - F.col("expected_a"))


def diff_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sources (label, path, kind, sha256) added, removed or changed, by path or else kind and label."""
    key = F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise(F.concat_ws(":", "kind", "label"))
    x, y = (df.select(key.alias("source"), F.col("sha256").alias(s)) for df, s in ((a, "sha_a"), (b, "sha_b")))
    change = F.when(F.col("sha_a").isNull(), "added").when(F.col("sha_b").isNull(), "removed").when(F.col("sha_a") != F.col("sha_b"), "changed")
    return x.join(y, "source", "full_outer").select("source", change.alias("change")).where("change IS NOT NULL")


def diff(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Model, component and source differences of two fetched runs (``get``)."""
    def results(run):
        return run.select(F.posexplode("run.results").alias("ordinal", "r"))

    models = lambda run: results(run).select("ordinal", "r.model", F.coalesce("r.input_tokens", F.lit(0).cast("long")).alias("tokens"), expected_cost(F.col("r.scenarios")).alias("cost"))
    parts = lambda run: results(run).select(F.explode("r.components").alias("c")).select("c.*")
    sources = lambda run: run.select(F.explode("run.sources").alias("s")).select("s.*")
    return diff_models(models(a), models(b)), diff_components(parts(a), parts(b)), diff_sources(sources(a), sources(b))

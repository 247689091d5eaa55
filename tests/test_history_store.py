"""The store of runs: two writers of one id, lookups by bucket, older layouts, and nothing left of a refused save."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from quillcount.operators import history as hs


def runs(spark, ids, day="2026-01-02"):
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    payload = F.to_json(F.struct(F.lit("v1").alias("schema"), F.lit("c").alias("catalog_version")))
    return df.select("id", F.lit(f"{day} 03:04:05").cast("timestamp").alias("created_at"), F.lit("c").alias("catalog_version"), F.array(F.lit("m")).alias("models"), F.lit(1).cast("long").alias("total_bytes"), F.lit(False).alias("incomplete"), payload.alias("payload"))


def test_two_writers_of_one_id(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    hs.save(runs(spark, ["first"]), path)
    said = []

    def write(k):
        try:
            hs.save(runs(spark, ["same", f"own-{k}"]), path)
            said.append("stored")
        except ValueError as error:
            said.append(str(error))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(said) == ["a run of that id is stored already"] * 2 + ["stored"]
    ids = sorted(r["id"] for r in hs.load(spark, path).collect())
    assert len(ids) == 3 and ids[0] == "first" and ids[1].startswith("own-") and ids[2] == "same"  # the losers' other runs are not there
    assert os.listdir(tmp_path / "runs" / "_locks") == [] and os.listdir(tmp_path / "runs" / "_staged") == []


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    ids = [f"run-{k}" for k in range(200)]
    hs.save(runs(spark, ids), path)
    hs.save(runs(spark, ["later"], "2026-03-04"), path)
    found = hs.lookup(spark, path, "run-7")
    assert [r["id"] for r in found.collect()] == ["run-7"] and hs.lookup(spark, path, "later").first()["run"]["catalog_version"] == "c"
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(KeyError):
        hs.lookup(spark, path, "run-999")
    assert hs.load(spark, path).count() == 201 and hs.latest(hs.load(spark, path), 1).first()["id"] == "later"
    with pytest.raises(ValueError):
        hs.save(runs(spark, ["fresh", "run-3"]), path)
    with pytest.raises(ValueError):
        hs.save(runs(spark, ["twice", "twice"]), path)
    assert hs.load(spark, path).count() == 201


def test_stores_without_buckets_stay_readable(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    runs(spark, ["old"]).withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(path)
    assert hs.lookup(spark, path, "old").first()["id"] == "old"
    hs.save(runs(spark, ["new"], "2026-05-06"), path)
    with pytest.raises(ValueError):
        hs.save(runs(spark, ["old"]), path)
    assert sorted(r["id"] for r in hs.load(spark, path).collect()) == ["new", "old"] and hs.lookup(spark, path, "new").count() == 1


def test_a_lock_that_stays_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hs, "PATIENCE", 0.3)
    path = f"file://{tmp_path}/runs"
    hs.save(runs(spark, ["a"]), path)
    bucket = spark.range(1).select(hs.bucket_of(F.lit("b"))).first()[0]
    os.makedirs(tmp_path / "runs" / "_locks", exist_ok=True)
    (tmp_path / "runs" / "_locks" / str(bucket)).touch()
    with pytest.raises(TimeoutError, match="locked"):
        hs.save(runs(spark, ["b"]), path)
    assert [r["id"] for r in hs.load(spark, path).collect()] == ["a"]

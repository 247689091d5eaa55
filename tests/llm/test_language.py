"""Language identification: held-out accuracy, sizes recomputed text by text, and defined results."""

import re
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from quillcount.llm import language as la
from quillcount.llm.queries import queries


def test_held_out_accuracy_and_columns(spark):
    where = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    rows = queries()["op12_language_id"](spark, where).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]
    assert len(held) > 200 and np.mean(right) >= 0.98
    sure = [r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held if not r["rejected"]]
    assert len(sure) > 0.9 * len(held) and np.mean(sure) >= np.mean(right)


def test_sizes_recomputed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    model = la.fit(docs.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in la.identified(docs, model).collect()}
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False)
    for r in docs.collect():
        text = (" " + re.sub(r"[^\w]|[\d_]", " ", r["text"].lower()) + " ").encode()
        text = re.sub(rb" +", b" ", text)
        size = []
        for d in model.dictionaries:
            own = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            size.append(sum(len(own.compress(text[i : i + la.BLOCK])) for i in range(0, len(text), la.BLOCK)))
        best = size.index(min(size))
        assert got[r["doc_id"]]["lang_pred"] == model.names[best]
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(2.0 ** (min(size) - s) for s in size)) < 1e-12


def test_dictionaries_are_bounded_and_do_not_depend_on_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text")
    copies = docs.unionByName(spark.range(3000).select(F.lit("en").alias("lang"), F.lit("copied words here " * 40).alias("text")))
    a, b = la.fit(copies.repartition(7)), la.fit(copies.orderBy(F.desc("text")))
    assert a == b and set(a.names) == {"de", "en", "es", "fr"} and a.names[0] == "en"
    assert all(0 < len(d) <= la.DICTIONARY for d in a.dictionaries) and len(a.dictionaries[0]) > la.DICTIONARY * 0.9
    assert a.dictionaries[0].count(b"copied words here copied") < 60  # each distinct piece once


def test_defined_results(spark):
    many = [("en", "the people of the town were there with the others and they went home again"), ("de", "die leute der stadt waren dort mit den anderen und sie gingen wieder nach hause")] * 5
    train = spark.createDataFrame([*many, (None, "nobody knows"), ("xx", "123"), ("en", None)], "lang string, text string")
    model = la.fit(train)
    assert model.names == ("de", "en")
    rows = [(1, "the others went home"), (2, "die anderen gingen nach hause"), (None, "The PEOPLE of the town!!"), (4, None), (5, ""), (6, "12 34 ..."), (7, "zq"), (7, "zq"), (8, "die stadt der leute " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("piece", F.lit(1))
    out = la.identified(docs, model)
    assert out.columns == ["doc_id", "piece", "lang_pred", "score", "margin", "rejected"]
    got = [(r["doc_id"], r["lang_pred"]) for r in out.collect()]
    assert got == [(1, "en"), (2, "de"), (None, "en"), (4, "und"), (5, "und"), (6, "und"), (7, "de"), (7, "de"), (8, "de")]
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["score"] == 0.0 and by[4]["rejected"] and by[7]["rejected"] and by[7]["score"] == 0.5 and not by[1]["rejected"] and not by[8]["rejected"]
    assert la.identified(docs.limit(0), model).collect() == []
    none = la.fit(train.limit(0))
    assert none == la.Languages((), ()) and {r["lang_pred"] for r in la.identified(docs, none).collect()} == {"und"}
    one = la.identified(docs.where("doc_id = 1"), la.fit(train.where("lang = 'en'"))).collect()[0]
    assert (one["lang_pred"], one["score"], one["rejected"]) == ("en", 1.0, False)

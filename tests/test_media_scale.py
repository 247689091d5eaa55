"""What media requests cost: the image formula without a search, methods that are compiled, rows that are dealt out."""

import math
import os

import pytest
from pyspark.sql import functions as F

from quillcount.functions.images import image_tokens, with_image_rule, with_image_tokens
from quillcount.operators import analyze as an
from quillcount.plans import queries
from quillcount.sources import catalog as cat

TABLES = "/root/testdata/sf0.001"
RULE = "struct<kind:string,patch_width:int,patch_height:int,multiplier:double,small_threshold:int,tile_size:int,tokens_per_tile:bigint,details:map<string,struct<mode:string,fixed_tokens:bigint,max_patches:bigint,max_edge:int>>>"
#: HotSpot leaves longer methods to its interpreter.
COMPILED = 8_000


def up(a, b):
    return -(-a // b)


def pixel_by_pixel(pw, ph, multiplier, most, edge, w, h):
    if edge and max(w, h) > edge:
        by = min(edge / w, edge / h)
        w, h = max(1, int(w * by)), max(1, int(h * by))
    if most and (n := up(w, pw) * up(h, ph)) > most:
        by = math.sqrt(most / n)
        w, h = max(1, int(w * by)), max(1, int(h * by))
        while up(w, pw) * up(h, ph) > most:
            w, h = (w - 1, h) if w >= h else (w, h - 1)
    n = up(w, pw) * up(h, ph)
    return math.ceil(n * multiplier), w, h, n, 0


def test_images_by_closed_form(spark):
    """Square and other patches, thin and equal sides, limits that both sides have to give way to."""
    sides = [(1, 9_000), (9_000, 1), (5, 200_000), (1_000, 1_000), (1_000, 1_001), (1_001, 1_000), (4_999, 5_000), (1_275, 1_650), (33, 64), (2_047, 3)]
    limits = [(0, 0), (1, 0), (2, 0), (5, 0), (6, 0), (12, 512), (30, 0), (768, 1_096), (1_568, 1_568), (1_536, 0)]
    cases = [(pw, ph, 1.62, most, edge, w, h) for pw, ph in ((32, 32), (28, 28), (1, 1), (16, 48), (50, 7)) for most, edge in limits for w, h in sides]
    rows = [(i, ("patch", pw, ph, m, 0, 0, 0, {"auto": ("patch", 0, most, edge)}), w, h) for i, (pw, ph, m, most, edge, w, h) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i long, rule {RULE}, w int, h int").repartition(4).cache()
    wanted = {i: pixel_by_pixel(*case) for i, case in enumerate(cases)}
    by_columns = with_image_tokens(with_image_rule(df, "c", F.col("rule"), F.lit("auto")), "c", F.col("w"), F.col("h"))
    by_column = df.withColumn("c", image_tokens(F.col("rule"), F.lit("auto"), F.col("w"), F.col("h")))
    for got in (by_columns, by_column):
        assert {r[0]: tuple(r[1:]) for r in got.select("i", "c.*").collect()} == wanted


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_a_file_of_one_row_group_is_dealt_out(spark):
    sources = queries._media_sources(spark, TABLES)
    full = sources.select(F.spark_partition_id().alias("p"), "request_id").distinct().groupBy("request_id").count()
    assert sources.select(F.spark_partition_id()).distinct().count() >= 2 * spark.sparkContext.defaultParallelism
    assert full.where("count > 1").isEmpty()


def planned(spark, name):
    """The plan of a query, and the longest methods of its stages."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan()
        stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
        return plan.toString().split("\n"), [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("name", ["media_components", "media_requests"])
def test_methods_are_compiled(spark, name):
    """Before, the class sums and counts of a text were one method of 9,438 bytes."""
    lines, sizes = planned(spark, name)
    assert sizes and max(sizes) < COMPILED
    assert not [x for x in lines if "NestedLoopJoin" in x and "size(" in x]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_requests_are_read_twice_at_most(spark):
    """Before, 8 times: sums, states, totals and shares of the cache, each for models and scenarios."""
    lines, _ = planned(spark, "media_requests")
    assert sum("FileScan" in x for x in lines) <= 2 and sum("SortMergeJoin" in x for x in lines) <= 1


def micros(rate, n):
    return (rate * n + 500_000) // 1_000_000 if rate > 0 and n > 0 else 0


@pytest.mark.parametrize("cached", [0, 100_000, 10_000_000])
@pytest.mark.parametrize("bound", ["expected", "high"])
def test_components_are_priced_at_the_tier_of_the_whole_request(spark, cached, bound):
    """Long recordings take a request over a tier; more may be cached than it has."""
    models = {m.id: m for m in cat.default_catalog().models if m.id in ("gemini-2.5-pro", "gemini-2.5-flash")}
    rows = [(r, label, kind, mime, text, "" if kind == "prompt" else label, ms) for r, label, kind, mime, text, ms in (
        ("long", "a", "audio", "audio/wav", "", 4_000_000), ("long", "b", "audio", "audio/wav", "said (in part)", 3_999_990), ("long", "c", "prompt", "", "word " * 900, None), ("short", "a", "audio", "audio/wav", "", 1_500), ("short", "c", "prompt", "", "What is it?", None),
        ("text", "c", "prompt", "", "only words", None))]
    df = spark.createDataFrame(rows, "request_id string, label string, kind string, mime string, text string, asset_id string, ms long")
    audio = F.when(F.col("ms").isNotNull(), F.struct(F.col("ms").alias("duration_ms"), F.lit("wav").alias("codec"), F.lit(8_000).alias("sample_rate_hz"), F.lit(1).alias("channels")))
    src = df.select("request_id", "label", F.col("label").alias("path"), "kind", F.lit("").alias("sha256"), F.lit(10).cast("long").alias("bytes"), "asset_id", "mime", "text", F.lit(None).cast(an.IMAGE).alias("image"), audio.cast(an.AUDIO).alias("audio"), F.lit(None).cast(an.DOCUMENT).alias("document"))
    r = an.analyze(src, cat.models(spark, cat.default_catalog(), list(models)), an.Options(profile="codex", bound=bound, cached_tokens=cached))
    parts = {}
    for x in r.components.orderBy("ordinal", "part_no").collect():
        parts.setdefault((x.request_id, x.model), []).append((x.modality, x.expected, x.high))
    found = r.both.collect()
    assert len(found) == 6
    for x in found:
        m, own = models[x.model], parts[x.request_id, x.model]
        if x.request_id == "text":
            tier = m.tiers[0]
            share = min(cached, x.decision_tokens)
            assert (x.input_micros, x.cached_micros) == (micros(tier.input, x.decision_tokens - share), micros(tier.cached, share))
            continue
        sizes = [high if bound == "high" else expected for _, expected, high in own]
        assert x.input_tokens == sum(e for _, e, _ in own) + x.overhead_tokens and x.n_sources == {"long": 3, "short": 2}[x.request_id] and x.total_bytes == 10 * x.n_sources
        tier = lambda modality, m=m, x=x: [t for t in m.modality_tiers.get(modality, m.tiers) if x.decision_tokens >= t.above][-1]
        left, regular, from_cache = min(cached, x.decision_tokens), 0, 0
        for modality, n in [*zip([p[0] for p in own], sizes, strict=True), ("text", x.decision_tokens - sum(sizes))]:
            share = min(n, left)
            left -= share
            regular, from_cache = regular + micros(tier(modality).input, n - share), from_cache + micros(tier(modality).cached, share)
        assert (x.input_micros, x.cached_micros) == (regular, from_cache)
        assert x.request_id != "long" or x.model != "gemini-2.5-pro" or tier("audio") is m.tiers[1]

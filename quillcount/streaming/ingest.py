"""Extension: heuristic token counts over files or rows that keep arriving.

Not part of the batch operators' inventory. Sums per request and window are
ordinary streaming aggregates, since the counts are additive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.counters import heuristic
from ..functions.text import CLASSES, with_classes


def arriving_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of whole text files with their modification time."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.col("path").alias("label"), F.col("modificationTime").alias("ts"), F.col("content").cast("string").alias("text"))


def windowed_counts(texts: DataFrame, family: str = "legacy", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tokens per window of a stream (ts, text); rows later than ``late`` are dropped by the watermark."""
    rows = with_classes(texts.withWatermark("ts", late), "text")
    sums = [(F.max if c == "code" else F.sum)(c).alias(c) for c in CLASSES]
    out = rows.groupBy(F.window("ts", window)).agg(F.count("*").alias("n_texts"), *sums)
    c = heuristic(family, {k: F.col(k) for k in CLASSES})
    return out.select(F.col("window.start").alias("start"), "n_texts", c["tokens"].alias("tokens"), c["low"].alias("low"), c["high"].alias("high"))

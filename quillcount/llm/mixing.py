"""Mixing sources to target weights by capped water-filling (native).

Every source's share of a word budget follows its weight, clamped at a maximum
number of epochs of its own size; what the clamped sources leave is reshared
among the others in proportion to their weights, round by round, until none is
above its clamp. A round is one sum over the sources.

A document is then taken floor(rate) times whole, where rate = target / size of
its source, and the rest of the target is filled by a seeded order of the
source's documents: whole ones up to the target and, of the one in which the
target falls, a part. That order is cut by sums over hash ranges of a source:
the range in which the target falls is cut again until it has few words, and
only then its documents are put in order, so no source, however large, is ever
gathered in one task. Sources may be as many as documents: they are ranked by
ranges too.

Defined results: a null text has size 0 and is taken 0 times; very long texts
are documents like others; null sources form one source, last in order;
repeated rows are rows of their own (their order among themselves changes
nothing but which of the equal rows is taken); an empty table gives an empty
table; other columns are carried along untouched, and one that has the name of
an added column gets an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, table, word_count

SEED = 17
#: Hexadecimal digits of a key by which ranges are cut at a time, until the one that matters has no more words than this.
RANGE_DIGITS, RANGE_WORDS = 3, 1 << 20


def with_cyclic_weights(sizes: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """``sizes`` (source, ...) with ``weight``, repeating by code-point order of the sources, null last.

    Sources are sorted into ranges, and a rank is that in its range plus the sizes of those before.
    """
    by = F.col("source").asc_nulls_last()
    ranges = sizes.repartitionByRange(shuffle_partitions(sizes.sparkSession), by).withColumn("range", F.spark_partition_id())
    ranges = staged(ranges, "mix-ranges")
    # a row per range
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.pmod(rank, F.lit(len(cycle))) + 1).cast("int"))
    return ranges.join(offsets, "range").withColumn("weight", weight).drop("range", "before")


def source_targets(weighed: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``weighed`` (source, source_size, weight; staged) with the water-filled ``target``."""
    rows = weighed.withColumn("clamp", F.col("source_size") * F.lit(float(max_epochs)))
    budget = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = 0.0, -1
    while True:
        over = F.col("clamp") < F.lit(level) * F.col("weight")
        sums = rows.agg(F.count(F.when(over, 1)).alias("clamped"), F.sum(F.when(over, F.col("clamp"))).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        # a source that is clamped stays so, for the level never falls
        if sums["clamped"] == clamped or not sums["open"]:
            break
        clamped, level = sums["clamped"], (budget - (sums["taken"] or 0.0)) / sums["open"]
    return rows.select("source", "source_size", "weight", F.least("clamp", F.lit(level) * F.col("weight")).alias("target"))


def seeded_key(*of: Column, seed: int = SEED) -> Column:
    """Hexadecimal digits that order rows at random, the same in every run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("")) for x in of]).cast("binary"))


def mix(rows: DataFrame, slim: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (row, source, size, key) as (row, size, source_size, target, repeats, part, taken):
    ``repeats`` whole copies and ``part`` words of one more, partial copy make ``taken`` words.

    ``slim`` (source, size, key) is the same rows, staged.
    """
    of = [F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none")]
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    own = targets.select(*of, "source_size", "target", whole.alias("whole"))
    own = staged(own.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long")), "mix-targets")
    slim = slim.select(*of, "size", "key")
    # the one range of each source in which its rest falls, cut again while one of them has many words
    falls = own.where("rest > 0").select("name", "none", "rest", F.lit("").alias("falls"), F.lit(0).cast("long").alias("before"))
    digits = 0
    while True:
        digits += RANGE_DIGITS
        inside = slim.join(falls, ["name", "none"]).where(F.startswith("key", F.col("falls")))
        ranges = inside.groupBy("name", "none", "rest", "before", F.substring("key", 1, digits).alias("falls")).agg(F.sum("size").alias("words"))
        sofar = F.sum("words").over(Window.partitionBy("name", "none").orderBy("falls").rowsBetween(Window.unboundedPreceding, -1))
        ranges = ranges.withColumn("before", F.col("before") + F.coalesce(sofar, F.lit(0)))
        ranges = staged(ranges.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words"))), "mix-falls")
        falls = ranges.drop("words")
        if (ranges.agg(F.max("words")).first()[0] or 0) <= RANGE_WORDS or digits >= 30:
            break
    # a row per source: Spark broadcasts it if its staged size allows, and else splits the hot sources of a sorted join
    known = staged(own.join(falls.drop("rest"), ["name", "none"], "left"), "mix-sources")
    rows = rows.select("row", *of, "size", "key").join(known, ["name", "none"], "left").withColumn("range", F.substring("key", 1, digits))
    inside = F.coalesce(F.col("range") == F.col("falls"), F.lit(False))
    order = Window.partitionBy("name", "none").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    cut = rows.where(inside).withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    rest = rows.where(~inside).withColumn("more", F.when(F.col("range") < F.col("falls"), F.col("size")).otherwise(F.lit(0)))
    out = cut.unionByName(rest)
    # a part that is the whole document is one more whole copy
    full = (F.col("more") == F.col("size")) & (F.col("size") > 0)
    out = out.withColumns({"repeats": F.col("whole") + full.cast("int"), "part": F.when(full, F.lit(0)).otherwise(F.col("more")).cast("long")})
    taken = (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken")
    return out.select("row", "size", "source_size", "target", "repeats", "part", taken)


def _mixed(docs: DataFrame, share: float, max_epochs: float, seed: int) -> DataFrame:
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed=seed).alias("key"))
    slim = staged(rows.select("source", "size", "key"), "mix-rows")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = staged(with_cyclic_weights(sizes), "mix-sizes")
    return mix(rows, slim, source_targets(weighed, share, max_epochs))


def mixed(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """Documents (doc_id, text, source, ...) with the columns of ``mix``, in words."""
    out = _mixed(docs, share, max_epochs, seed)
    added = out.columns[1:]
    return out.select(*[F.col("row").getField(c).alias(c + "_" if c.lower() in added else c) for c in docs.columns], *added)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-documents")
    rows = slim.select(F.struct("doc_id").alias("row"), "source", "size", seeded_key(F.col("doc_id")).alias("key"))
    weighed = staged(with_cyclic_weights(slim.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-sizes")
    out = mix(rows, rows.select("source", "size", "key"), source_targets(weighed))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "repeats")


OP5_SQL = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, ([3, 1, 2])[(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS clamp
  FROM sizes),
levels AS (
  SELECT *, clamp / weight AS ratio,
         (sum(source_size) OVER () * 1.5::DOUBLE
          - coalesce(sum(clamp) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
         / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
settled AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level * weight <= clamp),
targets AS (
  SELECT l.source, l.source_size, coalesce(least(l.clamp, s.level * l.weight), l.clamp) AS target FROM levels l CROSS JOIN settled s),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
running AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         floor(p.target - p.whole * p.source_size + 0.5::DOUBLE)::BIGINT AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, rest - before)) AS taken,
       (whole + CASE WHEN size > 0 AND rest - before >= size THEN 1 ELSE 0 END)::INT AS repeats
FROM running
"""


def materialised(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each document (doc_id, text, source, n_chars, ...) as often as it is
    taken, and the one that its source's target cuts with the first of its words."""
    plan = _mixed(docs, share, max_epochs, seed)
    whole = F.transform(F.when(F.col("repeats") > 0, F.sequence(F.lit(1), F.col("repeats"))).otherwise(F.array().cast("array<int>")), lambda i: F.lit(0).cast("long"))
    copies = F.concat(whole, F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))
    rows = plan.select("row", F.explode(copies).alias("words"))
    # a word with the white space before it, as often as words are taken
    text = F.col("row.text")
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), 1), F.lit(1), F.col("words").cast("int")), "")
    rows = rows.withColumn("cut", F.when(F.col("words") > 0, first))
    of = {c: F.col("row").getField(c) for c in docs.columns}
    of["text"] = F.coalesce("cut", of["text"])
    if "n_chars" in of:
        of["n_chars"] = F.when(F.col("cut").isNotNull(), F.char_length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(of["n_chars"])
    return rows.select(*[v.alias(c) for c, v in of.items()])

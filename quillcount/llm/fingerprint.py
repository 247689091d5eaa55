"""Document fingerprints: threshold-scaled sketches of word shingles (native).

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range, so its size follows the document's; where none lies there, as in most
texts of one shingle, it keeps the least one. Sketches of one fraction merge by
set union, and the share of one sketch's hashes found in another estimates
containment even between very unequal documents.

A fingerprint is the text form of a sketch: the number of shingles, a colon and
the kept hashes as 16 hexadecimal digits each, ascending. Texts are lower-cased
and cut into words; a shingle is five words, or all of a shorter text. An empty
or null text has no shingle and the fingerprint ``0:``; only such sketches have
no hashes, are alike (1.0) and lie within every other. A least hash above the
fraction compares only with its equal: of a text that has no other, a sketch of
hashes below the fraction cannot tell whether it lies within, and 0.0 is given.

Defined results: very long texts are sketched whole, as other texts; equal
texts, and repeated rows, have equal sketches; rows of one doc_id follow each
other in any order; null ids come first; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, table

SHINGLE_WORDS = 5
#: A kept hash lies in the lowest quarter of the signed 64-bit range.
FRACTION = 0.25
#: Bytes of texts that a range of ids has, to find each one's successor within; ranges for each shuffle partition at least.
RANGE_BYTES, RANGES_EACH = 64 << 20, 16


def shingle_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(text: Column, fraction: float = FRACTION, k: int = SHINGLE_WORDS) -> Column:
    """struct(n long, kept array<long>, above boolean): number of shingles, the distinct hashes
    kept, ascending, and whether that is a least one above the fraction."""
    below = F.lit(min(2**63 - 1, int(-(2**63) + fraction * 2**64)))
    hashed = F.transform(
        F.array(shingle_words(F.coalesce(text, F.lit("")))),
        lambda words: F.transform(
            F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (k - 1)))),
            lambda i: F.xxhash64(F.slice(words, i, F.lit(k))),
        ),
    )
    return F.transform(
        hashed,
        lambda hashes: F.struct(
            F.size(hashes).cast("long").alias("n"),
            F.when(F.array_min(hashes) >= below, F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < below)))).alias("kept"),
            F.coalesce(F.array_min(hashes) >= below, F.lit(False)).alias("above"),
        ),
    )[0]


def fingerprint(s: Column) -> Column:
    """Text form of a sketch."""
    return F.concat(s["n"].cast("string"), F.lit(":"), F.array_join(F.transform(s["kept"], lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def merged(a: Column, b: Column) -> Column:
    """Kept hashes of the union of two documents; one above the fraction stays only if it is the least of both."""
    both = F.array_sort(F.array_union(a["kept"], b["kept"]))
    return F.when(a["above"] & b["above"], F.slice(both, 1, 1)).when(a["above"] & (F.size(b["kept"]) > 0), b["kept"]).when(b["above"] & (F.size(a["kept"]) > 0), a["kept"]).otherwise(both)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    either = F.size(a["kept"]) + F.size(b["kept"]) - both
    return F.when(either == 0, (a["n"] == b["n"]).cast("double")).otherwise(F.try_divide(both, either)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first sketch's shingles that the second has."""
    both = F.size(F.array_intersect(a["kept"], b["kept"]))
    return F.when(F.size(a["kept"]) == 0, (a["n"] <= b["n"]).cast("double")).otherwise(F.try_divide(both, F.size(a["kept"]))).cast("double")


def id_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row with the array ``cuts`` between ranges of ids, a row per range that holds an id:
    ``first``, the least id, and ``to``, the range before it, the last one before the first).

    The number of ranges follows the bytes of the texts; ranges lie between quantiles of the ids.
    """
    ids = staged(docs.select("doc_id", F.octet_length("text").alias("bytes")), "fingerprint-ids")
    total = ids.agg(F.sum("bytes")).first()[0] or 0
    ranges = max(RANGES_EACH * shuffle_partitions(docs.sparkSession), -(-total // RANGE_BYTES))
    quantiles = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges))
    cuts = ids.agg(F.array_sort(F.array_distinct(F.coalesce(quantiles, F.array().cast("array<bigint>")))).alias("cuts"))
    cuts = staged(cuts, "fingerprint-cuts")
    firsts = ids.withColumn("cuts", cuts.scalar()).groupBy(range_of("doc_id", "cuts").alias("own")).agg(F.min("doc_id").alias("first")).where("first IS NOT NULL")
    order = Window.orderBy("own")  # over a row per range
    firsts = firsts.select("first", F.coalesce(F.lag("own").over(order), F.max("own").over(Window.partitionBy())).alias("to"), (F.row_number().over(order) == 1).alias("wraps"))
    return cuts, staged(firsts, "fingerprint-ranges")


def range_of(value: str, cuts: str) -> Column:
    """How many of the ascending ``cuts`` do not exceed a value, by bisection."""
    x, c = F.col(value), F.col(cuts)
    halves = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    return F.aggregate(halves, F.lit(0), lambda i, s: F.when((i + s <= F.size(c)) & (F.try_element_at(c, F.greatest(F.lit(1), F.least(i + s, F.size(c)))) <= x), i + s).otherwise(i))


def with_next(docs: DataFrame, carried: list[str], computed: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the columns ``computed``, and ``next_<column>`` of the document
    that follows by ascending doc_id (after the last, the first).

    Documents are dealt once, by ranges of ids; the first one of a range is also sent to the range
    before it. Null ids come first and are nobody's successor at the end.
    """
    cuts, firsts = id_ranges(docs)
    own = docs.withColumn("_cuts", cuts.scalar()).withColumn("_range", range_of("doc_id", "_cuts")).drop("_cuts")
    guests = docs.join(firsts, F.col("doc_id") == F.col("first")).withColumnRenamed("to", "_range").withColumn("_guest", F.when(F.col("wraps"), F.lit(2)).otherwise(F.lit(1))).drop("first", "wraps")
    rows = own.withColumn("_guest", F.lit(0)).unionByName(guests).withColumns(computed or {})
    order = Window.partitionBy("_range").orderBy(F.greatest(F.col("_guest"), F.lit(1)), F.col("doc_id").asc_nulls_first(), "_guest")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried})
    return rows.where(F.col("_guest") == 0).drop("_range", "_guest")


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # sketches are made behind the join that finds the guests, so once for each row
    rows = with_next(docs, ["text", "own"], {"own": sketch(F.col("text"))})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited", sketch(F.col("edited_text")))
    own, edited, following = F.col("own"), F.col("edited"), F.col("next_own")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(own, edited).alias("within_edited"),
        containment(own, following).alias("within_next"),
    )

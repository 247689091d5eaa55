"""Language identification by compression: the language whose zstandard dictionary shortens a text most.

Texts are lower-cased and all but letters and their marks become single spaces.
From the labelled texts of each language, pieces of ``PIECE`` characters with
the least hashes (a sample that does not depend on order or place) are put one
after the other as a raw-content dictionary of at most ``DICTIONARY`` bytes. A
text is encoded, whole, in blocks of ``BLOCK`` bytes with every dictionary; the
sum of encoded sizes is least under the predicted language. The score is 1 over
the sum of 2^-d over all languages, d bytes behind the best; where the second
best is less than ``LEAD`` bytes or less than ``MARGIN`` of the best size behind,
the guess is marked as rejected.

The dictionaries are the one thing that is sampled: 256 pieces to a language at
least where it has them, ``DICTIONARIES`` bytes in all at most, whatever the
corpus holds, so they can be broadcast.

Defined results: a text that is null or has no letter is ``und`` with score 0.0
and rejected; equally small encodings go to the language with more learned
texts, then the first by code point; documents with a null id are predicted but
neither held out nor learned from; repeated rows are rows like others, and equal
pieces stand in a dictionary once; very long texts are encoded whole; where
nothing can be learned every text is ``und``; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import configured, table

UNKNOWN = "und"
#: Characters of a piece; bytes of a dictionary, and of all together; bytes that are encoded at once.
PIECE, DICTIONARY, DICTIONARIES, BLOCK = 256, 64 << 10, 32 << 20, 4096
#: Pieces drawn for each one that a dictionary may hold, so that copies and short pieces leave enough.
DRAWN = 8
#: Margins below which a guess is rejected: share of the least size, and bytes.
MARGIN, LEAD = 0.01, 2
LETTER = r"\p{L}"


def letters(text: Column) -> Column:
    """Lower case, runs of anything but letters and marks as one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


@dataclass(frozen=True)
class Languages:
    """Dictionaries by language, those with more learned texts first."""

    names: tuple
    dictionaries: tuple

    def encoders(self) -> list:
        # lazy parsing over a binary tree finds three-letter matches, which short texts need; frames carry no sums or sizes
        how = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=16, hash_log=16, search_log=5, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False,
        )
        return [zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in self.dictionaries]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Dictionaries from rows with a language and a text with letters."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum(F.ceil(F.char_length("text") / PIECE)).alias("pieces"))
    learned = sorted(sizes.collect(), key=lambda r: (-r["texts"], r["lang"]))
    if not learned:
        return Languages((), ())
    budget = min(DICTIONARY, DICTIONARIES // len(learned))
    drawn_of = DRAWN * (budget // PIECE + 1)
    share = F.create_map(*[F.lit(x) for r in learned for x in (r["lang"], min(1.0, drawn_of / r["pieces"]))])[F.col("lang")]
    pieces = rows.select("lang", F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece")).withColumn("hash", F.xxhash64("piece"))
    # a hash below the share of the range, so the draw is bounded before anything is shuffled by language
    drawn = pieces.where(F.col("hash") / F.lit(2.0**64) + 0.5 <= share).groupBy("lang", "hash", "piece").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("lang").orderBy("hash", "piece")
    fits = drawn.withColumn("upto", F.sum(F.octet_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= budget)
    content = {r["lang"]: r["content"] for r in fits.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("hash", "piece"))), lambda x: x["piece"]), "").alias("content")).collect()}
    names = tuple(r["lang"] for r in learned if content.get(r["lang"]))
    return Languages(names, tuple(content[k].encode() for k in names))


def _guess(sizes: np.ndarray):
    """(index of the least size, score, margin, rejected) of each row of sizes; earlier columns win ties."""
    best = sizes.argmin(axis=1)
    least = sizes.min(axis=1)
    behind = sizes - least[:, None]
    score = 1 / np.exp2(-np.minimum(behind, 1000).astype(float)).sum(axis=1)
    lead = np.sort(behind, axis=1)[:, 1] if sizes.shape[1] > 1 else least
    margin = np.minimum(lead / np.maximum(least, 1), 1.0)
    return best, score, margin, (margin < MARGIN) | (lead < LEAD)


def identified(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` without its text and with lang_pred, score, margin and rejected; no shuffle."""
    spark = configured(docs.sparkSession)
    added = ("lang_pred", "score", "margin", "rejected")
    keep = [c for c in docs.columns if c != text and c.lower() not in added]
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        encoders, names = shared.value.encoders(), shared.value.names
        for batch in batches:
            column, n = batch.column(len(keep)).cast(pa.large_binary()), batch.num_rows
            sizes = np.zeros((n, max(len(names), 1)), np.int64)
            known = np.array([bool(names) and v.is_valid for v in column], bool)
            for i in np.flatnonzero(known):
                value = column[i].as_py()
                for k, encoder in enumerate(encoders):
                    sizes[i, k] = sum(len(encoder.compress(value[at : at + BLOCK])) for at in range(0, len(value), BLOCK))
            best, score, margin, rejected = _guess(sizes)
            guess = [names[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array(guess, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, margin, 0.0)), pa.array(np.where(known, rejected, True), pa.bool_())],
                names=[*keep, *added],
            )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    value = F.when(F.col(text).rlike(LETTER), letters(F.col(text)))
    return docs.select(*keep, value.alias(text)).mapInArrow(run, schema)


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = fit(docs.where(place != 2))
    rows = docs.select("doc_id", F.coalesce(place == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return identified(rows, model).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")

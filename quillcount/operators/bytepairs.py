"""Exact byte-pair counts of a corpus by dictionary encoding of its pre-tokens.

Texts are split natively by the vocabulary's pattern; pre-tokens are counted by
key, in part before they are shuffled; the merges are applied once to every
distinct pre-token of the corpus, in Arrow batches; and the lengths come back by
a join, as sums. Most of a corpus repeats itself, so merging grows with its
distinct pre-tokens, not with its bytes. A long text is first cut at places
that no pre-token spans, so no row holds all pre-tokens of a text.

A pre-token that is frequent everywhere has one row for each key; adaptive
execution splits what of that is skewed in the join.

Defined results: null and empty texts count 0; rows with equal keys, null ones
too, are counted together; characters that the pattern leaves out have no
token, as with the pattern's own encoder; an empty table gives an empty table.
The pattern's letters and numbers are those of Java's Unicode tables.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counters import Vocabulary
from ..functions.staging import staged
from .running import ranged, same, with_before

#: Characters after which a long text is cut at the next safe place.
STRETCH = 1 << 14
#: A letter or number before white space: no pre-token of the known patterns holds both.
SAFE = r"[\p{L}\p{N}](?=\s)"


def stretches(text: Column, length: int = STRETCH) -> Column:
    """Parts of a text that are split into pre-tokens independently of each other."""
    return F.regexp_extract_all(text, F.lit(rf"(?Us).{{{length},}}?{SAFE}|(?s).+"), F.lit(0))


def pre_tokens(text: Column, pattern: str) -> Column:
    """The pattern's matches; white space and case are those of Unicode, as in the pattern's own dialect."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


@lru_cache(maxsize=4)
def ranks_of(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, of equal ones the first, merges until none is left.

    A heap holds the pairs; one whose parts have changed since is recognised by its ends.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a part i is piece[i:end[i]]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        middle = end[i]
        if middle in (0, n, stop) or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def lengths(pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(piece, tokens) of a table of pre-tokens."""
    rank_file = vocabulary.rank_file

    def run(batches):
        ranks = ranks_of(rank_file)
        for batch in batches:
            sizes = [len(merged(p, ranks)) for p in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["piece", "tokens"])

    return pieces.select("piece").mapInArrow(run, "piece string, tokens long")


def counted(rows: DataFrame, key: list[str], text: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, tokens): exact ids of all texts of each key, every text by itself."""
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    names = [f"k{i}" for i in range(len(key))]
    parts = rows.select(*own, F.explode_outer(stretches(F.col(text))).alias("part"))
    pieces = parts.select(*names, F.explode_outer(pre_tokens(F.col("part"), vocabulary.pattern)).alias("piece"))
    uses = staged(pieces.groupBy(*names, "piece").agg(F.count("*").alias("n")), "pre-tokens")
    # merging is the costly part: the dictionary, small beside the corpus, is dealt to as many tasks as there are
    known = lengths(uses.where("piece IS NOT NULL").select("piece").distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), vocabulary)
    total = F.coalesce(F.sum(F.col("n") * F.col("tokens")), F.lit(0).cast("long"))
    out = uses.join(known, "piece", "left").groupBy(*names).agg(total.alias("tokens"))
    return out.select(*[F.col(o).alias(k) for o, k in zip(names, key, strict=True)], "tokens")


def request_counts(sources: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(request_id, raw, wrapped): ids of each request's joined texts, and of its wrapped ones, without assembling either.

    Sources (request_id, kind, label, text) are in the order (kind, label,
    digest). Between a text's first and last safe place it is counted by itself;
    what is left at its ends goes, through the line feed that joins them, with
    the ends of its neighbours, and with whole texts that have no such place,
    such as marks or white space alone; a run of those is one row. A wrapper has
    a safe place of its own, after its first word.
    """
    key, order = ["request_id"], ["kind", "label", "digest"]
    text = F.col("text")
    some = sources.where(F.octet_length(text) > 0).select(*key, "kind", "label", F.sha2(text.cast("binary"), 256).alias("digest"), "text")
    # a letter or number at the end is safe too, for a line feed or nothing comes next
    begun = F.regexp_extract("text", r"(?Us)^(.*?[\p{L}\p{N}])(?=\s|\z)", 1)
    until = F.regexp_extract("text", r"(?Us)^(.*[\p{L}\p{N}])(?=\s|\z)", 1)
    some = some.withColumns({"first": begun, "until": until}).withColumn("cut", (F.octet_length("until") > 0).cast("long"))
    rows = with_before(ranged(some, key, order), key, order, {"chain": F.col("cut"), "place": F.lit(1).cast("long")})
    cut, long = F.col("cut") > 0, lambda n: F.lit(n).cast("long")
    at = lambda chain, place, value: F.struct(chain.alias("chain"), place.alias("place"), value.alias("value"))
    end = F.substring("text", F.char_length("until") + 1, F.char_length("text"))
    inner = F.substring("text", F.char_length("first") + 1, F.char_length("until") - F.char_length("first"))
    loose = F.when(cut, F.array(at(F.col("chain"), F.col("place"), F.col("first")), at(F.col("chain") + 1, F.col("place"), end))).otherwise(F.array(at(F.col("chain"), F.col("place"), text)))
    ends = rows.select(*key, F.explode(loose).alias("x")).select(*key, "x.*").groupBy(*key, "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), "\n").alias("text"))
    middle = rows.where(cut).select(*key, inner.alias("text"))
    # <source| label="..">..</source>\n<source| label=..: cut after the first word of each wrapper
    name = F.translate("label", '"', "'")
    line = F.when(F.endswith(text, F.lit("\n")), "").otherwise("\n")
    opening = F.when(F.col("place") > 0, F.array()).otherwise(F.array(F.lit("<source")))
    total = some.groupBy(*key).agg((F.count("*") - 1).alias("_last"))
    own = rows.join(total.withColumnRenamed("request_id", "_of"), same([F.col("request_id")], [F.col("_of")]))
    body = F.concat(F.lit(' label="'), name, F.lit('">\n'), text, line, F.lit("</source>\n"), F.when(F.col("place") < F.col("_last"), F.lit("<source")).otherwise(F.lit("")))
    wrapped = own.select(*key, F.explode(F.concat(opening, F.array(body))).alias("text"))
    parts = [df.select(*key, F.lit(which).alias("which"), "text") for df, which in ((ends, "raw"), (middle, "raw"), (wrapped, "wrapped"))]
    sums = counted(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["request_id", "which"], "text", vocabulary)
    one = lambda which: F.coalesce(F.sum(F.when(F.col("which") == which, F.col("tokens"))), long(0)).alias(which)
    return sums.groupBy(*key).agg(one("raw"), one("wrapped"))

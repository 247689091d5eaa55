"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenised, closed with an end id and, if longer than a sequence,
cut into full pieces behind a shorter first one. Pieces are packed by best fit,
longest first, and a swap-based local search then moves single pieces, or
exchanges one for one, two for one and one for two, from emptier into fuller
underfull bins. Every accepted step raises the sum of squared fills, so bins
drain until some are empty. Partners are found through tables of the lengths,
and sums of two lengths, that underfull bins can give, so every bin is tried;
the search ends at the lower bound ceil(tokens / capacity) or in a local
optimum, when a pass over all underfull bins finds no step.

At scale, pieces are dealt at random to blocks of a bounded number of pieces,
each packed by one task. The underfull bins of all blocks are then dealt to
fewer blocks and packed again, until they fit one block or a round frees less
than a tenth of them.

Defined results: a null or empty text is one piece of length 1 (the end id); a
very long text becomes as many full pieces as it needs; of pieces of equal
length the one of the lower id is placed first; repeated rows are packed each;
null doc_ids are packed like others; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import base64
import itertools
import json
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configured, staged, table

CAPACITY = 2048
END_ID = 0
#: Pieces that one task packs at a time.
BLOCK_PIECES = 16_384
#: A bin below this share of the capacity is packed again in a later round.
UNDERFULL = 0.97
#: Rounds are numbered in the upper bits of a sequence id.
LAST_ROUND = 127

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, fill long"


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str):
    """A fast byte-pair encoder from a rank file, for text between a tokenizer's added tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizer(json_file: str):
    """The tokenizer of the contract, as it is."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_file)


@lru_cache(maxsize=2)
def added_tokens(json_file: str) -> tuple[re.Pattern, dict[str, int], bool]:
    """(pattern, ids, whether they are plain strings) of a tokenizer's added tokens."""
    with open(json_file, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")" if names else "(?!)()"), {t["content"]: t["id"] for t in added}, plain


def default_vocabulary() -> tuple[str, str, str]:
    """(rank file, split pattern, tokenizer file) of the 50k byte-level vocabulary."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")


def token_ids(text: str, vocabulary: tuple[str, str, str]) -> list[int]:
    """The ids of the tokenizer file with add_special_tokens=False: text is split at the added
    tokens, and the faster encoder of the same vocabulary encodes what lies between them."""
    pattern, added, plain = added_tokens(vocabulary[2])
    if not plain:
        return tokenizer(vocabulary[2]).encode(text, add_special_tokens=False).ids
    try:
        encode = encoder(*vocabulary[:2]).encode_ordinary
        if not pattern.search(text):
            return encode(text)
        return [i for part in pattern.split(text) if part for i in ([added[part]] if part in added else encode(part))]
    except BaseException as error:  # its regular expression gives up (a panic or ValueError) on some extreme runs of white space
        if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
            raise
        return tokenizer(vocabulary[2]).encode(text, add_special_tokens=False).ids


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones behind a shorter first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each document (doc_id, text)."""
    configured(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(token_ids(text.as_py() or "", vocabulary) + [END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    out.append((doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins as lists of indices, by best fit with the longest first."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    open_ = 0  # bit r: some bin has r free
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if high := open_ >> n:
            r = n + (high & -high).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := r - n:
            room[left].append(b)
            open_ |= 1 << left
    return bins


def sums(bin_: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """Distinct lengths of a bin's pieces, and distinct sums of two of them."""
    kinds = Counter(lengths[i] for i in bin_)
    single = sorted(kinds)
    pairs = {x + y for at, x in enumerate(single) for y in single[at + 1 :]} | {2 * x for x, n in kinds.items() if n > 1}
    return single, sorted(pairs)


def _pick(bin_: list[int], lengths: list[int], total: int, pieces: int) -> list[int]:
    """One piece of that length, or two of that sum."""
    if pieces == 1:
        return [next(i for i in bin_ if lengths[i] == total)]
    place: dict[int, int] = {}
    for i in bin_:
        if (other := place.get(total - lengths[i])) is not None:
            return [other, i]
        place.setdefault(lengths[i], i)
    raise LookupError


class _Partners:
    """For each amount that a bin can give back, the roomiest bin that can give it."""

    def __init__(self, capacity: int):
        self.room, self.bin = np.full(2 * capacity + 1, -1, np.int64), np.full(2 * capacity + 1, -1, np.int64)

    def put(self, b: int, room: int, amounts: list[int]) -> None:
        own = np.asarray(amounts, np.int64)
        own = own[self.room[own] <= room]
        self.room[own], self.bin[own] = room, b

    def drop(self, b: int) -> None:
        own = self.bin == b
        self.room[own], self.bin[own] = -1, -1

    def best(self, gives: list[int], capacity: int) -> tuple[int, int, int] | None:
        """(gain, given, taken) of the largest gain that fits the partner's room."""
        if not gives:
            return None
        back = np.flatnonzero(self.room >= 0)
        if not len(back):
            return None
        gain = np.asarray(gives, np.int64)[:, None] - back[None, :]
        gain = np.where((gain > 0) & (gain <= self.room[back][None, :]), gain, 0)
        at = int(gain.argmax())
        g, t = divmod(at, len(back))
        return (int(gain[g, t]), gives[g], int(back[t])) if gain[g, t] else None


def local_search(bins: list[list[int]], lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Drain emptier bins into fuller ones by moves and exchanges that raise the squared fill."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    least = math.ceil(sum(fill) / capacity)
    used = sum(1 for b in bins if b)
    changed = True
    while changed and used > least:
        changed = False
        # what fuller bins can give back: nothing or one piece, and two pieces
        one, two = _Partners(capacity), _Partners(capacity)

        def put(b):
            if 0 < fill[b] < capacity:
                single, pairs = sums(bins[b], lengths)
                one.put(b, capacity - fill[b], [0, *single])
                two.put(b, capacity - fill[b], pairs)

        for a in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: -fill[b]):
            while bins[a]:
                single, pairs = sums(bins[a], lengths)
                steps = [(s, n, m, table) for n, m, table, s in ((1, 1, one, one.best(single, capacity)), (2, 1, one, one.best(pairs, capacity)), (1, 2, two, two.best(single, capacity))) if s]
                if not steps:
                    break
                (gain, given, taken), n, m, table = max(steps, key=lambda s: s[0][0])
                b = int(table.bin[taken])
                if fill[b] + gain <= fill[a]:
                    break  # b has given to others meanwhile and is the emptier one; the next pass comes to it
                out, back = _pick(bins[a], lengths, given, n), _pick(bins[b], lengths, taken, m) if taken else []
                bins[a] = [i for i in bins[a] if i not in out] + back
                bins[b] = [j for j in bins[b] if j not in back] + out
                fill[a] -= gain
                fill[b] += gain
                changed = True
                one.drop(b)
                two.drop(b)
                put(b)
            used -= not bins[a]
            if used <= least:
                break
            put(a)
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins for one block of pieces."""
    full = [[i] for i, n in enumerate(lengths) if n >= capacity]
    rest = [i for i, n in enumerate(lengths) if n < capacity]
    own = [lengths[i] for i in rest]
    bins = local_search(best_fit(own, capacity), own, capacity)
    return full + [[rest[i] for i in b] for b in bins]


def _block_packer(round_: int, capacity: int):
    def one(key, frame):
        frame = frame.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = frame["length"].tolist()
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for s, b in enumerate(pack(lengths, capacity)):
            at = 0
            for i in b:
                sequence[i], offset[i] = (round_ << 56) | (int(key[0]) << 24) | s, at
                at += lengths[i]
            fill[b] = at
        return frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset, fill=fill)

    return one


def packed(rows: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``rows`` (PIECES, staged) with sequence_id, offset and fill."""
    done: list[DataFrame] = []
    bins_before = None
    for round_ in itertools.count():
        n = rows.count()
        blocks = max(1, math.ceil(n / block_pieces))
        # ids by file and place, so that equal rows are dealt apart
        dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(round_)), F.lit(blocks)).cast("int"))
        # ranges of whole numbers, so that each block is a task of its own
        dealt = dealt.repartitionByRange(blocks, "block") if blocks > 1 else dealt
        out = staged(dealt.groupBy("block").applyInPandas(_block_packer(round_, capacity), PACKED), f"packing-{round_}")
        if blocks == 1:
            done.append(out)
            break
        under = F.col("fill") < UNDERFULL * capacity
        left = out.where(under).agg(F.count("*").alias("rows"), F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("bins")).first()
        # the last number that a sequence id has room for is a whole round too: nothing is left over
        if not left["rows"] or (bins_before is not None and left["bins"] > 0.9 * bins_before) or round_ == LAST_ROUND:
            done.append(out)
            break
        bins_before = left["bins"]
        done.append(out.where(~under))
        rows = out.where(under).drop("sequence_id", "offset", "fill")
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    rows = staged(pieces(table(spark, sf_dir, "documents")), "packing-pieces")
    return packed(rows).drop("fill")

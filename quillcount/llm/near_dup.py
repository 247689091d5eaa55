"""MinHash near-dedup with sequential Bayesian verification.

Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct
five-word shingles (all words as one shingle if there are fewer). Documents are
linked if their sets' Jaccard similarity is at least 0.75, and a group of
linked documents keeps the one with the least id.

1. Documents with equal sets form a class, which stands for them from here on.
2. Classes whose minhash signatures agree in a whole band are candidates:
   ``BANDS`` bands of ``BAND_ROWS`` miss a pair of similarity 0.75 with a
   probability of about 5 in a million.
3. In each band's bucket, every class is first compared with the one of least
   id only. Signatures are compared in batches of ``BATCH_HASHES``; a pair is
   dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below ``MISS``. Survivors are verified
   on their full shingle sets.
4. Where a bucket then still holds classes of different components, its pairs
   across components are compared, in blocks of bounded rows and bytes that are
   dealt to many tasks, with the same pruning, each pair in the first band that
   it shares. A task verifies plausible pairs in order of their estimated
   similarity and passes over those that its own links have connected meanwhile,
   so it emits fewer links than it has classes. Every candidate pair is thus
   refuted, linked or connected, and no set of all pairs of a group is ever made.

Candidates grow with the corpus, so their texts and sets meet by sorted joins at
every size and are never broadcast.

Defined results: null or empty texts have an empty set and link with nothing;
very long texts have all their shingles; of equal sets the least id stands for
all; rows that share a doc_id count as one document (linked); a null doc_id gets a
null component and is kept; an empty table gives an empty table; other columns
are carried along.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import configured, discard, shuffle_partitions, staged, table
from .graph import connected_components

SHINGLE_WORDS = 5
#: Similarity from which documents are linked, in per cent.
THRESHOLD = 75
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
BATCH_HASHES = 32
#: Posterior probability of reaching the threshold below which a pair is dropped.
MISS = 1e-6
#: Classes of a bucket, and bytes of their shingle sets, that one task compares with as many others at a time.
BLOCK, BLOCK_BYTES = 2048, 32 << 20

_RNG = np.random.default_rng(75)
_FACTOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def shingles(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(tb.gram_hashes(words, min(k, len(words))))


def signature(kinds: np.ndarray) -> np.ndarray:
    """Minhash values of a shingle set, as uint32."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(kinds), 2048):
        part = kinds[at : at + 2048]
        values = part[None, :] * _FACTOR[:, None] + _SHIFT[:, None]
        values ^= values >> np.uint64(32)
        least = np.minimum(least, (values * np.uint64(0x9FB21C651E98DF25)).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


@lru_cache(maxsize=4)
def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches below which a pair is dropped) after each batch."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(BATCH_HASHES, HASHES + 1, BATCH_HASHES):
        for m in range(n + 1):
            density = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(density - density.max())
            if density[grid >= threshold].sum() / density.sum() >= miss:
                out.append((n, m))
                break
    return out


def plausible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential comparison."""
    alive, matches, before = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in least_matches():
        matches[alive] += (a[alive, before:n] == b[alive, before:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        before = n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def sets(docs: DataFrame, k: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, sig) of every document; s1 and s2 digest the set."""
    configured(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for _, n, w in tb.chunks(batch.column(1), lower=True):
                for i in range(n):
                    kinds = shingles(w.hash[w.first[i] : w.first[i + 1]], k)
                    out[0].append(len(kinds))
                    out[1].append(int(tb.mix64(kinds).sum().view(np.int64)) if len(kinds) else 0)
                    out[2].append(int(tb.mix64(kinds ^ np.uint64(0x5555555555555555)).sum().view(np.int64)) if len(kinds) else 0)
                    out[3].append(signature(kinds).tobytes() if len(kinds) else None)
            kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds_of, strict=True)]], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _bands(batches):
    for batch in batches:
        sig = _matrix(batch.column(1)).astype(np.uint64)
        ids = batch.column(0).to_numpy()
        keys = np.empty((len(sig), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(sig), b + 1, np.uint64)
            for r in range(b * BAND_ROWS, (b + 1) * BAND_ROWS):
                key = tb.mix64(key * np.uint64(0x9FB21C651E98DF25) + sig[:, r])
            keys[:, b] = key
        sizes = batch.column(2).to_numpy()
        columns = (keys.ravel().view(np.int64), np.repeat(ids, BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(ids)), np.repeat(sizes, BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "cid", "no", "n_shingles"])


def _plausible_pairs(batches):
    for batch in batches:
        a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(plausible(a, b)))


def linked_sets(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted shingle sets reach the threshold, on the full sets."""
    if not len(x) or 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def _block_links(batches, threshold: int):
    """Verified links across components within groups that come sorted by (band, i, j)."""

    def settle(rows):
        if len(rows) < 2:
            return
        (_, i, j) = rows[0][0]
        ids, no, comp, part = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint32).reshape(len(rows), HASHES)
        kinds = [np.frombuffer(r[6], np.uint64) for r in rows]
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found = []
        for u in left.tolist():
            q = right[comp[right] != comp[u]]
            if i == j:
                q = q[ids[q] > ids[u]]
            p = np.full(len(q), u)
            keep = plausible(sig[p], sig[q])
            p, q = p[keep], q[keep]
            alike = sig[p] == sig[q]
            # a pair that shares an earlier band is compared there
            first = alike.reshape(len(p), BANDS, BAND_ROWS).all(axis=2).argmax(axis=1) == no[0]
            if first.any():
                found.append((p[first], q[first], alike[first].sum(axis=1)))
        if not found:
            return
        p, q, alike = (np.concatenate(c) for c in zip(*found, strict=True))
        root: dict = {}

        def top(c):
            while c in root:
                c = root[c]
            return c

        out = []
        for k in np.argsort(-alike, kind="stable").tolist():
            u, v = int(p[k]), int(q[k])
            a, b = top(int(comp[u])), top(int(comp[v]))
            if a != b and linked_sets(kinds[u], kinds[v], threshold):
                root[max(a, b)] = min(a, b)
                out.append(sorted((int(ids[u]), int(ids[v]))))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held = []
    for batch in batches:
        for band, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != (band, i, j):
                yield from settle(held)
                held = []
            held.append(((band, i, j), *row))
    yield from settle(held)


def _full_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, kinds): the shingle sets of the documents ``ids`` (cid)."""

    def run(batches):
        for batch in batches:
            out = []
            for _, n, w in tb.chunks(batch.column(1), lower=True):
                out += [shingles(w.hash[w.first[i] : w.first[i + 1]]).tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["cid", "kinds"])

    chosen = texts.join(ids.withColumnRenamed("cid", "doc_id").hint("merge"), "doc_id").select(F.col("doc_id").alias("cid"), "text")
    return staged(chosen.mapInArrow(run, "cid long, kinds binary"), "near-sets")


def _verified(own: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets, of ``own`` (cid, kinds), reach the threshold."""
    of = lambda c: own.select(F.col("cid").alias(c), F.col("kinds").alias(f"k{c}")).hint("merge")
    rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ka", "kb")

    def check(batches):
        for batch in batches:
            keep = [linked_sets(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return staged(rows.mapInArrow(check, "a long, b long").distinct(), "near-links")


def near_groups(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    spark = configured(docs.sparkSession)
    own = staged(sets(docs), "near-signatures")
    digest = ["n_shingles", "s1", "s2"]
    filled = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = staged(filled.groupBy(*digest).agg(F.min("doc_id").alias("cid")), "near-classes")
    with_sig = filled.select(*digest, F.col("doc_id").alias("cid"), "sig").join(classes, [*digest, "cid"])
    with_sig = staged(with_sig.select("cid", "sig", "n_shingles").dropDuplicates(["cid", "sig"]), "near-class-signatures")
    bands = staged(with_sig.mapInArrow(_bands, "band long, cid long, no int, n_shingles long"), "near-bands")
    buckets = bands.groupBy("band").agg(F.min("cid").alias("rep"), F.count("*").alias("size"), (8 * F.sum("n_shingles")).alias("bytes"))
    buckets = staged(buckets.where("size > 1"), "near-buckets")
    members = staged(bands.join(buckets, "band"), "near-members")
    discard(bands, buckets)

    # a pair is compared first with the member of least id of its bucket
    pairs = members.where("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct()
    signed = pairs.join(with_sig.select(F.col("cid").alias("a"), F.col("sig").alias("sa")), "a").join(with_sig.select(F.col("cid").alias("b"), F.col("sig").alias("sb")), "b")
    stars = staged(signed.select("a", "b", "sa", "sb").mapInArrow(_plausible_pairs, "a long, b long").distinct(), "near-stars")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    full = _full_sets(texts, members.select("cid").distinct())
    links = _verified(full, stars, threshold)
    groups = connected_components(links)

    # buckets in which classes of different components are left that were not compared
    split = members.where("size > 2").join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    split = staged(split, "near-split")
    apart = split.where("cid <> rep").groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    # the least member has been compared with all others already
    left = split.where("cid <> rep").join(staged(apart, "near-apart"), "band").join(with_sig.select("cid", "sig"), "cid").join(full.hint("merge"), "cid")
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    left = left.withColumn("part", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    left = left.select("band", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cid", "no", "component", "part", "sig", "kinds")
    dealt = left.repartition(shuffle_partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j")
    more = staged(dealt.mapInArrow(lambda x: _block_links(x, threshold), "a long, b long").distinct(), "near-more-links")
    if not more.isEmpty():
        groups = connected_components(links.unionByName(more))
    of_class = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").select(*digest, F.coalesce("component", "cid").alias("component"))
    of_class = staged(of_class, "near-components")
    discard(classes, with_sig, members, stars, full, links, split, more)
    found = own.select("doc_id", *digest).join(of_class, digest, "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their group; of rows that share a kept id, all stay."""
    groups = near_groups(docs)
    gone = staged(groups.where("doc_id <> component_id").select("doc_id").distinct(), "near-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


OP2_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, s, s + 4), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
often AS (SELECT h FROM shingles GROUP BY h HAVING count(*) > 1),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM (shingles JOIN often USING (h)) x JOIN (shingles JOIN often USING (h)) y ON x.h = y.h AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reach r ON r.doc_id = d.doc_id
GROUP BY d.doc_id, n
"""

"""Embedding near-dedup by collision-counting projections.

Vectors of one label are linked if their cosine, in double precision, is at
least 0.93. Unit vectors are projected on random directions and sorted along
each; two vectors collide in a projection if the one's value lies in the window
centred on the other's. A pair at the threshold differs by a normal value of
known spread in every projection, so the chance of a collision, and from it the
least count of collisions that misses such a pair with probability ``MISS`` at
most, are known: the count is calibrated to recall. Pairs that reach it are
verified by their cosine.

Counting within a whole label would touch a share of all its pairs, so the same
windows first narrow it: a label of n vectors is halved at the medians of its
first log2(n / ``CELL``) projections. A vector's home is the cell where it lies;
it also visits the cells that its window, ``REACH`` spreads to each side,
touches. Of a pair in different cells, one of the two visits the other's home
unless they lie more than the window apart, which a pair at the threshold does
with a probability below 0.2 % a projection. A vector visits about 1.3 cells to
a halving, so comparisons grow with about the power 1.4 of a label's vectors.

A cell with more than ``BLOCK`` vectors (many near copies may lie in one) is
dealt to blocks, and each pair of blocks is compared by one task. A task emits
for each vector its number of links and one link into its local group: never
all pairs. Equal vectors of a label form a class that is compared once.

Defined results: vectors that are null, zero, empty or hold null or non-finite
components, or whose label is null, link with nothing; vectors of different
lengths are never linked; rows that share a vec_id count as one node with
several vectors; repeated rows link with each other; a null vec_id has a null
component and is kept; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configured, discard, shuffle_partitions, staged, table
from .graph import connected_components

LEAST_COSINE = 0.93
#: Projections on which collisions are counted, and those after which hopeless pairs are dropped.
PROJECTIONS, FIRST = 32, 8
#: Half width of a window in spreads of a pair at the threshold: for counting, and for visiting cells.
WINDOW, REACH = 2.0, 1.1
#: Probability of missing a pair at the threshold by its count.
MISS = 0.002
#: Vectors of a cell to aim at, halvings at most, and vectors of a cell that one task compares with as many others.
CELL, HALVINGS, BLOCK = 1024, 20, 4096
#: Queries whose collisions are counted at once.
QUERIES = 512


@lru_cache(maxsize=8)
def directions(length: int) -> np.ndarray:
    """Random directions: ``HALVINGS`` for cells, then ``PROJECTIONS`` for counting."""
    return np.random.default_rng([93, length]).standard_normal((length, HALVINGS + PROJECTIONS))


@lru_cache(maxsize=8)
def least_count(n: int, miss: float = MISS) -> int:
    """Largest count that a pair at the threshold reaches in n projections with probability 1 - miss."""
    p = math.erf(WINDOW / math.sqrt(2))
    below, k = 0.0, 0
    while True:
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > miss:
            return k
        k += 1


def spread(cosine: float) -> float:
    """Standard deviation of a projection's difference for unit vectors of that cosine."""
    return math.sqrt(2 - 2 * cosine)


def _unit(column) -> np.ndarray:
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 1))
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def collisions(queries: np.ndarray, values: np.ndarray, width: float) -> np.ndarray:
    """How often each value (columns) lies in the window centred on each query (rows), over all
    projections: every projection is sorted once and each window found by bisection."""
    count = np.zeros((len(queries), len(values)), np.int8)
    for k in range(values.shape[1]):
        order = np.argsort(values[:, k], kind="stable")
        along = values[order, k]
        first = np.searchsorted(along, queries[:, k] - width, "left")
        last = np.searchsorted(along, queries[:, k] + width, "right")
        for row, lo, hi in zip(count, first.tolist(), last.tolist(), strict=True):
            row[order[lo:hi]] += 1
    return count


def compared(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) of the unit vectors that reach the cosine."""
    width = np.float32(WINDOW * spread(cosine))
    pa_, pb = ((x @ directions(x.shape[1])[:, HALVINGS:]).astype(np.float32) for x in (a, b))
    rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(a) if len(b) else 0, QUERIES):
        count = collisions(pa_[at : at + QUERIES, :FIRST], pb[:, :FIRST], width)
        i, j = np.nonzero(count >= least_count(FIRST, MISS / 4))
        n = count[i, j].astype(np.int16)
        i += at
        # the windows of the other projections are looked up for the pairs that are left
        for k in range(FIRST, PROJECTIONS):
            n += np.abs(pa_[i, k] - pb[j, k]) <= width
        keep = n >= least_count(PROJECTIONS)
        i, j = i[keep], j[keep]
        exact = np.einsum("ij,ij->i", a[i], b[j]) >= cosine
        rows.append(i[exact])
        columns.append(j[exact])
    return np.concatenate(rows), np.concatenate(columns)


def local_groups(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n nodes, the least node of each one's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _halvings(batches):
    """Values of every vector in the projections that may halve its label."""
    for batch in batches:
        lengths = batch.column(4).to_numpy()
        values = np.zeros((len(lengths), HALVINGS), np.float32)
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            values[at] = _unit(batch.column(3).take(pa.array(at))) @ directions(int(length))[:, :HALVINGS]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, HALVINGS, dtype=np.int32)), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "along"])


def _visits(batches, names: list[str], cosine: float):
    """A row per cell that a vector lies in or visits; the columns ``names`` and home, near, cell."""
    reach = np.float32(REACH * spread(cosine))
    for batch in batches:
        columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        values = columns["along"].flatten().to_numpy().reshape(len(batch), HALVINGS)
        medians = columns["medians"].flatten().to_numpy().reshape(len(batch), HALVINGS)
        bits = np.int64(1) << np.arange(HALVINGS, dtype=np.int64)
        bits = np.where(np.arange(HALVINGS)[None, :] < columns["halvings"].to_numpy()[:, None], bits[None, :], 0)
        home = (bits * (values > medians)).sum(axis=1)
        near = (bits * (np.abs(values - medians) <= reach)).sum(axis=1)
        rows, cells = np.arange(len(home)), home.copy()
        for k in range(HALVINGS):
            more = np.flatnonzero(near[rows] >> k & 1)
            rows, cells = np.concatenate((rows, rows[more])), np.concatenate((cells, cells[more] ^ (1 << k)))
        for at in range(0, len(rows), 8_192):
            some, of = pa.array(rows[at : at + 8_192]), cells[at : at + 8_192]
            yield pa.RecordBatch.from_arrays([*[columns[n].take(some) for n in names], *[pa.array(x) for x in (home[rows[at : at + 8_192]], near[rows[at : at + 8_192]], of)]], names=[*names, "home", "near", "cell"])


def _compare_blocks(batches, cosine: float):
    """Link counts and local links of groups (g, length, cell, b1, b2) that come sorted."""
    kinds = (pa.int64(), pa.int64(), pa.int64())

    def pairs(left, right, cell, home, near, unit):
        """Links of visitors ``left`` (or of the cell's own vectors) with own vectors ``right``."""
        i, j = compared(unit[left], unit[right], cosine)
        i, j = left[i], right[j]
        # where each visits the other's home, the pair counts in the cell of the lower number
        apart = home[i] ^ cell
        mutual = (apart != 0) & (apart & ~near[j] == 0)
        keep = ~mutual | (cell < home[i])
        return i[keep], j[keep]

    def settle(rows):
        ids, mult, home, near, block = (np.concatenate([r[k] for r in rows]) for k in range(5))
        unit = np.concatenate([r[5] for r in rows])
        cell, b1, b2 = rows[0][6]
        own = home == cell
        at = lambda b, mine: np.flatnonzero((block == b) & (own == mine))
        if b1 == b2:
            i, j = pairs(at(b1, True), at(b1, True), cell, home, near, unit)
            found = [(i[i < j], j[i < j]), pairs(at(b1, False), at(b1, True), cell, home, near, unit)]
        else:
            found = [pairs(at(x, mine), at(y, True), cell, home, near, unit) for x, y, mine in ((b1, b2, True), (b1, b2, False), (b2, b1, False))]
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        if not len(i):
            return None
        n = np.bincount(i, weights=mult[j], minlength=len(ids)) + np.bincount(j, weights=mult[i], minlength=len(ids))
        order = np.argsort(ids, kind="stable")  # so that roots are least ids
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = local_groups(len(ids), place[i], place[j])
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids[at], n[at].astype(np.int64), ids[order][root[place[at]]]), kinds, strict=True)], names=["cid", "n", "root"])

    held, key = [], None
    for batch in batches:
        names = batch.schema.names
        group = np.column_stack([batch.column(names.index(c)).to_numpy() for c in ("g", "length", "cell", "b1", "b2")])
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(group)], strict=True):
            if lo == hi:
                continue
            own = tuple(group[lo])
            if own != key:
                if held and (out := settle(held)) is not None:
                    yield out
                held, key = [], own
            part = batch.slice(lo, hi - lo)
            values = [part.column(names.index(c)).to_numpy() for c in ("cid", "mult", "home", "near", "block")]
            held.append((*values, _unit(part.column(names.index("embedding"))), own[2:]))
    if held and (out := settle(held)) is not None:
        yield out


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes of equal vectors with their number, one vector of each) of ``rows`` that can link."""
    key = ["g", "length", "d1", "d2"]
    able = rows.where("able")
    counts = staged(able.groupBy(*key).agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult")), "vector-classes")
    one = able.join(counts.where("cid IS NOT NULL"), key).where("vec_id = cid")
    return counts, one.select("cid", "g", "mult", "embedding", "length").dropDuplicates(["cid", "g", "length", "embedding"])


def visited_cells(vectors: DataFrame, cosine: float) -> DataFrame:
    """(cid, g, mult, embedding, length, home, near, cell): every vector in each cell that it lies in or visits."""
    kind = dict(vectors.dtypes)["embedding"]
    names = ["cid", "g", "mult", "embedding", "length"]
    schema = f"cid long, g long, mult long, embedding {kind}, length long"
    placed = staged(vectors.select(*names).mapInArrow(_halvings, f"{schema}, along array<float>"), "vector-projections")
    medians = F.array(*[F.percentile_approx(F.col("along")[k], 0.5, 1_000).cast("float") for k in range(HALVINGS)])
    halvings = F.least(F.greatest(F.ceil(F.log2(F.count("*") / F.lit(float(CELL)))), F.lit(0)), F.lit(HALVINGS)).cast("int")
    labels = staged(placed.groupBy("g", "length").agg(medians.alias("medians"), halvings.alias("halvings")), "vector-labels")
    rows = placed.join(labels, ["g", "length"]).select(*names, "along", "medians", "halvings")
    out = staged(rows.mapInArrow(lambda b: _visits(b, names, cosine), f"{schema}, home long, near long, cell long"), "vector-cells")
    discard(placed, labels)
    return out


def linked(vectors: DataFrame, cosine: float = LEAST_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of ``vectors`` (vec_id, embedding, label)."""
    spark = configured(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("g"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    able = F.col("g").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    digest = [F.xxhash64("embedding"), F.xxhash64(F.lit(11), "embedding")]
    rows = rows.withColumns({"able": able, "d1": digest[0], "d2": digest[1], "length": F.coalesce(F.size("embedding"), F.lit(0)).cast("long")})
    key = ["g", "length", "d1", "d2"]
    counts, one = classes_of(rows)
    cells = visited_cells(one, cosine)
    sizes = cells.groupBy("g", "length", "cell").agg(F.count("*").alias("size"))
    blocks = staged(sizes.select("g", "length", "cell", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks")), "vector-blocks")
    placed = cells.join(blocks, ["g", "length", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = placed.select("g", "length", "cell", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "cid", "mult", "home", "near", "block", "embedding")
    group = ["g", "length", "cell", "b1", "b2"]
    dealt = dealt.repartition(shuffle_partitions(spark), *group).sortWithinPartitions(*group)
    found = staged(dealt.mapInArrow(lambda x: _compare_blocks(x, cosine), "cid long, n long, root long"), "vector-links")
    discard(cells)
    groups = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    classes = counts.join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
    classes = staged(classes.select(*key, (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("component")), "vector-components")
    discard(counts, blocks, found)
    # rows that take part find their class; others link with nothing
    out = rows.where("able").select("vec_id", *key).join(classes, key, "left").select("vec_id", "n", "component")
    out = out.unionByName(rows.where(~F.col("able")).select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))


def op10_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_aggregate(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END), 'sum') = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)::DOUBLE), 'sum') > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93::DOUBLE),
reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.root < l.b),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, min(root) AS component_id, e.vec_id = min(root) AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id JOIN reach r ON r.vec_id = e.vec_id
GROUP BY e.vec_id, n
"""

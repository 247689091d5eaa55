"""Running sums within keys of any size, in two levels.

Rows are dealt by ranges of (key, order), so a large key lies in many tasks.
What comes before a row is the sum of the ranges before its own, of which a key
has as many as tasks, and a running sum within the range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import staged


def ranged(rows: DataFrame, key: list[str], order: list[str], name: str = "_range") -> DataFrame:
    """``rows`` with the number of their range; written, so that all who read them see the same ranges."""
    dealt = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    return staged(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def same(left: list[Column], right: list[Column]) -> Column:
    """Equality of keys that may be null."""
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def with_before(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column], name: str = "_range") -> DataFrame:
    """``ranged`` rows with, for each of ``sums``, the total over all rows of the key that come earlier in order.

    Equal orders are taken one after the other, as a sort leaves them.
    """
    totals = rows.groupBy(*key, name).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_{s}") for s, c in sums.items()])
    earlier = Window.partitionBy(*key).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(name).alias("_k"), *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}") for s in sums])
    within = Window.partitionBy(*key, name).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({s: F.coalesce(F.sum(c).over(within), F.lit(0)) for s, c in sums.items()})
    joined = own.join(totals, same([*[F.col(k) for k in key], F.col(name)], [*[F.col(f"_k{i}") for i in range(len(key))], F.col("_k")]))
    return joined.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in sums else c for c in own.columns])

"""Exact quantiles by radix selection: partial histograms of the digits of sortable numbers.

A double becomes a long in the same order. Four passes count 16 bits each: the
first counts leading digits per key, every later one only the values that share
the digits found so far for one of the asked places. A histogram has at most
65,536 entries for each key and place, is counted in part before it is
shuffled, and serves all quantiles of its column, so nothing is ever sorted and
no group of values comes together. Rows are read four times, however many keys,
columns and quantiles there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MANTISSA, _LEAST = 52, -1022
_DIGIT = 16


def _power(e: Column) -> Column:
    return F.pow(F.lit(2.0), e.cast("double"))


def sortable(value: Column) -> Column:
    """A long in the order of a double: infinities at the ends, NaN last, both zeros equal."""
    x = F.abs(value.cast("double"))
    guess = F.greatest(F.lit(_LEAST), F.least(F.lit(1023), F.floor(F.log2(x)).cast("int")))
    # the logarithm may be off by one beside a power of two
    e = F.when(_power(guess) > x, guess - 1).when(_power(guess + 1) <= x, guess + 1).otherwise(guess)
    e = F.greatest(F.lit(_LEAST), F.least(F.lit(1023), e))
    one = F.lit(1 << _MANTISSA).cast("long")
    bits = (e.cast("long") - _LEAST) * one + (x / _power(e) * F.lit(float(1 << _MANTISSA))).cast("long")
    end = F.lit(2047).cast("long") * one
    size = F.when(x == 0, F.lit(0).cast("long")).when(F.isnan(x), end + 1).when(x == F.lit(float("inf")), end).otherwise(bits)
    return F.when((value < 0) & ~F.isnan(x), -size).otherwise(size)


def double_of(bits: Column) -> Column:
    """The double of a ``sortable`` long."""
    one = F.lit(1 << _MANTISSA).cast("long")
    size = F.abs(bits)
    e, rest = F.call_function("div", size, one), (size % one).cast("double")
    x = F.when(e == 0, rest * _power(F.lit(_LEAST - _MANTISSA))).when(e < 2047, (rest / F.lit(float(1 << _MANTISSA)) + 1) * _power(e + _LEAST - 1))
    x = F.coalesce(x, F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return F.when(bits < 0, -x).otherwise(x)


def _found(own: Column, target: Column) -> Column:
    """A target (name, prefix, place) after its next digit, from the sorted histogram of (v, n) that its place lies in."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"), F.lit(0).cast("long").alias("before"))
    there = F.aggregate(
        own, start,
        lambda s, h: F.struct(
            (s["seen"] + h["n"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + h["n"] >= target["place"]), h["v"]).otherwise(s["v"]).alias("v"),
            F.when(s["v"].isNull() & (s["seen"] + h["n"] >= target["place"]), s["seen"]).otherwise(s["before"]).alias("before"),
        ).cast("struct<seen:bigint,v:bigint,before:bigint>"),
    )
    return F.transform(F.array(there), lambda t: F.struct(target["name"].alias("name"), t["v"].alias("prefix"), (target["place"] - t["before"]).alias("place")))[0]


def nearest_ranks(rows: DataFrame, key: list[str], asked: dict[str, tuple[str, float]], ready: bool = False) -> DataFrame:
    """Per key, a column for each ``asked`` name: of its column the value at place ceil(q n), exactly.

    Null values do not count; a key without values has no row, one without
    values of one of the columns a null there. Keys may be null. Without a key
    there is one row. ``rows`` is read four times: stage it if it is costly.
    Columns that are ``ready`` are ``sortable`` longs already.
    """
    columns = list(dict.fromkeys(c for c, _ in asked.values()))
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)] or [F.lit(0).alias("k0")]
    names = [f"k{i}" for i in range(len(own))] + ["c"]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), (F.col(c) if ready else sortable(F.col(c))).alias("v")) for i, c in enumerate(columns)]))
    values = rows.select(*own, each.alias("x")).select(*names[:-1], "x.c", "x.v").where("v IS NOT NULL")

    def wanted(total: Column) -> Column:
        """The targets of a column with ``total`` values, before any digit."""
        place = lambda q: F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(q) * total))
        cases = F.array(*[F.struct(F.lit(columns.index(c)).alias("c"), F.lit(n).alias("name"), place(q).alias("place")) for n, (c, q) in asked.items()])
        return F.filter(cases, lambda t: t["c"] == F.col("c"))

    targets = None
    for shift in range(64 - _DIGIT, -1, -_DIGIT):
        digit = F.shiftright("v", shift)
        if targets is None:
            counts = values.groupBy(*names, digit.alias("v")).agg(F.count("*").alias("n"))
            first = counts.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"), F.sum("n").alias("total"))
            targets = first.select(*names, F.transform(wanted(F.col("total")), lambda t: _found(F.col("h"), t)).alias("t"))
        else:
            known = targets.select(*[F.col(n).alias(f"_{n}") for n in names], "t")
            same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
            near = values.join(known, same).where(F.exists("t", lambda t: t["prefix"] == F.shiftright("v", shift + _DIGIT)))
            counts = near.groupBy(*names, "t", digit.alias("v")).agg(F.count("*").alias("n"))
            first = counts.groupBy(*names, "t").agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("h"))
            within = lambda t: F.filter("h", lambda h: F.shiftright(h["v"], _DIGIT) == t["prefix"])
            targets = first.select(*names, F.transform("t", lambda t: _found(within(t), t)).alias("t"))
    found = targets.select(*names[:-1], F.explode("t").alias("t")).select(*names[:-1], "t.name", double_of(F.col("t.prefix")).alias("x"))
    out = [F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in asked]
    if not key:
        return found.groupBy().agg(*out)
    return found.groupBy(*names[:-1]).agg(*out).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], *asked)

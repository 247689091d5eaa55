"""Pricing: tiered fixed-point costs of requests, scenarios and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import cost_micros, modality_tiers, tier_at
from .running import ranged, with_before


def scenario_names(outputs: int) -> list[str]:
    if outputs == 1:
        return ["expected"]
    return ["low", "expected", "high"] if outputs == 3 else [f"scenario-{k + 1}" for k in range(outputs)]


def scenarios(results: DataFrame, outputs: list[int], reasoning: int = 0) -> DataFrame:
    """A row per result and output scenario with four cost buckets and their total.

    ``results``: tiers, decision_tokens, cached_tokens, max_output and optionally
    component_input, component_cached (costs of requests with media).
    """
    names = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(n).alias("name"), F.lit(o).cast("long").alias("output")) for k, (n, o) in enumerate(zip(scenario_names(len(outputs)), outputs, strict=True))])
    rows = results.withColumn("s", F.explode(names))
    tier = tier_at(F.col("tiers"), F.col("decision_tokens"))
    cached = F.least(F.greatest(F.col("cached_tokens"), F.lit(0).cast("long")), F.col("decision_tokens"))
    zero = F.lit(reasoning).cast("long")
    rows = rows.withColumns({"tier": tier, "cached": cached})
    regular, from_cache = cost_micros(F.col("tier.input"), F.col("decision_tokens") - F.col("cached")), cost_micros(F.col("tier.cached"), F.col("cached"))
    if "component_input" in results.columns:
        regular, from_cache = F.coalesce("component_input", regular), F.coalesce("component_cached", from_cache)
    rows = rows.withColumns({
        "scenario": F.col("s.name"), "scenario_no": F.col("s.no"), "output_tokens": F.col("s.output"), "reasoning_tokens": zero, "input_micros": regular, "cached_micros": from_cache,
        "output_micros": cost_micros(F.col("tier.output"), F.col("s.output")), "reasoning_micros": cost_micros(F.col("tier.output"), zero),
        "over_output": F.greatest(F.lit(0).cast("long"), F.col("s.output") + zero - F.col("max_output")),
    })
    total = F.col("input_micros") + F.col("cached_micros") + F.col("output_micros") + F.col("reasoning_micros")
    return rows.withColumn("cost_micros", total).drop("s", "tier", "cached")


def priced_components(rows: DataFrame, key: list[str], order: list[str], tokens: str, cached: Column, total: Column, modality: str = "modality", large: bool = False) -> DataFrame:
    """Components with the cached share, in order, and both costs at their modality's tier.

    The cached tokens are used up greedily, which is a running sum: a
    component's share is what is left after all before it. Where requests may
    be ``large``, the sum is taken in two levels, so that one request is spread
    over tasks, and the columns tiers and modality_tiers are left out; otherwise
    a request is one group of a window.
    """
    rows = rows.withColumn("tier", tier_at(modality_tiers(F.col("tiers"), F.col("modality_tiers"), F.col(modality)), total))
    if large:
        # what is dealt is written, so the catalog's lists stay behind
        rows = with_before(ranged(rows.drop("tiers", "modality_tiers"), key, order), key, order, {"_before": F.col(tokens)})
        before = F.col("_before")
    else:
        before = F.coalesce(F.sum(tokens).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = rows.withColumn("cached_n", F.least(F.col(tokens), F.greatest(F.lit(0).cast("long"), cached - before)))
    return rows.withColumns({
        "input_micros": cost_micros(F.col("tier.input"), F.col(tokens) - F.col("cached_n")),
        "cached_micros": cost_micros(F.col("tier.cached"), F.col("cached_n")),
    }).drop("tier", "_before", "_range")


#: What components are made of.
MODALITIES = ("text", "image", "audio")


def with_rates(models: DataFrame) -> DataFrame:
    """Models with ``levels``, the token numbers from which any of their tiers hold, and the rates of each modality at each level."""
    lists = {m: modality_tiers(F.col("tiers"), F.col("modality_tiers"), F.lit(m)) for m in MODALITIES}
    levels = F.array_sort(F.array_distinct(F.transform(F.flatten(F.array("tiers", *lists.values())), lambda t: t["above"])))

    def at_levels(tiers: Column) -> Column:
        """The tier that holds at each level; null below the first one."""
        return F.transform("levels", lambda level: F.try_element_at(F.filter(tiers, lambda t: level >= t["above"]), F.lit(-1)))

    return models.withColumn("levels", levels).withColumns({f"{m}_rates": at_levels(tiers) for m, tiers in lists.items()})


def level_costs(rows: DataFrame, tokens: str, cached: Column, levels: int) -> DataFrame:
    """Components with both costs at each level of ``with_rates``, for the total that decides is known later: input_0, cached_0, input_1 and so on."""
    of = F.col("text_rates")
    for m in MODALITIES[1:]:
        of = F.when(F.col("modality") == m, F.col(f"{m}_rates")).otherwise(of)
    rows = rows.withColumns({"_of": of, "cached_n": cached})
    costs = {}
    for k in range(levels):
        rate = F.get("_of", F.lit(k))
        costs |= {f"input_{k}": cost_micros(rate["input"], F.col(tokens) - F.col("cached_n")), f"cached_{k}": cost_micros(rate["cached"], F.col("cached_n"))}
    return rows.withColumns(costs).drop("_of")


def at_level(costs: str, levels: int, total: Column) -> Column:
    """Of summed costs at each level, those at the last level that ``total`` reaches."""
    return F.get(F.array(*[F.col(f"{costs}_{k}") for k in range(levels)]), F.size(F.filter("levels", lambda level: total >= level)) - 1)


def exit_codes(results: DataFrame, key: list[str], max_tokens: int = 0, max_cost_micros: int = 0, fail_on_overflow: bool = False, require_complete: bool = False) -> DataFrame:
    """The first threshold that a request breaks: overflow 3, tokens 4, expected cost 5, incomplete 6, verification 7, else 0.

    ``results``: decision_tokens, context_window, expected_cost (null without a
    scenario named expected), incomplete, verify_failed.
    """
    code = exit_code(max_tokens, max_cost_micros, fail_on_overflow, require_complete)
    return results.groupBy(*key).agg(code.alias("exit_code"))


def exit_code(max_tokens: int = 0, max_cost_micros: int = 0, fail_on_overflow: bool = False, require_complete: bool = False) -> Column:
    """The aggregate of ``exit_codes``, for several thresholds in one pass."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return (
        F.when(F.lit(fail_on_overflow) & any_(F.col("decision_tokens") > F.col("context_window")), 3)
        .when(F.lit(max_tokens > 0) & any_(F.col("decision_tokens") > F.lit(max_tokens)), 4)
        .when(F.lit(max_cost_micros > 0) & any_(F.col("expected_cost") > F.lit(max_cost_micros)), 5)
        .when(F.lit(require_complete) & any_(F.col("incomplete")), 6)
        .when(any_(F.col("verify_failed")), 7)
        .otherwise(0)
    )
